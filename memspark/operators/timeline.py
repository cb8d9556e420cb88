"""Decision timeline: merge of repeated extractions, supersession, filters and the diff of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import blank_to_null, fold, match_key

# Rank of a decision's status; of repeated extractions the highest counts.
STATUS_RANK = {"accepted": 4, "proposed": 3, "rejected": 2, "superseded": 1}


def status_rank(c: Column) -> Column:
    out = F.lit(0)
    for s, r in STATUS_RANK.items():
        out = F.when(c == s, r).otherwise(out)
    return out


def first_truthy(c: str, order: str) -> Column:
    """The value of the first row, by ``order``, in which it is neither null nor blank."""
    ok = blank_to_null(c).isNotNull()
    return F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col(order)))


def union_of(c: str) -> Column:
    """Sorted distinct union of arrays. Sets are collected, so copies of an array are dropped before the shuffle."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(c)))))


def merge_timeline(decisions: DataFrame, order: str = "ord") -> DataFrame:
    """One event for each title key: the status of highest rank (ties: the first row), first project and rationale that are not blank,
    least date, first end that is not blank (where there is a column valid_to), unions of sources and participants, greatest confidence. Rows without a title
    are dropped; ``order`` must be unique, of any type that sorts by arrival."""
    keyed = decisions.withColumn("title_key", match_key("title")).where("title_key is not null")
    ends = [first_truthy("valid_to", order).alias("valid_to")] if "valid_to" in decisions.columns else []
    return keyed.groupBy("title_key").agg(
        F.min_by("title", order).alias("title"),
        F.min_by("status", F.struct(-status_rank(F.col("status")), order)).alias("status"),
        first_truthy("project", order).alias("project"),
        first_truthy("rationale", order).alias("rationale"),
        F.min(blank_to_null("decision_date")).alias("valid_from"),
        union_of("source_ids").alias("source_ids"),
        union_of("participants").alias("participants"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"),
        F.min(order).alias("ord"),
        *ends,
    )


def supersession_edges(decisions: DataFrame) -> DataFrame:
    """source (superseding) and target title keys, distinct."""
    links = decisions.select(match_key("title").alias("source"), F.explode("supersedes").alias("t")).select("source", match_key("t").alias("target"))
    return links.where("source is not null and target is not null").distinct()


def resolve_supersession(timeline: DataFrame, edges: DataFrame) -> DataFrame:
    """The timeline with n_supersedes, n_superseded_by, valid_to (its own, else the least start of the superseding events) and current (accepted and not superseded).

    The superseding event's own status does not matter and supersession is not transitive; both ends of a cycle are not current.
    Edges are aggregated to one row for each event before they are joined.
    """
    starts = timeline.select(F.col("title_key").alias("source"), "valid_from")
    by = edges.join(starts, "source", "left").groupBy(F.col("target").alias("title_key")).agg(F.count("*").alias("n_superseded_by"), F.min("valid_from").alias("_end"))
    of = edges.groupBy(F.col("source").alias("title_key")).agg(F.count("*").alias("n_supersedes"))
    out = timeline.join(by, "title_key", "left").join(of, "title_key", "left").fillna(0, ["n_superseded_by", "n_supersedes"])
    out = out.withColumn("valid_to", F.coalesce("valid_to", "_end") if "valid_to" in timeline.columns else F.col("_end")).drop("_end")
    return out.withColumn("current", F.coalesce(F.col("status") == "accepted", F.lit(False)) & (F.col("n_superseded_by") == 0))


def with_links(resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """The timeline with ``supersedes`` and ``superseded_by``: sorted distinct title keys, empty where there are none. Edges are distinct, so a list
    is as long as the event has other ends."""
    none = F.array().cast("array<string>")
    of = edges.groupBy(F.col("source").alias("title_key")).agg(F.array_sort(F.collect_set("target")).alias("supersedes"))
    by = edges.groupBy(F.col("target").alias("title_key")).agg(F.array_sort(F.collect_set("source")).alias("superseded_by"))
    out = resolved.drop("supersedes", "superseded_by").join(of, "title_key", "left").join(by, "title_key", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("supersedes", "superseded_by")})


def in_order(resolved: DataFrame) -> DataFrame:
    """Events by start, those without one last, ties by arrival."""
    return resolved.orderBy(F.coalesce(blank_to_null("valid_from"), F.lit("9999-99-99")), "ord")


def current_titles(resolved: DataFrame) -> DataFrame:
    """The current decisions in order: title_key, title, valid_from, ord."""
    return in_order(decisions(resolved, current_only=True)).select("title_key", "title", "valid_from", "ord")


def decisions(resolved: DataFrame, project: str | None = None, current_only: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events of a project (case-folded part of its name), current ones only, between two dates, inclusive; undated events are in no window."""
    out = resolved
    if project is not None:
        out = out.where(F.contains(fold("project"), fold(F.lit(project))))
    if current_only:
        out = out.where("current")
    if since is not None:
        out = out.where(F.col("valid_from") >= since)
    return out if until is None else out.where(F.col("valid_from") <= until)


def memory_diff(resolved: DataFrame, days: int = 7) -> DataFrame:
    """kind, title_key: accepted events and superseding events within ``days`` of the newest date, and all superseded ones. The window ends at the newest date of
    the data, not today; without any readable date the result is empty."""
    day = F.try_to_date("valid_from", "yyyy-MM-dd")
    dated = resolved.withColumn("day", day)
    edge = dated.agg(F.max("day").alias("newest")).where("newest is not null")
    rows = dated.join(F.broadcast(edge))  # one row
    inside = F.col("day") >= F.date_sub("newest", days)
    kinds = F.array_compact(F.array(F.when(inside & (F.col("status") == "accepted"), "added"), F.when(inside & (F.col("n_supersedes") > 0), "superseding"), F.when(~F.col("current") & (F.col("n_superseded_by") > 0), "superseded")))
    return rows.select("title_key", F.explode(kinds).alias("kind"))
