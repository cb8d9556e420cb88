"""A small query language over the timeline: FIND, WHY, SHOW TIMELINE, SHOW CHANGES, each compiled to a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import fold, match_key
from memspark.operators.rationale import why
from memspark.operators.timeline import memory_diff


@dataclass(frozen=True)
class Query:
    verb: str
    argument: str | None = None
    days: int = 7


def parse_mql(text: str) -> Query | None:
    """The query that a text states, or None. Keywords are free of case, quotes optional around a decision."""
    text = " ".join(text.split())
    if re.fullmatch(r"(?i)find decisions where current ?= ?true", text):
        return Query("find")
    if m := re.fullmatch(r"""(?i)why decision ?= ?(["']?)(.+?)\1""", text):
        return Query("why", m.group(2))
    if m := re.fullmatch(r"""(?i)show timeline(?: for project ?= ?(["']?)(.+?)\1)?""", text):
        return Query("timeline", m.group(2))
    if m := re.fullmatch(r"(?i)show changes(?: last (\d+) days?)?", text):
        return Query("changes", days=int(m.group(1) or 7))
    return None


def run_mql(text: str, resolved: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """operation, title_key, answer. WHY answers from the rationale memory ``reasons`` where it is given, else from each event's own rationale. A timeline of a project
    that matches nothing is the whole timeline; unreadable text raises ValueError."""
    q = parse_mql(text)
    if q is None:
        raise ValueError(f"not a query: {text!r}")
    if q.verb == "find":
        rows = resolved.where("current").withColumn("answer", F.col("title"))
    elif q.verb == "why" and reasons is not None:
        rows = why(resolved, reasons, q.argument).withColumn("title_key", match_key("title"))
    elif q.verb == "why":
        rows = resolved.where(F.contains("title_key", match_key(F.lit(q.argument)))).withColumn("answer", F.coalesce("rationale", F.lit("no rationale recorded")))
    elif q.verb == "timeline":
        rows = resolved.withColumn("answer", F.concat_ws(" ", F.coalesce("valid_from", F.lit("?")), F.coalesce("status", F.lit("?"))))
        if q.argument:
            hit = F.coalesce(F.contains(fold("project"), fold(F.lit(q.argument))), F.lit(False))
            some = resolved.agg(F.coalesce(F.max(hit), F.lit(False)).alias("some"))
            rows = rows.withColumn("hit", hit).join(F.broadcast(some)).where("hit or not some")  # one row
    else:
        rows = memory_diff(resolved, q.days).withColumnRenamed("kind", "answer")
    return rows.select(F.lit(q.verb).alias("operation"), "title_key", "answer")
