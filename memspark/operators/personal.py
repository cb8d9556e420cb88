"""Personal memories: taken over from chunks, recalled by words, type, person and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import fold

# Kinds of memory, the kind of a source's chunks, keys of metadata that say when something happened.
KINDS = ["Project", "Idea", "Decision", "Task", "Person", "Meeting", "Document", "Email", "Action", "Preference", "Routine"]
KIND_OF_SOURCE = {"google_drive": "Document", "gmail": "Email", "google_calendar": "Meeting", "google_sheets": "Document", "jira": "Task", "github": "Document", "slack": "Decision"}
TIME_KEYS = ["occurred_at", "start", "date", "modified_at", "created_at"]


def memory_kind(source_type: Column, metadata: Column) -> Column:
    """The kind that the metadata ask for if there is such a kind, else that of the source, else Document."""
    asked = F.get_json_object(metadata, "$.memory_type")
    out = F.lit("Document")
    for s, k in KIND_OF_SOURCE.items():
        out = F.when(source_type == s, k).otherwise(out)
    return F.when(asked.isin(KINDS), asked).otherwise(out)


def simple_metadata(metadata: Column) -> Column:
    """map<string,string> of the metadata without nested objects; lists stay if they hold texts alone."""
    every = F.from_json(metadata, "map<string,string>")
    nested = lambda v: F.startswith(v, F.lit("{")) | (F.startswith(v, F.lit("[")) & F.rlike(v, F.lit(r"^\[\s*[^\s\"\]]")))
    return F.map_filter(every, lambda k, v: v.isNull() | ~nested(v))


def from_chunks(docs: DataFrame, stored: DataFrame | None = None, start: int = 0) -> DataFrame:
    """Memories of chunks whose source_id has none yet, numbered from ``start`` by arrival: id, type, title, content, tags, source, source_id, source_url, metadata, created_at.

    Of chunks with one source_id the first counts. Numbers are given within ranges of arrival and over the ranges' totals, so no task gets all rows.
    """
    first = docs.groupBy("source_id").agg(F.min_by(F.struct("ord", "content", "source_type", "metadata", "created_at"), "ord").alias("r")).select("source_id", "r.*")
    fresh = first if stored is None else first.join(stored.select("source_id").distinct(), "source_id", "left_anti")
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    tags = F.array_sort(F.array_distinct(F.filter(F.array(F.col("source_type"), get("google_service"), get("connector")), lambda t: t.isNotNull() & (t != ""))))
    rows = fresh.select(
        "ord", memory_kind(F.col("source_type"), F.col("metadata")).alias("type"), F.coalesce(F.when(get("title") != "", get("title")), F.col("source_id")).alias("title"), "content", tags.alias("tags"),
        F.coalesce(F.when(get("connector") != "", get("connector")), F.col("source_type")).alias("source"), "source_id", F.when(get("original_url") != "", get("original_url")).alias("source_url"), simple_metadata(F.col("metadata")).alias("metadata"), "created_at",
    )
    return numbered(rows, "ord", start).withColumn("id", F.format_string("personal_%06d", "n")).drop("n", "ord")


def numbered(rows: DataFrame, order: str, start: int = 0) -> DataFrame:
    """The rows with ``n``, their number by ``order`` from start + 1. Rows are spread over buckets that follow the order by a hash-free cut at sampled quantiles when
    the order is numeric, else at its leading characters."""
    kind = dict(rows.dtypes)[order]
    if kind in ("bigint", "int", "double"):
        cuts = rows.approxQuantile(order, [i / 64 for i in range(1, 64)], 0.005)
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    else:
        bucket = F.substring_index(F.col(order).cast("string"), "/", 2)
    placed = rows.withColumn("_b", bucket)
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_c"))
    before = sizes.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))  # one row for each bucket
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return placed.withColumn("_r", own).join(before, "_b").withColumn("n", (F.col("_before") + F.col("_r") + start).cast("long")).drop("_b", "_r", "_before")


def memory_time(df: DataFrame) -> Column:
    """When a memory happened: the first time that its metadata name, else created_at."""
    named = [F.try_to_timestamp(F.element_at("metadata", k)) for k in TIME_KEYS] if "metadata" in df.columns else []
    return F.coalesce(*named, F.col("created_at"))


def recall(memories: DataFrame, words: str, kind: str | None = None) -> DataFrame:
    """The memories that hold the words, case-folded, in title, content, a tag or their type; with ``kind`` those of one type alone."""
    part = fold(F.lit(words))
    tags = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(fold(t), part))
    hit = F.coalesce(F.contains(fold("title"), part), F.lit(False)) | F.coalesce(F.contains(fold("content"), part), F.lit(False)) | F.coalesce(tags, F.lit(False)) | F.coalesce(F.contains(fold("type"), part), F.lit(False))
    return memories.where(hit if kind is None else hit & (F.col("type") == kind))


def next_actions(memories: DataFrame) -> DataFrame:
    """Tasks, actions and whatever says next or priority."""
    said = F.contains(fold("content"), F.lit("next")) | F.contains(fold("content"), F.lit("priority"))
    return memories.where(F.coalesce(F.col("type").isin("Task", "Action"), F.lit(False)) | F.coalesce(said, F.lit(False)))


def between(memories: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """The memories with ``at``, when they happened, from ``since`` to ``until``, inclusive and both optional, newest first. Times are compared as instants; a
    bound that is no time raises an error."""
    out = memories.withColumn("at", memory_time(memories))
    if since is not None:
        out = out.where(F.col("at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("at") <= F.lit(until).cast("timestamp"))
    return out.orderBy(F.desc("at"), "id")


def recall_summary(memories: DataFrame) -> DataFrame:
    """n, confidence, depth, n_sources of what was recalled: one row."""
    n, kinds = F.count("*"), F.count_distinct("type")
    sure = F.when(n > 0, F.round(F.least(F.lit(0.95), 0.62 + 0.06 * F.least(n, F.lit(5))), 4)).otherwise(0.0)
    source = F.coalesce(F.when(F.col("source_id") != "", F.col("source_id")), F.when(F.col("source") != "", F.col("source")))
    return memories.agg(n.alias("n"), sure.alias("confidence"), F.greatest(F.lit(1), F.least(F.lit(4), kinds)).cast("long").alias("depth"), F.count(source).alias("n_sources"))
