"""Contract of a connector: diff of a listing against what is stored, its counts, and the log of sync runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.ids import row_id

STATES = ["new", "changed", "unchanged", "removed"]


def listing_diff(stored: DataFrame, fetched: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys, change (new, changed, unchanged or removed) of each item of two listings, in one aggregation: both sides are tagged, united and grouped. Of an item's
    repeated rows in a side the greatest digest counts; a null digest differs from any other."""
    tag = lambda df, s: df.select(*keys, F.lit(s).alias("_s"), F.col(digest).alias("_d"))
    sides = tag(stored, 0).unionByName(tag(fetched, 1)).groupBy(*keys).agg(*[x for s in (0, 1) for x in (F.count_if(F.col("_s") == s).alias(f"_n{s}"), F.max(F.when(F.col("_s") == s, F.col("_d"))).alias(f"_d{s}"))])
    change = F.when(F.col("_n0") == 0, "new").when(F.col("_n1") == 0, "removed").when(F.col("_d0").eqNullSafe(F.col("_d1")), "unchanged").otherwise("changed")
    return sides.select(*keys, change.alias("change"))


def diff_counts(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each kind of change, and how many were fetched; one row, or one for each group."""
    counts = [F.count_if(F.col("change") == s).alias(s) for s in STATES]
    return diff.groupBy(*(by or [])).agg(F.count_if(F.col("change") != "removed").alias("fetched"), *counts)


def sync_run(counts: DataFrame, connector: str, source: str, status: str, started_at: str, error: str | None = None) -> DataFrame:
    """One row of the sync log: id, connector, source, status, started_at, finished_at, error and the counts."""
    if status not in ("success", "failed"):
        raise ValueError(f"unknown status {status!r}")
    row = [F.lit(connector).alias("connector"), F.lit(source).alias("source"), F.lit(status).alias("status"), F.lit(started_at).cast("timestamp").alias("started_at"), F.current_timestamp().alias("finished_at"), F.lit(error).cast("string").alias("error")]
    return counts.select(row_id("sync", F.lit(connector), F.lit(source), F.lit(started_at)).alias("id"), *row, "fetched", *STATES)


def sync_history(log: DataFrame, connector: str | None = None, k: int = 20) -> DataFrame:
    """The last k runs, newest first, of one connector or all."""
    return (log if connector is None else log.where(F.col("connector") == connector)).orderBy(F.desc("started_at"), F.desc("id")).limit(k)
