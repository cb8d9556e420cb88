"""Raw chunks: identity, insert without repeats, active view, stale rows and rows by their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.ids import bronze_id, content_hash


def with_identity(docs: DataFrame, content: str = "content") -> DataFrame:
    return docs.withColumns({"id": bronze_id(F.col(content)), "content_hash": content_hash(F.col(content))})


def first_by_hash(docs: DataFrame, order: str = "ord", digest: str = "content_hash") -> DataFrame:
    """The first row of each content hash, whole. Rows are compared in a partial aggregate, so a hash with many copies costs one row a task; null hashes
    are dropped."""
    rest = [c for c in docs.columns if c != digest]
    return docs.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min_by(F.struct(*rest), order).alias("r")).select(digest, "r.*")


def put(stored: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """The incoming rows to append: first of their hash, and of no hash that is stored (the stored row keeps its source)."""
    return first_by_hash(incoming, order).join(stored.select("content_hash"), "content_hash", "left_anti")


def is_active(metadata: Column) -> Column:
    """Active unless the metadata say that it is not; absent, null or unreadable metadata count as active."""
    return F.coalesce(F.get_json_object(metadata, "$.active") != "false", F.lit(True))


def stale_ids(stored: DataFrame, roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, root_source_id of the stored rows of an incoming root whose content did not come again. Roots and hashes are distinct, and the roots are spread over salts, so that a
    root with a third of all rows is many tasks' work."""
    hit = roots.select("root_source_id").where("root_source_id is not null").distinct()
    same = fresh.select("content_hash").where("content_hash is not null").distinct()
    of_roots = spread_semi(stored.select("id", "root_source_id", "content_hash"), hit, "root_source_id", "id")
    return of_roots.join(same, "content_hash", "left_anti").select("id", "root_source_id").distinct()


def mark_stale(stored: DataFrame, roots: DataFrame, fresh: DataFrame, key: str = "ord") -> DataFrame:
    """The stored rows with ``active``: false for rows of an incoming root whose content did not come again, which also get ``superseded_at``, now. ``key`` is unique."""
    gone = stale_ids(stored.withColumn("id", F.col(key)), roots, fresh).select(F.col("id").alias(key)).withColumn("_gone", F.lit(True))
    out = stored.join(gone, key, "left")
    was = F.col("superseded_at") if "superseded_at" in stored.columns else F.lit(None).cast("timestamp")
    return out.withColumn("superseded_at", F.when(F.col("_gone") & F.col("active"), F.current_timestamp()).otherwise(was)).withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def spread_semi(rows: DataFrame, keys: DataFrame, key: str, salt: str, salts: int = 32) -> DataFrame:
    """The rows whose key is among ``keys`` (distinct). Keys are repeated for each salt, and a row meets them under the salt of its column ``salt``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    every = keys.select(key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(every, [key, "_salt"], "left_semi").drop("_salt")


def using_sources(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of which a source (source_ids) is among ``ids`` (id)."""
    hit = rows.select(F.col(key).alias("_r"), F.explode("source_ids").alias("id")).join(ids.select("id").distinct(), "id", "left_semi").select("_r").distinct()
    return rows.join(hit, rows[key] == hit["_r"], "left_semi")


def without_sources(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows without those sources: they are taken out of source_ids, and rows that have none left are dropped. Rows that had no source stay. ``key`` is unique."""
    refs = rows.select(F.col(key).alias("_r"), F.posexplode("source_ids").alias("_p", "id"))
    touched = refs.join(ids.select("id").distinct(), "id", "left_semi").select("_r").distinct()
    kept = refs.join(touched, "_r", "left_semi").join(ids.select("id").distinct(), "id", "left_anti").groupBy("_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "id"))), lambda x: x["id"]).alias("_s"))
    same = rows.join(touched, rows[key] == touched["_r"], "left_anti")
    return same.unionByName(rows.join(kept, rows[key] == kept["_r"]).withColumn("source_ids", F.col("_s")).drop("_r", "_s"))


def remove(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows but those with the ids."""
    return stored.join(ids.select("id").distinct(), "id", "left_anti")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last, ties by all of ``order``; a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
