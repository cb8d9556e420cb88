"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import strip_ws
from memspark.operators.work import Work


def hex_digits(c: Column | str) -> Column:
    """The hex digits of a hash in lower case, without the name of its algorithm or 0x before them; null if there are none."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    h = F.regexp_extract(F.regexp_replace(c, r"(?U)\s+", ""), r"^(?:[a-z]+[0-9-]*[:=]|0x)?([0-9a-f]+)$", 1)
    return F.when(h != "", h)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change (``added``, ``removed`` or ``changed``) between two full snapshots.

    Both sides are tagged, united and grouped by key in one aggregation; each side's row is reduced to a hash of ``values`` before the
    shuffle. Nulls count as values, in keys too. Of several rows of a key in a side the one with the least hash counts.
    """
    tag = lambda df, s: df.select(*keys, F.lit(s).alias("_side"), F.xxhash64(*[F.struct(F.col(v)) for v in values]).alias("_h"))
    both = tag(old, 0).unionByName(tag(new, 1)).groupBy(*keys).agg(*[F.min(F.when(F.col("_side") == s, F.col("_h"))).alias(f"_{s}") for s in (0, 1)])
    return both.select(*keys, _change(F.col("_0").isNotNull(), F.col("_1").isNotNull(), F.col("_0") != F.col("_1")).alias("change")).where("change is not null")


def _change(was: Column, now: Column, differs: Column) -> Column:
    return F.when(now & ~was, "added").when(was & ~now, "removed").when(was & now & differs, "changed")


def snapshot_series_diff(df: DataFrame, scope: list[str], number: str, item: str, digest: str, loaded: str, few: int = 200_000) -> DataFrame:
    """scope, the later snapshot's number, item and change for all consecutive snapshots of each scope.

    Snapshots are consecutive if no other with rows lies between. Of an item's rows in a snapshot the one loaded last counts (ties: the
    greatest hash, null least). A null hash is never a change; a later hash is compared with the last known since the item was
    last added. Rows with a null number or item are none; null scopes are a scope. Items are compared trimmed.

    All rows of an item go to one task in one shuffle, on (scope, item); reducing its rows, carrying hashes forward and grouping the two
    tagged sides by the later snapshot all reuse that partitioning. An item has as many rows as snapshots list it. The sequence of
    snapshots, one row for each, is written, counted, and broadcast up to ``few`` rows; beyond that it is repeated for each of 32 salts, so that a snapshot with
    most of all rows is many tasks' work.
    """
    work = Work(df.sparkSession, "snapshots")
    ks = [f"k{i}" for i in range(len(scope))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(scope, ks, strict=True)], F.col(number).cast("long").alias("no"), strip_ws(item).alias("item"), hex_digits(digest).alias("h"), F.col(loaded).alias("at")).where("no is not null and item is not null")
    listing = rows.groupBy(*ks, "no").count().drop("count")
    w = Window.partitionBy(*ks).orderBy("no")
    listing = work.cut(listing.select(*ks, "no", F.row_number().over(w).alias("idx"), F.lead("no").over(w).alias("next")), "listing")

    own = Window.partitionBy(*ks, "item").orderBy("no")
    on = [*[rows[k].eqNullSafe(F.col(f"l.{k}")) for k in ks], rows["no"] == F.col("l.no")]
    if listing.limit(few + 1).count() <= few:
        met = rows.join(F.broadcast(listing).alias("l"), on)
    else:
        salted = listing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31)))).alias("l")
        met = rows.join(salted, [*on, F.pmod(F.xxhash64("item"), F.lit(32)) == F.col("l.salt")])
    placed = met.select(*[rows[k] for k in ks], rows["no"], "item", "h", "at", "idx", "next")
    last = F.max_by(F.struct("h", "idx", "next"), F.struct("at", "h")).alias("r")
    once = placed.repartition(*ks, "item").groupBy(*ks, "item", "no").agg(last).select(*ks, "item", "no", "r.*")
    runs = once.withColumn("new_run", (F.col("idx") - F.coalesce(F.lag("idx").over(own), F.lit(-1)) > 1).cast("int")).withColumn("run", F.sum("new_run").over(own))
    known = runs.withColumn("h_known", F.last("h", ignorenulls=True).over(Window.partitionBy(*ks, "item", "run").orderBy("no")))
    sides = known.select(*ks, "item", F.explode(F.array(F.struct(F.col("no").alias("later"), F.lit(1).alias("side"), F.col("h").alias("h"), (F.col("idx") == 1).alias("first")), F.struct(F.col("next").alias("later"), F.lit(0).alias("side"), F.col("h_known").alias("h"), F.lit(False).alias("first")))).alias("s"))
    sides = sides.select(*ks, "item", "s.later", "s.side", "s.h", "s.first").where("later is not null and not first")
    pairs = sides.groupBy(*ks, "item", "later").agg(F.max("side").alias("now"), F.min("side").alias("was"), F.max(F.when(F.col("side") == 0, F.col("h"))).alias("old"), F.max(F.when(F.col("side") == 1, F.col("h"))).alias("new"))
    change = _change(F.col("was") == 0, F.col("now") == 1, F.col("old") != F.col("new"))
    return pairs.select(*[F.col(k).alias(c) for c, k in zip(scope, ks, strict=True)], F.col("later").alias(number), F.col("item").alias(item), change.alias("change")).where("change is not null")
