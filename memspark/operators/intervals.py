"""Continuous periods and gaps of overlapping intervals by a sweep line.

Boundaries become +1 and -1 events and are summed by (key, boundary) before anything is shuffled whole, so a hot key costs as many
rows as it has distinct boundaries. The prefix sum and the pairing of starts with ends run in two levels: windows within blocks of
the boundary line, and one over the block totals; a key with any number of boundaries is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep_intervals(df: DataFrame, keys: list[str], start: str, end: str, block: Column | None = None) -> DataFrame:
    """keys, kind (``period`` or ``gap``), start, end for intervals [start, end).

    Intervals that overlap, nest or touch make one period; a gap runs from the end of a period to the start of the key's next. Rows
    with a null key, start or end, or an end not after the start, are no interval. Repeated rows change nothing. ``block`` must be
    a non-decreasing function of the column ``at`` (the boundary); by default, for dates, its year.
    """
    block = F.year("at") if block is None else block
    k = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*k, F.col(start).alias("s"), F.col(end).alias("e")).where(" and ".join(f"{c} is not null" for c in [*ks, "s", "e"]) + " and s < e")
    marks = rows.select(*ks, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    net = marks.groupBy(*ks, F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d")).where("d <> 0").withColumn("b", block)

    inner = Window.partitionBy(*ks, "b").orderBy("at")
    outer = Window.partitionBy(*ks).orderBy("b")
    totals = net.groupBy(*ks, "b").agg(F.sum("d").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    active = net.join(totals, [*ks, "b"]).withColumn("after", F.col("base") + F.sum("d").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    turns = active.where("after = 0 or after = d").select(*ks, "b", "at", F.when(F.col("after") == 0, "gap").otherwise("period").alias("kind"))
    # a period's end is the next turn in the block, or the first of the next block that has one
    firsts = turns.groupBy(*ks, "b").agg(F.min("at").alias("f")).withColumn("onward", F.lead("f").over(outer)).drop("f")
    paired = turns.join(firsts, [*ks, "b"]).withColumn("to", F.coalesce(F.lead("at").over(inner), F.col("onward")))
    return paired.where("to is not null").select(*[F.col(a).alias(b) for a, b in zip(ks, keys, strict=True)], "kind", F.col("at").alias("start"), F.col("to").alias("end"))


def calendar_day(c: Column | str) -> Column:
    """The day that a text names, as written: YYYY-MM-DD, YYYY/MM/DD, YYYY.MM.DD or YYYYMMDD, blanks around it and a time of day after
    it ignored. Null for anything else, and for days that don't exist."""
    c = F.col(c) if isinstance(c, str) else c
    found = lambda g: F.regexp_extract(c, r"(?U)^\s*(\d{4})([-/.]?)(\d{2})\2(\d{2})(?:[T\s].*)?$", g)
    return F.try_to_date(F.concat_ws("-", found(1), found(3), found(4)), "yyyy-MM-dd")
