"""Connected components of a graph of any size by alternating min-label steps, in DataFrames alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from memspark.operators.work import Work


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 500_000, crowd: int = 1_000_000) -> DataFrame:
    """node, component (the least node of its component) for each node of an edge. Edges with a null end are none; loops and repeats do no harm.

    Up to ``few`` distinct edges, counted as they are written, one task joins them by union-find. Beyond that each round every node hands the least of its neighbours (and
    itself) to all its larger neighbours (large star), then to its smaller ones (small star); rounds grow with the logarithm of the nodes. Minima are partial
    aggregates; a hub of more than ``crowd`` edges, of which there are few, has its minimum broadcast to them. Both ways give the same rows.
    """
    work = Work(edges.sparkSession, "components")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    counted = Observation()
    pairs.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct().observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(work.path("e0"))
    pairs = work.read(pairs, "e0")
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    if counted.get["n"] <= few:
        joined = pairs.coalesce(1).mapInPandas(_union_find, pairs.schema)
        return nodes.join(joined.withColumnRenamed("u", "node"), "node", "left").selectExpr("node", "coalesce(v, node) component")
    r, before = 0, None
    while True:
        both = pairs.unionByName(pairs.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).selectExpr("u", "least(u, m) m", "n")
        large = _meet(both.where("v > u"), least, crowd).selectExpr("v u", "m v").where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _meet(large, down, crowd).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        seen = Observation()
        r += 1
        small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(work.path(f"e{r}"))
        now = (seen.get["n"], seen.get["h"])
        pairs = work.read(pairs, f"e{r}")
        if r > 1 and now == before:
            break
        before = now
        if r > 1:
            work.drop(f"e{r - 1}")
    return nodes.join(pairs.withColumnRenamed("u", "node"), "node", "left").selectExpr("node", "coalesce(v, node) component")


def _meet(edges: DataFrame, least: DataFrame, crowd: int) -> DataFrame:
    """Edges with the minimum of their ``u``. Those of hubs meet it by broadcast, so no task gets a hub's edges."""
    hubs = least.where(F.col("n") > crowd).select("u", "m")  # at most one for each ``crowd`` edges
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, least node of its component) of the nodes of all edges of one task."""
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for u, v in zip(batch["u"], batch["v"], strict=True):
            u, v = top(u), top(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    found = [(x, top(x)) for x in list(root)]
    for i in range(0, len(found), 100_000):
        yield pd.DataFrame(found[i : i + 100_000], columns=["u", "v"])
