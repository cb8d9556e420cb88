"""Parent-child links to full hierarchies by parallel tree contraction.

Each round rakes all leaves and compresses unary chains: of the nodes with a single child it splices out those whose
round-salted hash is below that of both neighbours, an independent set of about a third. Rounds grow with the logarithm of the
longest chain, not with its length. What no round can remove are self-loops, each a contracted cycle. The recorded rounds are then
undone in reverse, from the roots out, so depth, root and path of a node are found from those of the node it hung on.

No step gathers a group: child counts are partial aggregates, splices meet one child each by its own name, and leaves meet one row
for each node, crowded parents by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from memspark.operators.work import Work

KNOWN = "node string, parent string, root string, depth long, path array<string>, status string"


def resolve_hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", paths: bool = True, crowd: int = 1_000_000) -> DataFrame:
    """node, parent, root, depth, path (root first, the node last) and status of each node that occurs in ``links``.

    status is ``tree``, ``cycle`` (on a cycle, also to itself; depth -1) or ``below_cycle`` (depth -2); the last two have a null root
    and path. Links with a null end are none; repeated links count once; of several parents of a node the least counts. Other
    columns are ignored. An empty table gives an empty result. Without ``paths`` nothing of them is carried along, and path is null. Parents of more than ``crowd`` leaves
    in a round are broadcast as the leaves come back, so no task gets a hub's children.
    """
    spark = links.sparkSession
    work = Work(spark, "hierarchy")
    via = F.expr("cast(array() as array<string>)") if paths else F.lit(None).cast("array<string>")
    edges = (
        links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
        .where("node is not null and parent is not null")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
        .select("node", "parent", F.lit(1).cast("long").alias("w"), via.alias("via"))
    )
    rounds, table, removed = 0, None, []
    while True:
        here = _classified(edges, rounds)
        if removed:
            here = here.coalesce(_tasks(kept))
        seen = Observation()
        here.observe(seen, F.count_if(F.col("kind") != "core").alias("open"), F.count_if(F.col("kind").isin("rake", "splice")).alias("removed"), F.count(F.lit(1)).alias("n")).write.parquet(work.path(f"r{rounds}"))
        table = work.read(here, f"r{rounds}")
        removed.append(seen.get["removed"])
        kept = seen.get["n"] - removed[-1]
        if not seen.get["open"]:
            break
        edges, rounds = _contracted(table), rounds + 1

    first = work.read(here, "r0")
    roots = first.select(F.col("parent").alias("node")).distinct().join(first.select("node"), "node", "left_anti")
    start = "array(node)" if paths else "cast(null as array<string>)"
    known = roots.selectExpr("node", "cast(null as string) parent", "node root", "0L depth", f"{start} path", "'tree' status")
    cores = table.where("kind = 'core'").selectExpr("node", "node parent", "cast(null as string) root", "-1L depth", "cast(null as array<string>) path", "'cycle' status")
    empty = spark.createDataFrame([], KNOWN)
    known.unionByName(cores).write.parquet(work.path("k0"))
    names = ["k0"]
    for r in range(rounds - 1, -1, -1):
        _restored(work.read(here, f"r{r}"), work.read(empty, *names), crowd if removed[r] > crowd else None).coalesce(_tasks(removed[r])).write.parquet(work.path(f"k{rounds - r}"))
        names.append(f"k{rounds - r}")
        if r:
            work.drop(f"r{r}")
    parents = first.select("node", F.col("parent").alias("own_parent"))
    return work.read(empty, *names).drop("parent").join(parents, "node", "left").select("node", F.col("own_parent").alias("parent"), "root", "depth", "path", "status")


def _tasks(rows: int) -> int:
    """Tasks, and so files, for a round's rows: late rounds are small, and each table is read in every round after it."""
    return max(1, -(-rows // 250_000))


def _classified(edges: DataFrame, r: int) -> DataFrame:
    kids = edges.groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("n"), F.max("node").alias("child"))
    h = lambda c: F.xxhash64(c, F.lit(r))
    kind = (
        F.when(F.expr("node = parent"), "core")
        .when(F.col("n").isNull(), "rake")
        .when((F.col("n") == 1) & F.expr("child <> node") & (h("node") < h("parent")) & (h("node") < h("child")), "splice")
        .otherwise("keep")
    )
    return edges.join(kids, edges.node == kids["at"], "left").select("node", "parent", "w", "via", kind.alias("kind"), F.when(F.col("n") == 1, F.col("child")).alias("child"))


def _contracted(table: DataFrame) -> DataFrame:
    """The edges that a round leaves. A spliced node has one child, which meets it by its own name: both sides are unique, so a parent of many meets nobody."""
    out = table.where("kind = 'splice'").selectExpr("child at_child", "node at", "parent up", "w w_up", "via via_up")
    kept = table.where("kind in ('keep', 'core')").select("node", "parent", "w", "via")
    return kept.join(out, kept.node == out["at_child"], "left").selectExpr(
        "node", "coalesce(up, parent) parent", "w + coalesce(w_up, 0L) w", "if(at is null, via, concat(via_up, array(at), via)) via"
    )


def _restored(table: DataFrame, known: DataFrame, crowd: int | None = None) -> DataFrame:
    """The nodes that a round removed: first those spliced out, whose neighbours are known, then the leaves that hung on any. With ``crowd`` parents of more leaves
    than that, of which a round has few, are broadcast."""
    up = known.selectExpr("node up", "root up_root", "depth up_depth", "path up_path", "status up_status")
    below = known.where("status = 'cycle'").selectExpr("node below")
    hung = "node", "parent", "up_root root", "if(up_depth >= 0, up_depth + w, -2L) depth", "if(up_depth >= 0, concat(up_path, via, array(node)), null) path"
    status = "if(up_status = 'tree', 'tree', 'below_cycle') status"
    spliced = table.where("kind = 'splice'").join(up, F.col("parent") == F.col("up")).join(below, F.col("child") == F.col("below"), "left")
    # a spliced node lies on a cycle if its only child does
    spliced = spliced.selectExpr(*hung[:3], "if(below is not null, -1L, if(up_depth >= 0, up_depth + w, -2L)) depth", hung[4], "if(below is not null, 'cycle', if(up_status = 'tree', 'tree', 'below_cycle')) status")
    ups = up.unionByName(spliced.selectExpr("node up", "root up_root", "depth up_depth", "path up_path", "status up_status"))
    leaves = table.where("kind = 'rake'")
    if crowd is None:
        return spliced.unionByName(leaves.join(ups, F.col("parent") == F.col("up")).selectExpr(*hung, status))
    hot = leaves.groupBy(F.col("parent").alias("hot")).count().where(F.col("count") > crowd).select("hot")  # at most one for each ``crowd`` leaves
    hot_ups = ups.join(F.broadcast(hot), F.col("up") == F.col("hot"), "left_semi")
    few = leaves.join(F.broadcast(hot_ups), F.col("parent") == F.col("up"))
    rest = leaves.join(F.broadcast(hot), F.col("parent") == F.col("hot"), "left_anti").join(ups, F.col("parent") == F.col("up"))
    return spliced.unionByName(few.selectExpr(*hung, status)).unionByName(rest.selectExpr(*hung, status))


def descendants(nodes: DataFrame) -> DataFrame:
    """ancestor, node, distance for each node below each ancestor, from the paths of ``resolve_hierarchy``. Rows, not lists: a root
    may have more descendants than fit in one task. Nodes on or below a cycle have none."""
    steps = nodes.where("path is not null").select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.where("at < depth").selectExpr("ancestor", "node", "depth - at distance")
