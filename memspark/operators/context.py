"""Texts packed into a budget of characters, with compression of what does not fit, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import strip_ws, text_lines

# Fixed value: words that mark a line worth keeping.
KEY_LINE = r"(?iU)\b(decision|rationale|because|next action|todo|blocker|결정|근거|이유|할 일|차단)\b"


def extract_lines(text: Column) -> Column:
    """The first two lines and those with a key word, each once, in that order; the text where it has no line."""
    lines = F.filter(F.transform(text_lines(text), strip_ws), lambda x: x != "")
    kept = F.array_distinct(F.concat(F.slice(lines, 1, 2), F.filter(lines, lambda x: F.rlike(x, F.lit(KEY_LINE)))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(strip_ws(text))


def cut_to(text: Column, limit: Column) -> Column:
    """The text if it fits, else its beginning with a mark of omission, exactly ``limit`` characters in all."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.greatest(limit - 1, F.lit(0))), F.lit("…")))


def plan_context(items: DataFrame, group: str, key: str, budget: int) -> DataFrame:
    """group, key, kind (``none``, ``extractive`` or ``dropped``), room: how each item goes into its group's budget, in order of priority (greatest first), then ``ord``.

    An item that fits what is left goes whole; else what is left of it by key lines, or their beginning; once nothing is left items are dropped. What a
    compressed item takes depends on its own lengths only, so the fold sees numbers: (priority, ord, length, compressed length). Groups are hot only as far as
    a question has candidates; each costs one row of numbers an item.

    Each item but an empty one takes at least one character, so only the first ``budget`` non-empty items of a group are folded; what comes after the
    room is used up is dropped by comparison. ``items`` has group, key, ord, priority, content; a null priority is 0.5.
    """
    if budget < 1:
        raise ValueError("budget must be at least 1")
    n, short = F.length("content").cast("long"), F.length(extract_lines(F.col("content"))).cast("long")
    rows = items.where(F.col("content").isNotNull()).select(F.col(group).alias("g"), F.struct((-F.coalesce("priority", F.lit(0.5))).alias("p"), F.col("ord").alias("o"), F.col(key).alias("k")).alias("i"), n.alias("n"), short.alias("c"))
    first = rows.where("n > 0").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("i"))).where(F.col("r") <= budget)
    kind = f"array<struct<i:{dict(rows.dtypes)['i']},kind:string,room:bigint,after:bigint>>"

    def step(a: Column, x: Column) -> Column:
        after = a["left"] - _use(a["left"], x)
        return F.struct(after.alias("left"), F.concat(a["out"], F.array(F.struct(x["i"].alias("i"), _kind(a["left"], x).alias("kind"), a["left"].alias("room"), after.alias("after")))).alias("out"))

    taken = F.aggregate(F.array_sort(F.collect_list(F.struct("i", "n", "c"))), F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])
    planned = first.groupBy("g").agg(taken.alias("t"))
    stops = planned.select("g", F.array_min(F.transform(F.filter("t", lambda x: x["after"] <= 0), lambda x: x["i"])).alias("stop"))
    given = planned.select("g", F.explode("t").alias("t")).select("g", "t.*").where("kind <> 'dropped'")
    every = rows.join(stops, "g", "left").join(given.drop("after"), ["g", "i"], "left")
    empty = F.when((F.col("n") == 0) & (F.col("stop").isNull() | (F.col("i") < F.col("stop"))), "none")
    return every.select(F.col("g").alias(group), F.col("i.k").alias(key), F.coalesce("kind", empty, F.lit("dropped")).alias("kind"), F.coalesce("room", F.lit(0).cast("long")).alias("room"))


def _kind(left: Column, x: Column) -> Column:
    return F.when(left <= 0, "dropped").when(x["n"] <= left, "none").otherwise("extractive")


def _use(left: Column, x: Column) -> Column:
    return F.when(left <= 0, F.lit(0).cast("long")).when(x["n"] <= left, x["n"]).otherwise(F.least(x["c"], left))


def pack_context(items: DataFrame, group: str, key: str, budget: int) -> DataFrame:
    """group, key, kind, content, original_hash, original: items of each group within its budget of characters. ``original`` holds the text of compressed and dropped
    items (the archive); dropped ones have a null content. Items are unique in (group, key); null texts are none."""
    plan = plan_context(items, group, key, budget)
    rows = items.join(plan, [group, key])
    limit = F.greatest("room", F.lit(1)).cast("int")
    text = F.when(F.col("kind") == "none", F.col("content")).when(F.col("kind") == "extractive", cut_to(extract_lines(F.col("content")), limit))
    return rows.select(group, key, "kind", text.alias("content"), F.sha2("content", 256).alias("original_hash"), F.when(F.col("kind") != "none", F.col("content")).alias("original"))


def restore_context(packed: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, content: the kept items as they were, by the archive's hashes; dropped ones stay away."""
    archive = packed.where("original is not null").select(group, F.col("original_hash"), F.col("original").alias("_o")).dropDuplicates([group, "original_hash"])
    kept = packed.where("content is not null").join(archive, [group, "original_hash"], "left")
    return kept.select(group, key, F.coalesce("_o", "content").alias("content"))
