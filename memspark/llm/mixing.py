"""Sources mixed to target weights by Sainte-Lague apportionment of tokens.

Seats (tokens) go to the highest quotients weight / (2 seats + 1): first to sources by target share, then within each source to its
shards by their tokens, both under the caps that the allowed repeats set. Each shard then takes documents in seeded order, round
and round, up to its quota. Apportionment sees one row for each source and shard, their number fixed by a parameter; documents are
ordered within shards only, so a source with most of all rows is spread like any other. A small source has fewer shards, down to one, as
each shard rounds to whole documents.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.operators.work import Work, broadcast_if_small

# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str = TOKENIZER):
    """A pandas UDF: the number of tokens of a text, whole, under the rank file at ``path``; null for null."""

    def count(texts: pd.Series) -> pd.Series:
        e = _encoding(path)
        return texts.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int64")

    return F.pandas_udf(count, "long")


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), none beyond its cap; ties go to the earlier entry.

    A bisection on the quotient finds all but the last few seats at once, so the cost does not grow with the number of seats.
    """
    caps = [seats] * len(weights) if caps is None else caps
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    got = lambda q: [min(c, int((w / q + 1) / 2)) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]
    if seats <= 0:
        return [0] * len(weights)
    low, high = 0.0, max(weights) * 2
    low = min(w for w in weights if w > 0) / (2 * seats + 2) / 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(got(mid)) > seats:
            low = mid
        else:
            high = mid
    out = got(high)
    heap = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(weights, out, caps, strict=True)) if w > 0 and s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def mix_sources(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, block: int = 256, shards: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). selection: key, source, n_tokens, repeats (at least 1); shares: source, target_share, max_repeats, n_docs, tokens,
    quota_tokens, mixed_tokens, actual_share.

    ``targets`` has source, target_share, max_repeats, one row for each source (of repeated ones the first by share), null shares none;
    sources are compared trimmed and lower-cased. The mix is the largest at which each listed source that has tokens reaches its share with no
    document used more than max_repeats times. There are ``shards`` shards, by default one for each 50 million tokens, from 64 to 4,096; a source is spread over at most all of
    them, one for each ``shards`` blocks of its tokens. A listed source without tokens has actual share 0 and the others keep their proportions.
    Documents of unlisted or null sources, or with null or empty text, are not selected.
    """
    work = Work(docs.sparkSession, "mix")
    name = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    aims = targets.select(name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").dropDuplicates(["source"])
    aims = work.cut(aims, "targets")
    rows = docs.select(F.col(key).alias("key"), name(F.col(source)).alias("source"), F.col(text).alias("text")).where("text <> ''")
    rows = rows.join(broadcast_if_small(aims.select("source")), "source").select("key", "source", token_count(tokenizer)("text").alias("n_tokens"), F.xxhash64("key", F.xxhash64("text"), F.lit(seed)).alias("h"))
    counted = work.cut(rows.where("n_tokens > 0"), "tokens")
    if shards is None:
        shards = min(4096, max(64, -(-(counted.agg(F.sum("n_tokens")).first()[0] or 0) // 50_000_000)))
    rows = counted.withColumn("shard", F.pmod("h", F.lit(shards)))

    sizes: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("source", "shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect():  # sources listed x shards
        sizes.setdefault(r["source"], {})[r["shard"]] = (r["n"], r["t"])
    wanted = {r["source"]: (r["target_share"], r["max_repeats"] or 0) for r in aims.collect()}
    live = sorted(s for s in sizes if wanted[s][1] > 0)
    tokens = {s: sum(t for _, t in sizes[s].values()) for s in live}
    top = {s: wanted[s][1] * tokens[s] for s in live}
    whole = sum(wanted[s][0] for s in live)
    size = int(min((top[s] * whole / wanted[s][0] for s in live), default=0))
    quota = dict(zip(live, sainte_lague([wanted[s][0] for s in live], size, [top[s] for s in live]), strict=True))
    plan = []
    for s in live:
        parts = max(1, min(shards, tokens[s] // (block * shards)))
        total: dict[int, int] = {}
        for p, (_, t) in sorted(sizes[s].items()):
            total[p % parts] = total.get(p % parts, 0) + t
        share = dict(zip(total, sainte_lague([float(t) for t in total.values()], quota[s], [wanted[s][1] * t for t in total.values()]), strict=True))
        plan += [(s, p, p % parts, total[p % parts], share[p % parts]) for p in sizes[s]]
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, T.StructType([T.StructField("source", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("part", T.LongType()), T.StructField("total", T.LongType()), T.StructField("quota", T.LongType())]))

    # a document at m tokens of its part (its middle) is used once for each whole k with k * total + m < quota
    order = Window.partitionBy("source", "part").orderBy("h", "key")
    placed = rows.join(F.broadcast(plan), ["source", "shard"]).withColumn("m", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") / 2)
    used = placed.withColumn("repeats", F.ceil((F.col("quota") - F.col("m")) / F.col("total")).cast("long")).where("repeats > 0")
    selection = work.cut(used.select("key", "source", "n_tokens", "repeats"), "selection")

    mixed = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    all_tokens = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    quotas = plan.select("source", "part", "quota").distinct().groupBy("source").agg(F.sum("quota").alias("quota_tokens"))
    shares = aims.join(all_tokens, "source", "left").join(quotas, "source", "left").join(mixed, "source", "left").fillna(0, ["n_docs", "tokens", "quota_tokens", "mixed_tokens"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())  # one row for each listed source
    return selection, shares.withColumn("actual_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0))
