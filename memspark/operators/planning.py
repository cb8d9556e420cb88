"""Planning of loads, choice of a corpus for a source, tiers of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import ascii_tokens

# Bounds of risk in chunks, characters and characters of the largest chunk; least memory of each tier in GB; scores of a match.
HIGH, MEDIUM = (120, 180_000, 2_400), (40, 60_000, 1_800)
COMFORTABLE = 2_000
TIERS = [(128, "T5"), (64, "T4"), (48, "T3"), (32, "T2"), (16, "T1")]
SAME, IN_TREE, ACCEPTED, NEW = 0.98, 0.82, 0.72, 0.64
RISK_TEXT = {
    "blocked": "no supported documents: check the path or the kind of source",
    "high": "load in the background into a new corpus; split the source if it is too slow",
    "medium": "load in the background into a new corpus and watch its state",
    "low": "load directly or in the background",
}


def load_plan(docs: DataFrame, text: str, root: str) -> DataFrame:
    """One row: chunks, roots, chars, lines, largest chunk, chunks near the limit or with code, the risk of loading them, minutes and advice. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    lines = F.when(t != "", F.length(F.regexp_replace(t, r"[^\n]", "")) + 1).otherwise(0)
    out = docs.agg(
        F.count("*").alias("chunks"), F.count_distinct(root).alias("roots"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.coalesce(F.sum(lines), F.lit(0)).cast("long").alias("lines"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("largest"),
        F.count_if(n >= COMFORTABLE).alias("large_chunks"), F.count_if(F.contains(t, F.lit("```"))).alias("code_chunks"),
    )
    over = lambda b: (F.col("chunks") >= b[0]) | (F.col("chars") >= b[1]) | (F.col("largest") >= b[2])
    risk = F.when(F.col("chunks") == 0, "blocked").when(over(HIGH), "high").when(over(MEDIUM), "medium").otherwise("low")
    some = F.col("chunks") > 0
    advice = F.lit("")
    for k, v in RISK_TEXT.items():
        advice = F.when(F.col("risk") == k, v).otherwise(advice)
    out = out.withColumn("risk", risk).withColumn("minutes_min", F.when(some, F.greatest(F.lit(1), F.expr("chunks div 6"))).otherwise(0)).withColumn("minutes_max", F.when(some, F.greatest(F.lit(2), F.expr("chunks div 2"))).otherwise(0))
    return out.withColumn("advice", advice)


def largest_chunks(docs: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """The k longest texts, ties by key."""
    return docs.select(key, F.length(text).cast("long").alias("n_chars")).orderBy(F.desc("n_chars"), key).limit(k)


def rank_corpora(corpora: DataFrame, source: str, roots: DataFrame, k: int = 5) -> DataFrame:
    """corpus_id, score: the corpora that a source at a path may belong to, best first. ``corpora`` has corpus_id, last_source_path and root (a row for each of its
    roots); ``roots`` (root) are those of the source. A corpus scores for the same path, a path above or below, shared roots, and words that its name shares with the path's."""
    path = source.rstrip("/")
    name = path.rsplit("/", 1)[-1]
    wanted = roots.select("root").union(roots.sparkSession.createDataFrame([(name,)], "root string")).distinct().withColumn("_in", F.lit(1))
    per = corpora.select("corpus_id", F.rtrim(F.col("last_source_path"), F.lit("/")).alias("p"), "root").distinct().join(wanted, "root", "left")
    per = per.groupBy("corpus_id").agg(F.max("p").alias("p"), F.sum(F.coalesce("_in", F.lit(0))).alias("n"))
    under = lambda a, b: F.startswith(a, F.concat(b, F.lit("/")))
    at = F.when(F.col("p") == path, SAME).when(under(F.col("p"), F.lit(path)) | under(F.lit(path), F.col("p")), IN_TREE).otherwise(0.0)
    shared = F.when(F.col("n") > 0, F.least(F.lit(0.9), 0.35 + F.col("n") * 0.08)).otherwise(0.0)
    words = F.size(F.array_intersect(F.array_distinct(ascii_tokens(F.lit(f"{name.rsplit('.', 1)[0]} {name}"))), F.array_distinct(ascii_tokens("corpus_id"))))
    score = F.coalesce(at, F.lit(0.0)) + shared + F.least(F.lit(0.3), words * 0.1)
    return per.select("corpus_id", F.round(F.least(score, F.lit(0.99)), 2).alias("score")).where("score > 0").orderBy(F.desc("score"), "corpus_id").limit(k)


def choose_corpus(ranked: DataFrame, fallback: str, taken: list[str]) -> tuple[str, str, float]:
    """(corpus, action, confidence): the best candidate if it is good enough, else ``fallback``, numbered while that name is taken."""
    best = ranked.first()
    if best is not None and best["score"] >= ACCEPTED:
        return best["corpus_id"], "update_existing", best["score"]
    name, n = fallback, 2
    while name in taken:
        name, n = f"{fallback}-{n}", n + 1
    return name, "create_new", NEW


def machine_tier(gb: Column) -> Column:
    """The tier of a machine by its memory; null below the least."""
    out = F.lit(None).cast("string")
    for least, tier in reversed(TIERS):
        out = F.when(gb >= least, tier).otherwise(out)
    return out
