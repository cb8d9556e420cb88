"""Quality of a memory against cases: precision and recall of triples, share of passed questions, a grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import answer_key
from memspark.operators.rationale import title_matches

# Targets and the error rate of the best grade.
TARGETS = {"precision": 0.95, "recall": 0.90, "grounding_error": 0.01, "rationale_recall": 0.85, "chain": 0.90}
BEST_ERROR = 0.005


def ratio(n: Column, of: Column) -> Column:
    """n of how many, rounded; 0 of none."""
    return F.when(of == 0, 0.0).otherwise(F.round(n / of, 4))


def _loose(c: str) -> Column:
    return answer_key(c)


def found_triples(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, found: whether an edge has one of the case's relations and ends of which one contains the case's, or the other way round. ``cases`` has case_id,
    subject, relations (array), object."""
    e = edges.select(_loose("source").alias("s"), "relation", _loose("target").alias("t"))
    c = cases.select("case_id", _loose("subject").alias("cs"), F.explode("relations").alias("relation"), _loose("object").alias("ct"))
    hit = title_matches(c, e.withColumnRenamed("relation", "r").where("t <> ''"), "cs", "s").where("relation = r and (contains(t, ct) or contains(ct, t))")
    return cases.select("case_id").join(hit.select("case_id").distinct().withColumn("_f", F.lit(True)), "case_id", "left").select("case_id", F.col("_f").isNotNull().alias("found"))


def triple_precision(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """extracted, wrong, score: the share of edges that are not forbidden ones found; one row."""
    wrong = found_triples(edges, forbidden).agg(F.count_if("found").alias("wrong"))
    return edges.agg(F.count("*").alias("extracted")).join(F.broadcast(wrong)).select("extracted", "wrong", ratio(F.greatest(F.col("extracted") - F.col("wrong"), F.lit(0)), F.col("extracted")).alias("score"))


def recall_by_group(found: DataFrame, groups: DataFrame) -> DataFrame:
    """group, matched, total, minimum, passed, score. ``groups`` has case_id, group, minimum."""
    out = groups.join(found, "case_id").groupBy("group").agg(F.count_if("found").alias("matched"), F.count("*").alias("total"), F.max("minimum").cast("long").alias("minimum"))
    return out.withColumn("passed", F.col("matched") >= F.col("minimum")).withColumn("score", ratio(F.col("matched"), F.col("total")))


def pass_rates(results: DataFrame, by: str, passed: str, weight: str) -> DataFrame:
    """by, total, passed, pass_rate, weighted_total, weighted_passed, weighted_pass_rate."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    out = results.groupBy(by).agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.sum(weight).alias("weighted_total"), F.sum(F.when(ok, F.col(weight)).otherwise(0)).alias("weighted_passed"))
    return out.withColumn("pass_rate", ratio(F.col("passed"), F.col("total"))).withColumn("weighted_pass_rate", ratio(F.col("weighted_passed"), F.col("weighted_total")))


def contains_all(text: Column, tokens: Column) -> Column:
    """Whether a text holds all tokens, punctuation and whitespace ignored."""
    return F.forall(tokens, lambda t: F.contains(answer_key(text), answer_key(t)))


def grade(scores: dict[str, float]) -> str:
    """A+ to Fail from the five scores; the grounding error counts as passed at or under its target."""
    ok = {k: scores[k] <= t if k == "grounding_error" else scores[k] >= t for k, t in TARGETS.items()}
    if all(ok.values()):
        return "A+" if scores["grounding_error"] <= BEST_ERROR else "A"
    return {4: "B", 3: "C"}.get(sum(ok.values()), "Fail")
