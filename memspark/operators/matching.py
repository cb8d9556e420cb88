"""Substring joins without a cartesian product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, few: int = 2_000) -> DataFrame:
    """All columns of both sides for each text that contains a term, case-sensitive. Empty and null terms match nothing.

    Up to ``few`` terms (counted) are broadcast and tried one by one. Beyond that texts and terms meet in an equi-join on the first letters of the term,
    which a text that contains it must hold: four, or as many as the shortest term has. Each text gives its distinct letter groups, and each pair is
    verified, so nothing is lost and no pair without a common group arises.
    """
    terms = terms.where(F.col(term) != "")
    if terms.limit(few + 1).count() <= few:
        return texts.join(F.broadcast(terms), F.contains(F.col(text), F.col(term)))
    n = min(GRAM, terms.agg(F.min(F.length(term))).first()[0])
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    grams = texts.withColumn("_g", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n))))))
    keyed = terms.withColumn("_g", F.left(F.col(term), F.lit(n)))
    # only groups that some term starts with travel
    wanted = keyed.select("_g").distinct()
    return grams.join(wanted, "_g", "left_semi").join(keyed, "_g").where(F.contains(F.col(text), F.col(term))).drop("_g")
