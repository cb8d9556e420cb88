"""Rationale memory: why a decision was taken, from its own text and from specifications that documents support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import fold
from memspark.ids import row_id
from memspark.operators.matching import contains_join
from memspark.operators.timeline import union_of

FROM_SPEC = 0.92


def alike_titles(a: Column, b: Column) -> Column:
    """Whether one of two titles contains the other, in any case."""
    return F.contains(fold(a), fold(b)) | F.contains(fold(b), fold(a))


def title_matches(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """All columns of both sides for each pair of titles of which one contains the other, case-folded; blank titles match nothing."""
    ls, rs = left.withColumn("_a", fold(a)).where("_a <> ''"), right.withColumn("_b", fold(b)).where("_b <> ''")
    inside = contains_join(ls, "_a", rs, "_b")
    outside = contains_join(rs, "_b", ls, "_a").where("_a <> _b").select(*inside.columns)
    return inside.unionByName(outside).drop("_a", "_b")


def rationales(decided: DataFrame, docs: DataFrame, specs: DataFrame) -> DataFrame:
    """id, corpus_id, ord, decision_title, rationale_text, category, span, source_ids, confidence: one row for each (decision title, text) in any case.

    ``specs`` (spec_ord, decision_title, text, category, markers: array) are the caller's data. A decision with a rationale takes the texts of the specs whose
    title matches its own, else its own text, grounded in its documents. A spec that documents support, all markers in content, title or section path, gives
    one with those documents as sources. Of repeated ones the first stays, sources are united, the greatest confidence and the first span count.
    """
    reasons = decided.where("trim(rationale) <> ''").select("corpus_id", F.col("ord").cast("string").alias("ord"), F.col("id").alias("_d"), "title", "rationale", "source_ids", "confidence")
    specs = specs.select("spec_ord", F.col("decision_title").alias("s_title"), F.col("text").alias("s_text"), F.col("category").alias("s_category"), "markers")
    matched = title_matches(reasons, specs.drop("markers"), "title", "s_title")
    row = lambda df, stage, order, title, text, category, span, conf: df.select("corpus_id", F.lit(stage).alias("stage"), order.alias("ord"), title.alias("decision_title"), text.alias("rationale_text"), category.alias("category"), span.alias("span"), "source_ids", conf.alias("confidence"))
    by_spec = row(matched, 0, F.concat_ws("/", "ord", F.format_string("%06d", F.col("spec_ord").cast("int"))), F.col("s_title"), F.col("s_text"), F.col("s_category"), F.col("s_text"), F.lit(FROM_SPEC))
    own = reasons.join(matched.select("_d").distinct(), "_d", "left_anti")
    refs = own.select("_d", "rationale", F.explode("source_ids").alias("id")).join(docs.select("id", "content").dropDuplicates(["id"]), "id")
    spans = refs.where(F.contains("content", F.col("rationale"))).select("_d").distinct().withColumn("_hit", F.lit(True))
    own = row(own.join(spans, "_d", "left"), 0, F.col("ord"), F.col("title"), F.col("rationale"), F.lit("rationale"), F.when(F.col("_hit"), F.col("rationale")), F.col("confidence"))
    supported = supporting_docs(docs, specs).groupBy("spec_ord", "s_title", "s_text", "s_category").agg(F.min("corpus_id").alias("corpus_id"), F.array_sort(F.collect_set("id")).alias("source_ids"), F.max(F.contains("content", F.col("s_text")).cast("int")).alias("_hit"))
    by_docs = row(supported, 1, F.format_string("%06d", F.col("spec_ord").cast("int")), F.col("s_title"), F.col("s_text"), F.col("s_category"), F.when(F.col("_hit") == 1, F.col("s_text")), F.lit(FROM_SPEC))
    return merge_rationales(by_spec.unionByName(own).unionByName(by_docs))


def supporting_docs(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """Columns of ``specs`` (with markers) and id, corpus_id and content of ``docs`` for each document that holds all markers of a spec, in any case. Documents are met by
    the first marker; specs without markers have none."""
    title = F.col("title") if "title" in docs.columns else F.lit("")
    path = F.array_join("section_path", " ") if "section_path" in docs.columns else F.lit("")
    hay = docs.select("id", "corpus_id", "content", fold(F.concat_ws(" ", "content", title, path)).alias("_hay"))
    keyed = specs.withColumn("_m", fold(F.get("markers", F.lit(0)))).where("_m <> ''")
    return contains_join(hay, "_hay", keyed, "_m").where(F.forall("markers", lambda m: F.contains(F.col("_hay"), fold(m)))).drop("_hay", "_m")


def merge_rationales(rows: DataFrame) -> DataFrame:
    order = F.struct("stage", "ord")
    keyed = rows.groupBy(fold("decision_title").alias("_t"), fold("rationale_text").alias("_x"))
    first = F.min_by(F.struct("corpus_id", "ord", "decision_title", "rationale_text", "category"), order).alias("r")
    span = F.min_by(F.when(F.col("span").isNotNull(), F.col("span")), F.when(F.col("span").isNotNull(), order)).alias("span")
    out = keyed.agg(first, span, union_of("source_ids").alias("source_ids"), F.max("confidence").alias("confidence"))
    return out.select(row_id("rationale", F.col("r.corpus_id"), F.col("r.decision_title"), F.col("r.rationale_text")).alias("id"), "r.*", "span", "source_ids", "confidence")


def why(timeline: DataFrame, reasons: DataFrame | None, decision: str) -> DataFrame:
    """title, answer: the events whose title contains the decision's name, with the rationale memory of titles that contain the name or are contained in it; where it
    has none, the first event's own rationale, else a fixed text. One row for each event, or one with the asked name if no event matches but a rationale does."""
    name = fold(F.lit(decision))
    events = timeline.where(F.contains(fold("title"), name)).select("title", "rationale", "ord")
    texts = events.groupBy().agg(F.min_by("rationale", F.struct("ord", "title")).alias("own"))  # one row
    if reasons is not None:
        hit = reasons.where(F.contains(fold("decision_title"), name) | F.contains(name, fold("decision_title")))
        said = hit.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "decision_title", F.concat("rationale_text", F.lit(" ("), "category", F.lit(")")).alias("t")))), lambda x: x["t"]), "; ").alias("said"), F.array_sort(F.collect_set("decision_title")).alias("titles"))
        texts = texts.join(F.broadcast(said))  # one row each
    else:
        texts = texts.select("own", F.lit("").alias("said"), F.array().cast("array<string>").alias("titles"))
    answer = F.coalesce(F.when(F.col("said") != "", F.col("said")), F.when(F.trim("own") != "", F.col("own")), F.lit("no rationale recorded"))
    titles = events.select("title").join(F.broadcast(texts.select(answer.alias("answer"))))
    alone = texts.where("said <> ''").select(F.explode("titles").alias("title"), answer.alias("answer")).join(events.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti")
    return titles.unionByName(alone).distinct()
