"""Extraction by rules and the validation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import fold
from memspark.operators.matching import contains_join
from memspark.operators.work import broadcast_if_small

# Notations in the notes.
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
TERM = r"[0-9a-zA-Z가-힣]+"
DECISION_LINE = r"(?m)^(?:[-*>]\s*)?Decision:\s*([^\n]+)"


def terms(text: Column) -> Column:
    """Distinct case-folded terms of more than one character, in order of occurrence."""
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 1))


def front_matter(text: Column) -> Column:
    """map<string,string> of a note's front matter; the last of repeated keys counts; null without front matter."""
    body = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    pairs = F.filter(F.split(body, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']|[\"']$", "").alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.when(body != "", F.map_from_entries(last))


def wikilinks(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))))


def decision_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, statement: the lines labelled as decisions, in order."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(DECISION_LINE), F.lit(1))).alias("pos", "statement"))


def mentions(docs: DataFrame, key: str, text: str, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """key, term for each dictionary term that a text contains, case-sensitive."""
    return contains_join(docs.select(key, text), text, dictionary.select(F.col(term).alias("term")).distinct(), "term").select(key, "term")


def confidence_gate(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows with ``ok``: confidence at least the threshold; null is not."""
    return rows.withColumn("ok", F.coalesce(F.col("confidence") >= least, F.lit(False)))


def grounding_gate(entities: DataFrame, docs: DataFrame, key: str = "ord") -> DataFrame:
    """key, grounded: whether the span stands in a source document (null spans are), marks of omission around it ignored.

    Distinct pairs of span and source meet the documents in an equi-join, so what many rows ask of one document is asked once.
    """
    span = F.trim(F.regexp_replace("span", "^…|…$", ""))
    refs = entities.where("span is not null").select(F.col(key).alias("_k"), span.alias("s"), F.explode("source_ids").alias("id"))
    asked = refs.select("s", "id").distinct()
    texts = docs.select("id", "content").join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("content").alias("content"))
    held = asked.join(texts, "id").where(F.contains("content", F.col("s"))).select("s", "id")
    hit = refs.join(held, ["s", "id"], "left_semi").select(F.col("_k").alias(key)).distinct().withColumn("hit", F.lit(True))
    return entities.select(key, "span").join(hit, key, "left").select(key, (F.col("span").isNull() | F.col("hit").isNotNull()).alias("grounded"))


def type_gate(relations: DataFrame, ontology: DataFrame) -> DataFrame:
    """The relations (relation, source_type, target_type, ...) with ``ok``: the ontology (relation, domain, range: arrays) knows the relation and allows both types."""
    o = broadcast_if_small(ontology.select(F.col("relation").alias("_r"), "domain", "range"))
    ok = F.array_contains("domain", F.col("source_type")) & F.array_contains("range", F.col("target_type"))
    return relations.join(o, F.col("relation") == F.col("_r"), "left").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_r", "domain", "range")


def endpoint_gate(relations: DataFrame, named: DataFrame, ontology: DataFrame) -> DataFrame:
    """The relations (id, doc_id, subject, predicate, object, ...) with ``ok``: both ends are named (doc_id, name, type) in the relation's own document, and the ontology
    allows one of the types of each. Types of a name in a document are a set, so a name of several types passes with any of them."""
    types = named.groupBy("doc_id", "name").agg(F.collect_set("type").alias("types"))
    o = broadcast_if_small(ontology.select(F.col("relation").alias("_r"), "domain", "range"))
    s, t = types.selectExpr("doc_id", "name subject", "types s_types"), types.selectExpr("doc_id", "name object", "types o_types")
    out = relations.join(s, ["doc_id", "subject"], "left").join(t, ["doc_id", "object"], "left").join(o, F.col("predicate") == F.col("_r"), "left")
    ok = F.arrays_overlap("s_types", "domain") & F.arrays_overlap("o_types", "range")
    return out.withColumn("ok", F.coalesce(ok, F.lit(False))).select(*relations.columns, "ok")


def validate(entities: DataFrame, decisions: DataFrame, relations: DataFrame, docs: DataFrame, ontology: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, decisions, relations, rejects). Entities must be grounded and sure enough, decisions sure enough, relations sure enough and of types that the
    ontology allows, among their document's accepted entities and decisions. Rejects: kind, id, reason, source_ids, and of relations subject, predicate, object."""
    cols = lambda df: [c for c in df.columns if c not in ("ok", "grounded")]
    e = confidence_gate(entities, least).join(grounding_gate(entities, docs, "id").withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).drop("_i").withColumn("ok", F.col("ok") & F.col("grounded"))
    d = confidence_gate(decisions, least)
    good_e, good_d = e.where("ok").select(*cols(entities)), d.where("ok").select(*cols(decisions))
    named = good_e.select("doc_id", "name", "type").unionByName(good_d.select("doc_id", F.col("title").alias("name"), F.lit("Decision").alias("type")))
    r = endpoint_gate(confidence_gate(relations, least).withColumnRenamed("ok", "sure"), named, ontology).withColumn("ok", F.col("ok") & F.col("sure")).drop("sure")
    none = F.lit(None).cast("string")
    reject = lambda df, kind, s=none, p=none, o=none: df.where("not ok").select(F.lit(kind).alias("kind"), "id", F.lit("validation_failed").alias("reason"), "source_ids", s.alias("subject"), p.alias("predicate"), o.alias("object"))
    out = reject(e, "entity").unionByName(reject(d, "decision")).unionByName(reject(r, "relation", F.col("subject"), F.col("predicate"), F.col("object")))
    return good_e, good_d, r.where("ok").select(*cols(relations)), out


def merge_entities(rows: DataFrame) -> DataFrame:
    """One row for each (type, name in any case): the first by ord, sources united, greatest confidence."""
    return _merged(rows, [F.col("type"), fold("name")], [])


def merge_relations(rows: DataFrame) -> DataFrame:
    """One row for each (subject, predicate, object), ends in any case: the first by ord, sources united, greatest confidence."""
    return _merged(rows, [fold("subject"), F.col("predicate"), fold("object")], [])


def merge_decisions(rows: DataFrame) -> DataFrame:
    """One row for each title in any case: the first by ord, sources united, greatest confidence, and the first rationale that is not blank."""
    return _merged(rows, [fold("title")], ["rationale"])


def _merged(rows: DataFrame, keys: list[Column], filled: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("source_ids", "confidence", *filled)]
    order = F.struct("ord", "id")
    fill = [F.min_by(c, F.when(F.trim(c) != "", order)).alias(c) for c in filled]
    out = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*rest), order).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"), F.max("confidence").alias("confidence"), *fill)
    return out.select("r.*", "source_ids", "confidence", *filled).select(*rows.columns)
