"""Retrieval: keyword answers in stages, snippets, rules, sources of answers, context packing, vectors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import fold, squash, strip_ws
from memspark.operators.matching import contains_join
from memspark.operators.work import Work, broadcast_if_small

# Fixed value: where sentences end, for the snippet.
SENTENCE_END = r"(?U)(?<=[.!?。다])\s+|\n+"


def query_terms(text: str) -> list[str]:
    """The terms of a question: runs of digits, Latin and Hangul letters of more than one character, case-folded, in order."""
    return list(dict.fromkeys(t for t in re.findall(r"[0-9a-zA-Z가-힣]+", text.casefold()) if len(t) > 1))


def any_term(hay: Column, query: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(fold(hay), F.lit(t)) for t in query], F.lit(False))


def answer_text(text: Column) -> Column:
    """A note's text as quoted in answers: without front matter, heading lines and the brackets of links."""
    plain = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(?m)^[ \t]*#[^\n]*$", ""), r"\[\[|\]\]", "")


def snippet(text: Column, query: list[str]) -> Column:
    """The first sentence with the highest score and its neighbours; a term counts 3 if it holds a digit, else 1. Without a match the first sentence."""
    sentences = lambda t: F.filter(F.transform(F.split(t, SENTENCE_END), strip_ws), lambda s: s != "")
    plain = answer_text(text)
    parts = sentences(plain)
    # the text is folded once, not each sentence for each term; folding moves no end of a sentence
    score = lambda s: sum((F.when(F.contains(s, F.lit(t)), 3 if any(c.isdigit() for c in t) else 1).otherwise(0) for t in query), F.lit(0))
    scores = F.transform(sentences(fold(plain)), score)
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    around = F.array_join(F.slice(parts, F.greatest(best - 1, F.lit(1)), F.when(best == 1, 2).otherwise(3)), " ")
    return F.when(F.array_max(scores) > 0, around).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def answer_matches(text: str, docs: DataFrame, timeline: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """stage, key, match, source_ids: what matches a question, a row for each distinct match text, of the first stage that gives it.

    Stages: 1 documents that hold a term (with a snippet), 2 events with a term in title, project, rationale or status, or of a project that a question about
    decisions names, 3 nodes with a term in type or name, or whose name stands in the question, 4 edges with a term. Within a stage rows are ordered by key.
    """
    query, asked = query_terms(text), fold(F.lit(text))
    about_decisions = any(w in text.casefold() for w in ("decision", "decid", "결정"))
    row = lambda df, stage, key, match, sources: df.select(F.lit(stage).alias("stage"), key.cast("string").alias("key"), match.alias("match"), sources.alias("source_ids"))
    held = docs.where(any_term(F.col("content"), query))
    out = row(held, 1, F.col("id"), F.concat_ws(": ", "source_id", snippet(F.col("content"), query)), F.array("id"))
    named = F.coalesce(F.contains(asked, fold("project")), F.lit(False)) & (F.trim(F.coalesce("project", F.lit(""))) != "") & F.lit(about_decisions)
    events = timeline.where(any_term(F.concat_ws(" ", "title", "project", "rationale", "status"), query) | named)
    label = lambda k, c: F.when(F.col(c) != "", F.concat(F.lit(f", {k}: "), c)).otherwise("")
    start = F.coalesce(F.when(F.trim("valid_from") != "", F.col("valid_from")), F.lit("9999-99-99"))
    out = out.unionByName(row(events, 2, F.concat_ws("/", start, F.col("title_key")), F.concat(F.lit("Decision: "), "title", label("status", "status"), label("project", "project"), F.when(F.col("current"), ", current: true").otherwise(", current: false")), F.col("source_ids")))
    hit = nodes.where(F.contains(asked, fold("name")) | any_term(F.concat_ws(" ", "type", "name", "canonical_name"), query))
    out = out.unionByName(row(hit, 3, F.concat_ws("/", "type", "canonical_name"), F.concat_ws(": ", "type", "name"), F.col("source_ids")))
    linked = edges.where(any_term(F.concat_ws(" ", "source", "relation", "target"), query))
    out = out.unionByName(row(linked, 4, F.concat_ws("/", fold("source"), "relation", fold("target")), F.concat("source", F.lit(" -["), "relation", F.lit("]-> "), "target"), F.col("source_ids")))
    return out.groupBy("match").agg(F.min(F.struct("stage", "key")).alias("o"), F.array_distinct(F.flatten(F.collect_set("source_ids"))).alias("source_ids")).select("o.stage", "o.key", "match", "source_ids")


def answer_confidence(n: Column) -> Column:
    """Confidence of an answer by its number of matches; null without any."""
    return F.when(n > 0, F.round(F.least(F.lit(0.95), 0.55 + 0.1 * n), 4))


def keyword_answer(matches: DataFrame, k: int = 10) -> DataFrame:
    """rank, stage, match, confidence: the first k matches by stage and key; the confidence counts all of them."""
    found = Work(matches.sparkSession, "answers").cut(matches.select("stage", "key", "match"), "matches")  # found once, counted and ordered
    n = found.agg(F.count("*").alias("n"))
    top = found.orderBy("stage", "key", "match").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy("stage", "key", "match")).cast("long"))  # k rows
    return ranked.join(F.broadcast(n)).select("rank", "stage", "match", answer_confidence(F.col("n")).alias("confidence"))


def match_sources(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """id, source_id, source_type: the documents that matches rest on, each once; ids without a document are dropped."""
    ids = matches.select(F.explode("source_ids").alias("id")).distinct()
    return ids.join(docs.select("id", "source_id", "source_type").groupBy("id").agg(F.min(F.struct("source_id", "source_type")).alias("d")), "id").select("id", "d.*")


def hint_sources(docs: DataFrame, hints: DataFrame, order: str = "id") -> DataFrame:
    """group, hint_ord, id: for each hint, in order within its group, the first document whose section title, source id or content holds it, in any case, and that no hint
    before it took. ``hints`` has group, hint_ord, hint; a group is one answer's hints, a handful."""
    path = F.array_join("section_path", " ") if "section_path" in docs.columns else F.lit("")
    hay = docs.select(F.col(order).alias("o"), "id", fold(F.concat_ws("\n", path, "source_id", "content")).alias("_hay"))
    keyed = hints.withColumn("_h", fold("hint"))
    found = contains_join(hay, "_hay", keyed.select("_h").where("_h <> ''").distinct(), "_h").select("_h", "o", "id")
    # of each hint as many first documents are enough as a group has hints; a literal bound keeps that many a task before the shuffle
    most = hints.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("_h").orderBy("o"))).where(F.col("r") <= most)
    lists = ranked.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("ids"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.slice(F.filter(F.transform(x["ids"], lambda i: F.struct(x["hint_ord"].alias("hint_ord"), i["id"].alias("id"))), lambda c: ~F.exists(a["out"], lambda t: t["id"] == c["id"])), 1, 1)).alias("out"))
    rows = keyed.join(lists, "_h").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("hint_ord", "ids"))).alias("hs"))
    kind = f"array<struct<hint_ord:{dict(hints.dtypes)['hint_ord']},id:string>>"
    taken = rows.select("group", F.explode(F.aggregate("hs", F.struct(F.array().cast(kind).alias("out")), step, lambda a: a["out"])).alias("x"))
    return taken.select("group", "x.*")


def retrieve_matches(text: str, nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """stage, kind, key, label: the nodes, edges and documents that hold the whole question, in any case."""
    part = fold(F.lit(text))
    row = lambda df, stage, kind, key, label: df.select(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"))
    out = row(nodes.where(F.contains(fold("name"), part) | F.contains(fold("type"), part)), 1, "node", F.col("id"), F.col("name"))
    out = out.unionByName(row(edges.where(F.contains(fold(F.concat_ws(" ", "source", "relation", "target")), part)), 2, "edge", F.concat_ws("/", fold("source"), "relation", fold("target")), F.concat_ws(" ", "source", "relation", "target")))
    out = out.unionByName(row(docs.where(F.contains(fold("content"), part) | F.contains(fold("source_id"), part)), 3, "document", F.col("id"), F.col("source_id")))
    return out.distinct()


def retrieve(text: str, nodes: DataFrame, edges: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """The first k of ``retrieve_matches``: nodes, then edges, then documents, within a stage by key."""
    return retrieve_matches(text, nodes, edges, docs).orderBy("stage", "key", "label").limit(k)


def rule_answers(questions: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """key, rule_ord, answer: the first rule (rule_ord, terms: array, answer) all of whose terms stand in the question, whitespace ignored. Rules are the caller's
    data; a rule without terms never matches. With a column ``set_ord`` rule sets are tried in that order, and rows have it. Questions meet rules by their first term."""
    sets = ["set_ord"] if "set_ord" in rules.columns else []
    keyed = rules.withColumn("_t", squash(F.get("terms", F.lit(0)))).where("_t <> ''")
    met = contains_join(questions.select(key, squash(text).alias("_q")), "_q", keyed, "_t")
    hit = met.where(F.forall("terms", lambda t: F.contains(F.col("_q"), squash(t))))
    first = F.min_by(F.struct(*sets, "rule_ord", "answer"), F.struct(*sets, "rule_ord", "answer")).alias("r")
    return hit.groupBy(key).agg(first).select(key, "r.*")


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a task before the shuffle (window group limit), so a hot group costs k rows."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 10_000) -> DataFrame:
    """query, key, similarity: exact cosine top-k of a stated query set against all rows, ``block`` queries at a time. Null vectors are similar to none."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).withColumn("nv", norm(F.col("v")))
    qs = queries.select(F.col(key).alias("query"), F.col(vector).alias("q")).withColumn("nq", norm(F.col("q")))
    n = qs.count()
    blocks = max(1, -(-n // block))
    best = None
    for b in range(blocks):  # the vectors are read once for each block of queries, of which the best k a task travel
        part = qs if blocks == 1 else qs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        scored = rows.join(F.broadcast(part), F.col("key") != F.col("query")).withColumn("similarity", F.round(dot / (F.col("nv") * F.col("nq")), 4))
        one = top_per_group(scored.select("query", "key", "similarity"), "query", [F.desc("similarity"), F.col("key")], k)
        best = one if best is None else best.unionByName(one)
    return best
