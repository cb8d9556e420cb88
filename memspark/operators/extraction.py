"""Silver extraction by rules: entity candidates, typed links, decisions in stages, relations, the project of a text, and an optional model.

Documents have the columns id, corpus_id, ord (any type that orders arrival), title, content. Dictionaries, title rules and known pairs are the caller's data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import collapse_ws, fold, text_lines
from memspark.ids import row_id
from memspark.operators.matching import contains_join
from memspark.operators.silver import front_matter

# Notations, verbs of use, words that deny it, decision verbs, and the labels before a link that give its type.
FRONT_MATTER = r"(?s)\A---\s*\n.*?\n---\s*\n"
FENCED = r"(?s)```.*?```"
EXAMPLE_LINE = r"""(?i)^\s*(?:"(?:content|rationale|id|source_id)"|content|id|source_id)\s*:"""  # an unquoted rationale is a label
SENTENCE = r"(?U)(?<=[.!?。])\s+|\n+"
USE_VERBS = r"(?iU)\b(use|uses|using|adopt|adopts|adopted|selected|decided to use)\b|사용|채택|선택"
DENIED = r"(?iU)\b(considered|considering|instead of|not use|rejected)\b|고려|대신|폐기|거절"
DECIDED = r"(?iU)\bdecided\b|결정했|결정한다|선택|채택"
LINK = r"\[\[([^\]]+)\]\]"
TAG = r"(?U)(?<!\w)#([A-Za-z0-9_/-]+)"
LINK_LABELS = [("프로젝트", "Project"), ("도구", "Tool"), ("인물", "Person")]
MENTION_LABEL = "관련"
ENTITY_KINDS = ["Person", "Project", "Tool", "Concept", "Decision", "Issue", "Action"]
RELATION_KINDS = ["USES", "MADE_IN", "RELATED_TO", "SUPERSEDES", "MENTIONS"]
STATUSES = ["proposed", "accepted", "rejected", "superseded"]
_LABEL = r"[ \t]*(?:[-*>][ \t]+)?"


def body(text: Column) -> Column:
    """The text without front matter, fenced blocks and lines of example JSON."""
    return F.array_join(F.filter(text_lines(F.regexp_replace(F.regexp_replace(text, FRONT_MATTER, ""), FENCED, "")), lambda x: ~F.rlike(x, F.lit(EXAMPLE_LINE))), "\n")


def link_names(links: Column) -> Column:
    """The names of links without the words shown for them."""
    return F.transform(links, lambda x: F.trim(F.substring_index(x, "|", 1)))


def all_links(text: Column) -> Column:
    """Distinct names of a text's links, sorted."""
    return F.array_sort(F.array_distinct(link_names(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)))))


def tags(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TAG), F.lit(1))))


def headings(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(\S[^\r\n]*)"), F.lit(1)), lambda x: F.trim(x))


def labelled(text: Column, label: str) -> Column:
    """The values of the lines ``label: value``, whitespace collapsed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^{_LABEL}{label}[ \t]*:[ \t]*(\S[^\r\n]*)"), F.lit(1)), collapse_ws)


def positive_use(text: Column, tool: Column) -> Column:
    """Whether a sentence names the tool with a verb of use and no word that denies it."""
    return F.exists(F.split(text, SENTENCE), lambda s: F.contains(s, tool) & F.rlike(s, F.lit(USE_VERBS)) & ~F.rlike(s, F.lit(DENIED)))


def typed_links(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """id, line_no, link_no, type, name, label: each link with the type that the words before the line's first link give it; a dictionary (type, term) overrides it."""
    lines = docs.select("id", F.posexplode(text_lines(F.col("content"))).alias("line_no", "line")).where(F.contains("line", F.lit("[[")))
    label = F.substring_index("line", "[[", 1)
    kind = F.coalesce(*[F.when(F.contains(label, F.lit(w)), t) for w, t in LINK_LABELS], F.lit("Concept"))
    links = lines.select("id", "line_no", label.alias("label"), kind.alias("type"), F.posexplode(link_names(F.regexp_extract_all("line", F.lit(LINK), F.lit(1)))).alias("link_no", "name"))
    if dictionary is not None:
        known = dictionary.groupBy(F.col("term").alias("name")).agg(F.min_by("type", F.struct(_kind_order(F.col("type")), F.col("type"))).alias("known"))
        links = links.join(known, "name", "left").withColumn("type", F.coalesce("known", "type"))
    return links.select("id", "line_no", "link_no", "type", "name", "label")


def _kind_order(kind: Column) -> Column:
    """Order in which dictionaries are looked up."""
    return F.when(kind == "Project", 0).when(kind == "Tool", 1).when(kind == "Person", 2).otherwise(3)


def entity_candidates(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """id, rule, pos, type, name, confidence: what each rule proposes, before repeats are dropped. Rules in order: the front matter's project and author,
    the title as document and as concept, headings, links, tags, dictionary terms in the text (longest first)."""
    fm = front_matter(F.col("content"))
    row = lambda rule, pos, kind, name, conf: F.struct(F.lit(rule).alias("rule"), pos.cast("int").alias("pos"), F.lit(kind).alias("type"), name.alias("name"), F.lit(conf).alias("confidence"))
    zero = F.lit(0)
    single = [row(0, zero, "Project", F.element_at(fm, "project"), 0.95), row(1, zero, "Person", F.element_at(fm, "author"), 0.75), row(2, zero, "Document", F.col("title"), 0.9), row(3, zero, "Concept", F.col("title"), 0.9)]
    listed = lambda rule, names: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n, i: row(rule, i, "Concept", n, 0.9))
    many = [listed(4, headings(F.col("content"))), listed(6, tags(F.col("content")))]
    every = docs.select("id", F.explode(F.concat(F.array(*single), *many)).alias("c")).select("id", "c.*")
    at = F.col("line_no") * 1000 + F.col("link_no")
    links = typed_links(docs, dictionary).select("id", F.lit(5).alias("rule"), at.cast("int").alias("pos"), "type", "name", F.lit(0.9).alias("confidence"))
    every = every.unionByName(links)
    if dictionary is not None:
        hits = contains_join(docs.select("id", "content"), "content", dictionary.select("type", "term").where("term <> ''").distinct(), "term")
        every = every.unionByName(hits.select("id", (F.lit(7) + _kind_order(F.col("type"))).alias("rule"), (-F.length("term")).alias("pos"), "type", F.col("term").alias("name"), F.lit(0.95).alias("confidence")))
    return every.where("trim(name) <> ''")


def entities(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """id, corpus_id, ord, type, name, span, source_ids, confidence, doc_id: the first candidate of each (document, type, name in any case). The span is the
    name where the text holds it."""
    order = F.struct("rule", "pos", "name")
    first = entity_candidates(docs, dictionary).groupBy(F.col("id").alias("doc_id"), "type", F.lower("name").alias("_n")).agg(F.min_by(F.struct("name", "confidence", "rule", "pos"), order).alias("c"))
    rows = first.join(docs.select(F.col("id").alias("doc_id"), "corpus_id", "ord", "content"), "doc_id")
    ident = row_id("entity", F.col("doc_id"), F.col("type"), F.col("c.name"))
    return rows.select(ident.alias("id"), "corpus_id", "ord", "type", F.col("c.name").alias("name"), F.when(F.contains("content", F.col("c.name")), F.col("c.name")).alias("span"), F.array("doc_id").alias("source_ids"), F.col("c.confidence").alias("confidence"), "doc_id")


def project_of(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """id, project: of the front matter, else the first link to a project, else the first project of the dictionary that the text holds."""
    fm = docs.select("id", F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.element_at(front_matter(F.col("content")), "project").alias("project"))
    links = typed_links(docs, dictionary).where("type = 'Project'").select("id", F.lit(1).alias("rank"), (F.col("line_no") * 1000 + F.col("link_no")).cast("int").alias("pos"), F.col("name").alias("project"))
    every = fm.unionByName(links)
    if dictionary is not None:
        hits = contains_join(docs.select("id", "content"), "content", dictionary.where("type = 'Project' and term <> ''").select("term").distinct(), "term")
        every = every.unionByName(hits.select("id", F.lit(2).alias("rank"), (-F.length("term")).alias("pos"), F.col("term").alias("project")))
    return every.where("project <> ''").groupBy("id").agg(F.min_by("project", F.struct("rank", "pos", "project")).alias("project"))


def decision_stages(docs: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """id, stage, pos, title, status, rationale, decision_date, project, supersedes, participants, confidence: the decisions of the first stage that gives
    a document any. Stages: 1 rules by title (``literals``: doc_title and the decision's columns), 2 labelled lines, 3 sentences that say that something was decided.

    Labels (Rationale, Status, Date, Project, Supersedes, Participants) belong to the decision line before them; the rationale of a sentence is that of the whole text.
    """
    text = body(F.col("content"))
    block = rf"(?im)^{_LABEL}Decision[ \t]*:[^\n]*+(?:\n(?!{_LABEL}Decision[ \t]*:)[^\n]*+)*+"
    value = lambda b, k: F.get(labelled(b, k), F.lit(0))
    status = lambda b: F.when(F.lower(value(b, "Status")).isin(STATUSES), F.lower(value(b, "Status"))).otherwise("accepted")
    people = lambda b: F.filter(F.transform(F.split(F.coalesce(value(b, "Participants"), F.lit("")), "[;,]"), lambda p: F.trim(p)), lambda p: p != "")
    reason = lambda b: F.when(F.size(labelled(b, "Rationale")) > 0, F.array_join(labelled(b, "Rationale"), " "))
    one = lambda stage, title, st, why, date, project, sup, who, conf: F.struct(
        F.lit(stage).alias("stage"), title.alias("title"), st.alias("status"), why.alias("rationale"), date.alias("decision_date"), project.alias("project"), sup.alias("supersedes"), who.alias("participants"), F.lit(conf).alias("confidence")
    )
    none, fm = F.array().cast("array<string>"), front_matter(F.col("content"))
    day, owner = F.element_at(fm, "date"), F.element_at(fm, "project")
    said = F.transform(
        F.filter(F.regexp_extract_all(text, F.lit(block), F.lit(0)), lambda b: value(b, "Decision").isNotNull()),
        lambda b: one(2, value(b, "Decision"), status(b), reason(b), F.coalesce(value(b, "Date"), day), F.coalesce(value(b, "Project"), owner), labelled(b, "Supersedes"), people(b), 0.88),
    )
    sentences = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![^.\n])[^.\n]++(?:\.|\z)"), F.lit(0)), lambda s: F.rlike(s, F.lit(DECIDED)))
    plain = F.transform(sentences, lambda s: one(3, collapse_ws(F.regexp_replace(s, r"\.$", "")), F.lit("accepted"), reason(text), day, owner, none, none, 0.78))
    found = F.when(F.size(said) > 0, said).otherwise(plain)
    rows = docs.select("id", "title", F.posexplode(found).alias("pos", "d")).select("id", "pos", "d.*")
    if literals is None:
        return rows
    ruled = docs.select("id", F.col("title").alias("doc_title")).join(literals, "doc_title").withColumn("stage", F.lit(1))
    return rows.join(ruled.select("id").distinct(), "id", "left_anti").unionByName(ruled.select("id", "pos", "stage", "title", "status", "rationale", "decision_date", "project", "supersedes", "participants", "confidence"), allowMissingColumns=True)


def decisions(docs: DataFrame, dictionary: DataFrame | None = None, literals: DataFrame | None = None) -> DataFrame:
    """The decisions as rows of the silver table; titles are cut at 160 characters, ids come from the whole title."""
    d = decision_stages(docs, literals).withColumnRenamed("project", "_own").join(project_of(docs, dictionary), "id", "left")
    d = d.join(docs.select("id", "corpus_id", "ord"), "id")
    return d.select(
        row_id("decision", F.col("id"), F.col("title")).alias("id"), "corpus_id", F.concat_ws("/", F.col("ord").cast("string"), F.format_string("%06d", "pos")).alias("ord"), F.left("title", F.lit(160)).alias("title"), "status",
        F.coalesce("_own", "project").alias("project"), "rationale", "decision_date", "supersedes", "participants", F.array("id").alias("source_ids"), "confidence", F.col("id").alias("doc_id"),
    )


def relations(docs: DataFrame, found: DataFrame, decided: DataFrame, dictionary: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """id, corpus_id, ord, subject, predicate, object, source_ids, confidence, doc_id: the project USES each tool that a sentence says it uses, the title is
    RELATED_TO (or MENTIONS) its links, decisions SUPERSEDE others, and known ``pairs`` (subject, predicate, object, confidence) whose both names the document has.

    ``found`` and ``decided`` are the entities and decisions of the same documents."""
    triple = lambda df, s, p, o, c: df.select("doc_id", s.alias("subject"), p.alias("predicate"), o.alias("object"), c.alias("confidence"))
    here = docs.select(F.col("id").alias("doc_id"), "title", "content")
    tools = found.where("type = 'Tool'").select("doc_id", F.col("name").alias("tool")).distinct()
    project = project_of(docs, dictionary).withColumnRenamed("id", "doc_id")
    uses = triple(project.join(tools, "doc_id").join(here, "doc_id").where(positive_use(F.col("content"), F.col("tool"))), F.col("project"), F.lit("USES"), F.col("tool"), F.lit(0.82))
    links = typed_links(docs, dictionary).withColumnRenamed("id", "doc_id")
    links = links.groupBy("doc_id", "name").agg(F.max_by("type", F.struct("line_no", "link_no")).alias("type"), F.min_by("label", F.struct("line_no", "link_no")).alias("label"))
    mention = F.col("type").isin("Person", "Tool") & F.contains("label", F.lit(MENTION_LABEL))
    linked = triple(links.join(here.select("doc_id", "title"), "doc_id").where("title <> ''"), F.col("title"), F.when(mention, "MENTIONS").otherwise("RELATED_TO"), F.col("name"), F.lit(0.9))
    over = triple(decided.select("doc_id", "title", F.explode("supersedes").alias("old")).where("old is not null"), F.col("title"), F.lit("SUPERSEDES"), F.col("old"), F.lit(0.92))
    every = uses.unionByName(linked).unionByName(over)
    if pairs is not None:
        names = found.select("doc_id", "name").distinct()
        both = pairs.join(names.withColumnRenamed("name", "subject"), "subject").join(names.withColumnRenamed("name", "object"), ["doc_id", "object"])
        every = every.unionByName(both.select("doc_id", "subject", "predicate", "object", "confidence"))
    every = every.distinct().join(docs.select(F.col("id").alias("doc_id"), "corpus_id", "ord"), "doc_id")
    return every.select(row_id("relation", F.col("doc_id"), F.col("subject"), F.col("predicate"), F.col("object")).alias("id"), "corpus_id", "ord", "subject", "predicate", "object", F.array("doc_id").alias("source_ids"), "confidence", "doc_id")


MODEL_ROWS = "doc_id string, kind string, pos int, type string, name string, span string, object string, status string, project string, rationale string, decision_date string, participants array<string>, confidence double"


def model_rows(docs: DataFrame, client: Callable[[str, dict], dict], prompt: str, retries: int = 1) -> DataFrame:
    """What a model extracts from each document, checked row by row: kind is entity, relation or decision.

    ``client(prompt, payload)`` returns a mapping with lists entities, relations and decisions; it is pickled to the executors. An answer with
    a row out of schema is asked for again with the error, at most ``retries`` times; after that the valid rows of the last answer count. A client that raises fails the task.
    """

    def read(kind: str, x: object) -> dict | None:
        if not isinstance(x, dict):
            return None
        text = lambda k: x.get(k).strip() if isinstance(x.get(k), str) else None
        conf = x.get("confidence", 0.75 if kind == "entity" else 0.7)
        if isinstance(conf, bool) or not isinstance(conf, int | float) or not 0 <= conf <= 1:
            return None
        out = {"kind": kind, "confidence": float(conf)}
        if kind == "entity":
            out |= {"type": text("type"), "name": text("name"), "span": text("span") or text("name")}
            return out if out["type"] in ENTITY_KINDS and out["name"] else None
        if kind == "relation":
            out |= {"type": text("predicate"), "name": text("subject"), "object": text("object")}
            return out if out["type"] in RELATION_KINDS and out["name"] and out["object"] else None
        out |= {"status": text("status") if "status" in x else "proposed", "name": text("title"), "project": text("project"), "rationale": text("rationale"), "decision_date": text("decision_date")}
        people = x.get("participants", [])
        out["participants"] = [p for p in people if isinstance(p, str)] if isinstance(people, list) else []
        return out if out["status"] in STATUSES and out["name"] else None

    def one(payload: dict) -> list[dict]:
        rows: list[dict] = []
        for attempt in range(retries + 1):
            raw = client(prompt, payload)
            rows, wrong = [], []
            for kind, key in (("entity", "entities"), ("relation", "relations"), ("decision", "decisions")):
                listed = raw.get(key, []) if isinstance(raw, dict) else None
                for x in listed if isinstance(listed, list) else [None]:
                    row = read(kind, x)
                    (rows if row else wrong).append(row or (key, x))
            if not wrong or attempt == retries:
                break
            payload = payload | {"retry_feedback": f"not in the schema: {json.dumps(wrong, ensure_ascii=False, default=str)[:500]}"}
        return rows

    columns = [c.split(" ")[0] for c in MODEL_ROWS.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, title, content in zip(b["id"], b["title"], b["content"], strict=True):
                out += [{"doc_id": i, "pos": k, **r} for k, r in enumerate(one({"source_id": i, "title": title, "content": content}))]
            yield pd.DataFrame([[r.get(c) for c in columns] for r in out], columns=columns, dtype=object)

    return docs.select("id", "title", "content").mapInPandas(scan, MODEL_ROWS)


def with_model(docs: DataFrame, rows: DataFrame, base: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and decisions of the rules (``base``) and, after them, of a model (``rows``); of rows with one key in a document the first stays."""
    found, related, decided = base
    rows = rows.join(docs.select(F.col("id").alias("doc_id"), "corpus_id", "ord", F.element_at(front_matter(F.col("content")), "date").alias("_date")), "doc_id")
    src = F.array("doc_id").alias("source_ids")
    e = rows.where("kind = 'entity'").select(row_id("entity", F.col("doc_id"), F.col("type"), F.col("name")).alias("id"), "corpus_id", "ord", "type", "name", "span", src, "confidence", "doc_id", "pos")
    r = rows.where("kind = 'relation'").select(row_id("relation", F.col("doc_id"), F.col("name"), F.col("type"), F.col("object")).alias("id"), "corpus_id", "ord", F.col("name").alias("subject"), F.col("type").alias("predicate"), "object", src, "confidence", "doc_id", "pos")
    d = rows.where("kind = 'decision'").select(
        row_id("decision", F.col("doc_id"), F.col("name")).alias("id"), "corpus_id", F.concat_ws("/", F.col("ord").cast("string"), F.format_string("m%05d", "pos")).alias("ord"), F.left("name", F.lit(160)).alias("title"), "status", "project", "rationale",
        F.coalesce("decision_date", "_date").alias("decision_date"), F.array().cast("array<string>").alias("supersedes"), "participants", src, "confidence", "doc_id", "pos",
    )
    return _first(found, e, ["type", "name"]), _first(related, r, ["subject", "predicate", "object"]), _first(decided, d, ["title"])


def _first(base: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    both = base.withColumns({"_s": F.lit(0), "pos": F.lit(0)}).unionByName(more.withColumn("_s", F.lit(1)))
    cols = base.columns
    k = [fold(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    first = both.groupBy("doc_id", *k).agg(F.min_by(F.struct(*cols), F.struct("_s", "pos", "ord", *keys)).alias("r"))
    return first.select("r.*")
