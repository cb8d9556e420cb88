"""Knowledge graph: build from silver rows, node and edge upserts, neighbourhood, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import fold, note_name, strip_ws
from memspark.ids import row_id
from memspark.operators.matching import contains_join
from memspark.operators.timeline import union_of

# Folders of notes by type; other types take an s.
FOLDERS = {"Project": "Projects", "Tool": "Tools", "Decision": "Decisions", "Person": "People", "Concept": "Concepts"}
CATEGORY = "Rationale Category: "


def upsert_nodes(entities: DataFrame, order: str = "ord") -> DataFrame:
    """One node for each (type, trimmed case-folded name): the first spelling, the sorted union of sources. Rows without type or name are dropped."""
    keyed = entities.withColumn("canonical_name", fold(F.trim("name"))).where("type is not null and canonical_name <> ''")
    out = keyed.groupBy("type", "canonical_name").agg(F.min_by("name", order).alias("name"), F.count("*").alias("mentions"), union_of("source_ids").alias("source_ids"))
    return out.withColumn("id", row_id("node", F.col("type"), F.col("canonical_name")))


def upsert_edges(relations: DataFrame, order: str = "ord") -> DataFrame:
    """One edge for each (case-folded source, relation, case-folded target): the first spellings, the greatest weight, the number of rows and, where
    rows have source_ids, their sorted union. The id is that of the first spellings."""
    first = F.min_by(F.struct("source", "target"), order).alias("f")
    keyed = relations.withColumns({"s_key": fold("source"), "t_key": fold("target")}).where("s_key is not null and relation is not null and t_key is not null")
    sources = [union_of("source_ids").alias("source_ids")] if "source_ids" in relations.columns else []
    out = keyed.groupBy("s_key", "relation", "t_key").agg(first, F.max("weight").alias("weight"), F.count("*").alias("n_rows"), *sources)
    return out.select(F.col("f.source").alias("source"), "relation", F.col("f.target").alias("target"), "weight", "n_rows", *["source_ids" for _ in sources])


def edge_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", row_id("edge", F.col("source"), F.col("relation"), F.col("target")))


def rationale_name(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit(": "), text)


def build_nodes(entities: DataFrame, decisions: DataFrame, rationales: DataFrame) -> DataFrame:
    """Nodes of entities, of decisions, and of each rationale three: its decision, itself and its category, in that order of arrival. ``ord`` columns are compared as text."""
    row = lambda df, stage, kind, name: df.select(F.concat_ws("/", F.lit(stage), F.col("ord").cast("string")).alias("ord"), kind.alias("type"), name.alias("name"), "source_ids")
    title = F.col("decision_title")
    every = row(entities, "0", F.col("type"), F.col("name")).unionByName(row(decisions, "1", F.lit("Decision"), F.col("title")))
    for stage, kind, name in (("2", "Decision", title), ("3", "Rationale", rationale_name(title, F.col("rationale_text"))), ("4", "Concept", F.concat(F.lit(CATEGORY), "category"))):
        every = every.unionByName(row(rationales, stage, F.lit(kind), name))
    return upsert_nodes(every)


def relation_rows(relations: DataFrame, decisions: DataFrame, rationales: DataFrame, nodes: DataFrame) -> DataFrame:
    """ord, source, relation, target, source_ids, weight: the rows of which edges are made. Relations as they are; decisions HAS_RATIONALE, rationales RELATED_TO their
    category; decisions MADE_IN their project if it has a node, SUPERSEDES others, and if accepted USES each tool whose name stands in title or rationale."""
    row = lambda df, stage, s, r, t, w: df.select(F.concat_ws("/", F.lit(stage), F.col("ord").cast("string")).alias("ord"), s.alias("source"), r.alias("relation"), t.alias("target"), "source_ids", w.alias("weight"))
    named, conf = rationale_name(F.col("decision_title"), F.col("rationale_text")), F.col("confidence")
    named_nodes = lambda kind: nodes.where(F.col("type") == kind).select(fold("name").alias("_k"), F.col("name").alias("_n"))
    keyed = decisions.withColumn("_k", fold("project"))
    made = keyed.join(named_nodes("Project"), "_k")
    texts = decisions.where("status = 'accepted'").withColumn("_x", fold(F.concat_ws(" ", "title", F.coalesce("rationale", F.lit("")))))
    used = contains_join(texts, "_x", named_nodes("Tool"), "_k")
    over = decisions.withColumn("_t", F.explode("supersedes")).where("_t is not null")
    out = row(relations, "0", F.col("subject"), F.col("predicate"), F.col("object"), conf)
    out = out.unionByName(row(rationales, "1", F.col("decision_title"), F.lit("HAS_RATIONALE"), named, conf))
    out = out.unionByName(row(rationales, "2", named, F.lit("RELATED_TO"), F.concat(F.lit(CATEGORY), "category"), conf))
    out = out.unionByName(row(made, "3", F.col("title"), F.lit("MADE_IN"), F.col("_n"), conf))
    out = out.unionByName(row(over, "4", F.col("title"), F.lit("SUPERSEDES"), F.col("_t"), conf))
    return out.unionByName(row(used, "5", F.col("title"), F.lit("USES"), F.col("_n"), conf))


def build_edges(relations: DataFrame, decisions: DataFrame, rationales: DataFrame, nodes: DataFrame) -> DataFrame:
    return edge_id(upsert_edges(relation_rows(relations, decisions, rationales, nodes)))


def neighborhood(edges: DataFrame, name: str) -> DataFrame:
    """Edges that touch a name (case-folded), with the name at the other end. The filter reaches the scan; nothing is shuffled."""
    at = fold(F.lit(name))
    touching = edges.where((fold("source") == at) | (fold("target") == at))
    return touching.withColumn("neighbor", F.when(fold("source") == at, F.col("target")).otherwise(F.col("source")))


def around(nodes: DataFrame, edges: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) about a part of a name: the edges that have it in an end, and the nodes that are such an end or have it in their own name."""
    part = fold(F.lit(entity))
    touching = edges.where(F.contains(fold("source"), part) | F.contains(fold("target"), part))
    ends = touching.select(F.explode(F.array(fold("source"), fold("target"))).alias("_k")).distinct()
    named = nodes.withColumn("_k", fold("name"))
    hit = named.join(ends.withColumn("_e", F.lit(True)), "_k", "left").where(F.col("_e").isNotNull() | F.contains("_k", part))
    return hit.drop("_k", "_e"), touching


def kg_entities(nodes: DataFrame) -> DataFrame:
    """Entities of a custom knowledge graph export; the source is the first one, or empty."""
    return nodes.select(F.col("name").alias("entity_name"), F.col("type").alias("entity_type"), F.coalesce(F.get("source_ids", F.lit(0)), F.lit("")).alias("source_id"))


def kg_relationships(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("src_id"), F.col("target").alias("tgt_id"), F.col("relation").alias("description"), F.col("relation").alias("keywords"), "weight", F.coalesce(F.get("source_ids", F.lit(0)), F.lit("")).alias("source_id"))


def kg_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of the export: the active documents."""
    return docs.select("content", F.col("id").alias("source_id"))


def kg_json(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """kind, value: the export as JSON rows of entities, relationships and chunks; the description of an entity is its name."""
    entity = F.to_json(F.struct("entity_name", "entity_type", F.col("entity_name").alias("description"), "source_id"))
    out = kg_entities(nodes).select(F.lit("entities").alias("kind"), entity.alias("value"))
    out = out.unionByName(kg_relationships(edges).select(F.lit("relationships").alias("kind"), F.to_json(F.struct("*")).alias("value")))
    return out.unionByName(kg_chunks(docs).select(F.lit("chunks").alias("kind"), F.to_json(F.struct("*")).alias("value")))


def folder(kind: Column) -> Column:
    out = F.concat(kind, F.lit("s"))
    for k, f in FOLDERS.items():
        out = F.when(kind == k, f).otherwise(out)
    return out


def note_link(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("[["), folder(kind), F.lit("/"), note_name(name), F.lit("|"), name, F.lit("]]"))


def vault_index(nodes: DataFrame) -> DataFrame:
    """type, k, line: the lines of the index, a row for each distinct name of a type. Rows, not one text, as a type may hold most of all nodes; a sort by type, k and
    line gives the index its order, in ranges over many tasks."""
    names = nodes.where("type is not null and name is not null").select("type", "name").distinct()
    return names.select("type", fold("name").alias("k"), F.concat(F.lit("- "), note_link(F.col("type"), F.col("name"))).alias("line"))


def vault_notes(nodes: DataFrame, edges: DataFrame, timeline: DataFrame) -> DataFrame:
    """path, content: one note for each node, in the folder of its type. Notes of decisions with an event say status, project, summary, tools and related decisions.

    Ends of edges are met case-folded. Names that make one path get their node's id after it, so no note replaces another. A note lists
    its node's edges, so it is as long as they are many.
    """
    from pyspark.sql import Window

    ends = edges.select(fold("source").alias("_k"), "relation", F.col("target").alias("other"), F.lit(True).alias("out")).unionByName(edges.where(fold("source") != fold("target")).select(fold("target").alias("_k"), "relation", F.col("source").alias("other"), F.lit(False).alias("out")))
    lists = ends.groupBy("_k").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("- "), "relation", F.lit(": "), "other"))).alias("lines"),
        F.array_sort(F.collect_set(F.when(F.col("out") & (F.col("relation") == "USES"), F.col("other")))).alias("tools"),
        F.array_sort(F.collect_set(F.when(F.col("out") & (F.col("relation") == "SUPERSEDES"), F.col("other")))).alias("older"),
        F.min(F.when(F.col("out") & (F.col("relation") == "MADE_IN"), F.col("other"))).alias("made_in"),
    )
    events = timeline.select(F.col("title_key").alias("_t"), "status", "project", "rationale")
    rows = nodes.withColumn("_k", fold("name")).withColumn("_t", F.when(F.col("type") == "Decision", F.trim(F.regexp_replace("_k", r"(?U)\s+", " ")))).join(lists, "_k", "left").join(events, "_t", "left")
    base = F.concat(folder(F.col("type")), F.lit("/"), note_name(F.col("name")))
    rows = rows.withColumn("_base", base).withColumn("_n", F.count("*").over(Window.partitionBy("_base")))
    bullets = lambda c, kind=None: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), note_link(F.lit(kind), x) if kind else x))
    text = lambda *parts: F.array_join(F.flatten(F.array(*[p if isinstance(p, Column) else F.array(F.lit(p)) for p in parts])), "\n")
    one = lambda *cs: F.array(F.concat(*cs))
    links = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array(F.lit("- n/a")))
    is_event = F.col("_t").isNotNull() & F.col("status").isNotNull()
    project = F.coalesce("project", "made_in")
    plain = text("---", one(F.lit("type: "), "type"), one(F.lit("canonical_name: "), "canonical_name"), "---", "", one(F.lit("# "), "name"), "", "## Relations", links, "", "## Sources", bullets("source_ids"), "")
    decided = text(
        "---", "type: Decision", one(F.lit("canonical_name: "), "canonical_name"), one(F.lit("status: "), "status"), "---", "", one(F.lit("# "), "name"), "", one(F.lit("Status: "), "status"),
        one(F.lit("Project: "), F.coalesce(note_link(F.lit("Project"), project), F.lit("n/a"))), "", "## Summary", "", F.array(F.coalesce(F.when(strip_ws("rationale") != "", F.col("rationale")), F.col("name"))), "",
        "## Related Tools", bullets("tools", "Tool"), "", "## Sources", bullets("source_ids"), "", "## Related Decisions", bullets("older", "Decision"), "", "## Relations", links, "",
    )
    path = F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit(" "), "id")).otherwise(""), F.lit(".md"))
    return rows.select(path.alias("path"), F.when(is_event, decided).otherwise(plain).alias("content"))
