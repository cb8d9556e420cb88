"""The memory engine's queries over the domain and star-schema tables, with their SQL. Arrays are joined to text so that results compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import text
from memspark.functions.text import fold, strip_ws
from memspark.operators import bronze, chunking, context, contract, graph, personal, planning, quality, rationale, recall, silver, timeline
from memspark.operators.snapshots import snapshot_diff
from memspark.operators.work import broadcast_if_small
from memspark.plans.general_queries import table
from memspark.plans.mql import run_mql

#: Example inputs: a dictionary of terms, question terms, rules and an ontology are the caller's data.
DICTIONARY = ["sync cursor", "token cache", "retry queue", "lineage map", "review inbox", "export vault"]
QUERY = ["sync", "cursor", "retry"]
QUESTION = "Which decision moved the sync cursor?"
HINTS = [(1, 1, "sync cursor"), (1, 2, "Sync cursor"), (1, 3, "retry queue"), (2, 1, "slack:"), (2, 2, "no such hint")]
RULES = [(1, ["sync", "cursor"], "cursor"), (2, ["retry"], "queue"), (3, ["token", "cache"], "cache")]
ONTOLOGY = [("SUPPLIES", ["AUTOMOBILE", "BUILDING"], ["1-URGENT", "2-HIGH"]), ("USES", ["FURNITURE"], ["5-LOW"])]


def _merged(spark, d):
    return timeline.merge_timeline(table(spark, d, "silver_decisions"))


def _resolved(spark, d):
    return timeline.resolve_supersession(_merged(spark, d), timeline.supersession_edges(table(spark, d, "silver_decisions")))


def timeline_merge(spark, d):
    return _merged(spark, d).select("title_key", "title", "status", "project", "rationale", "valid_from", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("participants", ",").alias("participants"), F.round("confidence", 4).alias("confidence"))


def timeline_links(spark, d):
    links = timeline.with_links(_resolved(spark, d), timeline.supersession_edges(table(spark, d, "silver_decisions")))
    return links.select("title_key", F.array_join("supersedes", "|").alias("supersedes"), F.array_join("superseded_by", "|").alias("superseded_by"))


def timeline_start(spark, d):
    """The first twenty events by start, those without one last."""
    return timeline.in_order(_resolved(spark, d)).select("title_key", "valid_from", "ord").limit(20)


def current_titles(spark, d):
    return timeline.current_titles(_resolved(spark, d))


def timeline_resolved(spark, d):
    return _resolved(spark, d).select("title_key", "status", "valid_from", "valid_to", "n_superseded_by", "n_supersedes", "current")


def current_decisions(spark, d):
    return timeline.decisions(_resolved(spark, d), current_only=True).select("title_key", "project", "valid_from")


def decisions_filtered(spark, d):
    return timeline.decisions(_resolved(spark, d), project="console", since="2021-01-01", until="2023-12-31").select("title_key", "project", "status", "valid_from")


def memory_diff_7d(spark, d):
    return timeline.memory_diff(_resolved(spark, d))


def supersedes_index(spark, d):
    return timeline.supersession_edges(table(spark, d, "silver_decisions"))


def mql_find(spark, d):
    return run_mql("FIND decisions WHERE current=true", _resolved(spark, d))


def mql_why(spark, d):
    return run_mql('WHY decision="retry queue"', _resolved(spark, d))


def mql_why_rationale(spark, d):
    """Why, answered from the rationale memory of the decisions' own texts."""
    decided = table(spark, d, "silver_decisions").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))
    reasons = rationale.rationales(decided, table(spark, d, "bronze_documents"), spark.createDataFrame([], "spec_ord long, decision_title string, text string, category string, markers array<string>"))
    return run_mql('WHY decision="adopt duplicated retry queue"', _resolved(spark, d), reasons).select("operation", "title_key", "answer")


def mql_show_timeline(spark, d):
    return run_mql('SHOW timeline FOR project="console"', _resolved(spark, d))


def mql_show_changes(spark, d):
    return run_mql("SHOW changes LAST 30 days", _resolved(spark, d))


def bronze_identity(spark, d):
    return bronze.with_identity(table(spark, d, "bronze_documents").select("ord", "content")).select("ord", "id", "content_hash")


def bronze_dedup(spark, d):
    return bronze.first_by_hash(table(spark, d, "bronze_documents").select("ord", "source_id", "content_hash")).select("content_hash", "ord", "source_id")


def bronze_put(spark, d):
    rows = table(spark, d, "bronze_documents").select("ord", "corpus_id", "content_hash")
    return bronze.put(rows.where("corpus_id = 'corpus_main'"), rows.where("corpus_id <> 'corpus_main'")).select("content_hash", "ord")


def bronze_hard_chunks(spark, d):
    rows = table(spark, d, "bronze_documents").select("ord", F.posexplode(chunking.hard_windows(F.col("content"))).alias("i", "chunk"))
    return rows.select("ord", (F.col("i") + 1).cast("long").alias("chunk_no"), F.sha2("chunk", 256).alias("chunk_hash"), F.length("chunk").cast("long").alias("n_chars"))


def bronze_sections(spark, d):
    return chunking.sections(table(spark, d, "bronze_documents"), "ord", "content").select("ord", F.col("section_no").cast("long").alias("section_no"), "title", "path", F.length("body").cast("long").alias("n_chars"))


def bronze_active_view(spark, d):
    return table(spark, d, "bronze_documents").where(bronze.is_active(F.col("metadata"))).groupBy("source_type").agg(F.count("*").alias("n_active"))


def bronze_stale(spark, d):
    """Incoming rows: of each root those that arrived last, by the latest created_at; stored are all rows."""
    rows = table(spark, d, "bronze_documents").select("ord", "root_source_id", "content_hash", "created_at")
    last = rows.groupBy("root_source_id").agg(F.max("created_at").alias("created_at"))
    fresh = rows.join(last, ["root_source_id", "created_at"])
    return bronze.mark_stale(rows.withColumn("active", F.lit(True)), fresh, fresh).groupBy("root_source_id").agg(F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_stale"))


def _snapshot_sides(spark, d):
    """The listings of each two consecutive delivered snapshots of a connector; snapshot_no is the later one's."""
    rows = bronze.latest_by(table(spark, d, "connector_snapshots").select("corpus_id", "connector", "snapshot_no", strip_ws("source_id").alias("source_id"), "loaded_at", "content_hash"), ["corpus_id", "connector", "snapshot_no", "source_id"], ["loaded_at", "content_hash"])
    order = Window.partitionBy("corpus_id", "connector").orderBy("snapshot_no")
    pairs = broadcast_if_small(rows.select("corpus_id", "connector", "snapshot_no").distinct().select("*", F.lag("snapshot_no").over(order).alias("before")).where("before is not null"))
    old = rows.withColumnRenamed("snapshot_no", "before").join(pairs, ["corpus_id", "connector", "before"]).drop("before")
    return old, rows.join(pairs.drop("before"), ["corpus_id", "connector", "snapshot_no"])


def connector_diff(spark, d):
    """new, changed, unchanged and removed items of each two consecutive delivered snapshots of a connector."""
    return contract.listing_diff(*_snapshot_sides(spark, d), ["corpus_id", "connector", "snapshot_no", "source_id"], "content_hash")


def connector_counts(spark, d):
    return contract.diff_counts(connector_diff(spark, d), ["corpus_id", "connector", "snapshot_no"])


def connector_diff_all(spark, d):
    """As connector_diff, without the unchanged items."""
    return snapshot_diff(*_snapshot_sides(spark, d), ["corpus_id", "connector", "snapshot_no", "source_id"], ["content_hash"])


def node_upsert(spark, d):
    return graph.upsert_nodes(table(spark, d, "silver_entities")).select("id", "type", "canonical_name", "name", "mentions", F.array_join("source_ids", ",").alias("source_ids"))


def _edges(spark, d):
    li, s, p = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "part")
    named = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    return named.select(F.col("s_name").alias("source"), F.lit("SUPPLIES").alias("relation"), F.col("p_name").alias("target"), F.round(1 - F.col("l_discount"), 4).alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def edge_upsert(spark, d):
    return graph.upsert_edges(_edges(spark, d))


def graph_neighborhood(spark, d):
    return graph.neighborhood(graph.upsert_edges(_edges(spark, d)), "supplier#000000003").select("source", "target", "neighbor", "weight")


def custom_kg_entities(spark, d):
    return graph.kg_entities(graph.upsert_nodes(table(spark, d, "silver_entities")))


def custom_kg_relationships(spark, d):
    edges = graph.upsert_edges(_edges(spark, d).withColumn("source_ids", F.array(F.col("ord").cast("string"))))
    return graph.kg_relationships(edges).select("src_id", "tgt_id", "description", "keywords", "weight", F.coalesce("source_id", F.lit("")).alias("source_id"))


def custom_kg_chunks(spark, d):
    docs = table(spark, d, "bronze_documents").where(bronze.is_active(F.col("metadata")))
    return graph.kg_chunks(docs).select("source_id", F.sha2("content", 256).alias("content_hash"))


def graph_around(spark, d):
    nodes, edges = graph.around(_named_nodes(spark, d), graph.upsert_edges(_edges(spark, d)), "Supplier#00000001")
    return nodes.select(F.lit("node").alias("kind"), F.col("name").alias("value")).unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "relation", "target").alias("value")))


def _named_nodes(spark, d):
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    rows = s.select(F.col("s_suppkey").alias("ord"), F.lit("Tool").alias("type"), F.col("s_name").alias("name")).unionByName(p.select(F.col("p_partkey").alias("ord"), F.lit("Concept").alias("type"), F.col("p_name").alias("name")))
    return graph.upsert_nodes(rows.withColumn("source_ids", F.array(F.concat_ws(":", "type", "ord"))))


def vault_index(spark, d):
    return graph.vault_index(table(spark, d, "gold_nodes")).select("type", "line")


def vault_notes(spark, d):
    """Notes of the nodes of all entities and decisions; edges are the supersessions."""
    found, decided = table(spark, d, "silver_entities").select("ord", "type", "name", "source_ids"), table(spark, d, "silver_decisions")
    nodes = graph.upsert_nodes(found.unionByName(decided.select("ord", F.lit("Decision").alias("type"), F.col("title").alias("name"), "source_ids")))
    rows = decided.select("ord", F.col("title").alias("source"), F.explode("supersedes").alias("target")).select("ord", "source", F.lit("SUPERSEDES").alias("relation"), "target", F.lit(1.0).alias("weight"))
    return graph.vault_notes(nodes, graph.upsert_edges(rows.where("target is not null")), _merged(spark, d)).select("path", F.sha2("content", 256).alias("content_hash"))


def confidence_gate(spark, d):
    return silver.confidence_gate(table(spark, d, "silver_entities")).groupBy("type").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_rejected"))


def grounding_gate(spark, d):
    return silver.grounding_gate(table(spark, d, "silver_entities"), table(spark, d, "bronze_documents"))


def _relations(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, "SUPPLIES").otherwise("USES").alias("relation"), F.col("c_mktsegment").alias("source_type"), F.col("o_orderpriority").alias("target_type"))


def type_gate(spark, d):
    ontology = spark.createDataFrame(ONTOLOGY, "relation string, domain array<string>, range array<string>")
    return silver.type_gate(_relations(spark, d), ontology).select("ord", "ok")


def rejects(spark, d):
    gate = silver.grounding_gate(table(spark, d, "silver_entities"), table(spark, d, "bronze_documents"))
    rows = silver.confidence_gate(table(spark, d, "silver_entities")).join(gate, "ord")
    return rows.where("not ok or not grounded").select("ord", "type", "name", F.lit("validation_failed").alias("reason"))


def tool_mentions(spark, d):
    words = spark.createDataFrame([(w,) for w in DICTIONARY], "term string")
    return silver.mentions(table(spark, d, "bronze_documents"), "ord", "content", words)


def tokenize_terms(spark, d):
    t = silver.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort(t), " ")).alias("terms_hash"))


def decision_lines(spark, d):
    return silver.decision_lines(table(spark, d, "bronze_documents"), "ord", "content").select("ord", F.col("pos").cast("long").alias("pos"), "statement")


def front_matter_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.element_at(silver.front_matter(F.col("text")), "title").alias("title")).where("title is not null")


def _matches(spark, d, text):
    docs = table(spark, d, "bronze_documents").where(bronze.is_active(F.col("metadata"))).select("id", "source_id", "source_type", "content")
    edges = timeline.supersession_edges(table(spark, d, "silver_decisions")).select("source", F.lit("SUPERSEDES").alias("relation"), "target", F.array().cast("array<string>").alias("source_ids"))
    return docs, recall.answer_matches(text, docs, _resolved(spark, d), graph.upsert_nodes(table(spark, d, "silver_entities")), edges)


def keyword_search(spark, d):
    """The first ten matches of a question in all four stages: documents, timeline, nodes, edges."""
    return recall.keyword_answer(_matches(spark, d, QUESTION)[1])


def keyword_matches(spark, d):
    """How many matches each stage gives to a question on decisions, and how many sources they name."""
    m = _matches(spark, d, QUESTION)[1]
    return m.groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.size("source_ids") > 0).alias("n_sourced")).select(F.col("stage").cast("long").alias("stage"), "n", "n_sourced")


def keyword_sources(spark, d):
    docs, m = _matches(spark, d, QUESTION)
    return recall.match_sources(m, docs).select("id", "source_id", "source_type")


def hint_sources(spark, d):
    hints = spark.createDataFrame(HINTS, "group long, hint_ord long, hint string")
    return recall.hint_sources(table(spark, d, "bronze_documents"), hints, "ord")


def retrieve_topk(spark, d):
    """Nodes, edges and documents that hold the whole question, the first eight."""
    docs = table(spark, d, "bronze_documents").where(bronze.is_active(F.col("metadata")))
    edges = timeline.supersession_edges(table(spark, d, "silver_decisions")).select("source", F.lit("SUPERSEDES").alias("relation"), "target")
    return recall.retrieve("retry queue", table(spark, d, "gold_nodes").where("type = 'Tool'"), edges, docs).select(F.col("stage").cast("long").alias("stage"), "kind", "key")


def retrieve_counts(spark, d):
    docs = table(spark, d, "bronze_documents").where(bronze.is_active(F.col("metadata")))
    edges = timeline.supersession_edges(table(spark, d, "silver_decisions")).select("source", F.lit("SUPERSEDES").alias("relation"), "target")
    return recall.retrieve_matches("console", table(spark, d, "gold_nodes"), edges, docs).groupBy("kind").agg(F.count("*").alias("n"))


def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", recall.snippet(F.col("text"), ["cursor", "queue"]).alias("snippet"))


def rule_answer(spark, d):
    rules = spark.createDataFrame(RULES, "rule_ord long, terms array<string>, answer string")
    return recall.rule_answers(table(spark, d, "documents"), "doc_id", "text", rules)


def rule_precedence(spark, d):
    """Three rule sets tried in their order, whatever the numbers of their rules."""
    rules = spark.createDataFrame([(3 - i, r, t, a) for i, (r, t, a) in enumerate(RULES)], "set_ord long, rule_ord long, terms array<string>, answer string")
    return recall.rule_answers(table(spark, d, "documents"), "doc_id", "text", rules).select("doc_id", "set_ord", "answer")


def _packed(spark, d):
    items = table(spark, d, "bronze_documents").selectExpr("root_source_id grp", "ord item", "ord", "cast(coalesce(section_level, 0) as double) priority", "content")
    return context.pack_context(items, "grp", "item", 3000)


def context_pack(spark, d):
    return _packed(spark, d).select("grp", "item", "kind", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("text_hash"))


def context_restore(spark, d):
    return context.restore_context(_packed(spark, d), "grp", "item").select("grp", "item", F.sha2("content", 256).alias("text_hash"))


def load_plan(spark, d):
    return planning.load_plan(table(spark, d, "bronze_documents"), "content", "root_source_id").drop("advice")


def largest_chunks(spark, d):
    return planning.largest_chunks(table(spark, d, "bronze_documents"), "ord", "content")


def _memories(spark, d):
    """Each memory once: its latest row."""
    return bronze.latest_by(table(spark, d, "personal_memories").select("id", "type", "title", "content", "tags", "source", "source_id", "created_at"), ["id"], ["created_at", "type", "content"])


def personal_recall(spark, d):
    return personal.recall(_memories(spark, d), "review").select("id", "type", "title")


def personal_summary(spark, d):
    """Confidence, depth and sources of what several words recall; of the third only decisions."""
    rows = [personal.recall_summary(personal.recall(_memories(spark, d), w, k)).select(F.lit(w).alias("words"), "*") for w, k in (("queue", None), ("console", None), ("cursor", "Decision"), ("no such words", None))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def personal_import(spark, d):
    """Memories of all chunks, one for each source_id."""
    docs = table(spark, d, "bronze_documents").select("ord", "content", "source_type", "source_id", "metadata", "created_at")
    return personal.from_chunks(docs).select("id", "type", "title", "source", "source_id", F.array_join("tags", ",").alias("tags"))


def personal_next_actions(spark, d):
    return personal.next_actions(_memories(spark, d)).select("id", "type", "title")


def personal_timeline(spark, d):
    return personal.between(_memories(spark, d), "2024-01-01 02:00:00").select("id", "type", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def corpus_suggest(spark, d):
    """Corpora ranked for a source folder by their last path, shared roots and shared words; a corpus's last path is stood in for by its name and greatest root."""
    rows = table(spark, d, "bronze_documents").select("corpus_id", F.col("root_source_id").alias("root"))
    paths = rows.groupBy("corpus_id").agg(F.concat(F.lit("/data/"), "corpus_id", F.lit("/"), F.max("root")).alias("last_source_path"))
    roots = table(spark, d, "bronze_documents").where("source_type = 'markdown'").select(F.col("root_source_id").alias("root")).distinct()
    return planning.rank_corpora(rows.join(paths, "corpus_id"), "/data/corpus_ops", roots)


def sync_latest(spark, d):
    rows = table(spark, d, "connector_diffs").select("corpus_id", "connector", "started_at", "id", "status", "fetched")
    return bronze.latest_by(rows, ["corpus_id", "connector"], ["started_at", "id"]).select("corpus_id", "connector", "id", "status", "fetched")


def sync_history(spark, d):
    return contract.sync_history(table(spark, d, "connector_diffs"), "gmail", 15).select("id", "status", "fetched")


def high_water_mark(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("mark"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def message_threads(spark, d):
    """The messages of each thread joined in order of arrival; a thread is one text, as the readers give it."""
    rows = table(spark, d, "bronze_documents").where("source_type in ('slack', 'gmail')").select("ord", "corpus_id", "root_source_id", "source_id", "content")
    # the messages of one source id make its text, so a channel of any size is many rows
    texts = rows.groupBy("corpus_id", "root_source_id", "source_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n\n").alias("t"))
    return texts.select("corpus_id", "root_source_id", "source_id", "n_messages", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_hash"))


def quality_metrics(spark, d):
    """Pass rates of decisions by status: a decision passes if it names a source; its weight is its confidence in hundredths."""
    rows = table(spark, d, "silver_decisions").withColumns({"ok": F.size(F.coalesce("source_ids", F.array())) > 0, "w": F.floor(F.coalesce("confidence", F.lit(0.0)) * 100).cast("long")})
    return quality.pass_rates(rows, "status", "ok", "w")


def triple_recall(spark, d):
    """Which superseding pairs of the timeline the extracted decisions have, by status of the superseded event."""
    edges = timeline.supersession_edges(table(spark, d, "silver_decisions")).withColumn("relation", F.lit("SUPERSEDES"))
    gold = table(spark, d, "gold_timeline_events").select("id", F.col("title").alias("object"), "status", F.explode("superseded_by").alias("subject")).where("subject <> ''")
    cases = gold.groupBy("subject", "object").agg(F.min(F.struct("id", "status")).alias("g")).select(F.concat_ws("/", "g.id", "subject").alias("case_id"), F.col("g.status").alias("group"), "subject", "object")
    cases = cases.withColumn("relations", F.array(F.lit("SUPERSEDES"), F.lit("REPLACES")))
    return quality.recall_by_group(quality.found_triples(edges, cases), cases.select("case_id", "group", F.lit(1).alias("minimum")))


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return recall.nearest(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), 10).select("query", "key", "similarity", "rn")


def text_names(spark, d):
    """Names of nodes as slugs, file names, parts of paths and of notes."""
    n = F.col("name")
    return table(spark, d, "gold_nodes").where("name is not null").select("id", text.slug(n).alias("slug"), text.file_name(n).alias("file_name"), text.path_part(n).alias("path_part"), text.note_name(n).alias("note_name"), F.array_join(text.ascii_tokens(n), " ").alias("tokens")).distinct()


def model_json(spark, d):
    """JSON objects found in fenced answers and between other words, null where there is none."""
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: "), "props", F.lit(" as asked"))).otherwise("none")
    return e.select("event_id", text.embedded_json(said).alias("value"))


def redacted_secrets(spark, d):
    m = text.redact_secrets(F.create_map(F.lit("Token"), "props", F.lit("kind"), "event_type"))
    return table(spark, d, "events").select("event_id", F.element_at(m, "Token").alias("token"), F.element_at(m, "kind").alias("kind"))


def machine_tiers(spark, d):
    return table(spark, d, "part").select("p_partkey", planning.machine_tier(F.col("p_size") * 4).alias("tier"))


def evicted_entities(spark, d):
    """Entities without what only chunks of one chat channel say."""
    gone = table(spark, d, "bronze_documents").where("root_source_id = 'slack:ops-general'").select("id")
    rows = bronze.without_sources(table(spark, d, "silver_entities").select("ord", "name", "source_ids"), gone, "ord")
    return rows.select("ord", "name", F.array_join("source_ids", ",").alias("source_ids"))


def using_entities(spark, d):
    gone = table(spark, d, "bronze_documents").where("root_source_id = 'slack:ops-general'").select("id")
    return bronze.using_sources(table(spark, d, "silver_entities").select("ord", "name", "source_ids"), gone, "ord").select("ord", "name")


def bronze_removed(spark, d):
    docs = table(spark, d, "bronze_documents").select("ord", "id", "root_source_id")
    return bronze.remove(docs, docs.where("root_source_id = 'slack:ops-general'")).select("ord", "id")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_K = r"nullif(replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ß', 'ss'), '')"
_F = "replace(lower({}), 'ß', 'ss')"
_RANK = "case status when 'accepted' then 4 when 'proposed' then 3 when 'rejected' then 2 when 'superseded' then 1 else 0 end"
_MERGED = f"""sd as (select *, {_K.format("title")} as k from silver_decisions where {_K.format("title")} is not null),
src as (select k, string_agg(distinct u.x, ',' order by u.x) as source_ids from sd, unnest(source_ids) as u(x) group by k),
par as (select k, string_agg(distinct u.x, ',' order by u.x) as participants from sd, unnest(participants) as u(x) group by k),
merged as (select k as title_key, arg_min(title, ord) as title, arg_max(status, ({_RANK}, -ord)) as status, arg_min(project, ord) filter (where trim(project) <> '') as project,
  arg_min(rationale, ord) filter (where trim(rationale) <> '') as rationale, min(decision_date) filter (where trim(decision_date) <> '') as valid_from, coalesce(max(confidence), 0) as confidence from sd group by k),
edges as (select distinct {_K.format("title")} as source, {_K.format("u.x")} as target from silver_decisions, unnest(supersedes) as u(x) where {_K.format("title")} is not null and {_K.format("u.x")} is not null),
resolved as (select m.*, coalesce(b.n, 0) as n_superseded_by, b.valid_to, coalesce(o.n, 0) as n_supersedes, coalesce(m.status = 'accepted', false) and b.n is null as current from merged m
  left join (select target, count(*) as n, min(s.valid_from) as valid_to from edges left join merged s on s.title_key = source group by 1) b on b.target = m.title_key
  left join (select source, count(*) as n from edges group by 1) o on o.source = m.title_key)"""
_EDGES = """e as (select s_name as source, p_name as target, round(1 - l_discount, 4) as weight, l_orderkey * 10 + l_linenumber as ord from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey),
up as (select arg_min(source, ord) as source, 'SUPPLIES' as relation, arg_min(target, ord) as target, max(weight) as weight, count(*) as n_rows from e group by lower(source), lower(target))"""
_NODES = f"""n as (select type, {_F.format("trim(name, ' ')")} as c, arg_min(name, ord) as name, count(*) as mentions from silver_entities where type is not null and trim(name, ' ') <> '' group by 1, 2),
ns as (select type, {_F.format("trim(name, ' ')")} as c, array_to_string(list_sort(list_distinct(flatten(list(source_ids)))), ',') as source_ids, list_sort(list_distinct(flatten(list(source_ids)))) as l from silver_entities group by 1, 2)"""
_GROUND = """hit as (select distinct e.ord from silver_entities e, unnest(e.source_ids) as u(x) join (select id, any_value(content) as content from bronze_documents group by id) b on b.id = u.x
  where contains(b.content, trim(regexp_replace(e.span, '^…|…$', '', 'g'), ' '))),
g as (select ord, span is null or ord in (select ord from hit) as grounded from silver_entities)"""
_ANY = lambda c, ts: " or ".join(f"contains({_F.format(c)}, '{t}')" for t in ts)
_TERMS = r"list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[0-9a-zA-Z가-힣]+'), lambda t: length(t) > 1)"

_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_SNAPS = r"""r as (select corpus_id, connector, snapshot_no, regexp_replace(source_id, '^\s+|\s+$', '', 'g') as source_id, content_hash, loaded_at from connector_snapshots),
o as (select * from r qualify row_number() over (partition by corpus_id, connector, snapshot_no, source_id order by loaded_at desc, content_hash desc nulls last) = 1),
s as (select corpus_id, connector, snapshot_no, lag(snapshot_no) over (partition by corpus_id, connector order by snapshot_no) as before from (select distinct corpus_id, connector, snapshot_no from o)),
a as (select o.corpus_id, o.connector, s.snapshot_no, source_id, content_hash from o join s on s.corpus_id = o.corpus_id and s.connector = o.connector and s.before = o.snapshot_no),
b as (select o.* from o join s using (corpus_id, connector, snapshot_no) where s.before is not null),
ch as (select coalesce(a.corpus_id, b.corpus_id) as corpus_id, coalesce(a.connector, b.connector) as connector, coalesce(a.snapshot_no, b.snapshot_no) as snapshot_no, coalesce(a.source_id, b.source_id) as source_id,
  case when a.source_id is null then 'new' when b.source_id is null then 'removed' when a.content_hash is distinct from b.content_hash then 'changed' else 'unchanged' end as change
  from a full join b on a.corpus_id = b.corpus_id and a.connector = b.connector and a.snapshot_no = b.snapshot_no and a.source_id = b.source_id)"""
_LINKED = "links as (select m.title_key, coalesce((select array_to_string(list_sort(list(target)), '|') from edges where source = m.title_key), '') as supersedes, coalesce((select array_to_string(list_sort(list(source)), '|') from edges where target = m.title_key), '') as superseded_by from merged m)"
_ACTIVE = "docs as (select * from bronze_documents where coalesce(json_extract_string(metadata, '$.active') <> 'false', true))"
_Q = QUESTION.lower()
_QT = ["which", "decision", "moved", "the", "sync", "cursor"]
_START = "coalesce(case when trim(valid_from, ' ') <> '' then valid_from end, '9999-99-99')"


def _snippet(c: str, ts: list[str]) -> str:
    """SQL of the best sentence of a text and its neighbours."""
    plain = rf"regexp_replace(regexp_replace(regexp_replace({c}, '(?s)^---\s*\n.*?\n---\s*\n', ''), '(?m)^[ \t]*#[^\n]*$', '', 'g'), '\[\[|\]\]', '', 'g')"
    parts = rf"list_filter(list_transform(string_split_regex(regexp_replace({plain}, '([.!?。다])[\s\p{{Z}}\x{{85}}]+', '\1' || chr(10), 'g'), '\n+'), lambda x: {_STRIP('x')}), lambda x: x <> '')"
    score = " + ".join(f"cast(contains({_F.format('x')}, '{t}') as int)" for t in ts)
    return f"""(select case when len(p) = 0 then '' when m = 0 then p[1] else array_to_string(p[greatest(b - 1, 1):b + 1], ' ') end
  from (select p, list_max(sc) as m, list_position(sc, list_max(sc)) as b from (select p, list_transform(p, lambda x: {score}) as sc from (select {parts} as p))))"""


_MATCHES = f"""{_ACTIVE}, {_MERGED}, {_NODES},
m1 as (select 1 as stage, id as key, source_id || ': ' || {_snippet("content", _QT)} as match, [id] as src from docs where {_ANY("content", _QT)}),
m2 as (select 2 as stage, {_START} || '/' || title_key as key, 'Decision: ' || title || case when status <> '' then ', status: ' || status else '' end || case when project <> '' then ', project: ' || project else '' end || case when current then ', current: true' else ', current: false' end as match,
  (select list_sort(list(distinct u.x)) from sd, unnest(sd.source_ids) as u(x) where sd.k = title_key) as src from resolved where {_ANY("concat_ws(' ', title, project, rationale, status)", _QT)} or coalesce(trim(project, ' ') <> '' and contains('{_Q}', {_F.format("project")}), false)),
m3 as (select 3 as stage, n.type || '/' || n.c as key, n.type || ': ' || n.name as match, l as src from n join ns on n.type = ns.type and n.c = ns.c where contains('{_Q}', {_F.format("n.name")}) or {_ANY("concat_ws(' ', n.type, n.name, n.c)", _QT)}),
m4 as (select 4 as stage, source || '/SUPERSEDES/' || target as key, source || ' -[SUPERSEDES]-> ' || target as match, cast([] as varchar[]) as src from edges where {_ANY("concat_ws(' ', source, 'SUPERSEDES', target)", _QT)}),
every as (select * from m1 union all select * from m2 union all select * from m3 union all select * from m4),
matches as (select match, min(stage) as stage, min_by(key, (stage, key)) as key, list_distinct(flatten(list(coalesce(src, [])))) as src from every group by match)"""
_RETRIEVE = lambda q, where: f"""{_ACTIVE}, {_MERGED}, hit as (select 1 as stage, 'node' as kind, id as key, name as label from gold_nodes where {where} and (contains({_F.format("name")}, '{q}') or contains({_F.format("type")}, '{q}'))
  union select 2, 'edge', source || '/SUPERSEDES/' || target, source || ' SUPERSEDES ' || target from edges where contains(lower(source || ' SUPERSEDES ' || target), '{q}') union select 3, 'document', id, source_id from docs where contains({_F.format("content")}, '{q}') or contains({_F.format("source_id")}, '{q}'))"""  # noqa: E731
_KEYLINE = r"(?i)(^|[^\p{L}\p{M}\p{N}_])(decision|rationale|because|next action|todo|blocker|결정|근거|이유|할 일|차단)($|[^\p{L}\p{M}\p{N}_])"
_PACK = rf"""it as (select root_source_id as grp, ord as item, -cast(coalesce(section_level, 0) as double) as p, content from bronze_documents where content is not null),
ln as (select *, list_filter(list_transform(string_split_regex(content, '\r\n|[\n\r]'), lambda x: {_STRIP('x')}), lambda x: x <> '') as l from it),
cx as (select *, case when len(l) > 0 then array_to_string(list_concat(l[1:2], list_filter(l, lambda x: regexp_matches(x, '{_KEYLINE}'))), chr(10)) end as raw from ln),
un as (select grp, item, p, content, length(content) as n, case when len(l) = 0 then {_STRIP('content')} else (select array_to_string(list(x order by i), chr(10)) from (select x, min(i) as i from (select unnest(y) as x, unnest(range(len(y))) as i from (select list_concat(l[1:2], list_filter(l, lambda z: regexp_matches(z, '{_KEYLINE}'))) as y)) group by x)) end as short from cx),
num as (select *, length(short) as c, row_number() over (partition by grp order by p, item) as i from un),
fold as (select grp, i, n, case when n <= 3000 then 'none' else 'extractive' end as kind, 3000 as room, case when n <= 3000 then 3000 - n else 3000 - least(c, 3000) end as rest from num where i = 1
  union all select num.grp, num.i, num.n, case when rest <= 0 then 'dropped' when num.n <= rest then 'none' else 'extractive' end, rest, case when rest <= 0 then 0 when num.n <= rest then rest - num.n else rest - least(num.c, rest) end from fold join num on num.grp = fold.grp and num.i = fold.i + 1),
packed as (select num.grp, num.item, fold.kind, num.content as original, case fold.kind when 'none' then content when 'extractive' then case when c <= greatest(room, 1) then short else left(short, cast(greatest(room, 1) - 1 as int)) || '…' end end as content from num join fold on fold.grp = num.grp and fold.i = num.i)"""
_MEM = "mem as (select * from personal_memories qualify row_number() over (partition by id order by created_at desc, type desc, content desc) = 1)"
_RECALL = lambda w: f"(contains({_F.format('title')}, '{w}') or contains({_F.format('content')}, '{w}') or contains({_F.format('type')}, '{w}') or coalesce(len(list_filter(tags, lambda t: contains({_F.format('t')}, '{w}'))) > 0, false))"
_SUMMARY = lambda w, more: f"select '{w}' as words, count(*) as n, case when count(*) > 0 then cast(round(least(0.95, 0.62 + 0.06 * least(count(*), 5)), 4) as double) else 0.0 end as confidence, greatest(1, least(4, count(distinct type))) as depth, count(coalesce(nullif(source_id, ''), nullif(source, ''))) as n_sources from mem where {_RECALL(w)}{more}"
_NOTE_TABLES = f"""en as (select ord, type, name, source_ids as src from silver_entities union all select ord, 'Decision', title, source_ids from silver_decisions),
nn as (select type, {_F.format("trim(name, ' ')")} as c, arg_min(name, ord) as name, list_sort(list_distinct(flatten(list(coalesce(src, []))))) as src from en where type is not null and trim(name, ' ') <> '' group by 1, 2)"""
_DLINK = lambda x: f"'[[Decisions/' || {_STRIP(f'replace(replace({x}, {chr(39)}/{chr(39)}, {chr(39)}-{chr(39)}), {chr(39)}:{chr(39)}, {chr(39)} -{chr(39)})')} || '|' || {x} || ']]'"
_PLINK = lambda x: _DLINK(x).replace("Decisions/", "Projects/")
_NOTE_SQL = rf"""fe as (select arg_min(title, ord) as source, arg_min(u.x, ord) as target, {_F.format('title')} as s, {_F.format('u.x')} as t from silver_decisions, unnest(supersedes) as u(x) where u.x is not null group by {_F.format('title')}, {_F.format('u.x')}),
ends as (select s as k, target as other, true as o from fe union all select t, source, false from fe where s <> t),
lst as (select k, list_sort(list(distinct '- SUPERSEDES: ' || other)) as lines, list_sort(list(distinct other) filter (where o)) as older from ends group by k),
rowsx as (select nn.*, 'node_' || left(sha256(type || '|' || c), 16) as id, lines, coalesce(older, []) as older, m.status, m.project, m.rationale, case type when 'Person' then 'People' else type || 's' end || '/' || {_STRIP("replace(replace(name, '/', '-'), ':', ' -')")} as base
  from nn left join lst on k = {_F.format('name')} left join merged m on type = 'Decision' and m.title_key = {_K.format('name')}),
notes as (select *, array_to_string(list_concat(['---', 'type: ' || type, 'canonical_name: ' || c, '---', '', '# ' || name, '', '## Relations'], list_concat(coalesce(lines, ['- n/a']), list_concat(['', '## Sources'], list_concat(list_transform(src, lambda x: '- ' || x), [''])))), chr(10)) as plain,
  array_to_string(list_concat(['---', 'type: Decision', 'canonical_name: ' || c, 'status: ' || status, '---', '', '# ' || name, '', 'Status: ' || status, 'Project: ' || coalesce({_PLINK('project')}, 'n/a'), '', '## Summary', '', coalesce(case when {_STRIP('rationale')} <> '' then rationale end, name), '', '## Related Tools', '', '## Sources'],
    list_concat(list_transform(src, lambda x: '- ' || x), list_concat(['', '## Related Decisions'], list_concat(list_transform(older, lambda x: '- ' || {_DLINK('x')}), list_concat(['', '## Relations'], list_concat(coalesce(lines, ['- n/a']), [''])))))), chr(10)) as decided from rowsx)"""

ORACLE = {
    "timeline_merge": f"with {_MERGED} select title_key, title, status, project, rationale, valid_from, coalesce(source_ids, '') as source_ids, coalesce(participants, '') as participants, round(confidence, 4) as confidence from merged left join src on src.k = title_key left join par on par.k = title_key",
    "timeline_resolved": f"with {_MERGED} select title_key, status, valid_from, valid_to, n_superseded_by, n_supersedes, current from resolved",
    "current_decisions": f"with {_MERGED} select title_key, project, valid_from from resolved where current",
    "decisions_filtered": f"with {_MERGED} select title_key, project, status, valid_from from resolved where contains(lower(project), 'console') and valid_from between '2021-01-01' and '2023-12-31'",
    "memory_diff_7d": f"""with {_MERGED}, d as (select *, try_cast(valid_from as date) as day, max(try_cast(valid_from as date)) over () as newest from resolved)
select title_key, 'added' as kind from d where day >= newest - 7 and status = 'accepted' union all select title_key, 'superseding' from d where day >= newest - 7 and n_supersedes > 0
union all select title_key, 'superseded' from d where not current and n_superseded_by > 0 and newest is not null""",
    "supersedes_index": f"with {_MERGED} select source, target from edges",
    "mql_find": f"with {_MERGED} select 'find' as operation, title_key, title as answer from resolved where current",
    "mql_why": f"with {_MERGED} select 'why' as operation, title_key, coalesce(rationale, 'no rationale recorded') as answer from resolved where contains(title_key, 'retry queue')",
    "mql_show_timeline": f"with {_MERGED} select 'timeline' as operation, title_key, coalesce(valid_from, '?') || ' ' || coalesce(status, '?') as answer from resolved where contains(lower(project), 'console') or not exists (select 1 from resolved where contains(lower(project), 'console'))",
    "mql_show_changes": f"""with {_MERGED}, d as (select *, try_cast(valid_from as date) as day, max(try_cast(valid_from as date)) over () as newest from resolved)
select 'changes' as operation, title_key, 'added' as answer from d where day >= newest - 30 and status = 'accepted' union all select 'changes', title_key, 'superseding' from d where day >= newest - 30 and n_supersedes > 0
union all select 'changes', title_key, 'superseded' from d where not current and n_superseded_by > 0 and newest is not null""",
    "bronze_identity": "select ord, 'bronze_' || left(sha256(content), 16) as id, 'sha256:' || sha256(content) as content_hash from bronze_documents",
    "bronze_dedup": "select content_hash, min(ord) as ord, arg_min(source_id, ord) as source_id from bronze_documents where content_hash is not null group by 1",
    "bronze_put": "select content_hash, min(ord) as ord from bronze_documents where corpus_id <> 'corpus_main' and content_hash not in (select content_hash from bronze_documents where corpus_id = 'corpus_main' and content_hash is not null) group by 1",
    "bronze_hard_chunks": r"""with w as (select ord, unnest(range(0, greatest(cast(ceil((length(content) - 1800) / 1680.0) as int), 0) + 1)) as i, content from bronze_documents),
c as (select ord, i, regexp_replace(substring(content, i * 1680 + 1, 1800), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') as chunk from w)
select ord, row_number() over (partition by ord order by i) as chunk_no, sha256(chunk) as chunk_hash, length(chunk) as n_chars from c where chunk <> ''""",
    "bronze_active_view": "select source_type, count(*) as n_active from bronze_documents where coalesce(json_extract_string(metadata, '$.active') <> 'false', true) group by 1",
    "node_upsert": f"with {_NODES} select 'node_' || left(sha256(n.type || '|' || n.c), 16) as id, n.type, n.c as canonical_name, n.name, mentions, coalesce(source_ids, '') as source_ids from n join ns on n.type = ns.type and n.c = ns.c",
    "edge_upsert": f"with {_EDGES} select * from up",
    "graph_neighborhood": f"with {_EDGES} select source, target, case when lower(source) = 'supplier#000000003' then target else source end as neighbor, weight from up where lower(source) = 'supplier#000000003' or lower(target) = 'supplier#000000003'",
    "custom_kg_entities": f"with {_NODES} select n.name as entity_name, n.type as entity_type, coalesce(l[1], '') as source_id from n join ns on n.type = ns.type and n.c = ns.c",
    "confidence_gate": "select type, count(*) filter (where coalesce(confidence >= 0.7, false)) as n_ok, count(*) filter (where not coalesce(confidence >= 0.7, false)) as n_rejected from silver_entities group by 1",
    "grounding_gate": f"with {_GROUND} select ord, grounded from g",
    "type_gate": """select o_orderkey as ord, (o_orderkey % 2 = 0 and c_mktsegment in ('AUTOMOBILE', 'BUILDING') and o_orderpriority in ('1-URGENT', '2-HIGH'))
  or (o_orderkey % 2 <> 0 and c_mktsegment = 'FURNITURE' and o_orderpriority = '5-LOW') as ok from orders join customer on o_custkey = c_custkey""",
    "rejects": f"with {_GROUND} select e.ord, type, name, 'validation_failed' as reason from silver_entities e join g using (ord) where not grounded or coalesce(confidence < 0.7, true)",
    "tool_mentions": "select ord, term from bronze_documents, (select unnest([" + ", ".join(f"'{w}'" for w in DICTIONARY) + "]) as term) where contains(content, term)",
    "tokenize_terms": f"select doc_id, len(list_distinct({_TERMS})) as n_terms, md5(array_to_string(list_sort(list_distinct({_TERMS})), ' ')) as terms_hash from documents",
    "largest_chunks": "select ord, length(content) as n_chars from bronze_documents order by n_chars desc, ord limit 5",
    "sync_latest": "select corpus_id, connector, id, status, fetched from connector_diffs qualify row_number() over (partition by corpus_id, connector order by started_at desc, id desc) = 1",
    "high_water_mark": "select event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as mark, arg_max(event_id, (ts, event_id)) as last_event from events group by 1",
    "rule_answer": r"""with q as (select doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}\x{85}]+', '', 'g') as t from documents),
r as (select doc_id, case when contains(t, 'sync') and contains(t, 'cursor') then 1 when contains(t, 'retry') then 2 when contains(t, 'token') and contains(t, 'cache') then 3 end as rule_ord from q)
select doc_id, cast(rule_ord as bigint) as rule_ord, case rule_ord when 1 then 'cursor' when 2 then 'queue' else 'cache' end as answer from r where rule_ord is not null""",
    "vector_topk": """with s as (select q.vec_id as query, v.vec_id as key, round(list_dot_product(cast(v.embedding as double[]), cast(q.embedding as double[])) / (sqrt(list_dot_product(cast(v.embedding as double[]), cast(v.embedding as double[]))) * sqrt(list_dot_product(cast(q.embedding as double[]), cast(q.embedding as double[])))), 4) as similarity
  from embeddings v join embeddings q on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
select query, key, similarity, row_number() over (partition by query order by similarity desc, key) as rn from s qualify rn <= 10""",
    "timeline_links": f"with {_MERGED}, {_LINKED} select * from links",
    "timeline_start": f"with {_MERGED} select title_key, valid_from, (select min(ord) from sd where k = title_key) as ord from resolved order by {_START}, ord limit 20",
    "current_titles": f"with {_MERGED} select title_key, title, valid_from, (select min(ord) from sd where k = title_key) as ord from resolved where current",
    "mql_why_rationale": f"""with {_MERGED}, w as (select 'adopt duplicated retry queue' as w), rs as (select min_by(title, o) as title, min_by(rationale, o) as x, min(o) as o from (select title, rationale, cast(ord as varchar) as o from silver_decisions where trim(rationale, ' ') <> '') group by {_F.format('title')}, {_F.format('rationale')}),
hit as (select rs.* from rs, w where contains({_F.format('title')}, w) or contains(w, {_F.format('title')})), said as (select string_agg(x || ' (rationale)', '; ' order by o, title) as a from hit),
ev as (select title, rationale, (select min(ord) from sd where k = title_key) as ord from resolved, w where contains({_F.format('title')}, w)),
ans as (select coalesce((select a from said), (select min_by(rationale, ord) filter (where rationale is not null) from ev), 'no rationale recorded') as a)
select distinct 'why' as operation, {_K.format('title')} as title_key, a as answer from (select title from ev union select title from hit where not exists (select 1 from ev)), ans""",
    "bronze_stale": """with f as (select * from bronze_documents qualify created_at = max(created_at) over (partition by root_source_id)), m as (select root_source_id, content_hash not in (select content_hash from f where content_hash is not null) as stale from bronze_documents)
select root_source_id, count(*) filter (where not stale) as n_active, count(*) filter (where stale) as n_stale from m group by 1""",
    "bronze_sections": r"""with b as (select ord, content, string_split_regex(regexp_replace(content, '(?m)^(#{1,2}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) as parts from bronze_documents where content is not null),
x as (select ord, len(parts) > 2 as cut, case when len(parts) > 2 then parts[2:] else [content] end as ps from b), y as (select ord, cut, unnest(range(1, len(ps) + 1)) as section_no, unnest(ps) as body from x),
z as (select *, case when cut then trim(regexp_extract(body, '^#{1,2}[ \t]+([^\r\n]*)', 1), ' ' || chr(9)) end as title, case when cut then length(regexp_extract(body, '^(#{1,2})[ \t]', 1)) else 0 end as level from y),
v as (select *, last_value(case when level = 1 then title end ignore nulls) over (partition by ord order by section_no rows between unbounded preceding and current row) as top from z)
select ord, section_no, title, concat_ws(' > ', case when level = 2 then top end, title) as path, length(""" + _STRIP("body") + ") as n_chars from v",
    "decision_lines": r"""with x as (select ord, regexp_extract_all(content, '(?m)^(?:[-*>]\s*)?Decision:\s*([^\n]+)', 1) as l from bronze_documents) select ord, cast(unnest(range(len(l))) as bigint) as pos, unnest(l) as statement from x""",
    "front_matter_titles": r"""with x as (select doc_id, regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---\r?\n', 1) as b from documents), y as (select doc_id, regexp_extract_all(b, '(?m)^ *title *:[ ]*([^\r\n]*)', 1) as t from x where b <> '')
select doc_id, regexp_replace(trim(t[len(t)], ' '), '^["'']|["'']$', '', 'g') as title from y where len(t) > 0""",
    "connector_diff": f"with {_SNAPS} select * from ch",
    "connector_counts": f"with {_SNAPS} select corpus_id, connector, snapshot_no, count(*) filter (where change <> 'removed') as fetched, " + ", ".join(f"count(*) filter (where change = '{c}') as {c}" for c in contract.STATES) + " from ch group by 1, 2, 3",
    "connector_diff_all": f"with {_SNAPS} select corpus_id, connector, snapshot_no, source_id, case change when 'new' then 'added' else change end as change from ch where change <> 'unchanged'",
    "custom_kg_relationships": f"with {_EDGES}, so as (select lower(source) as s, lower(target) as t, min(cast(ord as varchar)) as o from e group by 1, 2) select source as src_id, target as tgt_id, relation as description, relation as keywords, weight, o as source_id from up join so on so.s = lower(source) and so.t = lower(target)",
    "custom_kg_chunks": f"with {_ACTIVE} select id as source_id, sha256(content) as content_hash from docs",
    "graph_around": f"""with {_EDGES}, t as (select * from up where contains(lower(source), 'supplier#00000001') or contains(lower(target), 'supplier#00000001')), k as (select lower(source) as k from t union select lower(target) from t),
nd as (select arg_min(name, ord) as name from (select s_suppkey as ord, 'Tool' as type, s_name as name from supplier union all select p_partkey, 'Concept', p_name from part) group by type, lower(trim(name, ' ')))
select 'node' as kind, name as value from nd where lower(name) in (select k from k) or contains(lower(name), 'supplier#00000001') union all select 'edge', source || ' SUPPLIES ' || target from t""",
    "vault_index": f"select type, '- [[' || case type when 'Person' then 'People' else type || 's' end || '/' || {_STRIP("replace(replace(name, '/', '-'), ':', ' -')")} || '|' || name || ']]' as line from (select distinct type, name from gold_nodes where type is not null and name is not null)",
    "keyword_search": f"with {_MATCHES}, top as (select stage, key, match, row_number() over (order by stage, key, match) as rank from matches) select rank, stage, match, (select cast(round(least(0.95, 0.55 + 0.1 * count(*)), 4) as double) from matches) as confidence from top where rank <= 10",
    "keyword_matches": f"with {_MATCHES} select cast(stage as bigint) as stage, count(*) as n, count(*) filter (where len(src) > 0) as n_sourced from matches group by 1",
    "keyword_sources": f"with {_MATCHES}, ids as (select distinct unnest(src) as id from matches) select id, min_by(source_id, (source_id, source_type)) as source_id, min_by(source_type, (source_id, source_type)) as source_type from docs join ids using (id) group by id",
    "hint_sources": f"""with h as (select * from (values {', '.join(str(h) for h in HINTS)}) as v(g, i, h)), hay as (select ord, id, {_F.format("concat_ws(chr(10), coalesce(array_to_string(section_path, ' '), ''), source_id, content)")} as t from bronze_documents),
m as (select g, i, id, row_number() over (partition by g, i order by ord) as r from h join hay on contains(t, {_F.format('h')})), c as (select g, i, list(id order by r) as ids from m where r <= 5 group by g, i),
a as (select g, i, ids[1] as id, row_number() over (partition by g order by i) as n, ids from c), t1 as (select g, i, id, ids from a where n = 1), t2 as (select a.g, a.i, list_filter(a.ids, lambda x: x <> t1.id)[1] as id, t1.id as p from a join t1 on t1.g = a.g and a.n = 2),
t3 as (select a.g, a.i, list_filter(a.ids, lambda x: x <> t2.id and x <> t2.p)[1] as id from a join t2 on t2.g = a.g and a.n = 3)
select cast(g as bigint) as "group", cast(i as bigint) as hint_ord, id from (select g, i, id from t1 union all select g, i, id from t2 union all select g, i, id from t3) where id is not null""",
    "retrieve_topk": f"with {_RETRIEVE('retry queue', chr(116) + 'ype = ' + chr(39) + 'Tool' + chr(39))} select cast(stage as bigint) as stage, kind, key from hit order by stage, key, label limit 8",
    "retrieve_counts": f"with {_RETRIEVE('console', 'true')} select kind, count(*) as n from hit group by 1",
    "snippets": f"select doc_id, {_snippet('text', ['cursor', 'queue'])} as snippet from documents",
    "context_pack": f"with recursive {_PACK} select grp, item, kind, length(content) as n_chars, sha256(content) as text_hash from packed",
    "context_restore": f"with recursive {_PACK} select grp, item, sha256(original) as text_hash from packed where content is not null",
    "load_plan": """select count(*) as chunks, count(distinct root_source_id) as roots, cast(coalesce(sum(length(content)), 0) as bigint) as chars, cast(coalesce(sum(case when content <> '' then length(content) - length(replace(content, chr(10), '')) + 1 else 0 end), 0) as bigint) as lines, coalesce(max(length(content)), 0) as largest,
  count(*) filter (where length(content) >= 2000) as large_chunks, count(*) filter (where contains(content, '```')) as code_chunks,
  case when count(*) >= 120 or sum(length(content)) >= 180000 or max(length(content)) >= 2400 then 'high' when count(*) >= 40 or sum(length(content)) >= 60000 or max(length(content)) >= 1800 then 'medium' else 'low' end as risk,
  greatest(1, count(*) // 6) as minutes_min, greatest(2, count(*) // 2) as minutes_max from bronze_documents""",
    "personal_recall": f"with {_MEM} select id, type, title from mem where {_RECALL('review')}",
    "personal_summary": f"with {_MEM} " + " union all ".join([_SUMMARY("queue", ""), _SUMMARY("console", ""), _SUMMARY("cursor", " and type = 'Decision'"), _SUMMARY("no such words", "")]),
    "personal_import": """with f as (select * from bronze_documents qualify row_number() over (partition by source_id order by ord) = 1)
select 'personal_' || case when n < 1000000 then lpad(cast(n as varchar), 6, '0') else cast(n as varchar) end as id, case source_type when 'gmail' then 'Email' when 'jira' then 'Task' when 'slack' then 'Decision' else 'Document' end as type, coalesce(nullif(json_extract_string(metadata, '$.title'), ''), source_id) as title, source_type as source, source_id, source_type as tags
from (select *, row_number() over (order by ord) as n from f)""",
    "personal_next_actions": f"with {_MEM} select id, type, title from mem where type in ('Task', 'Action') or {_ANY('content', ['next', 'priority'])}",
    "personal_timeline": f"with {_MEM} select id, type, strftime(created_at, '%Y-%m-%d %H:%M:%S') as at from mem where created_at >= timestamp '2024-01-01 02:00:00'",
    "corpus_suggest": """with r as (select corpus_id, count(distinct root_source_id) filter (where root_source_id in (select root_source_id from bronze_documents where source_type = 'markdown')) as n, '/data/' || corpus_id || '/' || max(root_source_id) as p from bronze_documents group by 1),
s as (select corpus_id, case when p = '/data/corpus_ops' then 0.98 when starts_with(p, '/data/corpus_ops/') or starts_with('/data/corpus_ops', p || '/') then 0.82 else 0 end + case when n > 0 then least(0.9, 0.35 + n * 0.08) else 0 end
  + least(0.3, 0.1 * len(list_intersect(list_distinct(string_split_regex(corpus_id, '[^a-z0-9]+')), ['corpus', 'ops']))) as s from r)
select corpus_id, cast(round(least(s, 0.99), 2) as double) as score from s where s > 0 order by score desc, corpus_id limit 5""",
    "sync_history": "select id, status, fetched from connector_diffs where connector = 'gmail' order by started_at desc, id desc limit 15",
    "message_threads": "select corpus_id, root_source_id, source_id, count(*) as n_messages, length(string_agg(content, chr(10) || chr(10) order by ord)) as n_chars, sha256(string_agg(content, chr(10) || chr(10) order by ord)) as text_hash from bronze_documents where source_type in ('slack', 'gmail') group by 1, 2, 3",
    "quality_metrics": """with q as (select status, coalesce(len(source_ids), 0) > 0 as ok, cast(floor(coalesce(confidence, 0) * 100) as bigint) as w from silver_decisions)
select status, count(*) as total, count(*) filter (where ok) as passed, cast(sum(w) as bigint) as weighted_total, cast(sum(case when ok then w else 0 end) as bigint) as weighted_passed, round(count(*) filter (where ok) / count(*), 4) as pass_rate, round(sum(case when ok then w else 0 end) / sum(w), 4) as weighted_pass_rate from q group by 1""",
    "rule_precedence": r"""with q as (select doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}\x{85}]+', '', 'g') as t from documents),
r as (select doc_id, case when contains(t, 'token') and contains(t, 'cache') then 1 when contains(t, 'retry') then 2 when contains(t, 'sync') and contains(t, 'cursor') then 3 end as set_ord from q)
select doc_id, cast(set_ord as bigint) as set_ord, case set_ord when 1 then 'cache' when 2 then 'queue' else 'cursor' end as answer from r where set_ord is not null""",
    "triple_recall": rf"""with {_MERGED}, g as (select u.x as subject, title as object, min(id) as id, min_by(status, (id, status)) as status from gold_timeline_events, unnest(superseded_by) as u(x) where u.x <> '' group by 1, 2),
nk as (select *, regexp_replace({_F.format('subject')}, '[\s\p{{Z}}\x{{85}}_\-./·:()"''`]+', '', 'g') as a, regexp_replace({_F.format('object')}, '[\s\p{{Z}}\x{{85}}_\-./·:()"''`]+', '', 'g') as b from g), ek as (select regexp_replace(source, '[\s\p{{Z}}\x{{85}}_\-./·:()"''`]+', '', 'g') as a, regexp_replace(target, '[\s\p{{Z}}\x{{85}}_\-./·:()"''`]+', '', 'g') as b from edges),
f as (select status, exists (select 1 from ek where a <> '' and b <> '' and nk.a <> '' and (contains(ek.a, nk.a) or contains(nk.a, ek.a)) and (contains(ek.b, nk.b) or contains(nk.b, ek.b))) as hit from nk)
select status as "group", count(*) filter (where hit) as matched, count(*) as total, cast(1 as bigint) as minimum, count(*) filter (where hit) >= 1 as passed, round(count(*) filter (where hit) / count(*), 4) as score from f group by 1""",
    "vault_notes": f"""with {_MERGED}, {_NOTE_TABLES}, {_NOTE_SQL}
select case when count(*) over (partition by base) > 1 then base || ' ' || id else base end || '.md' as path, sha256(case when status is not null then decided else plain end) as content_hash from notes""",
    "text_names": rf"""with n as (select distinct id, name, {_STRIP("name")} as s from gold_nodes where name is not null)
select distinct id, coalesce(nullif(regexp_replace(regexp_replace(lower(s), '[^a-zA-Z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), ''), 'documents') as slug,
  coalesce(nullif(left(regexp_replace(regexp_replace(name, '[^0-9A-Za-z가-힣._ -]+', '-', 'g'), '^[ .-]+|[ .-]+$', '', 'g'), 120), ''), 'memory') as file_name, coalesce(nullif(regexp_replace(regexp_replace(s, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'channel') as path_part,
  {_STRIP("replace(replace(name, '/', '-'), ':', ' -')")} as note_name, array_to_string(list_filter(string_split_regex(lower(name), '[^a-zA-Z0-9]+'), lambda t: t <> ''), ' ') as tokens from n""",
    "model_json": "select event_id, case when event_id % 3 < 2 then props end as value from events",
    "redacted_secrets": "select event_id, '[redacted]' as token, event_type as kind from events",
    "machine_tiers": "select p_partkey, case when p_size * 4 >= 128 then 'T5' when p_size * 4 >= 64 then 'T4' when p_size * 4 >= 48 then 'T3' when p_size * 4 >= 32 then 'T2' when p_size * 4 >= 16 then 'T1' end as tier from part",
    "evicted_entities": """with g as (select list(distinct id) as ids from bronze_documents where root_source_id = 'slack:ops-general'), e as (select ord, name, source_ids, list_filter(source_ids, lambda x: not list_contains(ids, x)) as kept from silver_entities, g)
select ord, name, coalesce(array_to_string(kept, ','), '') as source_ids from e where coalesce(len(source_ids), 0) = 0 or len(kept) > 0""",
    "using_entities": "with g as (select list(distinct id) as ids from bronze_documents where root_source_id = 'slack:ops-general') select ord, name from silver_entities, g where list_has_any(source_ids, ids)",
    "bronze_removed": "select ord, id from bronze_documents where id not in (select id from bronze_documents where root_source_id = 'slack:ops-general')",
}
