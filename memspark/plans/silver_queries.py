"""Queries of chunking, extraction, validation, rationale memory and graph build, with their SQL.

Extraction runs over notes rendered from all of silver_decisions, as the stored chunks hold neither links nor tags: each row becomes a Markdown note with front matter, links,
tags, labelled lines (accepted), a sentence that says decided (proposed), or neither. Notes of equal text are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import redact
from memspark.ids import bronze_id
from memspark.operators import chunking, extraction, graph, rationale, silver
from memspark.plans.general_queries import table
from memspark.plans.ontology import default_ontology

#: Example inputs: dictionaries and rationale specifications are the caller's data.
TERMS = [("Tool", "retry queue"), ("Tool", "token cache"), ("Tool", "sync cursor"), ("Concept", "snapshot job"), ("Project", "thread parser")]
SPECS = [(1, "retry queue", "retries hid the failures", "quality", ["retries", "failures"]), (2, "token cache", "a smaller cache costs less", "cost", ["token cache"]), (3, "mail importer", "owners confirm in writing", "process", ["owners", "writing"])]


def _ws(c):
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    t, none = _ws("title"), F.array().cast("array<string>")
    people, older = F.coalesce("participants", none), F.transform(F.coalesce("supersedes", none), _ws)
    line = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(k), c, F.lit("\n"))).otherwise("")
    links = lambda k, a, tail: F.when(F.size(a) > 0, F.concat(F.lit(k), F.array_join(F.transform(a, lambda x: F.concat(F.lit("[["), x, F.lit(tail + "]]"))), " "), F.lit("\n"))).otherwise("")
    why = line("Rationale: ", _ws("rationale"))
    said = F.concat(F.lit("Decision: "), t, F.lit("\nStatus: accepted\n"), why, F.array_join(F.transform(older, lambda x: F.concat(F.lit("Supersedes: "), x, F.lit("\n"))), ""))
    text = F.concat(
        F.lit("---\ntitle: "), t, F.lit("\n"), line("project: ", F.col("project")), line("date: ", F.col("decision_date")), line("author: ", F.get(people, F.lit(0))), F.lit("---\n# "), t, F.lit("\n\n"),
        links("프로젝트: ", F.array_compact(F.array("project")), ""), links("관련 인물: ", people, ""), links("이전 검토: ", older, "|earlier"), F.lit("#"), "status", F.lit(" #memory\n\n"),
        F.when(F.col("status") == "accepted", said).when(F.col("status") == "proposed", F.concat(F.lit("The team decided to keep "), t, F.lit(". We use the retry queue here.\n"), why)).otherwise(F.concat(F.lit("The token cache was considered. Then "), t, F.lit(" uses the sync cursor.\n"))),
    )
    rows = table(spark, d, "silver_decisions").select("ord", "corpus_id", t.alias("title"), text.alias("content")).withColumn("id", bronze_id(F.col("content")))
    return rows.groupBy("id").agg(F.min_by(F.struct("ord", "corpus_id", "title", "content"), "ord").alias("r")).select("id", "r.*")


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "type string, term string")


def _specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECS, "spec_ord long, decision_title string, text string, category string, markers array<string>")


def section_chunks(spark, d):
    docs = table(spark, d, "bronze_documents").select("ord", "content", F.concat_ws("@", "source_id", "ord").alias("base"))
    return chunking.markdown_chunks(docs, "ord", "content", "base").select("ord", "source_id", F.col("section_no").cast("long").alias("section_no"), F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_chunks").cast("long").alias("n_chunks"), F.sha2("content", 256).alias("chunk_hash"))


def packed_chunks(spark, d):
    rows = table(spark, d, "bronze_documents").select("ord", F.posexplode(chunking.pack_blocks(F.col("content"))).alias("i", "chunk"))
    return rows.select("ord", (F.col("i") + 1).cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_hash"))


def redact_pii(spark, d):
    out = redact("content")
    return table(spark, d, "personal_memories").select("id", F.sha2(out, 256).alias("redacted_hash"), (F.length("content") - F.length(out)).cast("long").alias("shorter_by")).distinct()


def note_tags(spark, d):
    return _notes(spark, d).select("id", F.array_join(extraction.tags(F.col("content")), ",").alias("tags"), F.array_join(extraction.all_links(F.col("content")), ",").alias("links"))


def typed_links(spark, d):
    return extraction.typed_links(_notes(spark, d), _terms(spark)).select("id", F.col("line_no").cast("long").alias("line_no"), F.col("link_no").cast("long").alias("link_no"), "type", "name", "label")


def entity_candidates(spark, d):
    return extraction.entity_candidates(_notes(spark, d), _terms(spark)).select("id", F.col("rule").cast("long").alias("rule"), F.col("pos").cast("long").alias("pos"), "type", "name", "confidence")


def extracted_entities(spark, d):
    return extraction.entities(_notes(spark, d), _terms(spark)).select("id", "doc_id", "type", "name", "span", "confidence")


def note_projects(spark, d):
    return extraction.project_of(_notes(spark, d), _terms(spark))


def decision_stages(spark, d):
    rows = extraction.decision_stages(_notes(spark, d))
    return rows.select("id", F.col("stage").cast("long").alias("stage"), F.col("pos").cast("long").alias("pos"), "title", "status", "rationale", "decision_date", "project", F.array_join("supersedes", "|").alias("supersedes"), "confidence")


def _silver(spark, d):
    docs, terms = _notes(spark, d), _terms(spark)
    found, decided = extraction.entities(docs, terms), extraction.decisions(docs, terms)
    return docs, found, decided, extraction.relations(docs, found, decided, terms)


def extracted_relations(spark, d):
    return _silver(spark, d)[3].select("id", "doc_id", "subject", "predicate", "object", "confidence")


def validated(spark, d):
    docs, found, decided, related = _silver(spark, d)
    out = silver.validate(found, decided, related, docs, default_ontology(spark), 0.8)
    kept = [df.select(F.lit(k).alias("kind"), "id") for k, df in zip(("entity", "decision", "relation"), out, strict=False)]
    every = kept[0].unionByName(kept[1]).unionByName(kept[2]).withColumn("state", F.lit("kept"))
    return every.unionByName(out[3].select("kind", "id", F.lit("rejected").alias("state"))).groupBy("kind", "state").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def rejected_relations(spark, d):
    docs, found, decided, related = _silver(spark, d)
    return silver.validate(found, decided, related, docs, default_ontology(spark), 0.8)[3].where("kind = 'relation'").select("id", "reason", "subject", "predicate", "object")


def _decisions(spark, d):
    return table(spark, d, "silver_decisions").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))


def _rationales(spark, d):
    docs = table(spark, d, "bronze_documents").withColumn("title", F.get_json_object("metadata", "$.title"))
    return rationale.rationales(_decisions(spark, d), docs, _specs(spark))


def rationale_memory(spark, d):
    return _rationales(spark, d).select("decision_title", "rationale_text", "category", "span", F.array_join("source_ids", ",").alias("source_ids"), "confidence")


def _graph(spark, d):
    found, decided, reasons = table(spark, d, "silver_entities"), _decisions(spark, d), _rationales(spark, d)
    nodes = graph.build_nodes(found, decided, reasons)
    related = spark.createDataFrame([], "ord string, subject string, predicate string, object string, source_ids array<string>, confidence double")
    return nodes, graph.relation_rows(related, decided, reasons, nodes)


def graph_nodes(spark, d):
    return _graph(spark, d)[0].groupBy("type").agg(F.count("*").alias("n_nodes"), F.sum("mentions").alias("mentions"), F.sum(F.size("source_ids")).alias("n_sources"))


def graph_edges(spark, d):
    edges = graph.upsert_edges(_graph(spark, d)[1])
    return edges.select(F.lower("source").alias("source_key"), "relation", F.lower("target").alias("target_key"), "weight", "n_rows", F.array_join("source_ids", ",").alias("source_ids"))


def merged_entities(spark, d):
    return silver.merge_entities(table(spark, d, "silver_entities")).select("id", "type", "name", F.array_join("source_ids", ",").alias("source_ids"), "confidence")


def merged_decisions(spark, d):
    return silver.merge_decisions(table(spark, d, "silver_decisions")).select("id", "title", "rationale", F.array_join("source_ids", ",").alias("source_ids"), "confidence")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_W = r"trim(regexp_replace({}, '[ \t\r\n\f]+', ' ', 'g'), ' ')"
_NOTE = rf"""src as (select ord, corpus_id, {_W.format("title")} as t, project, decision_date, status, {_W.format("rationale")} as why, coalesce(participants, []) as ps, list_transform(coalesce(supersedes, []), lambda x: {_W.format("x")}) as ss from silver_decisions),
note as (select ord, corpus_id, t as title, t, project, decision_date, status, why, ps, ss, concat('---' || chr(10) || 'title: ', t, chr(10), 'project: ' || project || chr(10), 'date: ' || decision_date || chr(10), 'author: ' || ps[1] || chr(10), '---' || chr(10) || '# ', t, chr(10) || chr(10),
  '프로젝트: [[' || project || ']]' || chr(10), case when len(ps) > 0 then '관련 인물: ' || array_to_string(list_transform(ps, lambda x: '[[' || x || ']]'), ' ') || chr(10) end, case when len(ss) > 0 then '이전 검토: ' || array_to_string(list_transform(ss, lambda x: '[[' || x || '|earlier]]'), ' ') || chr(10) end,
  '#', status, ' #memory' || chr(10) || chr(10), case when status = 'accepted' then concat('Decision: ', t, chr(10) || 'Status: accepted' || chr(10), 'Rationale: ' || why || chr(10), array_to_string(list_transform(ss, lambda x: 'Supersedes: ' || x || chr(10)), ''))
    when status = 'proposed' then concat('The team decided to keep ', t, '. We use the retry queue here.' || chr(10), 'Rationale: ' || why || chr(10)) else concat('The token cache was considered. Then ', t, ' uses the sync cursor.' || chr(10)) end) as content from src),
notes as (select *, 'bronze_' || left(sha256(content), 16) as id from note qualify row_number() over (partition by content order by ord) = 1)"""
_DICT = "dict as (select * from (values " + ", ".join(f"('{t}', '{w}', {i})" for (t, w), i in zip(TERMS, (8, 8, 8, 10, 7), strict=True)) + ") as v(type, term, rule))"
_LINKS = """ln as (select id, i, line from (select id, unnest(range(len(l))) as i, unnest(l) as line from (select id, string_split(content, chr(10)) as l from notes)) where contains(line, '[[')),
lk as (select id, i as line_no, split_part(line, '[[', 1) as label, unnest(range(len(x))) as link_no, trim(split_part(unnest(x), '|', 1), ' ') as name from (select id, i, line, regexp_extract_all(line, '\\[\\[([^\\]]+)\\]\\]', 1) as x from ln)),
links as (select id, line_no, link_no, coalesce((select min_by(d.type, d.rule) from dict d where d.term = lk.name), case when contains(label, '프로젝트') then 'Project' when contains(label, '도구') then 'Tool' when contains(label, '인물') then 'Person' else 'Concept' end) as type, name, label from lk)"""
_CANDIDATES = """cand as (select id, 0 as rule, 0 as pos, 'Project' as type, project as name, 0.95 as confidence from notes union all select id, 1, 0, 'Person', ps[1], 0.75 from notes
  union all select id, 2, 0, 'Document', title, 0.9 from notes union all select id, 3, 0, 'Concept', title, 0.9 from notes
  union all select id, 4, unnest(range(len(h))), 'Concept', trim(unnest(h), ' '), 0.9 from (select id, regexp_extract_all(content, '(?m)^#{1,6}[ \\t]+(\\S[^\\r\\n]*)', 1) as h from notes)
  union all select id, 5, line_no * 1000 + link_no, type, name, 0.9 from links
  union all select id, 6, unnest(range(len(g))), 'Concept', unnest(g), 0.9 from (select id, list_sort(list_distinct(regexp_extract_all(regexp_replace(content, '[\\p{L}\\p{N}_]#', 'x', 'g'), '#([A-Za-z0-9_/-]+)', 1))) as g from notes)
  union all select id, rule, -length(term), type, term, 0.95 from notes join dict on contains(content, term)),
cands as (select * from cand where trim(name, ' ') <> ''),
ents as (select id as doc_id, type, name, confidence from cands qualify row_number() over (partition by id, type, lower(name) order by rule, pos, name) = 1),
proj as (select id, min_by(name, (r, pos, name)) as project from (select id, 0 as r, 0 as pos, project as name from notes union all select id, 1, line_no * 1000 + link_no, name from links where type = 'Project' union all select id, 2, -length(term), term from notes join dict on contains(content, term) where type = 'Project') where name <> '' group by id)"""
_STAGES = """said as (select id, 2 as stage, 0 as pos, title, 'accepted' as status, case when why <> '' then why end as rationale, decision_date, project, array_to_string(list_filter(ss, lambda x: x <> ''), '|') as supersedes, ss, 0.88 as confidence from notes where status = 'accepted'),
body as (select id, decision_date, project, case when why <> '' and status = 'proposed' then why end as rationale, array_to_string(list_filter(string_split(regexp_replace(content, '(?s)^---\\s*\\n.*?\\n---\\s*\\n', ''), chr(10)), lambda x: not regexp_matches(x, '(?i)^\\s*(?:"(?:content|rationale|id|source_id)"|content|id|source_id)\\s*:')), chr(10)) as b, content from notes where status <> 'accepted'),
sent as (select *, list_filter(regexp_extract_all(b, '[^.\\n]+(?:\\.|$)'), lambda x: regexp_matches(x, '(?i)\\bdecided\\b|결정했|결정한다|선택|채택')) as s from body),
stages as (select id, stage, pos, title, status, rationale, decision_date, project, supersedes, ss, confidence from said
  union all select id, 3, unnest(range(len(s))), trim(regexp_replace(regexp_replace(unnest(s), '\\.$', ''), '\\s+', ' ', 'g'), ' '), 'accepted', rationale, decision_date, project, '', [], 0.78 from sent)"""
_RELATED = """used as (select p.id as doc_id, p.project as subject, 'USES' as predicate, d.term as object, 0.82 as confidence from proj p join notes n on n.id = p.id join ents e on e.doc_id = p.id and e.type = 'Tool' join dict d on d.term = e.name
  where exists (select 1 from (select unnest(string_split(regexp_replace(n.content, '([.!?。])[\\s\\p{Z}]+', '\\1' || chr(10), 'g'), chr(10))) as s) where contains(s, d.term) and regexp_matches(s, '(?i)\\b(use|uses|using|adopt|adopts|adopted|selected|decided to use)\\b|사용|채택|선택') and not regexp_matches(s, '(?i)\\b(considered|considering|instead of|not use|rejected)\\b|고려|대신|폐기|거절'))),
lnk as (select id as doc_id, name, max_by(type, (line_no, link_no)) as type, min_by(label, (line_no, link_no)) as label from links group by id, name),
decs as (select id as doc_id, left(title, 160) as title, coalesce(project, (select project from proj where proj.id = stages.id)) as project, confidence, ss, 'decision_' || left(sha256(id || '|' || title), 16) as id from stages),
rels as (select distinct * from (select * from used union all select doc_id, n.title, case when type in ('Person', 'Tool') and contains(label, '관련') then 'MENTIONS' else 'RELATED_TO' end, name, 0.9 from lnk join notes n on n.id = doc_id where n.title <> ''
  union all select doc_id, title, 'SUPERSEDES', unnest(ss), 0.92 from decs)),
relations as (select 'relation_' || left(sha256(doc_id || '|' || subject || '|' || predicate || '|' || object), 16) as id, doc_id, subject, predicate, object, confidence from rels),
entities as (select 'entity_' || left(sha256(doc_id || '|' || type || '|' || name), 16) as id, doc_id, type, name, case when contains(n.content, name) then name end as span, confidence from ents join notes n on n.id = doc_id)"""


def _onto() -> str:
    from memspark.plans.ontology import RELATIONS

    return "onto as (select * from (values " + ", ".join(f"('{r}', {a}, {b})" for r, a, b in RELATIONS) + ") as v(relation, dom, rng))"


_VALID = f"""{_onto()}, oke as (select *, coalesce(confidence >= 0.8, false) as ok from entities), okd as (select *, confidence >= 0.8 as ok from decs),
named as (select doc_id, name, type from oke where ok union all select doc_id, title, 'Decision' from okd where ok), types as (select doc_id, name, list(distinct type) as ts from named group by 1, 2),
okr as (select r.*, coalesce(r.confidence >= 0.8 and list_has_any(s.ts, o.dom) and list_has_any(t.ts, o.rng), false) as ok from relations r left join types s on s.doc_id = r.doc_id and s.name = r.subject left join types t on t.doc_id = r.doc_id and t.name = r.object left join onto o on o.relation = r.predicate)"""
_ALL = f"with {_NOTE}, {_DICT}, {_LINKS}, {_CANDIDATES}, {_STAGES}, {_RELATED}"
_F = "replace(lower({}), 'ß', 'ss')"
_SPECS = "specs as (select * from (values " + ", ".join(f"({i}, '{t}', '{x}', '{c}', {m})" for i, t, x, c, m in SPECS) + ") as v(o, st, sx, sc, ms))"
_WHY = f"""{_SPECS}, sd as (select *, coalesce(source_ids, []) as src from silver_decisions where trim(rationale, ' ') <> ''),
hit as (select sd.id as d, sd.ord, corpus_id, st, sx, sc, src, o from sd join specs on contains({_F.format("title")}, st) or contains(st, {_F.format("title")})),
own as (select ord, title, rationale, src, confidence, exists (select 1 from bronze_documents b where list_contains(src, b.id) and contains(b.content, rationale)) as g from sd where id not in (select d from hit)),
sup as (select o, st, sx, sc, list_sort(list_distinct(list(b.id))) as src, max(cast(contains(b.content, sx) as int)) as g from specs join (select id, content, {_F.format("concat_ws(' ', content, json_extract_string(metadata, '$.title'), array_to_string(section_path, ' '))")} as hay from bronze_documents) b
  on len(list_filter(ms, lambda m: not contains(b.hay, m))) = 0 group by 1, 2, 3, 4),
every as (select 0 as stage, cast(ord as varchar) || '/' || lpad(cast(o as varchar), 6, '0') as k, st as title, sx as x, sc as c, sx as span, src, 0.92 as conf from hit union all select 0, cast(ord as varchar), title, rationale, 'rationale', case when g then rationale end, src, confidence from own
  union all select 1, lpad(cast(o as varchar), 6, '0'), st, sx, sc, case when g = 1 then sx end, src, 0.92 from sup),
reasons as (select min_by(title, (stage, k)) as title, min_by(x, (stage, k)) as x, min_by(c, (stage, k)) as c, min_by(span, (stage, k)) filter (where span is not null) as span, list_sort(list_distinct(flatten(list(src)))) as src, max(conf) as conf from every group by {_F.format("title")}, {_F.format("x")})"""
_GRAPH = f"""rows as (select type, name, source_ids as src from silver_entities where type is not null union all select 'Decision', title, coalesce(source_ids, []) from silver_decisions union all select 'Decision', title, src from reasons
  union all select 'Rationale', title || ': ' || x, src from reasons union all select 'Concept', 'Rationale Category: ' || c, src from reasons),
nodes as (select type, {_F.format("trim(name, ' ')")} as k, count(*) as mentions, len(list_distinct(flatten(list(src)))) as n from rows where trim(name, ' ') <> '' group by 1, 2),
pn as (select type, min_by(name, (s, cast(ord as varchar))) as name from (select type, name, '0' as s, ord from silver_entities where type in ('Project', 'Tool') and trim(name, ' ') <> '') group by type, {_F.format("trim(name, ' ')")}),
sdx as (select *, coalesce(source_ids, []) as src from silver_decisions),
er as (select title as s, 'HAS_RATIONALE' as r, title || ': ' || x as t, src, conf as w from reasons union all select title || ': ' || x, 'RELATED_TO', 'Rationale Category: ' || c, src, conf from reasons
  union all select title, 'MADE_IN', pn.name, src, confidence from sdx join pn on pn.type = 'Project' and {_F.format("pn.name")} = {_F.format("project")} union all select title, 'SUPERSEDES', u.x, src, confidence from sdx, unnest(supersedes) as u(x) where u.x is not null
  union all select title, 'USES', pn.name, src, confidence from sdx join pn on pn.type = 'Tool' and contains({_F.format("concat_ws(' ', title, coalesce(rationale, ''))")}, {_F.format("pn.name")}) where status = 'accepted')"""
_PHONE = r"(?:\+?[0-9]{1,3}[\s\p{Z}\x{85}.-]?)?(?:\(?[0-9]{3}\)?[\s\p{Z}\x{85}.-]?[0-9]{3}[\s\p{Z}\x{85}.-]?[0-9]{4})"
_NOWORD = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
_SECTIONS = r"""b as (select ord, source_id || '@' || ord as base, content, string_split_regex(regexp_replace(content, '(?m)^(#{1,2}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) as parts from bronze_documents where content is not null),
s0 as (select ord, base, case when len(parts) > 2 then parts[2:] else [content] end as ps, len(parts) > 2 as cut from b),
s1 as (select ord, base, cut, unnest(range(1, len(ps) + 1)) as section_no, unnest(ps) as raw from s0),
sec as (select ord, section_no, case when cut then base || '#' || replace(replace(trim(regexp_replace(regexp_extract(raw, '^#{1,2}[ \t]+([^\r\n]*)', 1), '[\s\p{Z}\x{85}]+', ' ', 'g'), ' '), '/', '-'), ':', ' -') else base end as sid, raw as content from s1)"""


def _packed(src: str, keys: str) -> str:
    """SQL of the chunks of ``content`` in ``src``: blocks folded one by one by a recursive query, then windows."""
    strip = _STRIP.format("content")
    return rf"""x0 as (select {keys}, {strip} as txt from {src}), blk as (select {keys}, txt, string_split_regex(regexp_replace(txt, '(\n[\s\p{{Z}}\x{{85}}]*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as bs from x0 where length(txt) > 1800),
f as (select {keys}, bs, 0 as i, '' as cur, cast(null as varchar) as part from blk
  union all select {keys}, bs, i + 1, case when length(cur) + length(bs[i + 1]) <= 1800 then cur || bs[i + 1] when {_STRIP.format("cur")} <> '' then right(cur, 120) || bs[i + 1] else '' end,
    case when length(cur) + length(bs[i + 1]) <= 1800 then null when {_STRIP.format("cur")} <> '' then cur else bs[i + 1] end from f where i < len(bs)),
runs as (select {keys}, i, {_STRIP.format("part")} as run from f where part is not null union all select {keys}, i + 1, {_STRIP.format("cur")} from f where i = len(bs) union all select {keys}, 0, txt from x0 where length(txt) <= 1800),
win as (select {keys}, i, unnest(range(0, greatest(cast(ceil((length(run) - 1800) / 1680.0) as int), 0) + 1)) as j, run from runs),
chunks as (select {keys}, i, j, regexp_replace(substring(run, j * 1680 + 1, 1800), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g') as chunk from win)"""


ORACLE = {
    "packed_chunks": f"with recursive {_packed('bronze_documents', 'ord')} select ord, row_number() over (partition by ord order by i, j) as chunk_no, length(chunk) as n_chars, sha256(chunk) as chunk_hash from chunks where chunk <> ''",
    "section_chunks": f"""with recursive {_SECTIONS}, {_packed('sec', 'ord, section_no, sid')}, c as (select ord, section_no, sid, chunk, row_number() over (partition by ord, section_no order by i, j) as chunk_no, count(*) over (partition by ord, section_no) as n_chunks from chunks where chunk <> '')
select ord, case when n_chunks > 1 then sid || '::chunk-' || lpad(cast(chunk_no as varchar), 3, '0') || '-of-' || lpad(cast(n_chunks as varchar), 3, '0') else sid end as source_id, section_no, chunk_no, n_chunks, sha256(chunk) as chunk_hash from c""",
    "redact_pii": rf"""with e as (select id, content, regexp_replace(content, '(?i)(^|{_NOWORD})([A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}})($|{_NOWORD})', '\1[email]\3', 'g') as t from personal_memories),
p as (select id, content, regexp_replace(regexp_replace(t, '(^|{_NOWORD})({_PHONE})($|{_NOWORD})', '\1[phone]\3', 'g'), '(^|{_NOWORD})({_PHONE})($|{_NOWORD})', '\1[phone]\3', 'g') as t from e)
select distinct id, sha256(t) as redacted_hash, length(content) - length(t) as shorter_by from p""",
    "note_tags": f"""with {_NOTE} select id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(content, '[\\p{{L}}\\p{{N}}_]#', 'x', 'g'), '#([A-Za-z0-9_/-]+)', 1))), ',') as tags,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(split_part(x, '|', 1), ' ')))), ',') as links from notes""",
    "typed_links": f"with {_NOTE}, {_DICT}, {_LINKS} select id, line_no, link_no, type, name, label from links",
    "entity_candidates": f"with {_NOTE}, {_DICT}, {_LINKS}, {_CANDIDATES} select id, cast(rule as bigint) as rule, cast(pos as bigint) as pos, type, name, cast(confidence as double) as confidence from cands",
    "extracted_entities": f"{_ALL} select id, doc_id, type, name, span, cast(confidence as double) as confidence from entities",
    "note_projects": f"with {_NOTE}, {_DICT}, {_LINKS}, {_CANDIDATES} select id, project from proj",
    "decision_stages": f"with {_NOTE}, {_STAGES} select id, cast(stage as bigint) as stage, cast(pos as bigint) as pos, title, status, rationale, decision_date, project, supersedes, cast(confidence as double) as confidence from stages",
    "extracted_relations": f"{_ALL} select id, doc_id, subject, predicate, object, cast(confidence as double) as confidence from relations",
    "validated": f"""{_ALL}, {_VALID}, u as (select 'entity' as kind, id, ok from oke union all select 'decision', id, ok from okd union all select 'relation', id, ok from okr)
select kind, case when ok then 'kept' else 'rejected' end as state, count(*) as n, count(distinct id) as ids from u group by 1, 2""",
    "rejected_relations": f"{_ALL}, {_VALID} select id, 'validation_failed' as reason, subject, predicate, object from okr where not ok",
    "rationale_memory": f"with {_WHY} select title as decision_title, x as rationale_text, c as category, span, array_to_string(src, ',') as source_ids, cast(conf as double) as confidence from reasons",
    "graph_nodes": f"with {_WHY}, {_GRAPH} select type, count(*) as n_nodes, cast(sum(mentions) as bigint) as mentions, cast(sum(n) as bigint) as n_sources from nodes group by 1",
    "graph_edges": f"with {_WHY}, {_GRAPH} select lower(min(s)) as source_key, r as relation, lower(min(t)) as target_key, max(cast(w as double)) as weight, count(*) as n_rows, array_to_string(list_sort(list_distinct(flatten(list(src)))), ',') as source_ids from er group by {_F.format('s')}, r, {_F.format('t')}",
    "merged_entities": f"select min_by(id, (ord, id)) as id, min_by(type, (ord, id)) as type, min_by(name, (ord, id)) as name, array_to_string(list_sort(list_distinct(flatten(list(source_ids)))), ',') as source_ids, max(confidence) as confidence from silver_entities group by silver_entities.type, {_F.format('name')}",
    "merged_decisions": f"select min_by(id, (ord, id)) as id, min_by(title, (ord, id)) as title, min_by(rationale, (ord, id)) filter (where trim(rationale, ' ') <> '') as rationale, array_to_string(list_sort(list_distinct(flatten(list(source_ids)))), ',') as source_ids, max(confidence) as confidence from silver_decisions group by {_F.format('title')}",
}
