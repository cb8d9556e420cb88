"""Operators of extraction, retrieval, context and planning on small fixtures: nulls, empties, ties, repeats."""

import pytest
from pyspark.sql import functions as F

from memspark.functions import text
from memspark.operators import bronze, chunking, context, contract, extraction, graph, matching, personal, planning, quality, rationale, recall, silver
from memspark.plans.ontology import RELATIONS, default_ontology, dump_yaml


def _one(spark, *cols, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(*cols).first()


def test_text(spark):
    t = F.col("t")
    r = _one(spark, text.redact(t).alias("a"), text.slug(t).alias("b"), text.file_name(t).alias("c"), text.ascii_tokens(t).alias("d"), text.path_part(F.lit(" ")).alias("e"), value="Mail bo@x.org or +82 010-123-4567, no. 12345678901234567/ä")
    assert r["a"] == "Mail [email] or [phone], no. 12345678901234567/ä" and r["b"] == "mail-bo-x-org-or-82-010-123-4567-no-12345678901234567" and "/" not in r["c"] and r["d"][:2] == ["mail", "bo"] and r["e"] == "channel"
    assert _one(spark, text.redact_secrets(F.create_map(F.lit("Token"), t, F.lit("k"), t)).alias("m"))["m"] == {"Token": "[redacted]", "k": "x"}
    for value, want in (('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("[1]", None), ("none", None), ("{bad}", None)):
        assert _one(spark, text.embedded_json(t).alias("j"), value=value)["j"] == want
    r = _one(spark, silver.front_matter(t).alias("m"), silver.wikilinks(t).alias("w"), extraction.all_links(t).alias("l"), extraction.tags(t).alias("g"), value="---\ntitle: T\ntitle: U\n---\nBody [[b0|c]] [[a]] a#no #yes")
    assert r["m"] == {"title": "U"} and r["w"] == r["l"] == ["a", "b0"] and r["g"] == ["yes"]


def _pack(t, limit, overlap):
    """The fold as a loop."""
    import re

    t = t.strip()
    if len(t) <= limit:
        return [t] if t else []
    runs, cur = [], ""
    for b in filter(None, re.split(r"(\n\s*\n)", t)):
        if len(cur) + len(b) <= limit:
            cur += b
        elif cur.strip():
            runs, cur = [*runs, cur], cur[-overlap:] + b
        else:
            runs, cur = [*runs, b], ""
    out = []
    for r in [*runs, cur]:
        r, at = r.strip(), 0
        while r:
            out.append(r[at : at + limit].strip())
            if at + limit >= len(r):
                break
            at += limit - overlap
    return [x for x in out if x]


def test_chunks(spark):
    import random

    rnd = random.Random(4)
    texts = ["", None, "x" * 40, "x" * 95, " \n\n "] + ["".join(rnd.choice(["word ", "\n", "\n\n", "\n \n", "y" * 25, "é"]) for _ in range(n)) for n in (5, 30, 80, 200, 400)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.pack_blocks(F.col("t"), 40, 8).alias("p")).collect()
    for r in got:
        assert r["p"] == (None if texts[r["i"]] is None else _pack(texts[r["i"]], 40, 8)), texts[r["i"]]
    long = spark.createDataFrame([("x" * 4000,), ("",), (None,)], "t string").select(chunking.hard_windows(F.col("t")).alias("w")).collect()
    assert [len(x) for x in long[0]["w"]] == [1800, 1800, 640] and long[1]["w"] == [] and not long[2]["w"]
    s = chunking.sections(spark.createDataFrame([(1, "pre\n# A\nx\n### c\n## B\ny\n# D\n## E"), (2, "plain\n# one"), (3, None), (4, "")], "k int, t string"), "k", "t").orderBy("k", "section_no").collect()
    assert [(r["k"], r["title"], r["path"], r["body"]) for r in s] == [(1, "A", "A", "# A\nx\n### c"), (1, "B", "A > B", "## B\ny"), (1, "D", "D", "# D"), (1, "E", "D > E", "## E"), (2, None, "", "plain\n# one"), (4, None, "", "")]
    deep = "# h\n" + "line\n" * 60_000 + "# i\nz"
    assert chunking.sections(spark.createDataFrame([(1, deep)], "k int, t string"), "k", "t").count() == 2
    assert spark.createDataFrame([(deep,)], "t string").select(F.size(chunking.pack_blocks(F.col("t"))).alias("n")).first()["n"] > 100


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "cde"), (3, None), (4, "")], "i int, t string")
    terms = spark.createDataFrame([("cd",), ("abcde",), ("",), (None,), ("zz",)], "w string")
    want = {(1, "cd"), (1, "abcde"), (2, "cd")}
    for few in (10, 1):  # broadcast, and by letter groups
        assert {(r["i"], r["w"]) for r in matching.contains_join(texts, "t", terms, "w", few).collect()} == want
    assert matching.contains_join(texts, "t", terms.limit(0), "w").collect() == []


DOCS = "id string, corpus_id string, ord int, title string, content string"


def _docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", "c", i, f"T{i}", t) for i, t in enumerate(texts)], DOCS)


def test_extraction(spark):
    terms = spark.createDataFrame([("Tool", "Omega"), ("Tool", "Sigma"), ("Project", "Alpha Base"), ("Person", "Ann")], "type string, term string")
    docs = _docs(
        spark, "---\nproject: Alpha\nauthor: Ann\ndate: 2024-01-01\n---\n# Head\nAlpha uses Omega. Sigma was considered instead of Omega.\n관련 인물: [[Ann|A]] [[Bob]]\n#tag", "Alpha Base adopts Sigma.\n도구: [[Omega]]", "```\nDecision: fenced\n```\nDecision: One\nRationale: r1\nRationale: r2\nDecision: Two\nStatus: rejected\n", "We decided to go. Not this one", None, "", "use of nothing. 채택했다"
    )
    found = extraction.entities(docs, terms)
    got = {(r["doc_id"], r["type"], r["name"]) for r in found.collect()}
    assert {("d0", "Project", "Alpha"), ("d0", "Person", "Ann"), ("d0", "Person", "Bob"), ("d0", "Concept", "Head"), ("d0", "Concept", "tag"), ("d0", "Tool", "Omega"), ("d1", "Project", "Alpha Base"), ("d4", "Document", "T4")} <= got
    assert found.where("doc_id = 'd0' and type = 'Person' and name = 'Ann'").first()["confidence"] == 0.75  # the first rule's
    d = extraction.decisions(docs, terms)
    got = {(r["doc_id"], r["title"], r["status"], r["rationale"]) for r in d.collect()}
    assert got == {("d2", "One", "accepted", "r1 r2"), ("d2", "Two", "rejected", None), ("d3", "We decided to go", "accepted", None), ("d6", "채택했다", "accepted", None)}
    literal = spark.createDataFrame([("T2", 0, "By title", "proposed", 0.9)], "doc_title string, pos int, title string, status string, confidence double").withColumns({k: F.lit(None).cast("string") for k in ("rationale", "decision_date", "project")} | {k: F.array().cast("array<string>") for k in ("supersedes", "participants")})
    assert {(r["id"], r["stage"], r["title"]) for r in extraction.decision_stages(docs, literal).where("id = 'd2'").collect()} == {("d2", 1, "By title")}
    pairs = spark.createDataFrame([("Omega", "RELATED_TO", "Head", 0.9)], "subject string, predicate string, object string, confidence double")
    rel = {(r["doc_id"], r["subject"], r["predicate"], r["object"]) for r in extraction.relations(docs, found, d, terms, pairs).collect()}
    assert rel == {("d0", "Alpha", "USES", "Omega"), ("d0", "T0", "MENTIONS", "Ann"), ("d0", "T0", "MENTIONS", "Bob"), ("d0", "Omega", "RELATED_TO", "Head"), ("d1", "Alpha Base", "USES", "Sigma"), ("d1", "T1", "RELATED_TO", "Omega")}
    e, dd, r, rejects = silver.validate(found, d, extraction.relations(docs, found, d, terms, pairs), docs, default_ontology(spark))
    assert {(x["subject"], x["object"]) for x in rejects.where("kind = 'relation'").collect()} == set() or r.count() + rejects.where("kind = 'relation'").count() == len(rel)
    bad = spark.createDataFrame([("r", "d0", "Ann", "USES", "Omega", ["d0"], 0.9)], "id string, doc_id string, subject string, predicate string, object string, source_ids array<string>, confidence double")
    assert silver.validate(found, d, bad, docs, default_ontology(spark))[3].where("kind = 'relation'").first()["subject"] == "Ann"
    empty = docs.limit(0)
    assert extraction.entities(empty, terms).collect() == [] and extraction.decisions(empty).collect() == []


def test_rationale(spark):
    decided = spark.createDataFrame([("c", 1, "x1", "Use Omega now", "cheap and small", ["d1"], 0.8), ("c", 2, "x2", "Other", "said here", ["d2", "gone"], 0.7), ("c", 3, "x3", "None", None, [], 0.9), ("c", 4, "x4", "OTHER", "Said here", ["d1"], 0.9)], "corpus_id string, ord int, id string, title string, rationale string, source_ids array<string>, confidence double")
    docs = spark.createDataFrame([("d1", "c", "Omega is cheap", None), ("d2", "c", "it was said here", ["Omega"])], "id string, corpus_id string, content string, section_path array<string>")
    specs = spark.createDataFrame([(1, "use omega", "it is cheap", "cost", ["omega", "CHEAP"]), (2, "Nothing", "no text", "x", ["absent"]), (3, "Path", "by path", "p", ["omega", "said"]), (4, "Never", "n", "n", [])], "spec_ord long, decision_title string, text string, category string, markers array<string>")
    got = {(r["decision_title"], r["rationale_text"]): r for r in rationale.rationales(decided, docs, specs).collect()}
    assert set(got) == {("use omega", "it is cheap"), ("Other", "said here"), ("Path", "by path")}
    assert got["use omega", "it is cheap"]["source_ids"] == ["d1"] and got["use omega", "it is cheap"]["confidence"] == 0.92
    assert got["Other", "said here"]["source_ids"] == ["d1", "d2", "gone"] and got["Other", "said here"]["span"] == "said here" and got["Other", "said here"]["confidence"] == 0.9
    events = spark.createDataFrame([("Use Omega now", "own", 1)], "title string, rationale string, ord int")
    reasons = rationale.rationales(decided, docs, specs)
    assert [tuple(r) for r in rationale.why(events, reasons, "use omega now").collect()] == [("Use Omega now", "it is cheap (cost)")]
    assert [tuple(r) for r in rationale.why(events, reasons, "other").collect()] == [("Other", "said here (rationale)")]
    assert [tuple(r) for r in rationale.why(events, None, "omega").collect()] == [("Use Omega now", "own")]


def test_graph(spark):
    nodes = spark.createDataFrame([("n1", "Tool", "A/B", "a/b", ["s"]), ("n2", "Tool", "A-B", "a-b", []), ("n3", "Decision", "Go", "go", ["s"])], "id string, type string, name string, canonical_name string, source_ids array<string>")
    edges = spark.createDataFrame([("GO", "USES", "A/B"), ("Go", "MADE_IN", "P"), ("Go", "SUPERSEDES", "Stay")], "source string, relation string, target string")
    line = spark.createDataFrame([("go", "accepted", None, "why")], "title_key string, status string, project string, rationale string")
    notes = {r["path"]: r["content"] for r in graph.vault_notes(nodes, edges, line).collect()}
    assert set(notes) == {"Tools/A-B n1.md", "Tools/A-B n2.md", "Decisions/Go.md"}  # no note replaces another
    assert "- USES: GO" in notes["Tools/A-B n1.md"] and "- n/a" in notes["Tools/A-B n2.md"]
    assert "Project: [[Projects/P|P]]" in notes["Decisions/Go.md"] and "- [[Tools/A-B|A/B]]" in notes["Decisions/Go.md"] and "- [[Decisions/Stay|Stay]]" in notes["Decisions/Go.md"]
    rows = spark.createDataFrame([(1, "A", "R", "b", ["x"], 0.5), (2, "a", "R", "B", ["y", "x"], 0.9), (3, None, "R", "b", [], 1.0)], "ord int, source string, relation string, target string, source_ids array<string>, weight double")
    assert [tuple(r) for r in graph.upsert_edges(rows).collect()] == [("A", "R", "b", 0.9, 2, ["x", "y"])]


def test_sources_of_rows(spark):
    rows = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a"]), ("r3", []), ("r4", ["c"])], "id string, source_ids array<string>")
    gone = spark.createDataFrame([("a",), ("a",)], "id string")
    assert {(r["id"], tuple(r["source_ids"])) for r in bronze.without_sources(rows, gone).collect()} == {("r1", ("b",)), ("r3", ()), ("r4", ("c",))}
    assert {r["id"] for r in bronze.using_sources(rows, gone).collect()} == {"r1", "r2"}
    assert {r["id"] for r in bronze.remove(rows, spark.createDataFrame([("r1",)], "id string")).collect()} == {"r2", "r3", "r4"}


def test_context(spark):
    items = [("g", "k1", 1, 2.0, "x" * 60), ("g", "k2", 2, 1.0, "head\nnext line\nmiddle\nthe decision is made\n" + "y" * 50), ("g", "k3", 3, 0.0, "z" * 40), ("g", "k4", 4, 3.0, ""), ("g", "k5", 5, -1.0, ""), ("g", "k6", 6, None, None), ("h", "k1", 1, None, "short")]
    df = spark.createDataFrame(items, "q string, k string, ord int, priority double, content string")
    packed = context.pack_context(df, "q", "k", 90)
    got = {(r["q"], r["k"]): (r["kind"], r["content"]) for r in packed.collect()}
    assert got == {("g", "k1"): ("none", "x" * 60), ("g", "k2"): ("extractive", "head\nnext line\nthe decision i…"), ("g", "k3"): ("dropped", None), ("g", "k4"): ("none", ""), ("g", "k5"): ("dropped", None), ("h", "k1"): ("none", "short")}
    back = {(r["q"], r["k"]): r["content"] for r in context.restore_context(packed, "q", "k").collect()}
    assert back == {(q, k): c for q, k, _, _, c in items if got.get((q, k), ("dropped",))[0] != "dropped"}
    with pytest.raises(ValueError):
        context.pack_context(df, "q", "k", 0)


def test_recall(spark):
    assert recall.query_terms("What, is A 결정 2024 is?") == ["what", "is", "결정", "2024"]
    assert _one(spark, recall.snippet(F.lit("---\na: b\n---\n# H\nOne. Two [[cat]]. Three. Four."), ["cat"]).alias("s"))["s"] == "One. Two cat. Three."
    assert _one(spark, recall.snippet(F.lit("One. Two."), ["zebra"]).alias("s"))["s"] == "One."
    docs = spark.createDataFrame([("1", "a", "x", "alpha"), ("2", "b", "x", "alpha beta"), ("3", "c", "x", None)], "id string, source_id string, source_type string, content string")
    hints = spark.createDataFrame([(1, 1, "ALPHA"), (1, 2, "alpha"), (1, 3, "alpha"), (2, 1, "beta"), (2, 2, None)], "group long, hint_ord long, hint string")
    assert {tuple(r) for r in recall.hint_sources(docs, hints).collect()} == {(1, 1, "1"), (1, 2, "2"), (2, 1, "2")}
    rules = spark.createDataFrame([(1, [], "never"), (2, ["a  b"], "two"), (3, None, "never")], "rule_ord long, terms array<string>, answer string")
    asked = spark.createDataFrame([(1, "xAByz"), (2, None), (3, "b a")], "q int, t string")
    assert [tuple(r) for r in recall.rule_answers(asked, "q", "t", rules).collect()] == [(1, 2, "two")]
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, 2.0]) for i in range(20)], "id int, v array<double>")
    one, many = recall.nearest(v, "id", "v", v.where("id < 4"), 3), recall.nearest(v, "id", "v", v.where("id < 4"), 3, block=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_memories(spark):
    docs = spark.createDataFrame([(1, "t1", "jira", "s1", '{"memory_type": "Idea", "title": "T", "n": {"x": 1}, "l": ["a"]}'), (2, "t2", "gmail", "s2", None), (3, "t3", "gmail", "s2", None), (4, "t4", "x", "s3", '{"memory_type": "Odd"}')], "ord long, content string, source_type string, source_id string, metadata string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["source_id"]: r for r in personal.from_chunks(docs).collect()}
    assert {(k, r["type"], r["title"], r["id"]) for k, r in got.items()} == {("s1", "Idea", "T", "personal_000001"), ("s2", "Email", "s2", "personal_000002"), ("s3", "Document", "s3", "personal_000003")}
    assert got["s1"]["metadata"] == {"memory_type": "Idea", "title": "T", "l": '["a"]'} and got["s1"]["tags"] == ["jira"]
    more = personal.from_chunks(docs, personal.from_chunks(docs).where("source_id <> 's2'"), 7)
    assert [(r["id"], r["source_id"]) for r in more.collect()] == [("personal_000008", "s2")]
    m = spark.createDataFrame([("a", {"date": "2024-05-01T10:00:00+09:00"}), ("b", {}), ("c", None)], "id string, metadata map<string,string>").withColumn("created_at", F.lit("2024-05-01 01:30:00").cast("timestamp"))
    assert [r["id"] for r in personal.between(m, "2024-05-01 01:15:00").collect()] == ["b", "c"] and personal.between(m, None, "2024-05-01 01:00:00").count() == 1
    none = spark.createDataFrame([], "type string, source string, source_id string")
    assert tuple(personal.recall_summary(none).first()) == (0, 0.0, 1, 0)


def test_planning(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", None), ("b", "p\nq\n")], "r string, t string")
    p = planning.load_plan(docs, "t", "r").first()
    assert (p["chunks"], p["roots"], p["chars"], p["lines"], p["risk"], p["minutes_min"], p["minutes_max"]) == (3, 2, 5, 4, "low", 1, 2)
    e = planning.load_plan(docs.limit(0), "t", "r").first()
    assert (e["risk"], e["minutes_min"], e["minutes_max"]) == ("blocked", 0, 0)
    corpora = spark.createDataFrame([("alpha-notes", "/d/alpha", "r1"), ("alpha-notes", "/d/alpha", "r2"), ("beta", None, "r9"), ("gamma", "/d", "r3")], "corpus_id string, last_source_path string, root string")
    roots = spark.createDataFrame([("r1",), ("r2",)], "root string")
    ranked = planning.rank_corpora(corpora, "/d/alpha", roots)
    assert [(r["corpus_id"], r["score"]) for r in ranked.collect()] == [("alpha-notes", 0.99), ("gamma", 0.82)]
    assert planning.choose_corpus(ranked, "alpha", []) == ("alpha-notes", "update_existing", 0.99) and planning.choose_corpus(ranked.limit(0), "alpha", ["alpha", "alpha-2"]) == ("alpha-3", "create_new", 0.64)
    assert [r[0] for r in spark.createDataFrame([(8,), (16,), (47,), (200,)], "g int").select(planning.machine_tier(F.col("g"))).collect()] == [None, "T1", "T2", "T5"]


def test_contract_and_quality(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, h string")
    d = contract.listing_diff(old, new, ["k"], "h")
    assert {tuple(r) for r in d.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")}
    assert contract.diff_counts(d).first().asDict() == {"fetched": 3, "new": 1, "changed": 1, "unchanged": 1, "removed": 1}
    assert contract.diff_counts(d.limit(0)).first()["fetched"] == 0
    edges = spark.createDataFrame([("Omega Engine", "USES", "x"), ("b", "USES", "")], "source string, relation string, target string")
    cases = spark.createDataFrame([(1, "omega-engine", ["USES"], "X"), (2, "omega", ["MADE_IN"], "x"), (3, "", ["USES"], "x")], "case_id int, subject string, relations array<string>, object string")
    found = quality.found_triples(edges, cases)
    assert {tuple(r) for r in found.collect()} == {(1, True), (2, False), (3, False)}
    assert tuple(quality.triple_precision(edges, cases.where("case_id = 1")).first()) == (2, 1, 0.5) and quality.triple_precision(edges.limit(0), cases).first()["score"] == 0.0
    assert quality.grade({"precision": 1, "recall": 1, "grounding_error": 0.005, "rationale_recall": 1, "chain": 1}) == "A+" and quality.grade({"precision": 0, "recall": 1, "grounding_error": 0.01, "rationale_recall": 1, "chain": 1}) == "B"
    assert dump_yaml(default_ontology(spark)).count("domain:") == len(RELATIONS)
