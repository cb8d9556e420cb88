"""Store, corpus API, timeline and query language."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import timeline
from memspark.plans.mql import Query, parse_mql
from memspark.store import Corpus, Rules, Store


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    notes = root / "notes"
    for d in ("a", "b"):
        (notes / d).mkdir(parents=True)
    (notes / "a" / "README.md").write_text("---\ntitle: First\n---\n# First\nDecision: Use blue\nDate: 2024-01-01\nProject: Paint\nRationale: it is calm\n\nDecision: Use ink\nDate: 2024-01-05\nsee [[Colour]]\n프로젝트: [[Paint]]")
    (notes / "b" / "README.md").write_text("# Second\nDecision: Use red\nDate: 2024-02-01\nProject: Paint\nSupersedes: use  BLUE\n")
    c = Corpus(spark, str(root / "store"))
    c.ingest(str(notes))
    return c, notes


def test_corpus_round(spark, corpus, tmp_path):
    c, notes = corpus
    got = {r["title"]: r for r in c.decisions().collect()}
    # labels belong to the decision line before them
    assert got["Use ink"]["valid_from"] == "2024-01-05" and got["Use ink"]["current"] and got["Use ink"]["superseded_by"] == []
    assert got["Use blue"]["valid_to"] == "2024-02-01" and got["Use blue"]["superseded_by"] == ["use red"] and not got["Use blue"]["current"]
    assert {(r["source"], r["relation"], r["target"]) for r in c.graph("colour")[1].collect()} == {("First", "RELATED_TO", "Colour")}
    assert {r["name"] for r in c.graph("colour")[0].collect()} == {"First", "Colour"}
    n = c.store.read("bronze").count()
    assert c.ingest(str(notes))["bronze"] == 0 and c.store.read("bronze").count() == n
    # one folder again leaves the file of the same name in the other alone
    c.ingest(str(notes / "a"))
    assert c.documents().where("source_id = 'b/README.md'").count() == 1
    (notes / "b" / "README.md").write_text("# Second\nnothing was said\n")
    c.ingest(str(notes))
    assert {r["title"] for r in c.decisions(current_only=True).collect()} == {"Use blue", "Use ink"}
    assert c.stats()["inactive"] == 1 and c.stats()["bronze"] == 3
    c.write_decision("Use green", "it grows", project="Paint", date="2024-03-01", supersedes="Use blue", participants=["Ann B", "Cy D"])
    assert {r["title_key"] for r in c.mql("FIND decisions WHERE current=true").collect()} == {"use green", "use ink"}
    assert c.decisions().where("title_key = 'use green'").first()["participants"] == ["Ann B", "Cy D"]
    assert [tuple(r) for r in c.why("use green").collect()] == [("Use green", "it grows (rationale)")]
    assert c.why("no such").collect() == [] and "Use green" in c.current_decision()
    assert {r["stage"] for r in c.query("green", 50).collect()} == {1, 2, 3, 4} and c.query("zzzz").collect() == []
    assert {r["kind"] for r in c.retrieve("green", 20).collect()} == {"node", "edge", "document"}
    assert c.sources("green").count() == 1 and c.pack("green", 20).where("kind = 'extractive' and length(content) = 20").count() == 1
    assert {(r["title_key"]) for r in c.timeline("paint").collect()} == {"use blue", "use green", "use ink"}
    assert {r["kind"] for r in c.diff(30).collect()} == {"added", "superseding", "superseded"}
    n = c.export_vault(str(tmp_path / "vault"))
    assert n == len(list((tmp_path / "vault").rglob("*.md"))) and "[[Projects/Paint|Paint]]" in (tmp_path / "vault" / "Decisions" / "Use green.md").read_text()
    assert (tmp_path / "vault" / "Index.md").read_text().startswith("# Memory Index\n\n## Concepts\n")
    c.export_kg(str(tmp_path / "kg"))
    assert {p.name for p in (tmp_path / "kg").iterdir() if p.is_dir()} == {"kind=entities", "kind=relationships", "kind=chunks"}
    assert c.import_memories() == 3 and c.import_memories() == 0
    c.remember("Task", "Buy paint", "priority one", ["shop"])
    assert {r["title"] for r in c.next_actions().collect()} == {"Buy paint"} and c.recall("shop").count() == 1
    with pytest.raises(ValueError):
        c.remember("Nothing", "a", "b")
    run = c.sync(str(notes), "markdown").first()
    assert run["status"] == "success" and run["unchanged"] == 2 and c.sync_history().count() == 1
    assert [r["change"] for r in c.connector_diff(str(notes / "a"), "markdown").orderBy("change").collect()] == ["new", "removed", "removed"]


def test_failed_ingest_leaves_the_corpus(spark, corpus, tmp_path, monkeypatch):
    c, _ = corpus
    before, dirs = c.store.manifest(), len(list(__import__("pathlib").Path(c.store.root).glob("*/v-*")))
    (tmp_path / "x.md").write_text("# X\nDecision: Use pink\n")

    def fail(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(c, "_gold", fail)
    with pytest.raises(RuntimeError, match="lost"):
        c.ingest(str(tmp_path))
    assert c.store.manifest() == before and len(list(__import__("pathlib").Path(c.store.root).glob("*/v-*"))) == dirs
    monkeypatch.undo()
    with c.store.writing(), pytest.raises(RuntimeError, match="being written"):
        c.ingest(str(tmp_path))


def test_history_and_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for i in range(4):
        with s.writing() as write:
            s.commit(replace={"t": write("t", spark.range(i + 1))}, append={"log": write("log", spark.range(1))}, info={"i": i})
    assert s.read("t").count() == 4 and s.read("t", 2).count() == 2 and s.read("log").count() == 4
    assert [h["i"] for h in s.history()] == [0, 1, 2, 3]
    assert s.vacuum(2) == 2 and s.read("t", 3).count() == 3 and s.read("log").count() == 4
    with pytest.raises(ValueError):
        s.read("t", 1)


def test_answer_rules_and_model(spark, tmp_path):
    (tmp_path / "n.md").write_text("# Note\nThe desk waits for Omega.")
    answers = spark.createDataFrame([(2, 1, ["omega"], "second"), (1, 9, ["what", "omega"], "first")], "set_ord long, rule_ord long, terms array<string>, answer string")
    c = Corpus(spark, str(tmp_path / "s"), rules=Rules(answers=answers, client=Fake()))
    c.ingest(str(tmp_path / "n.md"))
    assert {r["name"] for r in c.store.read("nodes").where("type in ('Tool', 'Decision')").collect()} == {"Omega", "Wait"}
    assert c.query("What is Omega?").first()["match"] == "first" and c.query("omega").first()["match"] == "second"
    assert c.store.read("rejects").where("kind = 'relation'").count() == 1


class Fake:
    """A model whose first answer is out of schema; from then on one row in it is."""

    def __call__(self, prompt, payload):
        bad = {"entities": [{"type": "Planet", "name": "Omega"}]}
        good = {"entities": [{"type": "Tool", "name": "Omega", "confidence": 0.9}, {"type": "Tool", "name": "Omega", "confidence": 7}], "relations": [{"subject": "Ann", "predicate": "USES", "object": "Omega", "confidence": 0.9}], "decisions": [{"title": "Wait", "status": "accepted", "confidence": 0.8}]}
        return good if "retry_feedback" in payload else bad


def test_mql():
    assert parse_mql(" find  decisions where CURRENT=true") == Query("find")
    assert parse_mql('WHY decision="a b"') == Query("why", "a b")
    assert parse_mql("show changes last 30 days") == Query("changes", days=30)
    assert parse_mql("drop table") is None


def test_timeline_rules(spark):
    rows = [(1, "A", "proposed", None, None, "2024-02-01", None), (2, " a ", "accepted", "P", "r", "2024-01-01", []), (3, "B", "accepted", "P", "", "2024-03-01", ["A", None, "Z"]), (4, None, "accepted", "P", "", None, ["B"])]
    df = spark.createDataFrame(rows, "ord int, title string, status string, project string, rationale string, decision_date string, supersedes array<string>")
    df = df.withColumns({"source_ids": F.array(F.lit("s")), "participants": F.array().cast("array<string>"), "confidence": F.lit(0.5)})
    links = timeline.supersession_edges(df)
    got = {r["title_key"]: r for r in timeline.with_links(timeline.resolve_supersession(timeline.merge_timeline(df), links), links).collect()}
    assert set(got) == {"a", "b"} and got["a"]["status"] == "accepted" and got["a"]["valid_from"] == "2024-01-01"
    assert not got["a"]["current"] and got["a"]["valid_to"] == "2024-03-01" and got["b"]["current"]
    assert got["b"]["supersedes"] == ["a", "z"] and got["a"]["superseded_by"] == ["b"]
    ended = timeline.resolve_supersession(timeline.merge_timeline(df.withColumn("valid_to", F.when(F.col("ord") == 2, "2024-02-15"))), links)
    assert ended.where("title_key = 'a'").first()["valid_to"] == "2024-02-15"
    assert [r["title_key"] for r in timeline.in_order(ended).collect()] == ["a", "b"]
    empty = df.limit(0)
    assert timeline.memory_diff(timeline.resolve_supersession(timeline.merge_timeline(empty), timeline.supersession_edges(empty))).collect() == []
