"""Export readers with every field, the live source, streaming, settings and command line."""

import json

import pytest
from pyspark.sql import functions as F

from memspark import cli
from memspark.backends import Tables, backend
from memspark.config import Settings, load_settings
from memspark.sources.connector import Connector
from memspark.sources.exports import profile, read_source
from memspark.sources.live import ChatSource
from memspark.store import Corpus
from memspark.streaming.incremental import Progress, latest_marks, marks, merge_into, new_rows, read_stream, run_once


def _put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def _read(spark, path, kind, **more):
    return [(r, json.loads(r["metadata"])) for r in read_source(spark, str(path), kind, **more).orderBy("path", "pos").collect()]


def test_chat(spark, tmp_path):
    _put(tmp_path / "general" / "2024.json", [{"ts": "1.5", "user": "u", "text": "hello", "thread_ts": "1.0"}, {"text": "later"}, "no object"])
    _put(tmp_path / "root.json", {"messages": [{"ts": "9", "text": "x"}]})
    _put(tmp_path / "bad.json", "not json")
    got = _read(spark, tmp_path, "slack")
    assert [r["source_id"] for r, _ in got] == ["slack:general:1.5", "slack:general:1", "slack:root:9"]
    row, meta = got[0]
    assert row["root_source_id"] == "slack:general" and row["title"] == "Slack #general 1.5" and "User: u\n\nhello\nThread: 1.0" in row["content"]
    assert meta["channel"] == "general" and meta["user"] == "u" and meta["thread_ts"] == "1.0"


def test_issues(spark, tmp_path):
    at = _put(tmp_path / "a.json", {"issues": [{"key": "K-1", "fields": {"summary": "s", "description": "d", "status": {"name": "open"}, "comment": {"comments": [{"body": "c1"}, "skipped", {"text": "c2"}]}}}, {"id": 7, "title": "t", "body": "b"}]})
    (one, meta), (two, _) = _read(spark, at, "jira-json")
    assert one["source_id"] == "jira:K-1" and "# s\n\nd\n\n## Comments\n- c1\n- c2" in one["content"] and meta["status"] == "open" and "status: open" in one["content"]
    assert two["source_id"] == "jira:7" and two["title"] == "t"
    at = _put(tmp_path / "g.json", {"pull_requests": [{"number": 3, "pull_request": {}, "title": "t", "body": "b", "state": "open", "comments": [{"body": "c"}]}, {"number": 4, "kind": "issue", "title": "u", "discussion": [{"body": "e"}]}]})
    (one, meta), (two, _) = _read(spark, at, "github")
    assert one["source_id"] == "github:pull_request:3" and meta["state"] == "open" and "- c" in one["content"] and two["source_id"] == "github:issue:4" and "- e" in two["content"]
    at = _put(tmp_path / "p.json", {"id": "P", "title": "t", "content": "body", "url": "http://x", "last_edited_time": "2024"})
    ((one, meta),) = _read(spark, at, "notion")
    assert one["source_id"] == "notion:P" and meta["original_url"] == "http://x" and meta["modified_at"] == "2024" and "last_edited_time: 2024" in one["content"]


def test_json_lines(spark, tmp_path):
    at = _put(tmp_path / "l.jsonl", '{"id": "a", "content": "one", "comments": []}\n\nnot json\n{"id": "b", "content": "two"}\n')
    assert [r["source_id"] for r, _ in _read(spark, at, "notion")] == ["notion:a", "notion:b"]
    at = _put(tmp_path / "p.json", json.dumps({"items": [{"id": "c", "content": "three"}]}, indent=1))
    assert [r["source_id"] for r, _ in _read(spark, at, "notion")] == ["notion:c"]


def test_office(spark, tmp_path):
    at = _put(tmp_path / "d.json", {"files": [{"id": "D", "name": "n", "text": "body", "parents": ["x", "y"], "webViewLink": "u", "modifiedTime": "2024-01-01", "owners": [{"emailAddress": "a@x.org"}, "b@x.org; c"]}]})
    ((one, meta),) = _read(spark, at, "drive")
    assert one["source_id"] == "google_drive:D" and meta["folder"] == "x, y" and meta["owners"] == ["a@x.org", "b@x.org", "c"] and meta["memory_type"] == "Document" and meta["original_url"] == "u" and meta["modified_at"] == "2024-01-01"
    mail = {"threads": [{"threadId": "T", "messages": [{"id": "m1", "subject": "S", "from": "A <a@x.org>, b@x.org", "labelIds": ["IN", "X"], "date": "2024-01-02", "body": "hi"}, {"id": "m2", "from": {"emailAddress": {"address": "d@x.org"}}, "labelIds": ["IN"], "snippet": "yo +1 212 555 0100"}]}]}
    at = _put(tmp_path / "m.json", mail)
    ((one, meta),) = _read(spark, at, "gmail")
    assert one["title"] == "S" and meta["message_ids"] == ["m1", "m2"] and meta["labels"] == ["IN", "X"] and meta["participants"] == ["A <a@x.org>", "b@x.org", "d@x.org"] and meta["occurred_at"] == "2024-01-02"
    assert one["content"].index("hi") < one["content"].index("yo")
    ((one, meta),) = _read(spark, at, "gmail", redaction="content")
    assert "@" not in one["content"] and "555" not in one["content"] and "[phone]" in one["content"] and meta["participants"][1] == "[email]" and meta["message_ids"] == ["m1", "m2"]
    ((one, meta),) = _read(spark, at, "gmail", redaction="metadata")
    assert "b@x.org" in one["content"] and meta["participants"][1] == "[email]"
    at = _put(tmp_path / "c.json", {"events": [{"id": "E", "calendar_id": "c", "summary": "s", "start": {"dateTime": "2024-01-01T10:00"}, "end": {"date": "2024-01-02"}, "attendees": [{"email": "a@x.org"}], "htmlLink": "l", "location": "here", "description": "why"}]})
    ((one, meta),) = _read(spark, at, "calendar")
    assert one["source_id"] == "google_calendar:c:E" and meta["start"] == "2024-01-01T10:00" and meta["end"] == "2024-01-02" and meta["participants"] == ["a@x.org"] and "Location: here" in one["content"]
    at = _put(tmp_path / "s.json", {"spreadsheet_id": "S", "sheet_name": "N", "url": "u", "rows": [{"row_index": 5, "title": "t", "values": {"a": 1, "b": "x"}}, {"values": ["p", "q"]}]})
    (one, meta), (two, _) = _read(spark, at, "sheets")
    assert one["source_id"] == "google_sheets:S:N:5" and "a: 1\nb: x" in one["content"] and meta["original_url"] == "u" and two["source_id"] == "google_sheets:S:N:2" and "- p\n- q" in two["content"]
    at = _put(tmp_path / "v.json", {"id": "V", "values": [["h1", "h2"], ["a", "b"], ["c", None]]})
    (one, _), (two, _) = _read(spark, at, "google-sheets-json")
    assert one["source_id"] == "google_sheets:V:Sheet1:2" and "h1: a\nh2: b" in one["content"] and two["content"].endswith("h1: c\nh2:")


def test_markdown(spark, tmp_path):
    _put(tmp_path / "a" / "R E.md", '---\ntitle: "T"\nproject: P\n---\nbefore\n# A\nx [[k|v]] #tag\n### deep\n## B/C: d\n' + "\n\n".join(["y " * 500] * 3))
    _put(tmp_path / "b" / "R E.md", "---\ntitle: T\n---\nplain [[z]]")
    got = _read(spark, tmp_path, "obsidian")
    assert [r["source_id"] for r, _ in got] == ["a/R E.md#A", "a/R E.md#B-C - d::chunk-001-of-003", "a/R E.md#B-C - d::chunk-002-of-003", "a/R E.md#B-C - d::chunk-003-of-003", "b/R E.md"]
    assert got[0][0]["section_path"] == ["A"] and got[1][0]["section_path"] == ["A", "B/C: d"] and got[1][0]["section_level"] == 2 and got[0][1]["wikilinks"] == ["k"] and got[0][1]["tags"] == ["tag"]
    assert all(len(r["content"]) <= 1800 for r, _ in got) and got[4][1]["frontmatter"] == {"title": "T"} and got[4][0]["title"] == "T" and got[4][0]["root_source_id"] == "b/R E.md"
    assert [r["source_id"] for r, _ in _read(spark, tmp_path / "b" / "R E.md", "markdown")] == ["R E.md"]
    for bad in (lambda: read_source(spark, str(tmp_path), "nowhere"), lambda: read_source(spark, str(tmp_path), "slack-live"), lambda: read_source(spark, str(tmp_path), "gmail", "all")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        read_source(spark, str(tmp_path / "none"), "markdown")
    assert profile("Google_Drive").name == "google-drive-json"


def test_contract_and_command_line(spark, tmp_path):
    _put(tmp_path / "in" / "g" / "1.json", [{"ts": "1", "text": "one"}, {"ts": "2", "text": "two"}])
    k = Connector(Corpus(spark, str(tmp_path / "s")), str(tmp_path / "in"), "slack")
    assert k.connect()["name"] == "slack-export" and k.normalize().count() == 2
    assert {r["change"] for r in k.diff().collect()} == {"new"}
    k.sync()
    _put(tmp_path / "in" / "g" / "1.json", [{"ts": "1", "text": "ONE"}, {"ts": "3", "text": "three"}])
    assert {(r["source_id"], r["change"]) for r in k.diff().collect()} == {("slack:g:1", "changed"), ("slack:g:2", "removed"), ("slack:g:3", "new")}
    run = k.sync().first()
    assert (run["new"], run["changed"], run["removed"], run["fetched"]) == (1, 1, 1, 2)
    assert json.loads(cli.run(spark, [str(tmp_path / "s"), "stats"]))["active"] == 2
    live = k.corpus.documents().orderBy("source_id").collect()
    vectors = spark.createDataFrame([(live[0]["id"], [1.0, 0.0]), (live[1]["id"], [0.0, 1.0]), ("gone", [1.0, 1.0])], "id string, embedding array<double>")
    found = backend(k.corpus, Settings(), vectors, lambda t: [1.0, 0.1])
    assert [r["id"] for r in found.search("any", 5).orderBy("rank").collect()] == [live[0]["id"], live[1]["id"]] and isinstance(backend(k.corpus, Settings()), Tables)
    with pytest.raises(ValueError):
        backend(k.corpus, Settings(backend="vectors"))
    assert "three" in cli.run(spark, [str(tmp_path / "s"), "query", "three"])


def test_settings(tmp_path):
    at = _put(tmp_path / "c.toml", '[engine]\nconfidence_threshold = 0.8\n[security]\npii_redaction = "content"\n')
    assert load_settings(at) == Settings(0.8, "content") and Settings().retrieval(True) == "vectors" and Settings().retrieval(False) == "tables"
    for bad in ("[engine]\nx = 1\n", '[security]\npii_redaction = "some"\n'):
        with pytest.raises(ValueError):
            load_settings(_put(tmp_path / "bad.toml", bad))


class Chat:
    """A service of two channels with pages, a thread, and messages without text."""

    history = {"C1": [{"ts": "1.0", "user": "u", "text": "a", "reply_count": 1}, {"ts": "3.0", "text": "c"}, {"ts": "4.0", "text": " "}], "C2": [{"ts": "2.0", "username": "v", "text": "b"}]}

    def get(self, method, params):
        if method == "conversations.list":
            more = params.get("cursor") == "x"
            return {"ok": True, "channels": [{"id": "C2", "name": "two"}] if more else [{"id": "C1", "name": "one"}], "response_metadata": {} if more else {"next_cursor": "x"}}
        if method == "conversations.replies":
            return {"ok": True, "messages": [{"ts": "1.0", "text": "a"}, {"ts": "1.5", "user": "w", "text": "r"}]}
        return {"ok": True, "messages": [m for m in self.history[params["channel"]] if float(m["ts"]) > float(params.get("oldest", 0))]}


def test_live(spark, tmp_path):
    import memspark.sources.live as live

    spark.dataSource.register(ChatSource)
    read = lambda r: r.format("chat_live").option("client", "tests.test_sources:Chat")
    got = read(spark.read).load().orderBy("ts").collect()
    assert [(r["channel_name"], r["ts"], r["user"], r["thread_ts"]) for r in got] == [("one", "1.0", "u", None), ("one", "1.5", "w", "1.0"), ("two", "2.0", "v", None), ("one", "3.0", "unknown", None)]
    assert read(spark.read).option("channels", "two").load().count() == 1
    reader = live.ChatStreamReader({"client": "tests.test_sources:Chat"})
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 4 and json.loads(end["marks"]) == {"C1": "3.0", "C2": "2.0"}
    assert list(reader.read(end)[0]) == [] and len(list(reader.readBetweenOffsets(reader.initialOffset(), end))) == 4
    assert [r[2] for r in live.ChatStreamReader({"client": "tests.test_sources:Chat", "lateness": "2.5"}).read(end)[0]] == ["1.0", "1.5", "3.0", "2.0"]
    run_once(read(spark.readStream).load(), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_stream(spark, tmp_path):
    batch = lambda rows: spark.createDataFrame(rows, "id int, c string, t string").withColumn("t", F.to_timestamp("t"))
    first = batch([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-03 00:00:00"), (3, "b", "2024-01-05 00:00:00")])
    first.write.parquet(str(tmp_path / "in"))
    told = []
    listener = Progress(told.append)
    spark.streams.addListener(listener)
    stream = lambda: read_stream(spark, str(tmp_path / "in"), first.schema, "t", "1 day")
    run_once(new_rows(stream(), "id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    # a row behind the watermark is late, a repeated one is known, a new one comes through
    batch([(4, "a", "2023-12-01 00:00:00"), (3, "b", "2024-01-05 00:00:00"), (5, "a", "2024-01-06 00:00:00")]).write.mode("append").parquet(str(tmp_path / "in"))
    run_once(new_rows(stream(), "id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 5]
    run_once(marks(stream(), "c", "t", "id"), str(tmp_path / "m"), str(tmp_path / "ck2"))
    closed = latest_marks(spark.read.parquet(str(tmp_path / "m")), "c").collect()
    assert {(r["c"], r["last"]) for r in closed} == {("a", 2)}  # the windows of the last day are still open
    spark.streams.removeListener(listener)
    assert {t["stage"] for t in told} >= {"started", "batch", "ended"}


def test_stream_merges(spark, tmp_path):
    shape = "source_type string, source_id string, root_source_id string, title string, content string, metadata string, section_path array<string>, section_level int, path string, pos string"
    put = lambda rows: spark.createDataFrame([("note", f"{r}#{i}", r, "t", c, "{}", None, None, r, f"{i:08d}") for r, i, c in rows], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", 1, "one"), ("a", 2, "two"), ("b", 1, "three")])
    c = Corpus(spark, str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    merge_into(stream(), c, str(tmp_path / "ck"))
    put([("a", 1, "one"), ("a", 2, "TWO")])
    merge_into(stream(), c, str(tmp_path / "ck"))
    assert {r["content"] for r in c.documents().collect()} == {"one", "TWO", "three"} and c.store.read("inactive").where("superseded_at is not null").count() == 1
