"""Versioned tables of a corpus with an atomic pointer, and the public API."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import match_key, note_name
from memspark.ids import bronze_id, content_hash, row_id
from memspark.operators import bronze, context, contract, extraction, graph, personal, planning, rationale, recall, silver, timeline
from memspark.plans.mql import parse_mql, run_mql
from memspark.plans.ontology import default_ontology
from memspark.sources.exports import profile, read_source

ARRAY = "array<string>"
SPEC = "spec_ord long, decision_title string, text string, category string, markers array<string>"
SEGMENTS = ["bronze", "entities", "relations", "decisions", "rationales", "rejects"]


class Store:
    """Tables as lists of written folders, named by one small pointer file. A commit writes folders first, then a manifest, then replaces the pointer by a rename;
    readers resolve the pointer, so a failed commit leaves the version before untouched. Old manifests are the history, until ``vacuum`` drops the folders that only they
    name. One writer at a time: a lock file makes a second one fail."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _json(self, name: str) -> dict | None:
        p, fs = self._path(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """Writes a file under another name and renames it over the old one."""
        temp, fs = self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        at, _ = self._path(name)
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, at, options)

    def manifest(self, version: int | None = None) -> dict:
        found = self._json("CURRENT" if version is None else f"manifests/{version:08d}.json")
        if found is None and version is not None:
            raise ValueError(f"no version {version}")
        return found or {"version": 0, "tables": {}, "info": {}}

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        at = self.manifest(version)["tables"].get(name)
        return self.spark.read.parquet(*[f"{self.root}/{a}" for a in at]) if at else None

    def write(self, name: str, df: DataFrame) -> str:
        """Writes a folder that no manifest names yet."""
        at = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{at}")
        return at

    def open(self, at: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{at}")

    def commit(self, replace: dict[str, str] | None = None, append: dict[str, str] | None = None, info: dict | None = None) -> int:
        """Publishes written folders: each replaces its table or is added to it."""
        now = self.manifest()
        tables = {k: list(v) for k, v in now["tables"].items()} | {k: [v] for k, v in (replace or {}).items()}
        for k, v in (append or {}).items():
            tables[k] = [*tables.get(k, []), v]
        new = {"version": now["version"] + 1, "at": datetime.now(timezone.utc).isoformat(), "tables": tables, "info": info or {}}
        self._put(f"manifests/{new['version']:08d}.json", new)
        self._put("CURRENT", new)
        return new["version"]

    def history(self) -> list[dict]:
        """Version, time and info of each kept manifest, oldest first."""
        p, fs = self._path("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        every = [self._json(f"manifests/{n}") for n in names if n.endswith(".json")]
        return [{"version": m["version"], "at": m["at"], **m["info"]} for m in every]

    def vacuum(self, keep: int = 10) -> int:
        """Deletes manifests but the last ``keep`` and the folders that none of those names; returns how many folders went."""
        p, fs = self._path("manifests")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        kept = {a for n in names[-keep:] for at in self._json(f"manifests/{n}")["tables"].values() for a in at}
        gone = {a for n in names[:-keep] for at in self._json(f"manifests/{n}")["tables"].values() for a in at} - kept
        for name in [*(f"manifests/{n}" for n in names[:-keep]), *gone]:
            fs.delete(self._path(name)[0], True)
        return len(gone)

    def drop(self, places: list[str]) -> None:
        for a in places:
            p, fs = self._path(a)
            fs.delete(p, True)

    @contextmanager
    def writing(self):
        """Holds the lock; yields a writer whose folders are deleted if the block fails."""
        p, fs = self._path("LOCK")
        try:
            fs.create(p, False).close()
        except Exception as e:
            raise RuntimeError(f"{self.root} is being written to; if no writer lives, delete its LOCK file") from e
        written: list[str] = []

        def write(name: str, df: DataFrame) -> str:
            at = f"{name}/v-{uuid.uuid4().hex}"
            written.append(at)
            df.write.parquet(f"{self.root}/{at}")
            return at

        try:
            yield write
        except BaseException:
            self.drop(written)
            raise
        finally:
            fs.delete(p, False)


@dataclass(frozen=True)
class Rules:
    """The caller's data: a dictionary (type, term), decisions by title, known pairs, rationale specifications, an ontology, answer rules (set_ord, rule_ord, terms, answer),
    the least confidence, and a model's client with its prompt."""

    dictionary: DataFrame | None = None
    literals: DataFrame | None = None
    pairs: DataFrame | None = None
    specs: DataFrame | None = None
    ontology: DataFrame | None = None
    answers: DataFrame | None = None
    least: float = 0.7
    client: Callable[[str, dict], dict] | None = None
    prompt: str = "Extract entities, relations and decisions as JSON."


class Corpus:
    """The public API over one corpus.

    Writes: ingest, sync, write_note, write_decision, import_memories, remember. Reads: query, retrieve, graph, decisions, current_decision, why, timeline, mql, diff,
    connector_diff, recall, next_actions, memories_between, pack, load_plan, stats, history. Exports: export_kg, export_vault.

    Chunks and what is extracted from them are appended once and never rewritten; which chunks are inactive is one narrow table, and readers leave those out. The
    graph and the timeline are rebuilt from the extracted rows by group-bys.
    """

    def __init__(self, spark: SparkSession, root: str, corpus_id: str = "corpus_main", rules: Rules | None = None, progress: Callable[[str], None] | None = None):
        self.spark, self.store, self.corpus_id, self.rules, self.progress = spark, Store(spark, root), corpus_id, rules or Rules(), progress or (lambda stage: None)

    # writes

    def ingest(self, path: str, kind: str = "markdown", deactivate_removed: bool = False, redaction: str = "off") -> dict[str, Any]:
        """Reads a source, appends new chunks, marks those of its roots that did not come again inactive, extracts, validates and rebuilds the graph and the
        timeline, all in one commit. Content that is there already is not stored again; a second ingest of the same source changes nothing. Returns counts."""
        return self._add(read_source(self.spark, path, kind, redaction), profile(kind).source_type if deactivate_removed else None, {"kind": "ingest", "source": path, "connector": profile(kind).name})

    def _add(self, rows: DataFrame, whole_type: str | None, info: dict) -> dict[str, Any]:
        with self.store.writing() as write:
            self.progress("bronze")
            batch = self.store.manifest()["version"] + 1
            order = F.concat_ws("/", F.lit(f"{batch:010d}"), "path", "pos")
            ident = {"id": bronze_id(F.col("content")), "content_hash": content_hash(F.col("content")), "corpus_id": F.lit(self.corpus_id), "ord": order, "created_at": F.current_timestamp()}
            came = write("incoming", rows.withColumns(ident))  # the source is read once; all that follows reads this
            fresh, stored, gone = self.store.open(came), self.store.read("bronze"), self._inactive()
            new = bronze.first_by_hash(fresh) if stored is None else bronze.put(stored, fresh)
            at = {"bronze": write("bronze", new.select(*fresh.columns))}
            if stored is not None:
                live = stored.join(gone.select("id"), "id", "left_anti")
                roots = live.where(F.col("source_type") == whole_type) if whole_type else fresh
                stale = bronze.stale_ids(live, roots.select("root_source_id").unionByName(fresh.select("root_source_id")), fresh).withColumn("superseded_at", F.current_timestamp())
                before, gone = gone, gone.unionByName(stale).join(fresh.select("id").distinct(), "id", "left_anti")
            replace = {"inactive": write("inactive", gone)}
            if stored is not None and self.store.open(at["bronze"]).isEmpty():
                now = self.store.open(replace["inactive"]).select("id")
                if now.join(before, "id", "left_anti").isEmpty() and before.join(now, "id", "left_anti").isEmpty():
                    self.store.drop([came, at["bronze"], replace["inactive"]])
                    return {"version": batch - 1, "bronze": 0}
            self.progress("silver")
            at |= self._extract(write, self.store.open(at["bronze"]))
            self.progress("gold")
            replace |= self._gold(write, at, self.store.open(replace["inactive"]))
            counts = {k: self.store.open(v).count() for k, v in {**at, "nodes": replace["nodes"], "edges": replace["edges"], "timeline": replace["timeline"]}.items()}
            self.progress("commit")
            version = self.store.commit(replace, at, {**info, "counts": counts})
        self.store.drop([came])
        return {"version": version, **counts}

    def _inactive(self) -> DataFrame:
        found = self.store.read("inactive")
        return self.spark.createDataFrame([], "id string, root_source_id string, superseded_at timestamp") if found is None else found

    def _extract(self, write, docs: DataFrame) -> dict[str, str]:
        r = self.rules
        found, decided = extraction.entities(docs, r.dictionary), extraction.decisions(docs, r.dictionary, r.literals)
        related = extraction.relations(docs, found, decided, r.dictionary, r.pairs)
        if r.client is not None:
            said = self.store.open(write("model", extraction.model_rows(docs, r.client, r.prompt)))  # asked once
            found, related, decided = extraction.with_model(docs, said, (found, related, decided))
        ontology = r.ontology if r.ontology is not None else default_ontology(self.spark)
        e, d, rel, rejects = silver.validate(found, decided, related, docs, ontology, r.least)
        at = {"entities": write("entities", e), "decisions": write("decisions", d), "relations": write("relations", rel), "rejects": write("rejects", rejects)}
        specs = r.specs if r.specs is not None else self.spark.createDataFrame([], SPEC)
        return at | {"rationales": write("rationales", rationale.rationales(self.store.open(at["decisions"]), docs, specs))}

    def _live(self, name: str, more: str | None, gone: DataFrame) -> DataFrame | None:
        """The rows of an extracted table, with those of a folder not yet published, without what only inactive chunks say."""
        parts = [x for x in (self.store.read(name), self.store.open(more) if more else None) if x is not None]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        ids = gone.select("id").distinct()
        if "doc_id" in rows.columns:
            return rows.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
        key = rows.withColumn("_key", F.concat_ws("|", "id", F.array_join("source_ids", ",")))
        return bronze.without_sources(key.dropDuplicates(["_key"]), ids, "_key").drop("_key")

    def _gold(self, write, at: dict[str, str], gone: DataFrame) -> dict[str, str]:
        e, d, rel = (self._live(k, at[k], gone) for k in ("entities", "decisions", "relations"))
        reasons = rationale.merge_rationales(self._live("rationales", at["rationales"], gone).withColumn("stage", F.lit(0)))
        nodes = write("nodes", graph.build_nodes(e, d, reasons))
        edges = write("edges", graph.build_edges(rel, d, reasons, self.store.open(nodes)))
        links = timeline.supersession_edges(d)
        resolved = timeline.with_links(timeline.resolve_supersession(timeline.merge_timeline(d), links), links)
        return {"nodes": nodes, "edges": edges, "timeline": write("timeline", resolved), "reasons": write("reasons", reasons)}

    def sync(self, path: str, kind: str, deactivate_removed: bool = False) -> DataFrame:
        """Diff, ingest, and one row in the log of sync runs, whether it succeeds or fails. Returns that row."""
        started = datetime.now(timezone.utc).isoformat()
        counts = contract.diff_counts(self.connector_diff(path, kind)).first().asDict()
        row = lambda status, error=None: contract.sync_run(self.spark.createDataFrame([counts]), profile(kind).name, path, status, started, error)
        try:
            self.ingest(path, kind, deactivate_removed)
        except Exception as e:
            self._append("sync_runs", row("failed", str(e)[:500]))
            raise
        return self.store.open(self._append("sync_runs", row("success")))

    def _append(self, name: str, df: DataFrame) -> str:
        with self.store.writing() as write:
            at = write(name, df)
            self.store.commit(append={name: at}, info={"kind": name})
        return at

    def write_note(self, title: str, body: str) -> dict[str, Any]:
        """Adds one note; it goes through the same path as an ingested one."""
        text = f'---\ntitle: "{title}"\nsource: writeback\n---\n\n# {title}\n\n{body}'
        return self._write(title, text, "note")

    def write_decision(self, title: str, rationale: str = "", project: str = "", date: str = "", supersedes: str | list[str] = "", participants: list[str] | None = None, status: str = "accepted") -> dict[str, Any]:
        """Adds a note that says the decision in labelled lines; it is extracted, validated and resolved like any other."""
        older = [supersedes] if isinstance(supersedes, str) else supersedes
        labels = [("Decision", title), ("Status", status), ("Rationale", " ".join(rationale.split())), ("Date", date), ("Project", project), *(("Supersedes", s) for s in older), ("Participants", "; ".join(participants or []))]
        head = [f'title: "{title}"', *([f"project: {project}"] if project else []), *([f"date: {date}"] if date else []), "source: writeback"]
        return self._write(title, "\n".join(["---", *head, "---", "", f"# {title}", "", *(f"{k}: {v}" for k, v in labels if v)]), "decision")

    def _write(self, title: str, text: str, kind: str) -> dict[str, Any]:
        rows = self.spark.createDataFrame([(title, text)], "title string, content string")
        ident = row_id(kind, match_key("title"))
        rows = rows.select(F.lit("note").alias("source_type"), ident.alias("source_id"), ident.alias("root_source_id"), "title", "content", F.to_json(F.struct("title", F.lit("writeback").alias("connector"))).alias("metadata"), F.lit(None).cast(ARRAY).alias("section_path"), F.lit(None).cast("int").alias("section_level"), note_name("title").alias("path"), F.lit("00000000").alias("pos"))
        return self._add(rows, None, {"kind": f"write_{kind}", "source": title, "connector": "writeback"})

    def import_memories(self) -> int:
        """Personal memories of the active chunks whose source has none yet; returns how many."""
        stored = self.store.read("memories")
        start = 0 if stored is None else stored.count()
        at = self._append("memories", personal.from_chunks(self.documents(), stored, start))
        return self.store.open(at).count()

    def remember(self, kind: str, title: str, content: str, tags: list[str] | None = None, source: str = "hand", source_id: str | None = None) -> None:
        if kind not in personal.KINDS:
            raise ValueError(f"unknown kind of memory {kind!r}; known: {', '.join(personal.KINDS)}")
        stored = self.store.read("memories")
        n = 1 + (0 if stored is None else stored.count())
        row = self.spark.createDataFrame([(kind, title, content, tags or [], source, source_id)], "type string, title string, content string, tags array<string>, source string, source_id string")
        self._append("memories", row.withColumns({"source_url": F.lit(None).cast("string"), "metadata": F.create_map().cast("map<string,string>"), "created_at": F.current_timestamp(), "id": F.lit(f"personal_{n:06d}")}))

    # reads

    def _table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        if found is None:
            raise ValueError(f"the corpus has no {name} yet: ingest something first")
        return found

    def documents(self) -> DataFrame:
        """The active chunks."""
        return self._table("bronze").join(self._inactive().select("id"), "id", "left_anti")

    def query(self, text: str, k: int = 10) -> DataFrame:
        """rank, stage, match, confidence. The first answer rule that fits is the only match, of stage 0; without one a query of the query language is run; else the
        question's words are searched in documents, timeline, nodes and edges."""
        if self.rules.answers is not None:
            asked = self.spark.createDataFrame([(1, text)], "q int, text string")
            hit = recall.rule_answers(asked, "q", "text", self.rules.answers).select(F.lit(1).cast("long").alias("rank"), F.lit(0).alias("stage"), F.col("answer").alias("match"), F.lit(0.9).alias("confidence"))
            if not hit.isEmpty():
                return hit
        if parse_mql(text) is not None:
            return self.mql(text).select(F.lit(1).cast("long").alias("rank"), F.lit(0).alias("stage"), F.concat_ws(": ", "title_key", "answer").alias("match"), F.lit(0.9).alias("confidence"))
        return recall.keyword_answer(self.matches(text), k)

    def matches(self, text: str) -> DataFrame:
        return recall.answer_matches(text, self.documents(), self._table("timeline"), self._table("nodes"), self._table("edges"))

    def sources(self, text: str) -> DataFrame:
        """The active documents that the matches of a question rest on."""
        return recall.match_sources(self.matches(text), self.documents())

    def retrieve(self, text: str, k: int = 8) -> DataFrame:
        return recall.retrieve(text, self._table("nodes"), self._table("edges"), self.documents(), k)

    def graph(self, entity: str) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) about a part of a name."""
        return graph.around(self._table("nodes"), self._table("edges"), entity)

    def decisions(self, **filters) -> DataFrame:
        return timeline.decisions(self._table("timeline"), **filters)

    def current_decision(self) -> str:
        """The titles of the current decisions, in order, joined; they stream to the caller a partition at a time."""
        return ", ".join(r["title"] for r in timeline.current_titles(self._table("timeline")).toLocalIterator()) or "none"

    def why(self, decision: str) -> DataFrame:
        return rationale.why(self._table("timeline"), self._table("reasons"), decision)

    def timeline(self, project: str | None = None) -> DataFrame:
        return self.mql("SHOW timeline" + (f' FOR project="{project}"' if project else ""))

    def diff(self, days: int = 7) -> DataFrame:
        return timeline.memory_diff(self._table("timeline"), days)

    def mql(self, text: str) -> DataFrame:
        return run_mql(text, self._table("timeline"), self._table("reasons"))

    def connector_diff(self, path: str, kind: str) -> DataFrame:
        """source_id, change: a source as it is against the active chunks of its kind."""
        fetched = read_source(self.spark, path, kind).select("source_id", content_hash(F.col("content")).alias("content_hash"))
        stored = self.store.read("bronze")
        live = self.documents().where(F.col("source_type") == profile(kind).source_type).select("source_id", "content_hash") if stored is not None else fetched.limit(0)
        return contract.listing_diff(live, fetched, ["source_id"], "content_hash")

    def sync_history(self, connector: str | None = None, k: int = 20) -> DataFrame:
        return contract.sync_history(self._table("sync_runs"), connector, k)

    def recall(self, words: str, kind: str | None = None) -> DataFrame:
        return personal.recall(self._table("memories"), words, kind)

    def next_actions(self) -> DataFrame:
        return personal.next_actions(self._table("memories"))

    def memories_between(self, since: str | None = None, until: str | None = None) -> DataFrame:
        return personal.between(self._table("memories"), since, until)

    def pack(self, text: str, budget: int) -> DataFrame:
        """The documents that a question rests on, packed into a budget of characters."""
        docs = self.documents().join(self.sources(text).select("id"), "id", "left_semi").select(F.lit(text).alias("question"), "id", "ord", F.lit(0.5).alias("priority"), "content")
        return context.pack_context(docs, "question", "id", budget)

    def load_plan(self, path: str, kind: str = "markdown") -> DataFrame:
        return planning.load_plan(read_source(self.spark, path, kind), "content", "root_source_id")

    def stats(self) -> dict[str, int]:
        """Rows of each table, and of bronze those active."""
        out = {name: self.store.read(name).count() for name in self.store.manifest()["tables"]}
        return out | ({"active": self.documents().count()} if "bronze" in out else {})

    def history(self) -> list[dict]:
        return self.store.history()

    # exports

    def export_kg(self, path: str) -> None:
        """The custom knowledge graph as JSON lines in folders of entities, relationships and chunks."""
        graph.kg_json(self._table("nodes"), self._table("edges"), self.documents()).write.partitionBy("kind").mode("overwrite").text(path)

    def export_vault(self, path: str) -> int:
        """One Markdown file for each node and an index, written by the executors; returns how many. Notes of one path don't occur."""
        notes = graph.vault_notes(self._table("nodes"), self._table("edges"), self._table("timeline"))
        index = graph.vault_index(self._table("nodes")).orderBy("type", "k", "line")
        return write_files(notes, path) + write_index(index, path)


def write_files(notes: DataFrame, root: str) -> int:
    """Writes each (path, content) as a file under a folder that all executors see."""
    import os

    def save(rows):
        for r in rows:
            at = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            temp = f"{at}.{uuid.uuid4().hex}"
            with open(temp, "w", encoding="utf-8") as f:
                f.write(r["content"])
            os.replace(temp, at)  # a task that runs twice leaves one file

    notes.foreachPartition(save)
    return notes.count()


def write_index(index: DataFrame, root: str) -> int:
    """Index.md from its rows in order; they stream through the driver a partition at a time."""
    import os

    os.makedirs(root, exist_ok=True)
    last = None
    with open(os.path.join(root, "Index.md"), "w", encoding="utf-8") as f:
        f.write("# Memory Index\n")
        for r in index.withColumn("folder", graph.folder(F.col("type"))).toLocalIterator():
            if r["type"] != last:
                last = r["type"]
                f.write(f"\n## {r['folder']}\n\n")
            f.write(r["line"] + "\n")
    return 1
