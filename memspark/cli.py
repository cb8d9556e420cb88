"""Command line over a corpus: python -m memspark.cli CORPUS COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from memspark.store import Corpus

COMMANDS = {
    "ingest": ["path", "kind"], "sync": ["path", "kind"], "load-plan": ["path", "kind"], "connector-diff": ["path", "kind"], "query": ["text"], "retrieve": ["text"], "why": ["text"], "mql": ["text"], "graph": ["text"], "recall": ["text"], "note": ["title", "body"],
    "decision": ["title", "rationale"], "decisions": [], "timeline": [], "diff": [], "current": [], "stats": [], "history": [], "import-memories": [], "next-actions": [], "export-kg": ["path"], "export-vault": ["path"], "vacuum": [],
}


def shown(x: object, rows: int) -> str:
    """A result as JSON lines, a DataFrame's first rows."""
    if isinstance(x, DataFrame):
        return "\n".join(json.dumps(r.asDict(True), default=str, ensure_ascii=False) for r in x.limit(rows).collect())
    if isinstance(x, tuple):
        return "\n".join(shown(y, rows) for y in x)
    return x if isinstance(x, str) else json.dumps(x, default=str, ensure_ascii=False)


def run(spark: SparkSession, argv: list[str]) -> str:
    parser = argparse.ArgumentParser(prog="memspark")
    parser.add_argument("corpus")
    parser.add_argument("--rows", type=int, default=50)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    a = parser.parse_args(argv)
    c = Corpus(spark, a.corpus)
    args = [getattr(a, x) for x in COMMANDS[a.command]]
    calls = {
        "note": c.write_note, "decision": c.write_decision, "current": c.current_decision, "import-memories": c.import_memories, "next-actions": c.next_actions, "export-kg": c.export_kg, "export-vault": c.export_vault,
        "load-plan": c.load_plan, "connector-diff": c.connector_diff, "vacuum": c.store.vacuum,
    }
    return shown(calls.get(a.command, getattr(c, a.command, None))(*args), a.rows)


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.appName("memspark").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
