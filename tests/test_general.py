"""Operators of the general problems against brute force, with nulls, empties, repeats and clashing columns."""

import datetime as dt
import random

from pyspark.sql import functions as F

from memspark.operators.components import connected_components
from memspark.operators.hierarchy import descendants, resolve_hierarchy
from memspark.operators.intervals import calendar_day, sweep_intervals
from memspark.operators.snapshots import hex_digits, snapshot_diff, snapshot_series_diff


def _walk(parent):
    out = {}
    for n in {*parent, *parent.values()}:
        seen, cur = [], n
        while cur in parent and cur not in seen:
            seen.append(cur)
            cur = parent[cur]
        if cur in parent:
            out[n] = (None, -1 if cur == n else -2)
        else:
            out[n] = (cur, len(seen))
    return out


def test_hierarchy_random(spark):
    rnd = random.Random(3)
    parent = {f"n{i}": f"n{rnd.randrange(max(0, i - 3), i)}" for i in range(1, 120)}
    parent |= {f"c{i}": f"c{(i + 1) % 5}" for i in range(5)} | {"h1": "c0", "h2": "h1", "self": "self", "on": "self"}
    parent |= {f"s{i}": "hub" for i in range(200)}
    rows = [(a, b, "x") for a, b in parent.items()] + [("n5", None, "x"), (None, "n1", "x"), ("n7", parent["n7"], "again")]
    df = spark.createDataFrame(rows, "node string, parent string, root string")
    got = resolve_hierarchy(df).collect()
    # without paths, and with the parents of many leaves broadcast
    assert {(r["node"], r["root"], r["depth"], r["status"]) for r in got} == {(r["node"], r["root"], r["depth"], r["status"]) for r in resolve_hierarchy(df, paths=False, crowd=5).collect()}
    assert {r["node"]: (r["root"], r["depth"]) for r in got} == _walk(parent)
    assert len(got) == len({r["node"] for r in got})
    for r in got:
        if r["depth"] >= 0:
            assert len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["node"] and r["path"][0] == r["root"]
            assert all(parent[b] == a for a, b in zip(r["path"], r["path"][1:]))


def test_hierarchy_empty_and_descendants(spark):
    empty = resolve_hierarchy(spark.createDataFrame([], "node string, parent string"))
    assert empty.collect() == [] and descendants(empty).collect() == []
    nodes = resolve_hierarchy(spark.createDataFrame([("b", "a"), ("c", "b")], "node string, parent string"))
    assert {tuple(r) for r in descendants(nodes).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("e", "f"), (None, "a"), ("b", "a")], "a string, b string")
    assert connected_components(edges.limit(0)).collect() == [] and sorted(connected_components(edges, few=0).collect()) == sorted(connected_components(edges, few=0, crowd=1).collect()) == sorted(connected_components(edges).collect())
    assert {tuple(r) for r in connected_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "e")}


def test_sweep_random(spark):
    rnd = random.Random(5)
    day = dt.date(2020, 1, 1)
    rows = [(rnd.choice("ab"), day + dt.timedelta(s := rnd.randrange(1500)), day + dt.timedelta(s + rnd.randrange(-2, 25)), 1) for _ in range(120)]
    rows += rows[:3] + [(None, day, day + dt.timedelta(3), 1), ("a", None, day, 1), ("a", day, None, 1)]
    got = {tuple(r) for r in sweep_intervals(spark.createDataFrame(rows, "k string, s date, e date, kind int"), ["k"], "s", "e").collect()}
    want = set()
    for k in "ab":
        days = {s + dt.timedelta(i) for x, s, e, _ in rows if x == k and s and e for i in range((e - s).days)}
        runs, last = [], None
        for d in sorted(days):
            if last and d == last + dt.timedelta(1):
                runs[-1][1] = d + dt.timedelta(1)
            else:
                runs.append([d, d + dt.timedelta(1)])
            last = d
        want |= {(k, "period", a, b) for a, b in runs} | {(k, "gap", x[1], y[0]) for x, y in zip(runs, runs[1:])}
    assert got == want


def test_calendar_day(spark):
    cases = {"2024-02-29": "2024-02-29", " 20240131 ": "2024-01-31", "2024/03/01": "2024-03-01", "2024-01-02T23:59:59Z": "2024-01-02", "2023-02-29": None, "2024-13-01": None, "TBD": None, "": None, None: None, "Q3 2022": None}
    got = {r["t"]: r["d"] for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", calendar_day("t").cast("string").alias("d")).collect()}
    assert got == cases


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", None, 1), (None, "x", 1)], "k string, v string, change int")
    new = spark.createDataFrame([("a", "1", 2), ("b", "3", 2), ("c", "4", 2), ("d", "5", 2), ("d", "5", 2)], "k string, v string, change int")
    assert {tuple(r) for r in snapshot_diff(old, new, ["k"], ["v"]).collect()} == {("b", "changed"), ("c", "changed"), ("d", "added"), (None, "removed")}
    assert snapshot_diff(old.limit(0), new.limit(0), ["k"], ["v"]).collect() == []


def test_snapshot_series(spark):
    rows = [
        ("x", 1, "a ", "sha256:AA", 1), ("x", 1, "b", "bb", 1), ("x", 1, "n", "cc", 1),
        ("x", 3, "a", "aa", 1), ("x", 3, "n", None, 1), ("x", 3, "d", "d1", 1), ("x", 3, "d", "d2", 2),
        ("x", 4, "a", "ab", 1), ("x", 4, "b", "bb", 1), ("x", 4, "n", "cd", 1), ("x", 4, "d", "d2", 1),
        (None, 1, "q", "aa", 1), (None, 2, "q", "ab", 1),
    ]
    df = spark.createDataFrame(rows, "s string, no int, item string, h string, at int")
    got = {tuple(r) for r in snapshot_series_diff(df, ["s"], "no", "item", "h", "at").collect()}
    assert got == {tuple(r) for r in snapshot_series_diff(df, ["s"], "no", "item", "h", "at", few=0).collect()}
    assert got == {("x", 3, "b", "removed"), ("x", 3, "d", "added"), ("x", 4, "a", "changed"), ("x", 4, "b", "added"), ("x", 4, "n", "changed"), (None, 2, "q", "changed")}
    one = spark.range(1).select(hex_digits(F.lit("SHA256: 0Aff")).alias("h"), hex_digits(F.lit("0x1b")).alias("g"), hex_digits(F.lit("?")).alias("n")).first()
    assert tuple(one) == ("0aff", "1b", None)
