"""Free-text operators: exact round trips, brute force on small fixtures, nulls, empties, long texts and repeats."""

import random
import re

from pyspark.sql import functions as F

from memspark.llm import leakage, mixing, names, personal, splitting, visual


def test_split_round_trip(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta.", "gamma\n", "delta\n\n", "é̈", "가나다", "\n## Head\n", "x" * 50, "? "]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([0, 1, 40, 300, 3000])]
    rows += [(9, "y" * 5000), (10, None), (11, "z" * 100), (12, "z" * 101), (13, "\U0001f600" * 250)]
    df = spark.createDataFrame(rows, "k int, t string")
    texts = dict(rows)
    got = df.select("k", splitting.pieces("t", 100, 10).alias("p")).collect()
    for r in got:
        if texts[r["k"]] is None:
            assert r["p"] is None
            continue
        out, last = "", None
        for p in r["p"]:
            assert len(p["text"]) <= 100 and p["at"] == len(out)
            if last is not None:
                assert p["text"].startswith(last[-10:])
            out += p["text"] if last is None else p["text"][len(last[-10:]) :]
            last = p["text"]
        assert out == texts[r["k"]]
    over = splitting.split_oversized(df.withColumn("at", F.lit("clash")), "t", 100, 10)
    assert {r["k"] for r in over.select("k").distinct().collect()} == {k for k, t in rows if t and len(t) > 100}
    assert splitting.split_oversized(df.limit(0), "t", 100, 10).collect() == []


def test_split_boundaries(spark):
    text = "First sentence here. Second one is longer than that.\n\nA paragraph of its own follows now."
    parts = spark.createDataFrame([(text,)], "t string").select(splitting.pieces("t", 60, 5).alias("p")).first()["p"]
    assert parts[0]["text"].rstrip().endswith("that.")


def test_units(spark):
    df = spark.createDataFrame([(1, " a\r\n  \r\nb\n\n\n c "), (2, ""), (3, None)], "k int, t string")
    got = {(r["k"], r["block_no"], r["unit"]) for r in splitting.units(df, "k", "t").collect()}
    assert got == {(1, 0, "a\r\n  \r\nb\n\n\n c"), (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 0, "")}


def test_visual(spark):
    rows = [
        (1, "The scope of café code-x fine"), (2, "The sсope of café c​ode‐x ﬁne"), (3, "The scope of cafe code-x fine"),
        (4, "x²"), (5, "x2"), (6, "ＨＩ 7"), (7, "HI 7"), (8, "HI 7"), (9, None), (10, ""), (11, "мама мыла раму"), (12, "мaма мыла раму"),
    ]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("row", F.lit("clash"))
    got = {tuple(r) for r in visual.look_alike_pairs(df, "k", "t").collect()}
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s and t and s != t and visual.skeleton(visual.base_form(s)) == visual.skeleton(visual.base_form(t))}
    assert got == want == {(1, 2), (6, 7), (6, 8), (11, 12)}
    form = {r["key"]: r["canonical"] for r in visual.canonical_text(df, "k", "t").collect()}
    assert form[9] is None and form[10] == "" and form[12] == "мама мыла раму" and form[2] == rows[0][1].replace(" ", " ")
    assert visual.look_alike_pairs(df.limit(0), "k", "t").collect() == []


def test_personal_round_trip(spark):
    people = spark.createDataFrame([("Anna Example",), ("Bob B. Sample",), (None,), ("Solo",)], "name string")
    given = spark.createDataFrame([("anna",)], "part string")
    text = "Dr. Anna Example (anna.example@mail.example, +44 1632 960108) met Sample, Bob at 12 Mill Row\nTown 00123; id 912-34-5678. Build 202418-0147, version 01.99.69."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing " * 5000)], "masked int, t string").withColumnRenamed("masked", "k")
    got = {r["k"]: r for r in personal.find_personal(df, "t", personal.gazetteer(people, "name"), given, b"key").collect()}
    found = [(f["kind"], f["value"]) for f in got[1]["found"]]
    assert found == [("name", "Anna Example"), ("email", "anna.example@mail.example"), ("phone", "+44 1632 960108"), ("name", "Sample, Bob"), ("address", "12 Mill Row\nTown 00123"), ("idno", "912-34-5678")]
    assert got[1]["masked"] != text and personal.unmasked(got[1]["masked"], b"key") == text
    assert re.sub(r"\[[A-Z]+:[^\]]*\]", "", got[1]["masked"]).startswith("Dr.  (, ) met ")
    assert got[2]["masked"] is None and got[3]["masked"] == "" and got[4]["found"] == []
    assert personal.permute("+1 20", b"k", "phone").translate(str.maketrans("0123456789", "d" * 10)) == "+d dd"
    a, b = personal.permute("01632 960108", b"k", "phone"), personal.permute("01632-960-108", b"k", "phone")
    assert personal._digits(a) == personal._digits(b) != "01632960108"
    assert personal.valid("idno", personal.permute("940315-9483614", b"k", "idno"))


def test_leakage_against_exhaustive(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(40))) for i in range(30)]
    docs, want = [], set()
    for k in range(120):
        body = [rnd.choice(vocabulary) for _ in range(60)]
        i, mode = rnd.randrange(30), k % 4
        w = items[i][1].split(" ")
        if mode == 0:
            part = [x.upper() if j % 7 else x[:2] + x[3:] for j, x in enumerate(w[5:35])]
            body[20:20], want = part, want | {(k, i)}
        elif mode == 1:
            body[20:20] = w[:10]
        elif mode == 2:
            body[20:20] = rnd.sample(w, 40)
        docs.append((k, ", ".join(body)))
    docs += [(900, None), (901, "")]
    d, t = spark.createDataFrame(docs, "k int, t string"), spark.createDataFrame([*items, (99, None), (98, "!")], "i int, t string")
    got = {(r["doc"], r["item"]) for r in leakage.leaked_passages(d, "k", "t", t, "i", "t").collect()}
    assert got == want
    blocks = {(r["doc"], r["item"]) for r in leakage.leaked_passages(d, "k", "t", t, "i", "t", block=3000).collect()}
    assert blocks == want
    clean = leakage.without_passages(d, "k", "t", leakage.leaked_passages(d, "k", "t", t, "i", "t"))
    assert leakage.leaked_passages(clean, "doc", "text", t, "i", "t").count() == 0 and clean.count() == len(want)


def test_sainte_lague():
    assert mixing.sainte_lague([53.0, 24.0, 23.0], 7) == [3, 2, 2]
    rnd = random.Random(4)
    for _ in range(50):
        w, n = [rnd.random() + 0.01 for _ in range(6)], rnd.randrange(1, 60)
        caps = [rnd.randrange(0, 25) for _ in w]
        out = [0] * 6
        for _ in range(min(n, sum(caps))):
            i = max((i for i in range(6) if out[i] < caps[i]), key=lambda i: (w[i] / (2 * out[i] + 1), -i))
            out[i] += 1
        assert mixing.sainte_lague(w, n, caps) == out


def test_mix(spark):
    rows = [(i, f"word{i} " * 50, "A " if i % 4 else "b") for i in range(400)] + [(900, None, "a"), (901, "", "a"), (902, "text", None), (903, "text", "other")]
    docs = spark.createDataFrame(rows, "k int, t string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(docs, "k", "t", "source", targets, block=64, shards=4)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["b"]["actual_share"] - 2 / 3) < 0.02 and abs(s["a"]["actual_share"] - 1 / 3) < 0.02 and s["none"]["actual_share"] == 0
    top = {r["source"]: r["m"] for r in selection.groupBy("source").agg(F.max("repeats").alias("m")).collect()}
    assert top["a"] <= 1 and top["b"] <= 3 and selection.count() == selection.select("key").distinct().count()
    none, shares = mixing.mix_sources(docs.limit(0), "k", "t", "source", targets)
    assert none.count() == 0 and shares.count() == 3


def test_names(spark):
    nodes = [
        (1, "Person", "Robert Hakatiley"), (2, "Person", "HAKATILEY, BOB"), (3, "Person", "Robert B. Hakatilye"), (4, "Person", "R. Hakatiley"), (5, "Person", "roberthakatiley"),
        (6, "Person", "Olivia Hakatiley"), (7, "Person", "Robert Zomodin"), (8, "Person", None), (9, "Person", " "), (10, "Tool", "Robert Hakatiley"), (1, "Person", "Robert Hakatiley"),
        (20, "Project", "Peluvo Archive Gateway"), (21, "Project", "Project Peluvo Archiev Gateway"), (22, "Project", "peluvo-archive-gateway"), (23, "Project", "Peluvo Arch. GW"), (24, "Project", "Gateway (Peluvo Archive)"), (25, "Project", "Peluvo Billing Portal"),
        (26, "Project", "Peluvo AG"),
    ]
    df = spark.createDataFrame(nodes, "id int, type string, name string").withColumn("form", F.lit("clash"))
    aliases = spark.createDataFrame([("Person", "R. Hakatiley", "tbd"), ("Person", "R. Hakatiley", None)], "type string, name string, alias string")
    nick = spark.createDataFrame([("Robert", "Bob"), ("Olivia", "Liv")], "given_name string, short_form string")
    got = {tuple(r) for r in names.variant_pairs(df.where("type <> 'Tool'"), aliases, nick).collect()}
    pairs = lambda g: {(a, b) for a in g for b in g if a < b}
    assert got == pairs([1, 2, 3, 4, 5]) | pairs([20, 21, 22, 23, 24, 26])
    assert names.variant_pairs(df.limit(0), aliases.limit(0), nick).collect() == []


def test_typing_errors():
    assert names.edits("abcd", "acbd") == 1 and names.edits("abcd", "abd") == 1 and names.edits("abcd", "xyz") == 3
    rnd = random.Random(6)
    for _ in range(2000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(6)))
        i, c = rnd.randrange(len(a) + 1), rnd.choice("abc")
        b = rnd.choice([a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :], a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :], "".join(rnd.choice("abc") for _ in range(rnd.randrange(6)))])
        assert a == b or names.one_edit(a, b) == (names.edits(a, b, 1) == 1), (a, b)
    for _ in range(300):
        w = "".join(rnd.choice("bdfgklmnaeiou") for _ in range(8))
        i, c = rnd.randrange(8), rnd.choice("bdfgklmnaeiou")
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
            assert names.near_codes(names.code(w)) & names.near_codes(names.code(v)) or len(names.code(w)) < 3 or len(names.code(v)) < 3
