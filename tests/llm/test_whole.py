"""Jobs done whole: names with common tokens, small sources beside large ones, words written all in look-alikes."""

import random

from pyspark.sql import functions as F

from memspark.llm import leakage, mixing, names, personal, visual


def test_names_with_common_tokens(spark):
    given = ["Olivia", "Hugo", "Petra", "Emil", "Clara", "Anton", "Greta", "Viktor", "Nora", "Felix", "Ida", "Jonas", "Zelda", "Quentin"]
    nodes = [(i, "Person", f"{g} Hakatiley") for i, g in enumerate(given)] + [(50, "Person", "Robert Hakatiley"), (51, "Person", "Bob Hakatiley"), (52, "Person", "Hakatilye, Bob")]
    kinds = ["Archive Gateway", "Billing Portal", "Search Index", "Token Cache", "Review Inbox", "Export Vault", "Lineage Map"]
    nodes += [(100 + i, "Project", f"Peluvo {k}") for i, k in enumerate(kinds)] + [(200 + i, "Project", f"Peluvo {k[:4]}. {k.split()[1]}") for i, k in enumerate(kinds)] + [(300, "Project", "Peluvo AG")]
    df = spark.createDataFrame(nodes, "id int, type string, name string")
    nick = spark.createDataFrame([("Robert", "Bob"), *((g, g) for g in given)], "given_name string, short_form string")
    got = {tuple(r) for r in names.variant_pairs(df, df.limit(0).selectExpr("type", "name", "name alias"), nick).collect()}
    assert got == {(50, 51), (50, 52), (51, 52), (100, 300), (200, 300)} | {(100 + i, 200 + i) for i in range(len(kinds))}


def test_keys_miss_no_alike_pair():
    rnd = random.Random(8)
    nick = names.Nicknames([("Robert", "Bob"), ("Robert", "Rob"), ("Elisabeth", "Beth"), ("Elisabeth", "Liz"), ("Olivia", "Liv")])

    def slip(w):
        i, c = rnd.randrange(len(w)), rnd.choice("abdegklmnorst")
        return rnd.choice([w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]])

    people, projects = set(), set()
    for _ in range(350):
        g, s = slip(rnd.choice(["robert", "bob", "rob", "elisabeth", "beth", "liz", "olivia", "xaver", "ver", "r", "e"])), slip(rnd.choice(["hakatiley", "rouhe", "maier"]))
        people.add(rnd.choice([f"{g} {s}", f"{s} {g}", g + s, s + g, g[:1] + s]).strip())
        t = [slip(w) for w in rnd.choice([["peluvo", "archive", "gateway"], ["peluvo", "catalogue"], ["zomo", "billing", "portal"]])]
        t[-1] = rnd.choice([t[-1], t[-1][:4], t[-1].replace("catalogue", "catalog")])
        rnd.shuffle(t)
        projects.add(rnd.choice([" ".join(t), "".join(t), f"{t[0]} {''.join(w[:1] for w in t[1:])}"]).strip())
    for kind, forms in (("Person", sorted(people)), ("Project", sorted(projects))):
        split = [[x for x in f.split(" ") if x] for f in forms]
        keyed = [names._keys(t, kind, nick, max(map(len, split))) for t in split]
        for i, a in enumerate(split):
            for j in range(i):
                b = split[j]
                if names.compare_people(a, b, nick) if kind == "Person" else names.compare_projects(a, b):
                    swap = lambda ks, other: {("=" + k[1:] if len(other) > 1 and k[0] == "1" and "~" not in k else k, x) for k, x in ks}
                    ka, kb = (swap(keyed[i], b), swap(keyed[j], a)) if kind == "Person" else (keyed[i], keyed[j])
                    assert any(k == m and names.edits(x, y, 3) <= 2 for k, x in ka for m, y in kb), (a, b)


def test_mix_with_small_source(spark):
    rows = [(i, f"word{i} " * 50, "large") for i in range(1500)] + [(5000 + i, f"some few words {i}", "small") for i in range(20)] + [(6000 + i, f"some more words {i}", "middle") for i in range(60)]
    docs = spark.createDataFrame(rows, "k int, t string, source string")
    targets = spark.createDataFrame([("large", 0.9, 4), ("small", 0.05, 2), ("middle", 0.05, 2)], "source string, target_share double, max_repeats int")
    selection, shares = mixing.mix_sources(docs, "k", "t", "source", targets)
    s = {r["source"]: r for r in shares.collect()}
    assert s["small"]["tokens"] < 64 * 256 and s["small"]["mixed_tokens"] == s["small"]["quota_tokens"] == 2 * s["small"]["tokens"]
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.08 for r in s.values()) and all(r["mixed_tokens"] > 0 for r in s.values())
    assert selection.where("source <> 'large'").agg(F.max("repeats")).first()[0] == 2


def test_visual_with_all_twins_replaced(spark):
    rows = [(1, "он дал раму"), (2, "он дaл раму"), (3, "он дал раму сам"), (4, "a long note on д\u0430л"), (5, "a long note on д\u0061л"), (6, "API를"), (7, "\u0410\u0420I를"), (8, "\u0410\u0420\u0406를"), (9, "\u0410\u0420\u0406를 x"), (10, "API를 x")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {tuple(r) for r in visual.look_alike_pairs(df, "k", "t").collect()}
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s != t and visual.skeleton(s) == visual.skeleton(t)}
    assert got == want == {(1, 2), (4, 5), (6, 7), (6, 8), (7, 8), (9, 10)}


def test_leaks_with_edits():
    """Every third word misspelt, every fourth replaced, others put in or left out: found; less than half, or another order: not."""
    rnd = random.Random(11)
    voc = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 10))) for _ in range(3000)]
    items = [(i, [rnd.choice(voc) for _ in range(rnd.randrange(30, 90))]) for i in range(40)]
    table = leakage._Items([(i, " ".join(w)) for i, w in items])
    numbers = table.numbers()

    def slip(x):
        j = rnd.randrange(len(x))
        return rnd.choice([x[:j] + "z" + x[j + 1 :], x[:j] + "z" + x[j:], x[:j] + x[j + 1 :] or "z"])

    edits = {
        "third misspelt": lambda w: [slip(x) if q % 3 == 0 else x for q, x in enumerate(w)], "fourth misspelt": lambda w: [slip(x) if q % 4 == 0 else x for q, x in enumerate(w)], "fifth misspelt": lambda w: [slip(x) if q % 5 == 0 else x for q, x in enumerate(w)],
        "fifth replaced": lambda w: [rnd.choice(voc) if q % 5 == 0 else x for q, x in enumerate(w)], "fifth put in": lambda w: [y for q, x in enumerate(w) for y in ([x, rnd.choice(voc)] if q % 5 == 0 else [x])],
        "sixth left out": lambda w: [x for q, x in enumerate(w) if q % 6], "most of it": lambda w: w[: len(w) * 60 // 100],
    }
    around = lambda w: " ".join([*rnd.choices(voc, k=50), *w, *rnd.choices(voc, k=50)])
    for name, f in edits.items():
        docs = [(i, around(f(w))) for i, w in items]
        got = {(k, i) for k, i, *_ in leakage._scan(docs, table, numbers, 0.5)}
        assert len(got & {(i, i) for i, _ in items}) >= 0.9 * len(items) and len(got - {(i, i) for i, _ in items}) <= 0.05 * len(items), name
    for f in (lambda w: w[: len(w) * 40 // 100], lambda w: rnd.sample(w, len(w)), lambda w: w[::-1]):
        assert leakage._scan([(i, around(f(w))) for i, w in items], table, numbers, 0.5) == []


def test_long_gaps_and_short_items():
    table = leakage._Items([(1, " ".join(f"word{i}x" for i in range(60))), (2, "one two three"), (3, "")])
    numbers = table.numbers()
    put_in = " ".join(f"word{i}x" + (" aa bb" if i % 2 else "") for i in range(60))  # longer than the first window
    got = {(k, i) for k, i, *_ in leakage._scan([("a", put_in), ("b", "so ONE, two: three!"), ("c", "one two"), ("d", None), ("e", "")], table, numbers, 0.5)}
    assert ("b", 2) in got and not {k for k, _ in got} & {"d", "e"}
    assert leakage._scan([("a", "x")], leakage._Items([]), leakage._Items([]).numbers(), 0.5) == []


def test_gazetteer_of_any_size(spark):
    """Broadcast or met in a join, the gazetteer finds the same."""
    people = spark.createDataFrame([("Anna Example",), ("Émile O’Sample",), ("Bob-Lee Sample",)], "name string")
    given = spark.createDataFrame([("anna",), ("emile",), (None,)], "part string")
    texts = ["Anna Example and Émile O’Sample met.", "sample, nobody", "A. Example or Sample, Bob-Lee", None, "", "Anna Example and Émile O’Sample met."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k int, t string, found string")
    parts = personal.gazetteer(people, "name")
    one, other = personal.find_personal(df, "t", parts, given, b"k"), personal.find_personal(df, "t", parts, given, b"k", most_bytes=0)
    got = sorted(map(str, one.collect()))
    assert got == sorted(map(str, other.collect())) and sum("kind='name'" in g for g in got) == 3
    assert personal.find_personal(df.limit(0), "t", parts, given, b"k", most_bytes=0).collect() == []


def test_pseudonyms_are_as_valid_as_their_values():
    right = ["1 85 05 78 006 084 91", "940315-1234567", "123-45-6789", "AB 12 34 56 C", "1 85 13 78 006 084 36", "912-34-5678"]
    n = "2" + "85057800608"
    right.append(f"{n}4{97 - int(n + '4') % 97:02d}")
    for v in right:
        p = personal.permute(v, b"key", "idno")
        assert p != v and personal.checked(p) == personal.checked(v) and personal.valid("idno", p) == personal.valid("idno", v) and personal.permute(p, b"key", "idno", undo=True) == v
    assert personal.checked(right[-1]) and not personal.checked("912-34-5678") and not personal.valid("idno", "940230-1234567") and personal.valid("idno", "940229-1234567")


def test_joiners_that_are_seen():
    family, persian, flag = "\U0001f469\u200d\U0001f469\u200d\U0001f467", "می\u200cخواهم", "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"
    for t in (family, persian, flag, "क्\u200dष"):
        assert visual.base_form(t) == t and visual.base_form("so " + t + " it is") == "so " + t + " it is"
    for t in (family, persian, flag):
        assert visual.base_form(t) != visual.base_form("".join(c for c in t if c not in "\u200c\u200d" and not 0xE0000 <= ord(c) <= 0xE007F))
    assert visual.base_form("a\u200db\u200c c\U000e0067\u200d") == "ab c" and visual.base_form("\u200dа\u200d") == "а"


def test_copies_and_one_variant(spark):
    rows = [(i, "a plain text") for i in range(30)] + [(40, "a pl\u0430in text"), (41, "a\u00a0plain text"), (42, None), (None, "a\u00a0plain text")]
    got = {tuple(r) for r in visual.look_alike_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == {(i, j) for i in range(30) for j in (40, 41)} | {(40, 41)}
