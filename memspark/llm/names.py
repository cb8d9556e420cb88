"""Variant spellings of names of people and projects: blocks of phonetic codes of sorted tokens, comparison by Jaro-Winkler with
a nickname table, clusters by connected components.

Names are reduced to distinct token forms first, so copies cost nothing. A form's blocking keys are consonant codes and their one-deletion
neighbours (two codes one edit apart share one), each with what the rest of the name has in common in every spelling that compares as alike: of a
surname with a letter of the given name, of a project's token with the initials of the others, and the code of the letters run together. So
each pair that compares as alike shares a key, however common its tokens are. Full matches are clustered first; forms that fit several
people (initials, short forms of several names) join a cluster only if it is the only one that fits, or the one that their aliases name.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.components import connected_components
from memspark.operators.work import Work

# Words around a name that are no part of it, letters that digits are taken for, sounds that are one.
TITLES = {"dr", "mr", "mrs", "ms", "prof", "frau", "herr", "mme", "mlle", "sir"}
FRAME = {"project", "projekt", "projet", "the", "team", "and", "und", "et", "of", "equipe"}
OCR = str.maketrans("01358", "olesb")
SOUND = str.maketrans({"b": "p", "v": "f", "w": "f", "d": "t", "g": "k", "q": "k", "c": "k", "z": "s", "x": "s"})


def fold(s: str) -> str:
    d = unicodedata.normalize("NFKD", s.casefold().replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in d if not unicodedata.combining(c))


def tokens(name: str, kind: str) -> list[str]:
    """The tokens of a name as compared; a comma's second part goes first for people; initials keep one letter."""
    name = unicodedata.normalize("NFKC", "".join(c for c in name if unicodedata.category(c) != "Sk"))
    spaced = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", name)  # joined words with inner capitals
    if kind == "Person" and "," in spaced:
        last, _, first = spaced.partition(",")
        spaced = f"{first} {last}"
    found = [fold(t) for t in re.findall(r"[^\W_]+(?:[’'][^\W_]+)*", spaced)]
    found = [re.sub(r"[’']", "", t) for t in found]
    found = [t.translate(OCR) if any(c.isalpha() for c in t) else t for t in found]
    drop = TITLES if kind == "Person" else FRAME
    kept = [t for t in found if t not in drop] or found
    if kind == "Person" and len(kept) > 2:
        kept = [kept[0], *[t for t in kept[1:-1] if len(t) > 1], kept[-1]]
    return kept


@lru_cache(1 << 16)
def code(token: str) -> str:
    """Consonants of a token by sound; a vowel in first place leaves a mark. One typing error changes at most one letter of the code."""
    t = token.translate(SOUND)
    return ("a" if t[:1] and t[0] in "aeiouy" else "") + "".join(c for c in t if c not in "aeiouyh")


def near_codes(c: str) -> set[str]:
    return {c, *(c[:i] + c[i + 1 :] for i in range(len(c)))}


def edits(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return min(one[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    hit, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit[j] and b[j] == x:
                hit[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, (y for y, h in zip(b, hit, strict=True) if h), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one inserted, missing, changed or swapped letter apart."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(long) - len(short) > 1:
        return False
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    if len(short) < len(long):
        return short[i:] == long[i + 1 :]
    return short[i + 1 :] == long[i + 1 :] or short[i : i + 2] == long[i : i + 2][::-1] and short[i + 2 :] == long[i + 2 :]


@lru_cache(1 << 18)
def typo(a: str, b: str) -> int:
    """0 if equal, 1 if one typing error apart and alike, else 2."""
    if a == b:
        return 0
    return 1 if min(len(a), len(b)) >= 4 and one_edit(a, b) and jaro_winkler(a, b) >= 0.85 else 2


class Nicknames:
    """Given names and their short forms; a short form may belong to several names."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.roots: dict[str, set[str]] = {}
        for full, short in rows:
            self.roots.setdefault(fold(short), set()).add(fold(full))
        self.full = {fold(f) for f, _ in rows}
        self.known = self.full | set(self.roots)

    def compare(self, a: str, b: str) -> tuple[int, bool] | None:
        """(typing errors, sure) if two given names may be one person's, else None."""
        if a == b:
            return 0, len(a) > 1 and (a in self.full or len(self.roots.get(a, ())) < 2)
        if len(a) == 1 or len(b) == 1:
            short, long = (a, b) if len(a) == 1 else (b, a)
            return (0, False) if long[0] == short or any(r[0] == short for r in self.roots.get(long, ())) else None
        ra, rb = self.roots.get(a, {a}) | ({a} if a in self.full else set()), self.roots.get(b, {b}) | ({b} if b in self.full else set())
        if ra & rb:
            return 0, len(ra) == 1 and len(rb) == 1
        if not (a in self.full and b in self.full):
            if typo(a, b) == 1 and not (a in self.known and b in self.known):
                return 1, True
            if any(typo(x, y) == 1 for x in ra for y in rb if not (x in self.full and y in self.full)):
                return 1, False
            short, long = sorted((a, b), key=len)
            if len(short) >= 3 and short not in self.full and (long.startswith(short) or long.endswith(short) or len(short) == 3 and long[0] == short[0] and edits(short, long[:3], 1) < 1):
                return 0, False
            if len(short) >= 4 and short not in self.full and long[:3] == short[:3] and len(long) > len(short):
                return 0, False
        return None


def readings(t: list[str], nick: Nicknames) -> list[tuple[str, str]]:
    """The ways to read tokens as (given name, surname)."""
    if len(t) < 2:
        return []
    g, s = t[0], "".join(t[1:])
    if len(g) == 1 or len(s) > 1 and g in nick.known and t[-1] not in nick.known:
        return [(g, s)]
    if len(t) == 2:
        return [(s, g)] if len(s) == 1 or s in nick.known and g not in nick.known else [(g, s), (s, g)]
    return [(g, s), (t[-1], "".join(t[:-1]))]


def compare_people(a: list[str], b: list[str], nick: Nicknames) -> int:
    """2 if two forms are one person's, 1 if they may be, 0 if not."""
    ra, rb = readings(a, nick), readings(b, nick)
    best = 0
    if not ra or not rb:
        one, rest = ("".join(a), rb) if not ra else ("".join(b), ra)
        if not rest:
            return 2 if typo(one, "".join(b) if not ra else "".join(a)) < 2 else 0
        for g, s in rest:
            if len(g) > 1 and min(typo(one, g + s), typo(one, s + g)) < 2:
                best = 2
            elif typo(one, g[0] + s) < 2 or typo(one, s + g[0]) < 2:
                best = max(best, 1)
        return best
    for g, s in ra:
        for h, z in rb:
            if len(s) < 2 or len(z) < 2 or (e := typo(s, z)) > 1:
                continue
            if (c := nick.compare(g, h)) and e + c[0] < 2:
                both_initial = len(g) == len(h) == 1
                best = max(best, 2 if c[1] or both_initial else 1)
    return best


def abbreviates(short: str, long: str) -> bool:
    """Whether a token is short for another: its beginning, or letters of it in order with the same first."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    it = iter(long)
    return long.startswith(short) or len(short) <= 4 and all(c in it for c in short) or len(short) >= len(long) - 3 and not set("aeiou") & set(short[1:]) and all(c in iter(long) for c in short)


def compare_projects(a: list[str], b: list[str]) -> int:
    """2 if two forms are one project's, 1 if they may be (one shortened to initials), 0 if not."""
    if typo("".join(a), "".join(b)) < 2:
        return 2
    if min(len(a), len(b)) == 1:
        one, rest = ("".join(a), b) if len(a) == 1 else ("".join(b), a)
        return 2 if typo(one, "".join(rest)) < 2 else 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    left, wrong, unsure, lost = list(long), 0, False, []
    for t in sorted(short, key=lambda x: -len(x)):
        best = t if t in left else min(left, key=lambda x: (typo(t, x), -jaro_winkler(t, x)), default=None)
        if best is not None and typo(t, best) < 2:
            wrong += typo(t, best)
            left.remove(best)
        elif best is not None and edits(t, best, 2) == 2 and (t + "ue" == best or best + "ue" == t):
            left.remove(best)
        else:
            lost.append(t)
    for t in lost:
        fits = [x for x in left if abbreviates(t, x) or abbreviates(x, t)]
        if len(t) == len(left) > 1 and t == "".join(x[0] for x in left):
            left, unsure = [], True
        elif fits:
            left.remove(max(fits, key=len))
        else:
            return 0
    if left or wrong > 1 or len(lost) == len(short):
        return 0
    return 1 if unsure else 2


def _codes(part: str) -> set[str]:
    """The codes that a part shares with each part at most one typing error away; parts under four letters allow none."""
    return near_codes(code(part)) if len(part) > 3 else {code(part)}


def _given_marks(g: str, nick: Nicknames) -> set[str]:
    """Marks of which two given names that ``Nicknames.compare`` takes share one: first letters, or endings where the first letter differs."""
    every = {g, *nick.roots.get(g, ())}
    return {x[0] for x in every} | {"$" + x[-2:] for x in every if len(x) > 2}


def _keys(t: list[str], kind: str, nick: Nicknames, widest: int) -> list[tuple[str, str]]:
    """(key, part that the key is of): forms that compare as alike share a key whose parts are at most one typing error or "ue" apart.

    ``widest`` is the largest number of tokens of a form; a longer token stands for no initials."""
    whole = "".join(t)
    if kind == "Person":
        out = {("1", c, whole) for c in _codes(whole)} if len(t) == 1 else set()
        for g, s in readings(t, nick):
            out |= {("=", c, x) for x in (g + s, s + g, g[0] + s, s + g[0]) for c in _codes(x)}
            if len(s) > 1:
                out |= {(m + "~", c, s) for m in _given_marks(g, nick) for c in _codes(s)}
        return sorted((m + c, x) for m, c, x in out)
    found = {("=" + c, whole) for c in _codes(whole)}
    for i, x in enumerate(t if len(t) > 1 else []):
        rest = t[:i] + t[i + 1 :]
        lists = [[y[0] for y in rest]] + [[*y, *(z[0] for z in rest[:j] + rest[j + 1 :])] for j, y in enumerate(rest) if 1 < len(y) < widest]
        found |= {("".join(sorted(m)) + "~" + c, x) for m in lists for c in _codes(x)}
    return sorted(found)


def link_variants(nodes: DataFrame, aliases: DataFrame, nicknames: DataFrame) -> DataFrame:
    """type, form (the tokens in order), cluster: one row for each distinct form of ``nodes`` (type, name).

    ``aliases`` has type, name, alias: another spelling that a mention gives. ``nicknames`` has given_name and short_form and is collected: it is
    a dictionary of given names, bounded by the language. Null, blank or letterless names have no form and no link. Names of different types never
    link. Repeated rows change nothing.
    """
    spark = nodes.sparkSession
    work = Work(spark, "names")
    nick = spark.sparkContext.broadcast(Nicknames([(r["given_name"], r["short_form"]) for r in nicknames.collect() if r["given_name"] and r["short_form"]]))

    def forms(names: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([" ".join(tokens(n, k)) if n else "" for n, k in zip(names, kinds, strict=True)], dtype=object)

    form = F.pandas_udf(forms, "string")
    distinct = work.cut(nodes.select("type", form("name", "type").alias("form")).where("form <> ''").distinct(), "forms")
    widest = distinct.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 0

    def keys(fs: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([[{"key": c, "part": x} for c, x in _keys(f.split(" "), k, nick.value, widest)] for f, k in zip(fs, kinds, strict=True)])

    keyed = distinct.select("type", "form", F.explode(F.pandas_udf(keys, "array<struct<key string, part string>>")("form", "type")).alias("k"))
    keyed = work.cut(keyed.select("type", "form", F.col("k.key").alias("key"), F.col("k.part").alias("part")), "keys")
    # parts further apart than any that compare as alike go before forms meet in Python; a single token meets whole names under their keys
    left, right = keyed.selectExpr("type", "key", "form a", "part pa"), keyed.selectExpr("type", "key", "form b", "part pb")
    near = F.levenshtein("pa", "pb", 2) >= 0
    pairs = left.where("type <> 'Person' or key not like '=%'").join(right, ["type", "key"]).where("a < b").where(near).select("type", "a", "b")
    single = left.where("type = 'Person' and key like '1%'").withColumn("key", F.regexp_replace("key", "^1", "="))
    met = single.join(right.where("type = 'Person' and key like '=%'"), ["type", "key"]).where(near).selectExpr("type", "least(a, b) a", "greatest(a, b) b")
    pairs = pairs.unionByName(met).distinct()

    def levels(kinds: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        n = nick.value
        return pd.Series([compare_people(x.split(" "), y.split(" "), n) if k == "Person" else compare_projects(x.split(" "), y.split(" ")) for k, x, y in zip(kinds, xs, ys, strict=True)], dtype="int32")

    scored = work.cut(pairs.repartition("a").select("type", "a", "b", F.pandas_udf(levels, "int")("type", "a", "b").alias("level")).where("level > 0"), "scored")

    said = aliases.where("alias is not null").select("type", form("name", "type").alias("x"), form("alias", "type").alias("y")).where("x <> '' and y <> '' and x <> y").selectExpr("type", "least(x, y) a", "greatest(x, y) b").distinct()
    here = distinct.select("type", "form")
    said = said.join(here.withColumnRenamed("form", "a"), ["type", "a"], "left_semi").join(here.withColumnRenamed("form", "b"), ["type", "b"], "left_semi")

    def weak(kinds: pd.Series, fs: pd.Series) -> pd.Series:
        def one(k, f):
            t = f.split(" ")
            if k == "Person":
                return len(t) == 1 or any(len(x) == 1 for x in t) or any(len(nick.value.roots.get(x, ())) > 1 for x in t)
            return any(len(x) == 2 for x in t)

        return pd.Series([one(k, f) for k, f in zip(kinds, fs, strict=True)])

    is_weak = F.pandas_udf(weak, "boolean")
    named = work.cut(said.select("type", "a", "b", is_weak("type", "a").alias("wa"), is_weak("type", "b").alias("wb")), "named")
    node = lambda c: F.concat_ws("\t", "type", c)
    strong = scored.where("level = 2").select(node("a").alias("a"), node("b").alias("b")).unionByName(named.where("not wa and not wb").select(node("a").alias("a"), node("b").alias("b")))
    alone = distinct.select(node("form").alias("a"), node("form").alias("b"))
    first = work.cut(connected_components(strong.unionByName(alone)), "first")

    # candidates of clusters that are not sure: those that fit, and those that aliases name
    maybe = scored.where("level = 1").select(node("a").alias("a"), node("b").alias("b"), F.lit(False).alias("said"))
    maybe = maybe.unionByName(named.where("wa or wb").select(node("a").alias("a"), node("b").alias("b"), F.lit(True).alias("said")))
    ca, cb = first.selectExpr("node a", "component x"), first.selectExpr("node b", "component y")
    links = maybe.join(ca, "a").join(cb, "b").where("x <> y").select("x", "y", "said").distinct()
    forms_of = first.select("component", F.split("node", "\t").getItem(0).alias("type"), F.split("node", "\t").getItem(1).alias("form"))
    sure = forms_of.select("component", (~is_weak("type", "form")).cast("int").alias("s")).groupBy("component").agg(F.max("s").alias("s"))
    sure = work.cut(sure, "sure")
    both = links.unionByName(links.selectExpr("y x", "x y", "said"))
    fits = both.join(sure.selectExpr("component y", "s sy"), "y").join(sure.selectExpr("component x", "s sx"), "x")
    # an unsure cluster looks at sure ones; a sure one with an odd short form looks at the other sure ones
    fits = fits.where("sy = 1").groupBy("x", "sx").agg(F.count_distinct("y").alias("n"), F.min("y").alias("y"), F.count_distinct(F.when(F.col("said"), F.col("y"))).alias("m"), F.min(F.when(F.col("said"), F.col("y"))).alias("z"))
    chosen = fits.where("m = 1 or n = 1").selectExpr("x a", "if(m = 1, z, y) b")
    final = connected_components(work.cut(chosen, "chosen").unionByName(first.select(F.col("component").alias("a"), F.col("component").alias("b")).distinct()))
    out = first.join(final.selectExpr("node component", "component cluster"), "component")
    return out.select(F.split("node", "\t").getItem(0).alias("type"), F.split("node", "\t").getItem(1).alias("form"), "cluster")


def variant_pairs(nodes: DataFrame, aliases: DataFrame, nicknames: DataFrame) -> DataFrame:
    """a, b: ids of ``nodes`` (id, type, name), a < b, that stand for the same person or project."""
    nodes = nodes.where("id is not null")
    clusters = link_variants(nodes, aliases, nicknames)

    def forms(names: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([" ".join(tokens(n, k)) if n else "" for n, k in zip(names, kinds, strict=True)], dtype=object)

    placed = nodes.select("id", "type", F.pandas_udf(forms, "string")("name", "type").alias("form")).distinct().join(clusters, ["type", "form"]).select("id", "cluster").distinct()
    placed = Work(nodes.sparkSession, "name-pairs").cut(placed, "placed")
    return placed.withColumnRenamed("id", "a").join(placed.withColumnRenamed("id", "b"), "cluster").where("a < b").select("a", "b").distinct()
