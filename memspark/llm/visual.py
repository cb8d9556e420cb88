"""Visually identical text with different characters: one consistent form by script-aware repair.

Characters that draw nothing are removed, joiners and tags where they draw nothing; blanks, widths, joined letters, hyphens and composition are unified character by
character; raised digits, quotes, dashes and capitals stay. Letters of another script drawn the same are repaired by token. A token's
script is that of its letters without a twin in another script. Tokens in which scripts mix take the form of their class (tokens
that look the same) that stands in the corpus vocabulary in one script, else the class's most frequent form. A token all of whose letters have
twins takes the script of its document's unambiguous letters. Both choices depend on the visible form alone, so
texts that look the same become equal and texts that differ visibly stay different.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.work import Work, broadcast_if_small

# Letters of other scripts drawn like a Latin letter.
CYRILLIC = "аеорсухіјѕһԁԛԝүАВЕКМНОРСТУХІЈЅԚԜҮӀ"
CYRILLIC_AS = "aeopcyxijshdqwyABEKMHOPCTYXIJSQWYI"
GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳ"
GREEK_AS = "oABEZHIKMNOPTYXj"
ARMENIAN = "օսհոցԼՕՍ"
ARMENIAN_AS = "ouhngLOU"
# Common letters of a language written in the script, to which a Latin letter may be turned back.
BACK = {"CYRILLIC": ("АВЕКМНОРСТУХаеорсух", "ABEKMHOPCTYXaeopcyx"), "GREEK": ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX")}
HYPHENS = "‐‑﹣－"
LETTERS = r"[^\W_]"

_twin = dict(zip(CYRILLIC + GREEK + ARMENIAN, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS, strict=True))
_drawn = re.compile("[؀-؅۝܏࣢]")


def _plain_map() -> dict[int, str | None]:
    """Code point -> what it becomes whatever stands around it. Built by rule from the character database."""
    out: dict[int, str | None] = {}
    for o in range(0x80, 0x20000):
        c, kind = chr(o), unicodedata.category(chr(o))
        if kind == "Cf" and not _drawn.match(c) and o not in (0x200C, 0x200D) or 0xFE00 <= o <= 0xFE0F or o == 0x34F or 0x180B <= o <= 0x180F or kind == "Cc" and c != "\x85":
            out[o] = None
        elif kind == "Zs":
            out[o] = " "
        elif 0xFF01 <= o <= 0xFFEF or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17 or o in (0x132, 0x133):
            out[o] = unicodedata.normalize("NFKC", c)
    out |= {ord(c): "-" for c in HYPHENS} | {0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
    out |= {o: None for o in [*range(0, 9), *range(11, 13), *range(14, 32), 127, *range(0xE0000, 0xE0020), *range(0xE0080, 0xE01F0)]}
    return out


_plain = _plain_map()
_twins = str.maketrans(_twin)
_other = re.compile("[\u0370-\u058f\u1c80-\u1c8f\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f\ufb13-\ufb17]")  # letters of scripts with twins of Latin ones
_token = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ])*")


_joiners = re.compile("[\u200c\u200d\U000e0020-\U000e007f]+")
FLAG = "\U0001f3f4"


def _joins(c: str) -> bool:
    """Whether a joiner beside the letter changes how it is drawn: scripts whose letters join or stack."""
    return "\u0600" <= c <= "\u0fff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u18af" or "\ua980" <= c <= "\uabff" or "\ufb50" <= c <= "\ufeff"


def _pictures(c: str) -> bool:
    return "\U0001f000" <= c <= "\U0001faff" or "\u2190" <= c <= "\u2bff"


def _drawing_joiners(text: str) -> str:
    """The text without joiners and tags that draw nothing. A joiner between pictures or between letters of scripts that join is seen, and so are tags after the black flag."""

    def one(m: re.Match) -> str:
        run, before, after = m.group(), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before == FLAG and run[0] > "\u200d":
            return "".join(c for c in run if c > "\u200d")
        kept = "".join(c for c in run if c <= "\u200d")[-1:]
        if kept and before and after and (_joins(before) and _joins(after) or kept == "\u200d" and _pictures(before) and _pictures(after)):
            return kept
        return ""

    return _joiners.sub(one, text)


def base_form(text: str) -> str:
    """The text in one form but for letters of other scripts."""
    if text.isascii() and text.isprintable():
        return text
    text = text.translate(_plain)
    if _joiners.search(text):
        text = _drawing_joiners(text)
    return unicodedata.normalize("NFC", text).replace("\r\n", "\n")


def skeleton(text: str) -> str:
    """The text with every look-alike letter as its Latin twin, accents composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_twins))


def _script(c: str) -> str | None:
    if not c.isalpha():
        return None
    return unicodedata.name(c, "?").split()[0]


_scripts: dict[str, str | None] = {}


def _letters(token: str) -> list[tuple[str, str, bool]]:
    """(letter without accent, script, has a twin in another script) of each letter."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        s = _scripts[c] if c in _scripts else _scripts.setdefault(c, _script(c))
        if s is not None:
            out.append((c, s, c in _twin or c in _latin_twins))
    return out


_latin_twins = set(_twin.values())
TWIN_SCRIPTS = {"LATIN", "CYRILLIC", "GREEK", "ARMENIAN"}


def _mixed(letters: list[tuple[str, str, bool]]) -> bool:
    """Whether scripts with twins mix; those without (Hangul, kanji) stand beside any."""
    return len(TWIN_SCRIPTS & {s for _, s, _ in letters}) > 1


def _context(text: str) -> str:
    counts: dict[str, int] = {}
    for c in text:
        if c not in _twin and c not in _latin_twins:
            s = _scripts[c] if c in _scripts else _scripts.setdefault(c, _script(c))
            if s in ("LATIN", "CYRILLIC", "GREEK"):
                counts[s] = counts.get(s, 0) + 1
    return max(sorted(counts, key=lambda s: s != "LATIN"), key=counts.get) if counts else "LATIN"


def _to_script(skel: str, script: str) -> str:
    if script in BACK:
        letters, latin = BACK[script]
        d = unicodedata.normalize("NFD", skel)
        if all(c in latin for c in d if c.isalpha()):
            return unicodedata.normalize("NFC", d.translate(str.maketrans(latin, letters)))
    return skel


@lru_cache(1 << 17)
def _seen(token: str) -> tuple[str, bool, bool, bool]:
    """(skeleton, all letters have twins, is to be repaired, letters of one script) of a token."""
    letters = _letters(token)
    mixed = _mixed(letters)
    odd = any(c in _twin for c, _, _ in letters) or mixed and any(two for _, _, two in letters)
    return skeleton(token), bool(letters) and all(two for _, _, two in letters), odd, not mixed


def examine(text: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """The base form with wholly ambiguous tokens in the script of their document, and the distinct tokens that are left with look-alike letters, or
    with Latin ones among letters of another script that has twins: (form, skeleton, all in one script)."""
    base = base_form(text)
    if not _other.search(base):  # without a letter of another script nothing is ambiguous
        return base, []
    context = _context(skeleton(base))
    odd: dict[str, tuple[str, str, bool]] = {}

    def see(m: re.Match) -> str:
        t = m.group()
        skel, ambiguous, repair, pure = _seen(t)
        if ambiguous:
            return _to_script(skel, context)
        if repair:
            odd[t] = (t, skel, pure)
        return t

    return _token.sub(see, base), list(odd.values())


EXAMINED = "base string, odd array<struct<form string, skel string, pure boolean>>"


def _examined(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else examine(t) for t in texts]
    return pd.DataFrame({"base": [b for b, _ in rows], "odd": [o and [{"form": f, "skel": s, "pure": p} for f, s, p in o] for _, o in rows]})


def _repaired(texts: pd.Series, repairs: pd.Series) -> pd.Series:
    def one(t, r):
        m = {x["form"]: x["to"] for x in r}
        return unicodedata.normalize("NFC", _token.sub(lambda x: m.get(x.group(), x.group()), t))

    return pd.Series([one(t, r) for t, r in zip(texts, repairs, strict=True)], dtype=object)


def _one_script(c: str) -> Column:
    """Whether a word's letters are of at most one of the scripts with twins."""
    return sum((F.rlike(c, F.lit(rf"\p{{Is{s.capitalize()}}}")).cast("int") for s in sorted(TWIN_SCRIPTS)), F.lit(0)) < 2


def _repairs(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(seen, repairs). seen: row, key, raw, base, plain (the hash of base), and odd_base, the base of rows with tokens to look at; repairs: row, repairs of the rows that have any."""
    work = Work(df.sparkSession, "visual")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.select("row", "key", F.sha2("text", 256).alias("raw"), F.pandas_udf(_examined, EXAMINED)("text").alias("x")).select("row", "key", "raw", "x.base", "x.odd")
    seen = work.cut(rows.select("*", F.sha2("base", 256).alias("plain"), F.when(F.size("odd") > 0, F.col("base")).alias("odd_base")), "seen")
    odd = seen.where("size(odd) > 0").select("row", F.explode("odd").alias("o")).select("row", "o.*")
    forms = work.cut(odd.groupBy("skel", "form", "pure").agg(F.count("*").alias("n")), "forms")
    # Latin forms of those classes that the whole vocabulary has; those in one script are in no repair, so they stand for their class
    words = seen.select(F.explode(F.split("base", r"[^\p{L}\p{M}\p{N}]+")).alias("skel"))
    latin = words.join(broadcast_if_small(forms.select("skel").distinct()), "skel", "left_semi").distinct().where(_one_script("skel")).selectExpr("skel", "skel form", "true pure", "1L n", "true fixed")
    classes = forms.withColumn("fixed", F.lit(False)).unionByName(latin).groupBy("skel").agg(F.max_by("form", F.struct("fixed", "pure", "n", "form")).alias("to"))
    changes = forms.join(classes, "skel").where("form <> to").select("form", "to")
    per_row = odd.select("row", "form").join(changes, "form").groupBy("row").agg(F.collect_list(F.struct("form", "to")).alias("repairs"))
    return seen, work.cut(per_row, "repairs")


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, raw (sha-256 of the text as it was), canonical: one row for each row of ``df``, in its one consistent form.

    Null texts give null; empty texts stay empty; texts of any length are processed whole. Repeated and null keys are kept apart by row.
    Only tokens with look-alike letters are shuffled with their rows; the vocabulary is counted with map-side aggregation.
    """
    seen, repairs = _repairs(df, key, text)
    todo = seen.select("row", "key", "raw", "odd_base").join(repairs, "row")
    done = todo.select("key", "raw", F.pandas_udf(_repaired, "string")("odd_base", "repairs").alias("canonical"))
    return seen.join(repairs.select("row"), "row", "left_anti").select("key", "raw", F.col("base").alias("canonical")).unionByName(done)


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """a, b: keys, a < b, of texts that look the same but differ in a character. Distinct raw texts meet within a class, then give their pairs to the keys that have
    them; classes of one raw text send no row to the join, so groups of exact copies cost nothing. Rows with a null key or text pair with none."""
    seen, repairs = _repairs(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()), key, text)
    todo = seen.select("row", "key", "raw", "odd_base").join(repairs, "row")
    done = todo.select("key", "raw", F.sha2(F.pandas_udf(_repaired, "string")("odd_base", "repairs"), 256).alias("c"))
    form = seen.join(repairs.select("row"), "row", "left_anti").select("key", "raw", F.col("plain").alias("c")).unionByName(done)
    work = Work(df.sparkSession, "visual-pairs")
    form = work.cut(form.distinct(), "forms")
    mixed = form.groupBy("c").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("c")
    texts = work.cut(form.select("c", "raw").distinct().join(mixed, "c"), "texts")
    met = texts.withColumnRenamed("raw", "ra").join(texts.withColumnRenamed("raw", "rb"), "c").where("ra < rb").select("ra", "rb")
    pairs = met.join(form.select(F.col("raw").alias("ra"), F.col("key").alias("x")), "ra").join(form.select(F.col("raw").alias("rb"), F.col("key").alias("y")), "rb")
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
