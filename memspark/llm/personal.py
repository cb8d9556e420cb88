"""Personal information in free text: typed placeholders that hold format-preserving Feistel pseudonyms.

Email addresses, phone numbers, national identity numbers and street addresses are found by their notations and validated; names of people
by a gazetteer of the name parts of known people. A value becomes ``[KIND:pseudonym]``. The pseudonym keeps the value's
format: digits stay digits, letters stay letters of their case, punctuation stays. It is a keyed Feistel permutation of the value's letters
and digits, so equal values are linked across documents and notations of spacing, and the key's holder can undo it. Numbers that
carry a date or a bounded field are walked along the permutation until they are valid again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.operators.work import Work

# Notations.
_AT = r"(?: @ |@|\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|\.)\s?[)\]}]\s?)"
EMAIL = re.compile(
    rf"(?<![\w.+@/-])(?:[^\W_][\w.+'-]*|_[\w.+'-]+){_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)*{_DOT}[^\W\d_]{{2,24}}(?![\w@])"
    r"|(?<![\w.])[^\W_][\w.+-]* at [^\W_][\w-]*(?: dot [\w-]+)* dot (?:com|org|net|edu|info|io|de|fr|kr|ru|uk|test|example|invalid)\b"
)
IDNO = re.compile(r"(?<![\w./+-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{3}([- ])\d\d\1\d{4}|[12]( ?)\d\d\2\d\d\2\d\d\2\d{3}\2\d{3}\2\d\d|\d{6}-\d{7})(?![\w/]|[-.]\d)")
PHONE = re.compile(
    r"(?<![\w./+-])(?:"
    r"(?:\+|00)\d{1,3}(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d{1,8}){1,6}"
    r"|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:1[.-])?\d{3}([.-])\d{3}\1\d{4}"
    r"|\(0\d{1,4}\)(?:[ ./-]?\d{2,8}){1,4}|0\d{1,4}(?:[ ./-]\d{2,8}){1,4}"
    r")(?![\w/]|[-.]\d)"
)
_STREET = r"(?:Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Lane|Ln\.?|Terrace|Row|Close|Court|Ct\.?|Road|Rd\.?|Street|St\.?|Way|Place|Pl\.?|Square|Sq\.?|Crescent|Gardens|Walk|Mews|Hill|Grove|Park|Parade|Rise|Path|Circle|Trail)"
_TOWN = r"[^\W\d_a-z][^\W\d_]*(?:[-’'][^\W\d_]+)*"
_GAP = r"(?:,[^\S\n]?\n?|[^\S\n]?\n)[^\S\n]?"
# notations, each behind a cheap test of what any text that holds it must hold
_CODE = re.compile(r"\d{5} [^\W\d_a-z]")
ADDRESSES = [
    (re.compile(rf"\b{_STREET}(?:{_GAP})").search, re.compile(rf"(?<![\w.,/-])\d{{1,5}}[a-zA-Z]? (?:[^\W\d_a-z][\w’'-]* ){{1,3}}{_STREET}(?:{_GAP}(?:Apt|Unit|Suite|Ste|Flat|No)\.? ?\w+)?{_GAP}{_TOWN}(?:,? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}|,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|,? \d{{5}})?(?!\w)")),
    (_CODE.search, re.compile(rf"(?<!\w)(?:[^\W\d_]+-)*[^\W\d_]*(?:[sS]tra(?:ß|ss)e|[sS]tr\.|[wW]eg|[gG]asse|[pP]latz|[aA]llee|[uU]fer|[rR]ing|[dD]amm|[sS]teig) \d{{1,4}} ?[a-z]?{_GAP}(?:D-)?\d{{5}} {_TOWN}")),
    (_CODE.search, re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|allée|quai|chemin|place|impasse|boulevard|cours|route|square|sentier|passage|villa)(?: (?:de la|de l[’']|du|des|de|d[’']))? ?{_TOWN}(?: {_TOWN})?{_GAP}(?:F-)?\d{{5}} {_TOWN}")),
    (lambda t: "시 " in t, re.compile(r"(?<!\w)(?:[가-힣]+도 )?[가-힣]+시 (?:[가-힣]+[구군] )?[가-힣\d]+(?:로|길) \d+(?:-\d+)?(?!\d)")),
]
_AT_HINT = re.compile(r"[(\[{]\s?(?:at|AT)\s?[)\]}]")
NOTATIONS = [("email", lambda t: "@" in t or " at " in t and " dot " in t or _AT_HINT.search(t), EMAIL), *(("address", hint, p) for hint, p in ADDRESSES), ("idno", None, IDNO), ("phone", None, PHONE)]
_capital = re.compile(r"[^\W\d_a-z][^\W\d_]*(?:[’'-][^\W\d_]+)*")
CAPITAL = r"(?U)[\p{L}&&[^a-z]]\p{L}*(?:[’'-]\p{L}+)*"  # the same in the JVM
_next = re.compile(r"(,?)([^\S\n]{1,2}|\n)((?:[^\W\d_]\.[^\S\n]?)*)((?:[^\W\d_a-z][^\W\d_]*(?:[’'-][^\W\d_]+)*)?)")
_before = re.compile(r"(?:(?<=[^\w.])|^)(?:[^\W\d_a-z]\.[^\S\n]?){1,2}$")
# Titles, no part of a name.
TITLES = frozenset("dr mr mrs ms prof frau herr mme mlle madame monsieur sir miss dame".split())


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("value", T.StringType())]))


@lru_cache(1 << 17)
def name_part(token: str) -> str:
    """A part of a name as the gazetteer holds it: case-folded, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", token.casefold()) if not unicodedata.combining(c))


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _real_day(month: int, day: int) -> bool:
    return 1 <= month <= 12 and 1 <= day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)


def valid(kind: str, value: str) -> bool:
    """Whether a number holds what its notation demands: enough digits, and real days in those that have one."""
    d = _digits(value)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "idno" and len(d) == 13:
        return _real_day(int(d[2:4]), int(d[4:6]))
    return True


def checked(value: str) -> bool:
    """Whether an identity number passes the check of its notation: the remainder by 97 of fifteen digits, the weighted sum of thirteen, blocks that are
    issued of nine. Numbers that fail are personal all the same (they may be mistyped), so finding does not ask for it; a pseudonym passes if its number does."""
    d = _digits(value)
    if len(d) == 15:
        return int(d[13:]) == 97 - int(d[:13]) % 97
    if len(d) == 13:
        weights = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
        return (11 - sum(int(x) * w for x, w in zip(d, weights, strict=False)) % 11) % 10 == int(d[12])
    if len(d) == 9:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    return True


def find(text: str, parts: frozenset[str] | set[str], given: frozenset[str] | set[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each piece of personal information, in order, without overlap."""
    spans: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def take(kind: str, a: int, b: int) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            spans.append((kind, a, b))

    for kind, hint, pattern in NOTATIONS:
        for m in pattern.finditer(text) if hint is None or hint(text) else ():
            if valid(kind, m.group()):
                take(kind, *m.span())
    if parts:
        done = 0
        for m in _capital.finditer(text):
            a, b = m.span()
            one = name_part(m.group())
            if a < done or one not in parts or one in TITLES or taken[a]:
                continue
            n = _next.match(text, b)
            comma, gap, initials, other = n.groups() if n else ("", "", "", "")
            two = name_part(other)
            lead = _before.search(text[max(0, a - 8) : a])
            if lead and one not in given and not (comma and two in parts and two in given):
                take("name", a - len(lead.group()), b)
            elif other and two in parts and two not in TITLES and (gap != "\n" or (one in given) != (two in given)) and not (comma and initials):
                end = n.end()
                tail = re.match(r"[^\S\n][^\W\d_a-z]\.", text[end:]) if comma or two in given and one not in given else None
                end += tail.end() if tail else 0
                take("name", a, end)
            elif initials and gap != "\n" and one not in given:
                end = n.start(3) + len(initials.rstrip())
                take("name", a, end)
            else:
                continue
            done = max(done, spans[-1][2])
    return sorted(spans, key=lambda s: s[1])


def _radix(c: str) -> tuple[int, int]:
    """(size, first code point) of the class of characters within which a character is permuted; size 1 for those that stay."""
    if "0" <= c <= "9":
        return 10, 48
    if "a" <= c <= "z":
        return 26, 97
    if "가" <= c <= "힣":
        return 11172, 0xAC00
    return 1, ord(c)


def permute(value: str, key: bytes, kind: str, undo: bool = False) -> str:
    """The value under the keyed permutation of its format, or back. Letters are permuted without case and accents kept in place:
    upper case stays upper case; letters outside a-z and Hangul syllables stay as they are."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in value]
    spots = [i for i, c in enumerate(low) if _radix(c)[0] > 1]
    sizes = [_radix(low[i])[0] for i in spots]
    numbers = [ord(low[i]) - _radix(low[i])[1] for i in spots]
    out = _feistel(numbers, sizes, key, kind, undo)

    def text(ns: list[int]) -> str:
        chars = list(value)
        for i, n in zip(spots, ns, strict=True):
            c = chr(_radix(low[i])[1] + n)
            chars[i] = c.upper() if value[i] != low[i] else c
        return "".join(chars)

    # walk along the cycle to the next value that is as valid as this one, which the walk back finds again
    like = (valid(kind, value), checked(value))
    while kind == "idno" and (valid(kind, text(out)), checked(text(out))) != like:
        out = _feistel(out, sizes, key, kind, undo)
    return text(out)


def _feistel(numbers: list[int], sizes: list[int], key: bytes, kind: str, undo: bool, rounds: int = 10) -> list[int]:
    half = len(numbers) // 2
    if not numbers:
        return numbers
    parts = [numbers[:half], numbers[half:]]
    mods = [sizes[:half], sizes[half:]]
    for r in reversed(range(rounds)) if undo else range(rounds):
        at, by = r % 2, 1 - r % 2
        message = f"{kind}|{r}|{','.join(map(str, sizes))}|{','.join(map(str, parts[by]))}".encode()
        stream = hmac.new(key, message, hashlib.sha256).digest()
        while len(stream) < 4 * len(parts[at]):
            stream += hmac.new(key, stream[-32:] + message, hashlib.sha256).digest()
        add = [int.from_bytes(stream[4 * i : 4 * i + 4], "big") for i in range(len(parts[at]))]
        parts[at] = [(x - a if undo else x + a) % m for x, a, m in zip(parts[at], add, mods[at], strict=True)]
    return parts[0] + parts[1]


def masked(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], "[", kind.upper(), ":", permute(text[a:b], key, kind), "]"]
        at = b
    return "".join([*out, text[at:]])


def unmasked(text: str, key: bytes) -> str:
    """The text before ``masked``, for the holder of the key."""
    return re.sub(r"\[(EMAIL|ADDRESS|IDNO|PHONE|NAME):((?:[^\[\]]|\[[^\[\]]*\])*)\]", lambda m: permute(m.group(2), key, m.group(1).lower(), undo=True), text)


def value_key(value: str) -> str:
    return "".join(c for c in value.lower() if c.isalpha() or c.isdigit())


def gazetteer(people: DataFrame, name: str) -> DataFrame:
    """part: the distinct parts, of two letters or more, of names of two parts or more. Null and one-word names give none."""

    def parts(names: pd.Series) -> pd.Series:
        def one(n):
            found = [name_part(t) for t in re.findall(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*", n or "")]
            found = [t for t in found if len(t) > 1 and t not in TITLES]
            return found if len(found) > 1 else []

        return names.map(one)

    distinct = people.select(F.col(name).alias("n")).where("n is not null").distinct()
    return distinct.select(F.explode(F.pandas_udf(parts, "array<string>")("n")).alias("part")).distinct()


def find_personal(df: DataFrame, text: str, parts: DataFrame, given: DataFrame, key: bytes, most_bytes: int = 64_000_000) -> DataFrame:
    """All columns of ``df`` but the text, and ``found`` (array of kind, from, to, value) and ``masked``. ``key`` is secret: who has it can undo the masking.

    ``parts`` (column part) and ``given`` (column part) are the gazetteer. Up to ``most_bytes``, measured, it is broadcast, and nothing is shuffled. Beyond that the capitalised words
    of the texts meet it in an equi-join, each word once, and a row carries the parts that it holds. Null texts give nulls; texts without personal information come
    back as they are; repeated rows are treated alike.
    """
    spark = df.sparkSession
    known = parts.select("part").unionByName(given.select("part")).where("part is not null").distinct()
    rest = [c for c in df.columns if c not in (text, "found", "masked")]
    rows = df.select(*rest, F.col(text).alias("masked"))
    schema = T.StructType([*rows.schema.fields, T.StructField("found", FOUND)])

    def scanned(batch: pd.DataFrame, names: list, first: list) -> pd.DataFrame:
        out, found = [], []
        for t, n, g in zip(batch["masked"], names, first, strict=True):
            spans = find(t, n, g) if t is not None else []
            out.append(masked(t, spans, key) if spans else t)
            found.append(None if t is None else [{"kind": k, "from": a, "to": z, "value": t[a:z]} for k, a, z in spans])
        return batch.assign(masked=out, found=found)[[*rest, "masked", "found"]]

    size = known.agg(F.sum(F.length("part") + 64)).first()[0] or 0
    if size <= most_bytes:
        first = frozenset(r["part"] for r in given.select("part").where("part is not null").distinct().collect())
        shared = spark.sparkContext.broadcast((frozenset(r["part"] for r in known.collect()) | first, first))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, first = shared.value
            for b in batches:
                yield scanned(b, [names] * len(b), [first] * len(b))

        return rows.mapInPandas(scan, schema)
    numbered = Work(spark, "personal").cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    words = numbered.select("_row", F.explode(F.array_distinct(F.regexp_extract_all("masked", F.lit(CAPITAL), F.lit(0)))).alias("word"))
    forms = words.select("word").distinct().select("word", F.pandas_udf(lambda s: s.map(name_part), "string")("word").alias("part"))
    marked = known.join(given.select("part").distinct().withColumn("is_given", F.lit(True)), "part", "left")
    hit = words.join(forms.join(marked, "part"), "word").groupBy("_row").agg(F.collect_set("part").alias("_parts"), F.collect_set(F.when(F.col("is_given"), F.col("part"))).alias("_given"))

    def scan_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = lambda c: [frozenset(x) if x is not None else frozenset() for x in c]
        for b in batches:
            yield scanned(b, sets(b["_parts"]), sets(b["_given"]))

    return numbered.join(hit, "_row", "left").drop("_row").mapInPandas(scan_rows, schema)
