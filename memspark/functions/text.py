"""Column -> Column text helpers, all JVM-side. Unicode classes are switched on with (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Case-folded text: lower case, with sharp s as ss and final sigma as sigma, as full case folding has them."""
    return F.translate(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def strip_ws(c: Column | str) -> Column:
    """Text without Unicode whitespace at either end (Spark's trim drops blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column | str) -> Column:
    """Trimmed text in which each run of whitespace is one blank."""
    return F.trim(F.regexp_replace(col(c), WS, " "))


def match_key(c: Column | str) -> Column:
    """The key under which two titles are the same: folded, trimmed, whitespace collapsed; null for null or blank."""
    k = fold(collapse_ws(c))
    return F.when(k != "", k)


def blank_to_null(c: Column | str) -> Column:
    return F.when(strip_ws(c) != "", col(c))


# Notations that are redacted, and the keys of maps whose values are secrets.
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?<!\w)(?:\+?[0-9]{1,3}[\s.-]?)?(?:\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4})(?!\w)"
SECRET_KEYS = ["access_token", "refresh_token", "client_secret", "authorization", "token"]
REDACTION = ("off", "metadata", "content")


def redact(c: Column | str) -> Column:
    """Text with email addresses and phone numbers replaced by [email] and [phone]. For texts, not for ids or times."""
    return F.regexp_replace(F.regexp_replace(col(c), EMAIL, "[email]"), PHONE, "[phone]")


def redact_when(c: Column | str, mode: str, part: str) -> Column:
    """Redaction by mode: ``off`` touches nothing, ``metadata`` the metadata's texts, ``content`` those and the content. ``part`` says which this is."""
    if mode not in REDACTION:
        raise ValueError(f"unknown redaction mode {mode!r}; known: {', '.join(REDACTION)}")
    return redact(c) if mode == "content" or mode == part == "metadata" else col(c)


def redact_secrets(m: Column | str) -> Column:
    """A map<string,string> with the values of secret keys, in any case, replaced by [redacted]."""
    return F.transform_values(col(m), lambda k, v: F.when(F.lower(k).isin(SECRET_KEYS), F.lit("[redacted]")).otherwise(v))


def text_lines(c: Column | str) -> Column:
    return F.split(col(c), r"\r\n|[\n\r]")


def squash(c: Column | str) -> Column:
    """Case-folded text without any whitespace."""
    return F.regexp_replace(fold(c), WS, "")


def answer_key(c: Column | str) -> Column:
    """Case-folded text without whitespace and the punctuation that answers differ in."""
    return F.regexp_replace(fold(c), r"(?U)[\s_\-./·:()\"'`]+", "")


def slug(c: Column | str, default: str = "documents") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(strip_ws(c)), r"[^a-zA-Z0-9_-]+", "-"), r"^[-_]+|[-_]+$", "")
    return F.when(s != "", s).otherwise(default)


def ascii_tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[^a-zA-Z0-9]+"), lambda t: t != "")


def note_name(c: Column | str) -> Column:
    """A name as part of a path of notes."""
    return strip_ws(F.replace(F.replace(col(c), F.lit("/"), F.lit("-")), F.lit(":"), F.lit(" -")))


def file_name(c: Column | str, default: str = "memory") -> Column:
    s = F.left(F.regexp_replace(F.regexp_replace(col(c), r"[^0-9A-Za-z가-힣._ -]+", "-"), r"^[ .-]+|[ .-]+$", ""), F.lit(120))
    return F.when(s != "", s).otherwise(default)


def path_part(c: Column | str, default: str = "channel") -> Column:
    s = F.regexp_replace(F.regexp_replace(strip_ws(c), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(s != "", s).otherwise(default)


def embedded_json(c: Column | str) -> Column:
    """The JSON object in a text that may be fenced or stand among other words; null if there is none that can be read."""
    body = F.regexp_replace(strip_ws(c), r"(?i)\A```(?:json)?\s*|\s*```\z", "")
    is_object = lambda x: F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False)), x)
    return F.coalesce(is_object(body), is_object(F.regexp_extract(body, r"(?s)\{.*\}", 0)))
