"""Values of any nesting in JSON exports as text and as lists of people. Arrow-batched, as no expression of fixed depth can read them."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys under which a nested value says itself, and those of a person and of a message.
SAID = ["displayName", "emailAddress", "email", "name", "dateTime", "date", "value"]
PERSON = ["email", "address", "displayName", "name"]
PEOPLE_KEYS = ["from", "sender", "author", "to", "cc", "bcc", "recipients"]
LABEL_KEYS = ["labelIds", "label_ids", "labels"]
MAIL = "people array<string>, ids array<string>, labels array<string>, subject string, occurred string, body string"


def load(value: str | None) -> Any:
    """The JSON value of a text; a text that is no JSON is itself."""
    if value is None:
        return None
    try:
        return json.loads(value)
    except ValueError:
        return value


def said(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, dict):
        key = next((k for k in SAID if value.get(k) is not None), None)
        return said(value[key]) if key else " ".join(f"{k}={said(v)}" for k, v in value.items())
    if isinstance(value, list):
        return ", ".join(t for t in map(said, value) if t)
    return str(value)


def persons(value: Any) -> list[str]:
    if isinstance(value, list):
        return [p for v in value for p in persons(v)]
    if isinstance(value, dict):
        if isinstance(value.get("emailAddress"), dict):
            return persons(value["emailAddress"])
        name = said(present(value, *PERSON, "emailAddress"))
        return [name] if name else []
    return [p.strip() for p in said(value).replace(";", ",").split(",") if p.strip()]


def present(row: dict, *keys: str) -> Any:
    return next((row[k] for k in keys if row.get(k) is not None), None)


def distinct(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def thread(item: str | None) -> dict:
    """People, message ids and labels of a mail thread, its subject and time, and its messages as one text, in order."""
    row = load(item)
    row = row if isinstance(row, dict) else {}
    listed = row.get("messages")
    messages = [m for m in listed if isinstance(m, dict)] if isinstance(listed, list) else [row]
    labels = lambda r: [x for k in LABEL_KEYS for x in persons(r.get(k))]
    first = lambda *ks: next((said(m[k]) for k in ks for m in messages if m.get(k)), "")
    ident = lambda m: said(present(m, "id", "message_id", "messageId"))
    lines = []
    for m in messages:
        head = [("Message ID", ident(m)), ("From", said(present(m, "from", "sender", "author"))), ("To", said(present(m, "to", "recipients"))), ("Cc", said(m.get("cc"))), ("Date", said(present(m, "date", "internalDate", "created_at"))), ("Labels", ", ".join(distinct(labels(m))))]
        lines += [*(f"{k}: {v}" for k, v in head), "", said(present(m, "body", "text", "content", "snippet")), ""]
    return {
        "people": sorted({p for m in messages for k in PEOPLE_KEYS for p in persons(m.get(k))}), "ids": distinct([ident(m) for m in messages]), "labels": distinct([*labels(row), *(x for m in messages for x in labels(m))]),
        "subject": first("subject"), "occurred": first("date", "internalDate"), "body": "\n".join(lines).strip(),
    }


def cells(value: str | None, names: str | None) -> str:
    """The cells of a sheet's row, one line each: by their keys, by the names of a header row, or as a list."""
    v, head = load(value), load(names)
    if isinstance(v, dict):
        return "\n".join(f"{k}: {said(x)}" for k, x in v.items())
    if isinstance(v, list):
        if isinstance(head, list) and head:
            return "\n".join(f"{said(k)}: {said(x)}" for k, x in zip([*head, *[""] * len(v)], v, strict=False))
        return "\n".join(f"- {said(x)}" for x in v)
    return said(v)


def flat_text(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: said(load(v))), "string")(c)


def people(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: persons(load(v))), "array<string>")(c)


def mail_thread(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.DataFrame([thread(v) for v in s], columns=[c.split(" ")[0] for c in MAIL.split(", ")]), MAIL)(c)


def sheet_cells(row: Column, names: Column) -> Column:
    return F.pandas_udf(lambda v, h: pd.Series([cells(a, b) for a, b in zip(v, h, strict=True)], dtype=object), "string")(row, names)
