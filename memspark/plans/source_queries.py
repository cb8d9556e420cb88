"""Queries of the export readers: all stored chunks are written as an export of each kind, with the fields that its reader knows, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.work import Work
from memspark.plans.general_queries import table
from memspark.sources.exports import read_export


def _read(spark: SparkSession, d: str, kind: str, item: Column, *meta: str, by: Column | None = None) -> DataFrame:
    """source_id, title, content_hash and fields of the metadata of an export of all chunks; ``by`` names the folders."""
    rows = table(spark, d, "bronze_documents").withColumn("t", F.coalesce(F.get_json_object("metadata", "$.title"), F.lit("untitled"))).withColumn("n", F.col("ord").cast("string"))
    at = Work(spark, "exports").path(kind)
    out = rows.select(item.alias("x"), *([by.alias("folder")] if by is not None else [])).select("x.*", *(["folder"] if by is not None else []))
    out = out.write.partitionBy("folder") if by is not None else out.write
    out.json(at)
    return read_export(spark, at, kind).select("source_id", "title", F.sha2("content", 256).alias("content_hash"), *[F.get_json_object("metadata", f"$.{m}").alias(m) for m in meta])


def export_chat(spark, d):
    item = F.struct(F.concat("n", F.lit(".5")).alias("ts"), F.when(F.col("ord") % 3 > 0, F.col("source_type")).alias("user"), F.col("content").alias("text"), F.when(F.col("ord") % 2 == 0, F.lit("1.0")).alias("thread_ts"))
    return _read(spark, d, "slack", item, "channel", "user", "thread_ts", by=F.col("source_type"))


def export_issues(spark, d):
    fields = F.struct(F.col("t").alias("summary"), F.col("content").alias("description"), F.struct(F.lit("open").alias("name")).alias("status"), F.struct(F.array(F.struct(F.col("source_id").alias("body")), F.struct(F.lit("second").alias("body"))).alias("comments")).alias("comment"))
    return _read(spark, d, "jira", F.struct(F.concat(F.lit("K-"), "n").alias("key"), fields.alias("fields")), "issue_key", "status")


def export_pulls(spark, d):
    item = F.struct(F.col("ord").alias("number"), F.when(F.col("ord") % 2 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"), F.col("t").alias("title"), F.col("content").alias("body"), F.lit("closed").alias("state"), F.array(F.struct(F.col("source_id").alias("body"))).alias("comments"))
    return _read(spark, d, "github", item, "kind", "state")


def export_pages(spark, d):
    item = F.struct(F.concat(F.lit("p"), "n").alias("id"), F.col("t").alias("title"), F.col("content"), F.concat(F.lit("https://pages.example/"), "n").alias("url"), F.lit("2024-05-01").alias("last_edited_time"))
    return _read(spark, d, "notion", item, "original_url", "modified_at")


def export_files(spark, d):
    item = F.struct(F.concat(F.lit("f"), "n").alias("id"), F.col("t").alias("name"), F.col("content").alias("text"), F.array("source_type", "corpus_id").alias("parents"), F.lit("https://files.example").alias("webViewLink"), F.lit("2024-05-01").alias("modifiedTime"), F.array(F.struct(F.concat("source_type", F.lit("@x.example")).alias("emailAddress"))).alias("owners"))
    return _read(spark, d, "google-drive", item, "folder", "owners", "occurred_at", "memory_type")


def export_mail(spark, d):
    one = F.struct(F.concat(F.lit("m"), "n").alias("id"), F.concat("source_type", F.lit("@x.example; b@x.example")).alias("from"), F.array(F.lit("c@x.example")).alias("to"), F.array(F.lit("INBOX"), F.col("source_type")).alias("labelIds"), F.lit("2024-05-01").alias("date"), F.col("content").alias("body"))
    two = F.struct(F.lit("last").alias("id"), F.lit("c@x.example").alias("from"), F.array(F.lit("d@x.example")).alias("to"), F.array(F.lit("INBOX")).alias("labelIds"), F.lit("2024-05-02").alias("date"), F.lit("thanks").alias("body"))
    return _read(spark, d, "gmail", F.struct(F.concat(F.lit("t"), "n").alias("threadId"), F.col("t").alias("subject"), F.array(one, two).alias("messages")), "message_ids", "labels", "participants", "occurred_at")


def export_calendar(spark, d):
    item = F.struct(F.concat(F.lit("e"), "n").alias("id"), F.col("corpus_id").alias("calendar_id"), F.col("t").alias("summary"), F.struct(F.lit("2024-05-01T10:00").alias("dateTime")).alias("start"), F.struct(F.lit("2024-05-02").alias("date")).alias("end"), F.array(F.struct(F.concat("source_type", F.lit("@x.example")).alias("email")), F.struct(F.lit("z@x.example").alias("email"))).alias("attendees"), F.lit("room").alias("location"), F.col("content").alias("description"))
    return _read(spark, d, "google-calendar", item, "start", "end", "participants")


def export_sheets(spark, d):
    item = F.struct(F.col("corpus_id").alias("spreadsheet_id"), F.col("source_type").alias("sheet_name"), F.col("ord").alias("row_index"), F.struct(F.col("t").alias("name"), F.col("content").alias("note")).alias("values"), F.lit("2024-05-01").alias("modified_at"))
    return _read(spark, d, "google-sheets", item, "row_index", "modified_at")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__name__.startswith("export_")}

_ROWS = "r as (select *, coalesce(json_extract_string(metadata, '$.title'), 'untitled') as t, cast(ord as varchar) as n from bronze_documents where content is not null)"


def _sql(prefix: str, ident: str, title: str, front: list[tuple[str, str]], body: list[str], meta: dict[str, str], heading: str | None = None) -> str:
    """SQL of what a reader gives: the note with front matter, heading and body, as one text."""
    lines = ["'---'", f"'title: ' || {title}", *(f"'{k}: ' || {v}" for k, v in front), "'---'", "''", f"'# ' || {heading or title}", "''", *body]
    text = rf"regexp_replace(array_to_string([{', '.join(lines)}], chr(10)), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
    return f"with {_ROWS} select '{prefix}:' || {ident} as source_id, {title} as title, sha256({text}) as content_hash, {', '.join(f'{v} as {k}' for k, v in meta.items())} from r"


_CH, _WHO = "'folder=' || source_type", "case when ord % 3 > 0 then source_type else 'unknown' end"
_KIND = "case when ord % 2 = 0 then 'pull_request' else 'issue' end"
_FOLDER, _PEOPLE = "source_type || ', ' || corpus_id", "source_type || '@x.example, z@x.example'"
_MAIL = [
    "'Thread: t' || n", "''", "'Message ID: m' || n", "'From: ' || source_type || '@x.example; b@x.example'", "'To: c@x.example'", "'Cc: '", "'Date: 2024-05-01'", "'Labels: ' || case when source_type = 'INBOX' then 'INBOX' else 'INBOX, ' || source_type end", "''", "content", "''",
    "'Message ID: last'", "'From: c@x.example'", "'To: d@x.example'", "'Cc: '", "'Date: 2024-05-02'", "'Labels: INBOX'", "''", "'thanks'",
]
_LINK = "'https://mail.google.com/mail/u/0/#all/t' || n"

ORACLE = {
    "export_chat": _sql("slack", f"{_CH} || ':' || n || '.5'", f"'Slack #' || {_CH} || ' ' || n || '.5'", [("channel", _CH), ("user", _WHO), ("timestamp", "n || '.5'")], [f"'User: ' || {_WHO}", "''", "content", "case when ord % 2 = 0 then 'Thread: 1.0' else '' end"], {"channel": _CH, "user": f'{_WHO}', "thread_ts": "case when ord % 2 = 0 then '1.0' end"}, f"'Slack #' || {_CH}").replace(f'{_WHO} as user', f'{_WHO} as "user"'),
    "export_issues": _sql("jira", "'K-' || n", "t", [("issue_key", "'K-' || n"), ("status", "'open'")], ["content", "''", "'## Comments'", "'- ' || source_id", "'- second'"], {"issue_key": "'K-' || n", "status": "'open'"}),
    "export_pulls": _sql("github", f"{_KIND} || ':' || n", "t", [("github_kind", _KIND), ("github_number", "n"), ("state", "'closed'")], ["content", "''", "'## Comments'", "'- ' || source_id"], {"kind": _KIND, "state": "'closed'"}),
    "export_pages": _sql("notion", "'p' || n", "t", [("notion_page_id", "'p' || n"), ("url", "'https://pages.example/' || n"), ("last_edited_time", "'2024-05-01'")], ["content"], {"original_url": "'https://pages.example/' || n", "modified_at": "'2024-05-01'"}),
    "export_files": _sql("google_drive", "'f' || n", "t", [("google_service", "'drive'"), ("document_id", "'f' || n"), ("folder", _FOLDER), ("modified_at", "'2024-05-01'"), ("occurred_at", "'2024-05-01'"), ("original_url", "'https://files.example'")], [f"'Folder: ' || {_FOLDER}", "''", "content"], {"folder": _FOLDER, "owners": "'[\"' || source_type || '@x.example\"]'", "occurred_at": "'2024-05-01'", "memory_type": "'Document'"}),
    "export_mail": _sql("gmail", "'t' || n", "t", [("google_service", "'gmail'"), ("thread_id", "'t' || n"), ("message_ids", "'m' || n || ', last'"), ("labels", "'INBOX, ' || source_type"), ("occurred_at", "'2024-05-01'"), ("original_url", _LINK)], _MAIL, {"message_ids": "'[\"m' || n || '\",\"last\"]'", "labels": "'[\"INBOX\",\"' || source_type || '\"]'", "participants": "'[\"' || array_to_string(list_sort([source_type || '@x.example', 'b@x.example', 'c@x.example', 'd@x.example']), '\",\"') || '\"]'", "occurred_at": "'2024-05-01'"}),
    "export_calendar": _sql("google_calendar", "corpus_id || ':e' || n", "t", [("google_service", "'calendar'"), ("calendar_id", "corpus_id"), ("event_id", "'e' || n"), ("start", "'2024-05-01T10:00'"), ("end", "'2024-05-02'"), ("location", "'room'"), ("occurred_at", "'2024-05-01T10:00'"), ("original_url", "''")], ["'Start: 2024-05-01T10:00'", "'End: 2024-05-02'", "'Location: room'", f"'Participants: ' || {_PEOPLE}", "''", "content"], {"start": "'2024-05-01T10:00'", '"end"': "'2024-05-02'", "participants": "'[\"' || source_type || '@x.example\",\"z@x.example\"]'"}),
    "export_sheets": _sql("google_sheets", "corpus_id || ':' || source_type || ':' || n", "source_type || ' row ' || n", [("google_service", "'sheets'"), ("spreadsheet_id", "corpus_id"), ("sheet_name", "source_type"), ("row_index", "n"), ("occurred_at", "'2024-05-01'"), ("original_url", "''")], ["'name: ' || t", "'note: ' || content"], {"row_index": "n", "modified_at": "'2024-05-01'"}),
}
