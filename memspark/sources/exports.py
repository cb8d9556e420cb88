"""Readers of Markdown folders and JSON exports. Every reader gives one shape: source_type, source_id, root_source_id, title, content, metadata (JSON text),
section_path, section_level, path (relative to what was read) and pos, the place in the file.

Files are read whole, one task reads many; JSON stays text, and fields are taken from it by path, so exports of any nesting need no inference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attribute

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import redact, redact_when, strip_ws
from memspark.operators import chunking, extraction
from memspark.operators.silver import front_matter
from memspark.sources.nested import flat_text, mail_thread, people, sheet_cells

# The keys under which exports hold their list, in order of preference; the last three are additions.
ENVELOPES = ["messages", "issues", "pull_requests", "prs", "discussions", "comments", "files", "documents", "threads", "events", "rows", "values", "items", "pages", "results", "data"]
COLUMNS = ["source_type", "source_id", "root_source_id", "title", "content", "metadata", "section_path", "section_level", "path", "pos"]


def field(item: Column, *paths: str) -> Column:
    """The first of the paths that is present."""
    return F.coalesce(*[F.get_json_object(item, f"$.{p}") for p in paths])


def filled(*values: Column) -> Column:
    """The first of the values that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def elements(item: Column, *lists: str) -> Column:
    """The elements, as JSON texts, of the first list present; of an object, those of the first list under a known key."""
    value = field(item, *lists)
    return F.coalesce(F.when(F.startswith(F.trim(value), F.lit("[")), F.from_json(value, "array<string>")), unwrap(value), F.array().cast("array<string>"))


def comment_lines(item: Column, *lists: str) -> Column:
    """A line for each comment that is an object."""
    said = F.transform(F.filter(elements(item, *lists), lambda e: F.startswith(F.trim(e), F.lit("{"))), lambda e: F.concat(F.lit("- "), F.coalesce(field(e, "body", "text", "content"), F.lit(""))))
    return F.array_join(said, "\n")


@dataclass(frozen=True)
class Item:
    """An item of an export: its JSON text, the object that holds it, its file's name without ending, the folder it is in (of files at the root their own name), its number."""

    item: Column = attribute(default_factory=lambda: F.col("item"))
    parent: Column = attribute(default_factory=lambda: F.col("value"))
    stem: Column = attribute(default_factory=lambda: F.col("stem"))
    folder: Column = attribute(default_factory=lambda: F.col("folder"))
    number: Column = attribute(default_factory=lambda: F.col("pos"))

    def get(self, *paths: str) -> Column:
        return field(self.item, *paths)

    def text(self, *paths: str) -> Column:
        """A value of any nesting as text."""
        return flat_text(self.get(*paths))


@dataclass(frozen=True)
class Reading:
    """How an item of one kind is read. ``front`` are lines of the rendered note's front matter after its title, ``body`` the lines after its heading, ``meta`` what else is kept."""

    ident: Column
    title: Column
    front: dict[str, Column]
    body: list[Column]
    meta: dict[str, Column]
    root: Column | None = None
    heading: Column | None = None


def _slack(x: Item) -> Reading:
    ts = filled(x.get("ts", "timestamp", "created_at"), x.number.cast("string"))
    user, thread = F.coalesce(x.text("user", "username", "author"), F.lit("")), x.get("thread_ts", "parent_ts")
    user = filled(user, F.lit("unknown"))
    name = F.concat(F.lit("Slack #"), x.folder)
    body = [F.concat(F.lit("User: "), user), F.lit(""), F.coalesce(x.get("text", "message", "content"), F.lit("")), F.when(thread != "", F.concat(F.lit("Thread: "), thread)).otherwise("")]
    return Reading(F.concat_ws(":", x.folder, ts), F.concat_ws(" ", name, ts), {"channel": x.folder, "user": user, "timestamp": ts}, body, {"channel": x.folder, "user": user, "thread_ts": thread, "connector": F.lit("slack-export")}, root=x.folder, heading=name)


def _jira(x: Item) -> Reading:
    key = filled(x.get("key", "id", "issue_key"), x.stem)
    both = lambda *ks: F.coalesce(F.when(x.get("fields").isNotNull(), field(x.item, *[f"fields.{k}" for k in ks])).otherwise(x.get(*ks)), F.lit(None))
    title, status = filled(both("summary", "title", "name"), key), F.coalesce(flat_text(both("status", "state")), F.lit(""))
    nested = [f"{p}{c}" for p in ("fields.", "") for c in ("comments.comments", "comment.comments", "comments", "comment")]
    body = [F.coalesce(both("description", "body", "content"), F.lit("")), F.lit(""), F.lit("## Comments"), comment_lines(x.item, *nested)]
    return Reading(key, title, {"issue_key": key, "status": status}, body, {"issue_key": key, "status": status, "connector": F.lit("jira-json")})


def _github(x: Item) -> Reading:
    number = filled(x.get("number", "id"), x.stem)
    kind = F.coalesce(x.get("kind", "type"), F.when(x.get("pull_request").isNotNull(), "pull_request").otherwise("issue"))
    title, state = filled(x.get("title", "summary", "name"), F.concat_ws(" ", kind, number)), F.coalesce(x.get("state", "status"), F.lit(""))
    body = [F.coalesce(x.get("body", "description", "content"), F.lit("")), F.lit(""), F.lit("## Comments"), comment_lines(x.item, "comments", "discussion")]
    return Reading(F.concat_ws(":", kind, number), title, {"github_kind": kind, "github_number": number, "state": state}, body, {"kind": kind, "state": state, "connector": F.lit("github-json")})


def _notion(x: Item) -> Reading:
    ident = filled(x.get("id", "page_id"), x.stem)
    url, edited = F.coalesce(x.get("url", "public_url"), F.lit("")), F.coalesce(x.get("last_edited_time", "updated_at"), F.lit(""))
    return Reading(ident, filled(x.get("title", "name"), ident), {"notion_page_id": ident, "url": url, "last_edited_time": edited}, [F.coalesce(x.get("content", "body", "text"), F.lit(""))], {"original_url": url, "modified_at": edited, "connector": F.lit("notion-json")})


def _numbered(x: Item) -> Column:
    return F.concat_ws("-", x.stem, x.number.cast("string"))


def _drive(x: Item) -> Reading:
    ident = filled(x.get("id", "file_id", "document_id"), _numbered(x))
    title, folder = filled(x.get("name", "title"), ident), x.text("folder", "folder_path", "path", "parents")
    url, edited = F.coalesce(x.get("webViewLink", "web_url", "url", "alternateLink"), F.lit("")), F.coalesce(x.get("modifiedTime", "modified_at", "updated_at"), F.lit(""))
    front = {"google_service": F.lit("drive"), "document_id": ident, "folder": folder, "modified_at": edited, "occurred_at": edited, "original_url": url}
    body = [F.concat(F.lit("Folder: "), folder), F.lit(""), x.text("text", "body", "content", "description")]
    return Reading(ident, title, front, body, front | {"owners": people(x.get("owners", "owner", "lastModifyingUser")), "memory_type": F.lit("Document"), "privacy_level": F.lit("private"), "connector": F.lit("google-drive-json")})


def _gmail(x: Item) -> Reading:
    m = mail_thread(x.item)
    ident = filled(x.get("threadId", "thread_id", "id"), _numbered(x))
    subject, url = filled(x.get("subject", "title"), m["subject"], ident), filled(x.get("url", "web_url"), F.concat(F.lit("https://mail.google.com/mail/u/0/#all/"), ident))
    at = filled(x.get("date", "internalDate", "created_at", "updated_at"), m["occurred"], F.lit(""))
    at = F.coalesce(at, F.lit(""))
    front = {"google_service": F.lit("gmail"), "thread_id": ident, "message_ids": F.array_join(m["ids"], ", "), "labels": F.array_join(m["labels"], ", "), "occurred_at": at, "original_url": url}
    meta = front | {"message_ids": m["ids"], "labels": m["labels"], "participants": m["people"], "memory_type": F.lit("Email"), "privacy_level": F.lit("private"), "connector": F.lit("gmail-json")}
    return Reading(ident, subject, front, [F.concat(F.lit("Thread: "), ident), F.lit(""), m["body"]], meta)


def _calendar(x: Item) -> Reading:
    ident, calendar = filled(x.get("id", "event_id", "iCalUID"), _numbered(x)), filled(x.get("calendar_id", "calendarId"), F.lit("primary"))
    day = lambda *ks: F.coalesce(field(x.item, *[f"{k}.{d}" for k in ks for d in ("dateTime", "date")], *ks), F.lit(""))
    start, end = day("start", "start_time", "starts_at"), day("end", "end_time", "ends_at")
    title, url, place = filled(x.get("summary", "title", "name"), ident), F.coalesce(x.get("htmlLink", "url", "web_url"), F.lit("")), x.text("location", "meeting_location")
    who = people(x.get("attendees", "participants"))
    front = {"google_service": F.lit("calendar"), "calendar_id": calendar, "event_id": ident, "start": start, "end": end, "location": place, "occurred_at": start, "original_url": url}
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in (("Start", start), ("End", end), ("Location", place), ("Participants", F.array_join(who, ", ")))]
    return Reading(F.concat_ws(":", calendar, ident), title, front, [*lines, F.lit(""), x.text("description", "body", "content")], front | {"participants": who, "memory_type": F.lit("Meeting"), "privacy_level": F.lit("private"), "connector": F.lit("google-calendar-json")})


def _sheets(x: Item) -> Reading:
    up = lambda *ks: F.coalesce(field(x.item, *ks), F.when(F.startswith(F.trim(x.parent), F.lit("{")), field(x.parent, *ks)))
    sheet = filled(up("spreadsheet_id", "spreadsheetId"), F.when(F.startswith(F.trim(x.parent), F.lit("{")), field(x.parent, "id")), x.stem)
    name, n = filled(up("sheet_name", "sheetName"), F.lit("Sheet1")), filled(x.get("row_index", "rowIndex"), (x.number + 1).cast("string"))
    url, edited = F.coalesce(up("url", "web_url"), F.lit("")), F.coalesce(up("modified_at", "updated_at"), F.lit(""))
    front = {"google_service": F.lit("sheets"), "spreadsheet_id": sheet, "sheet_name": name, "row_index": n, "occurred_at": edited, "original_url": url}
    # a row of a matrix is the cells themselves, named by the matrix's header row; the header is no row of its own
    row = F.coalesce(F.when(F.startswith(F.trim(x.item), F.lit("[")), x.item), x.get("values", "cells", "data"), x.get("body", "content", "text", "description"), x.item)
    title = filled(x.get("title", "summary"), F.concat(name, F.lit(" row "), n))
    return Reading(F.concat_ws(":", sheet, name, n), title, front, [sheet_cells(row, F.col("header"))], front | {"modified_at": edited, "memory_type": F.lit("Document"), "privacy_level": F.lit("private"), "connector": F.lit("google-sheets-json")})


@dataclass(frozen=True)
class Profile:
    """A kind of source: its name, what it offers, the names that mean it, and for exports how an item is read and under which keys its lists stand first."""

    name: str
    source_type: str
    features: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    read: Callable[[Item], Reading] | None = None
    lists: tuple[str, ...] = ()
    mode: str = "export"


# Names of the kinds, what they offer and the names that mean them.
PROFILES = [
    Profile("markdown", "markdown", ("file", "section", "frontmatter", "headings"), ("markdown-files", "md")),
    Profile("obsidian", "obsidian", ("vault_import", "vault_export", "wikilink", "tag")),
    Profile("slack-export", "slack", ("workspace", "channel", "thread", "message", "export_json"), ("slack",), _slack),
    Profile("jira-json", "jira", ("issue", "comment", "status", "export_json"), ("jira",), _jira),
    Profile("github-json", "github", ("issue", "pull_request", "discussion", "comment", "export_json"), ("github",), _github),
    Profile("notion-json", "notion", ("page", "database", "block", "comment", "export_json"), ("notion",), _notion),
    Profile("google-drive-json", "google_drive", ("file", "document", "owner", "modified_time", "original_url", "export_json"), ("google-drive", "drive", "gdrive"), _drive, ("files", "documents", "items")),
    Profile("gmail-json", "gmail", ("thread", "message", "participants", "original_url", "export_json"), ("gmail", "google-email", "google-mail", "mail"), _gmail, ("threads", "messages", "items")),
    Profile("google-calendar-json", "google_calendar", ("event", "meeting", "attendees", "time_range", "original_url", "export_json"), ("google-calendar", "calendar", "gcal"), _calendar, ("events", "items")),
    Profile("google-sheets-json", "google_sheets", ("spreadsheet", "sheet", "row", "modified_time", "original_url", "export_json"), ("google-sheets", "sheets", "gsheets"), _sheets, ("rows", "values")),
    Profile("slack-live", "slack", ("workspace", "channel", "thread", "message", "incremental_sync"), mode="live"),
]


def profile(name: str) -> Profile:
    """The profile of a name or alias, case and underscores aside; an unknown one is an error."""
    key = name.lower().replace("_", "-")
    found = next((p for p in PROFILES if key == p.name or key in p.aliases), None)
    if found is None:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(p.name for p in PROFILES)}")
    return found


def unwrap(value: Column, lists: tuple[str, ...] = ()) -> Column:
    """array<string> of the items of a JSON text: a list's elements, those of the first list under a known key, else the object itself; null for a scalar."""
    keys = lists or ENVELOPES
    inner = [F.when(F.startswith(F.get_json_object(value, f"$.{k}"), F.lit("[")), F.from_json(F.get_json_object(value, f"$.{k}"), "array<string>")) for k in keys]
    text = F.trim(value)
    return F.when(F.startswith(text, F.lit("[")), F.from_json(value, "array<string>")).when(F.startswith(text, F.lit("{")), F.coalesce(*inner, F.array(value)))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path (relative to the folder, of a single file its name), value, stem, folder."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(at).toString()
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        root = root.rsplit("/", 1)[0]
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inside = F.substring(plain(named), F.length(plain(F.lit(root))) + 2, 100_000)
    name = F.element_at(F.split(inside, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.when(F.contains(inside, F.lit("/")), F.element_at(F.split(inside, "/"), -2)).otherwise(stem)
    return files.select(inside.alias("path"), "value", stem.alias("stem"), folder.alias("folder"))


def read_export(spark: SparkSession, path: str, kind: str, redaction: str = "off") -> DataFrame:
    """The rows of a folder or file of JSON exports of one kind. A file whose first line is a JSON object by itself and has lines after it is the list of its lines. Unreadable JSON, scalars and items without text give no row. ``redaction`` off, metadata or content: which
    texts lose email addresses and phone numbers; ids and times keep theirs."""
    p = profile(kind)
    files = _files(spark, path, "*.{json,jsonl}").withColumn("lines", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""))
    an_object = lambda x: F.startswith(F.trim(x), F.lit("{")) & F.try_parse_json(x).isNotNull()
    by_line = (F.size("lines") > 1) & an_object(F.get("lines", F.lit(0)))
    listed = F.when(by_line, F.filter("lines", an_object)).when(F.try_parse_json("value").isNotNull(), unwrap(F.col("value"), p.lists))
    files = files.select("path", "stem", "folder", F.when(by_line, "[]").otherwise(F.col("value")).alias("value"), listed.alias("items"))
    items = files.select("*", F.posexplode("items").alias("pos", "item"))
    if p.source_type == "google_sheets":
        matrix = F.startswith(F.trim(F.get_json_object("value", "$.values[0]")), F.lit("[")) & F.get_json_object("value", "$.rows").isNull()
        items = items.withColumn("header", F.when(matrix, F.get_json_object("value", "$.values[0]"))).where("header is null or pos > 0")
    else:
        items = items.where(F.startswith(F.trim("item"), F.lit("{")))
    r = p.read(Item())
    rows = items.select("path", "pos", r.ident.alias("ident"), (r.root if r.root is not None else r.ident).alias("root"), r.title.alias("title"), (r.heading if r.heading is not None else r.title).alias("heading"), F.struct(*[v.alias(k) for k, v in r.front.items()]).alias("front"), F.concat_ws("\n", *[F.coalesce(b, F.lit("")) for b in r.body]).alias("body"), F.struct(*[v.alias(k) for k, v in r.meta.items()]).alias("meta"))
    head = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(f"front.{k}"), F.lit(""))) for k in r.front]
    content = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), *head, F.lit("---"), F.lit(""), F.concat(F.lit("# "), "heading"), F.lit(""), "body")
    # texts of people and titles are redacted in the metadata, ids, times and addresses of pages are not
    kept = lambda c, k: redact_when(c, redaction, "metadata") if k in ("title", "user", "folder", "location") else F.transform(c, lambda v: redact(v)) if k in ("participants", "owners") and redaction != "off" else c
    meta = [kept(F.col(f"meta.{k}"), k).alias(k) for k in r.meta]
    prefix = lambda c: F.concat(F.lit(f"{p.source_type}:"), c)
    out = rows.where("trim(body) <> ''").select(
        F.lit(p.source_type).alias("source_type"), prefix(F.col("ident")).alias("source_id"), prefix(F.col("root")).alias("root_source_id"), redact_when("title", redaction, "metadata").alias("title"), strip_ws(redact_when(content, redaction, "content")).alias("content"),
        F.to_json(F.struct(redact_when("title", redaction, "metadata").alias("title"), *meta, F.lit(redaction).alias("pii_redaction"))).alias("metadata"), F.lit(None).cast("array<string>").alias("section_path"), F.lit(None).cast("int").alias("section_level"), "path", F.format_string("%08d", "pos").alias("pos"),
    )
    return out.where("source_id is not null").select(*COLUMNS)


def read_markdown(spark: SparkSession, path: str, kind: str = "markdown") -> DataFrame:
    """The chunks of a folder of Markdown notes or of one note. A text with two headings or more of the first two levels gives chunks by section. The title is the section's, else
    the front matter's, the first heading's or the file's; metadata hold front matter and headings, those of a vault also links and tags."""
    files = _files(spark, path, "*.{md,markdown}")
    cut = _cut(files)
    text = F.col("content")
    fm, heads = front_matter(text), extraction.headings(text)
    title = F.coalesce("title", filled(F.element_at(fm, "title")), F.get(heads, F.lit(0)), F.col("stem"))
    links = [extraction.all_links(text).alias("wikilinks"), extraction.tags(text).alias("tags")] if kind == "obsidian" else []
    section = F.when(F.col("title").isNotNull(), F.split("crumbs", " > "))
    meta = F.to_json(F.struct(title.alias("title"), F.col("path").alias("source_file"), F.col("path").alias("root_source_id"), fm.alias("frontmatter"), heads.alias("headings"), F.col("title").alias("section_title"), section.alias("section_path"), F.when(F.col("title").isNotNull(), F.col("level")).alias("section_level"), (F.col("chunk_no") - 1).alias("chunk_index"), F.col("n_chunks").alias("chunk_total"), *links))
    return cut.select(
        F.lit(kind).alias("source_type"), "source_id", F.col("path").alias("root_source_id"), title.alias("title"), "content", meta.alias("metadata"), section.alias("section_path"),
        F.when(F.col("title").isNotNull(), F.col("level")).cast("int").alias("section_level"), "path", F.concat_ws("/", F.format_string("%08d", "section_no"), F.format_string("%08d", "chunk_no")).alias("pos"),
    ).where("content <> ''")


def _cut(files: DataFrame) -> DataFrame:
    named = files.select(F.col("path").alias("file"), "stem", "value")
    cut = chunking.markdown_chunks(named.withColumn("base", F.col("file")), "file", "value", "base").withColumnRenamed("path", "crumbs")
    return cut.join(named.select("file", "stem"), "file").withColumnRenamed("file", "path")


def read_source(spark: SparkSession, path: str, kind: str, redaction: str = "off") -> DataFrame:
    """The reader of a kind of source, by name or alias; an unknown kind is an error, and so is a live one, which has no path."""
    p = profile(kind)
    if p.mode == "live":
        raise ValueError(f"{p.name} is a live source and has no path; see sources.live")
    return read_markdown(spark, path, p.source_type) if p.read is None else read_export(spark, path, p.name, redaction)
