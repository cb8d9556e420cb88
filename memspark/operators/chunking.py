"""Markdown texts to chunks: sections by headings, greedy packing of blocks, hard windows, chunk ids. JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import strip_ws

# Size of a chunk and of the text that it repeats from the one before, in characters.
LIMIT, OVERLAP = 1800, 120
_HEAD = r"^#{1,2}[ \t]+\S"
# blocks of lines, and the blank lines between them; possessive, so long texts don't recurse
BLOCKS = r"(?U)\n\s*\n|(?:[^\n]++|\n(?!\s*\n))++"


def hard_windows(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Windows of ``limit`` characters every ``limit - overlap``, stripped, empty ones dropped; the last reaches the end."""
    step = limit - overlap
    n = F.greatest(F.ceil((F.length(text) - limit) / step).cast("int"), F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), n), lambda i: strip_ws(F.substring(text, i * step + 1, F.lit(limit))))
    return F.filter(windows, lambda w: w != "")


def pack_blocks(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The chunks of a text: blocks between blank lines packed while they fit, each chunk after the first led by the last ``overlap`` characters of the one
    before, and what is still too long cut into windows. A text within the limit is one chunk, a blank one none, a null one null."""
    text = strip_ws(text)
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("cur"), none.alias("out"))

    def step(a: Column, b: Column) -> Column:
        fits, filled = F.length(a["cur"]) + F.length(b) <= limit, strip_ws(a["cur"]) != ""
        cur = F.when(fits, F.concat(a["cur"], b)).when(filled, F.concat(F.right(a["cur"], F.lit(overlap)), b)).otherwise("")
        out = F.when(fits, a["out"]).otherwise(F.concat(a["out"], F.array(F.when(filled, a["cur"]).otherwise(b))))
        return F.struct(cur.alias("cur"), out.alias("out"))

    runs = F.aggregate(F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0)), start, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    packed = F.flatten(F.transform(runs, lambda r: hard_windows(strip_ws(r), limit, overlap)))
    return F.when(F.length(text) <= limit, F.filter(F.array(text), lambda t: t != "")).otherwise(packed)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_no, level, title, path, body for Markdown texts with at least two headings of the first two levels: one row for each such heading,
    its body up to the next; what stands before the first is in none. Other texts give one row, no title. The path holds the titles of the first and the
    section's own level. ``key`` is unique; null texts give none. One regex cuts a text, so cost grows with its length alone."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?ms){_HEAD}.*?(?={_HEAD}|\z)"), F.lit(0))
    parts = F.when(F.size(found) >= 2, found).otherwise(F.array(F.col(text)))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), (F.size(found) >= 2).alias("_cut"), F.posexplode(parts).alias("i", "body"))
    level = F.when(F.col("_cut"), F.length(F.regexp_extract("body", r"^(#{1,2})[ \t]", 1))).otherwise(0)
    title = F.when(F.col("_cut"), strip_ws(F.regexp_extract("body", r"^#{1,2}[ \t]+([^\r\n]*)", 1)))
    rows = rows.select("_k", "i", level.alias("level"), title.alias("title"), strip_ws("body").alias("body"))
    top = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(Window.partitionBy("_k").orderBy("i"))
    return rows.select(F.col("_k").alias(key), (F.col("i") + 1).alias("section_no"), "level", "title", F.concat_ws(" > ", F.when(F.col("level") == 2, top), "title").alias("path"), "body")


def chunk_id(base: Column, number: Column, total: Column) -> Column:
    """``base`` for the only chunk of a text, else with the chunk's number of how many."""
    return F.when(total > 1, F.format_string("%s::chunk-%03d-of-%03d", base, number, total)).otherwise(base)


def section_id(base: Column, title: Column) -> Column:
    """``base#title`` with the title's separators made plain; ``base`` without a title."""
    plain = F.replace(F.replace(F.trim(F.regexp_replace(title, r"(?U)\s+", " ")), F.lit("/"), F.lit("-")), F.lit(":"), F.lit(" -"))
    return F.concat_ws("#", base, plain)


def chunk_numbers(chunks: DataFrame, parent: list[str] | str, order: list[str] | str) -> DataFrame:
    """chunk_no and n_chunks within each parent; a parent has as many chunks as its text."""
    w = Window.partitionBy(parent)
    return chunks.withColumn("chunk_no", F.row_number().over(w.orderBy(order))).withColumn("n_chunks", F.count("*").over(w))


def markdown_chunks(docs: DataFrame, key: str, text: str, base: str) -> DataFrame:
    """key, source_id, section_no, level, title, path, chunk_no, n_chunks, content: the sections of each text packed into chunks, with ids from the column ``base``."""
    cut = sections(docs, key, text).join(docs.select(key, F.col(base).alias("_base")), key).withColumn("_p", pack_blocks(F.col("body")))
    rows = cut.select(key, "_base", "section_no", "level", "title", "path", F.size("_p").alias("n_chunks"), F.posexplode("_p").alias("_i", "content"))
    named = chunk_id(section_id(F.col("_base"), F.col("title")), F.col("_i") + 1, F.col("n_chunks"))
    return rows.select(key, named.alias("source_id"), "section_no", "level", "title", "path", (F.col("_i") + 1).alias("chunk_no"), "n_chunks", "content")
