"""Oversized items cut at natural boundaries by one bounded-quantifier regex; overlap from lookback offsets. JVM-side throughout.

The alternatives are ordered by boundary strength: before a heading, after a blank line, a line, a sentence, a blank, and at last any character
that no combining mark follows. Each first asks for a piece of at least a third of the limit, so that a strong boundary near
the start does not leave slivers; then all are tried again without that. Pieces concatenated without their overlap give back the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boundaries in order of strength, as what must follow the last character of a piece.
BOUNDARIES = [r"(?<=\n)(?=#{1,6}\s)", r"(?<=\n)(?=\n)|(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?。…][\"'”’»)\]]?)(?=\s)", r"(?<=\s)|(?=\s)"]
WHOLE_CHARACTER = r"(?![\p{M}‍️\n])"
BLOCK_BREAK = r"(?U)\n\s*\n"


def _piece(limit: int) -> str:
    least = max(1, limit // 3)
    ways = [rf".{{1,{limit}}}\z"]
    ways += [rf".{{{least},{limit}}}(?:{b})" for b in BOUNDARIES]
    ways += [rf".{{1,{least}}}(?:{b})" for b in BOUNDARIES] if least > 1 else []
    return "|".join([*ways, rf".{{1,{limit}}}{WHOLE_CHARACTER}", rf".{{1,{limit}}}"])


def cut_pattern(limit: int, overlap: int) -> str:
    """The regex whose matches, in order, are a text's pieces without overlap: up to ``limit`` characters at the start of the text, up to
    ``limit - overlap`` after that."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    return rf"(?Us)\A(?:{_piece(limit)})|(?:{_piece(limit - overlap)})"


def pieces(text: Column | str, limit: int = 1800, overlap: int = 120) -> Column:
    """array<struct<at, text>>: the pieces of a text in order, ``at`` the offset of a piece's own part in code points.

    Each piece after the first begins with the last ``overlap`` characters of the one before. A text within the limit is one piece, an
    empty one none, a null one null.
    """
    text = F.col(text) if isinstance(text, str) else text
    parts = F.when(F.length(text) <= limit, F.filter(F.array(text), lambda x: x != "")).otherwise(F.regexp_extract_all(text, F.lit(cut_pattern(limit, overlap)), F.lit(0)))
    # one fold over the parts: the offset so far, the piece before, the pieces
    none = F.array().cast("array<struct<at:int,text:string>>")
    piece = lambda a, p: F.concat(F.substring(a["last"], -overlap, overlap) if overlap else F.lit(""), p)
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), piece(a, p).alias("last"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), piece(a, p).alias("text")))).alias("out"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), none.alias("out")), step, lambda a: a["out"])


def split_oversized(df: DataFrame, text: str, limit: int = 1800, overlap: int = 120) -> DataFrame:
    """All columns but the text, and piece_no (from 1), n_pieces, at, piece: one row for each piece of each row over the limit.

    Rows within the limit, empty or null are not oversized and give none. Columns named like the new ones are replaced. Rows
    are independent, so repeated rows give repeated pieces; nothing is shuffled.
    """
    rest = [c for c in df.columns if c not in (text, "piece_no", "n_pieces", "at", "piece")]
    over = df.where(F.length(text) > limit).withColumn("_p", pieces(text, limit, overlap))
    return over.select(*rest, F.size("_p").alias("n_pieces"), F.posexplode("_p").alias("_i", "_x")).select(*rest, (F.col("_i") + 1).alias("piece_no"), "n_pieces", F.col("_x.at").alias("at"), F.col("_x.text").alias("piece"))


def units(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, block_no, unit: the whole text as block 0 and its blocks, separated by blank lines, from 1, each trimmed. Empty blocks are
    not numbered; null texts have no units."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    blocks = F.filter(F.transform(F.split(text, BLOCK_BREAK), strip), lambda b: b != "")
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.concat(F.array(strip(F.col(text))), blocks)).alias("block_no", "unit"))
