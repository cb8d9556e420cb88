"""Identity rules: content-addressed ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def bronze_id(content: Column) -> Column:
    return F.concat(F.lit("bronze_"), F.left(F.sha2(content, 256), F.lit(16)))


def row_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the parts joined by a vertical bar; a null part counts as empty."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(16)))
