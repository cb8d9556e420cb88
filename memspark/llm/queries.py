"""The queries of the free-text problems over the domain tables, with SQL where SQL can say it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import leakage, mixing, names, personal, splitting, visual


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _name_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kinds = "type in ('Person', 'Project')"
    aliases = table(spark, d, "silver_entities").where(kinds).select("type", "name", F.explode("aliases").alias("alias"))
    return table(spark, d, "gold_nodes").where(kinds).select("id", "type", "name"), aliases, table(spark, d, "given_name_forms")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(*_name_tables(spark, d)).selectExpr("a node_a", "b node_b")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.link_variants(*_name_tables(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    units = splitting.units(table(spark, d, "bronze_documents"), "ord", "content")
    return splitting.split_oversized(units, "unit").where("piece_no = 1").selectExpr("ord", "cast(block_no as bigint) block_no")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bronze_documents").select("ord", "id", "content", F.array_join("section_path", " / ").alias("section_path"))
    return splitting.split_oversized(rows, "content").selectExpr("ord", "id", "section_path", "cast(piece_no as bigint) piece_no", "cast(n_pieces as bigint) n_pieces", "cast(at as bigint) at", "piece")


def _key(spark: SparkSession) -> bytes:
    """The secret of the session, spark.memspark.personal.key; without one a key of this session alone, which nobody keeps."""
    kept = spark.conf.get("spark.memspark.personal.key", None)
    if kept is None:
        spark.conf.set("spark.memspark.personal.key", kept := secrets.token_hex(32))
    return kept.encode()


def _personal(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "gold_nodes").where("type = 'Person'").select("name")
    entities = table(spark, d, "silver_entities").where("type = 'Person'")
    people = people.unionByName(entities.select("name")).unionByName(entities.select(F.explode("aliases").alias("name")))
    forms = table(spark, d, "given_name_forms")
    given = forms.select(F.explode(F.array("given_name", "short_form")).alias("n")).where("n is not null").select(F.pandas_udf(lambda n: n.map(personal.name_part), "string")("n").alias("part"))
    rows = table(spark, d, "bronze_documents").selectExpr("'bronze' src", "cast(ord as string) row_key", "content")
    rows = rows.unionByName(table(spark, d, "personal_memories").selectExpr("'memory' src", "id row_key", "content"))
    return personal.find_personal(rows, "content", personal.gazetteer(people, "name"), given, _key(spark))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = _personal(spark, d).select("src", "row_key", F.explode("found").alias("f"))
    return found.select("src", "row_key", "f.kind", F.regexp_replace(F.lower("f.value"), r"[^\p{L}\p{Nd}]", "").alias("value_key")).distinct()


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).selectExpr("src", "row_key", "masked content", "coalesce(size(found), 0) n_found")


def _places(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).selectExpr("doc doc_id", "item item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("n_docs"), F.round(F.max("share"), 4).alias("largest_share"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    from memspark.operators.work import Work

    places = Work(spark, "leaks").cut(_places(spark, d), "places")
    return leakage.without_passages(table(spark, d, "documents"), "doc_id", "text", places).withColumnRenamed("doc", "doc_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("key", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].withColumn("actual_share", F.round("actual_share", 4))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text").selectExpr("a doc_a", "b doc_b")


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return visual.canonical_text(table(spark, d, "documents"), "doc_id", "text").selectExpr("key doc_id", "canonical text", "sha2(canonical, 256) <> raw changed")


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p5_found, p5_pieces, p6_found, p6_masked, p7_found, p7_items, p7_clean, p8_selection, p8_shares, p9_found, p9_canonical)}

ORACLE = {
    "p5_found": r"""with u as (select ord, regexp_replace(content, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') as whole, string_split_regex(content, '\n[\s\p{Z}\x{85}]*\n') as parts from bronze_documents where content is not null),
b as (select ord, whole, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), lambda p: p <> '') as blocks from u),
x as (select ord, 0 as block_no, whole as unit from b union all select ord, unnest(range(1, len(blocks) + 1)), unnest(blocks) from b)
select ord, cast(block_no as bigint) as block_no from x where length(unit) > 1800""",
}
