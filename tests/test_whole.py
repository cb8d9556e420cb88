"""Jobs done whole over the domain tables."""

from memspark.plans import memory_queries


def test_connector_diff_all(spark, tmp_path):
    rows = [("c", "x", 2, "a", "1"), ("c", "x", 2, "b", "1"), ("c", "x", 5, "a ", "2"), ("c", "x", 5, "b", "1"), ("c", "x", 6, "b", "1"), ("c", "x", 6, "d", None), ("c", "y", 1, "a", "1")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "corpus_id string, connector string, snapshot_no int, source_id string, content_hash string, loaded_at int")
    df.write.parquet(str(tmp_path / "connector_snapshots.parquet"))
    got = {tuple(r) for r in memory_queries.connector_diff_all(spark, str(tmp_path)).collect()}
    assert got == {("c", "x", 5, "a", "changed"), ("c", "x", 6, "a", "removed"), ("c", "x", 6, "d", "added")}
    assert memory_queries.QUERIES["connector_diff_all"] and "connector_diff_all" in memory_queries.ORACLE
