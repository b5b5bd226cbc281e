from palimpsest.streaming.changes import StateTable, capture


def test_changes_of_arriving_manifests(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "path string, blob_hash string, version long"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], schema).coalesce(1).write.parquet(source)
    run = lambda: capture(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("a", "2", 3), ("b", None, 3), ("c", "9", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    table = StateTable(spark, str(tmp_path / "out"))
    assert sorted((r.batch, r.path, r.change) for r in table.changes().collect()) == [(0, "a", "insert"), (0, "b", "insert"), (1, "b", "delete"), (1, "c", "insert")]
    assert {(r.path, r.blob_hash) for r in table.at(1).collect()} == {("a", "2"), ("c", "9")}
