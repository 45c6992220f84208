from panelspark.streaming.ingest import arriving, ingest_new_files


def test_each_file_is_ingested_once(spark, tmp_path):
    raw, out, memory = (str(tmp_path / x) for x in ("raw", "out", "memory"))
    first = spark.createDataFrame([("2020-01-02", 1.0), ("bad", 2.0)], "DATE string, RET double")
    first.write.parquet(raw)
    for more in ([], [("20210105", 3.0)]):
        if more:
            spark.createDataFrame(more, first.schema).write.mode("append").parquet(raw)
        ingest_new_files(arriving(spark, first.schema, raw, "DATE"), out, memory).awaitTermination()
    assert sorted((r.year, r.RET) for r in spark.read.parquet(out).collect()) == [(2020, 1.0), (2021, 3.0)]
