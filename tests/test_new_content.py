"""Content that was seen at any time is dropped, after a restart too."""

from quillspark.streaming import streams as S

SCHEMA = "doc_id long, text string, ts timestamp, batch string"


def test_content_seen_at_any_time_is_dropped(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def feed(checkpoint, *rows):
        made = spark.createDataFrame([(i, t, None, "x") for i, t, _ in rows], SCHEMA)
        days = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, day string")
        made.drop("ts").join(days, "doc_id").selectExpr("doc_id", "text", "cast(day as timestamp) as ts", "batch").coalesce(1).write.mode("append").parquet(source)
        S.new_content(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r.doc_id for r in S.seen_rows(spark, path, schema).collect())

    assert feed("c1", (1, "a", "2020-01-02"), (2, "a", "2020-01-01"), (3, "b", "2020-01-01"), (4, None, "2020-01-01"), (5, "", None)) == [2, 3, 5]
    # A year later, in a new run of the same checkpoint.
    assert feed("c1", (6, "a", "2021-06-01"), (7, "c", "2021-06-01")) == [2, 3, 5, 7]
    # A new checkpoint reads everything again and adds nothing but what is new.
    assert feed("c2", (8, "c", "2022-01-01"), (9, "d", "2022-01-01")) == [2, 3, 5, 7, 9]


def test_a_batch_that_is_done_again_adds_nothing(spark, tmp_path):
    import shutil

    source, path, check = str(tmp_path / "in"), str(tmp_path / "state"), tmp_path / "c"
    spark.createDataFrame([(i, f"text {i % 3}", None, "x") for i in range(9)], SCHEMA).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    run = lambda: S.new_content(spark.readStream.schema(schema).parquet(source), path, str(check)).awaitTermination()
    run()
    before = sorted(r.text for r in S.seen_rows(spark, path, schema).collect())
    shutil.rmtree(check)  # as if the driver had died before the batch was told to be done
    run()
    assert sorted(r.text for r in S.seen_rows(spark, path, schema).collect()) == before == ["text 0", "text 1", "text 2"]
