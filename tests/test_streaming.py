from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.streaming import states as S


def _batches(spark, tmp_path, batches):
    for k, b in enumerate(batches):
        rows = [(e, f"2024-01-01 00:{m:02}:00", s) for e, m, s in b]
        spark.createDataFrame(rows, "entity string, t string, state string").select("entity", F.col("t").cast("timestamp").alias("t"), "state").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    return spark.readStream.schema("entity string, t timestamp, state string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_stream_transitions_match_batch(spark, tmp_path):
    # the last batch only moves the watermark on
    stream = _batches(spark, tmp_path, [[("a", 0, "A"), ("a", 2, "B"), ("a", 1, "A")], [("a", 3, "B"), ("a", 4, "A"), ("a", 5, "B")], [("z", 50, "A")], [("z", 58, "A")]])
    query = S.transitions(stream, 2, delay="1 minute").writeStream.format("memory").queryName("moves").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    found = [(r["entity"], r["t"].minute, r["from_state"], r["to_state"]) for r in spark.sql("SELECT * FROM moves").collect()]
    assert found == [("a", 3, "A", "B")]


def test_results_are_appended_once(spark, tmp_path):
    stream = _batches(spark, tmp_path, [[("a", 0, "A")], [("a", 1, "B")]])
    for _ in range(2):
        S.append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
