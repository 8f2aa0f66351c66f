"""Streams give what the batch does."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.streaming import wal


def test_stream_dedupe_and_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, i % 5, f"2024-01-01 00:{i % 50:02d}:00") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, user long, t string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    wal.run_to_table(wal.dedupe_stream(stream, ["user"], "t", "2 hours"), "deduped", checkpoint=str(tmp_path / "c1"))
    assert spark.table("deduped").count() == 5
    wal.run_to_table(wal.windowed_counts(stream, "t", "1 hour", "10 minutes", "user"), "counted", "complete", str(tmp_path / "c2"))
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 100


def test_log_lines(spark, tmp_path):
    p = tmp_path / "wal.jsonl"
    p.write_text('{"seq":1,"timestamp":"a","type":"phase:start","phase":"x"}\n\n{"seq":2,"timestamp":"b","type":"odd"}\n{"seq":3,"timestamp":"c","type":"phase:fail","phase":"x"}\n')
    lines = wal.read_lines(spark, str(p))
    assert [r["line_no"] for r in lines.collect()] == [1, 3, 4]
    kept = wal.valid_prefix(lines).collect()
    assert [r["seq"] for r in kept] == [1] and kept[0]["corrupted"]
