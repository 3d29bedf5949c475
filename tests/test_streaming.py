"""Streams judged in event time against the batch operators."""

import random

from pyspark.sql import functions as F

from attestra.operators import limits
from attestra.streaming.limiter import ordered_attempt_stream


def test_late_and_backfilled_rows_get_the_verdicts_of_a_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], 1_000_000
    for i in range(240):
        t += rng.choice([0, 1, 500, 4_000, 40_000])
        rows.append((i, i % 2, t))
    # Rows come up to 60 seconds late, in seven files; the last file moves the watermark past all.
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(60_000))
    source = str(tmp_path / "in")
    schema = "event_id bigint, k bigint, ts_ms bigint"
    for start in range(0, len(arrival), 40):
        spark.createDataFrame(arrival[start : start + 40], schema).coalesce(1).write.mode("append").parquet(source)
    late = [(1000 + n, 9, rows[-1][2] + 10_000_000 * n) for n in (1, 2)]
    for row in late:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = ordered_attempt_stream(stream, "k", window_ms=60_000, limit=3, lateness="5 minutes")
    query = (out.writeStream.format("memory").queryName("ordered").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    got = {tuple(r) for r in spark.table("ordered").filter("k < 9").collect()}
    frame = spark.createDataFrame(rows, schema)
    batch = limits.attempt_windows(frame, "k", 60_000, 3, ("event_id",))
    want = {tuple(r) for r in batch.select("k", "event_id", "ts_ms", "window_start_ms", "attempt", "allowed").collect()}
    assert got == want
    assert spark.table("ordered").select(F.count("*")).first()[0] >= len(rows)
