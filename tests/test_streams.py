"""Streams over several micro-batches equal the batch, and their state shrinks."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import tallies as X


@pytest.fixture()
def source(spark, tmp_path):
    base = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(i, base + timedelta(minutes=11 * i), 99 if i % 50 == 7 else i // 45 * 10 + i % 2, "abc"[i % 3], float(i)) for i in range(300)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k in range(6):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), spark.createDataFrame(rows, schema), schema


def run(spark, df, tmp_path):
    """The rows, and the rows of state after each batch."""
    q = df.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect(), held


def test_onset_windows_equal_the_batch_join(spark, source, tmp_path):
    path, batch, schema = source
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    d = X.onset_windows(stream().where("event_type = 'a'"), stream(), ["user_id"], "30 MINUTES", "1 HOUR", "1 HOUR")
    got, held = run(spark, d, tmp_path)
    o = batch.where("event_type = 'a'").select(F.col("user_id").alias("u"), F.col("event_id").alias("onset_id"), F.col("ts").alias("onset"))
    want = o.join(batch, F.expr("u = user_id AND ts >= onset - INTERVAL 30 MINUTES AND ts <= onset + INTERVAL 1 HOUR")).collect()
    assert sorted((r.onset_id, r.event_id, r.value) for r in got) == sorted((r.onset_id, r.event_id, r.value) for r in want)
    assert len(held) >= 6 and max(held) < 250  # of 400 rows that came in on both sides


def test_visits_end_by_timer(spark, source, tmp_path):
    path, batch, schema = source
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, held = run(spark, X.expiring_transitions(stream, 3600, "10 minutes"), tmp_path)
    want, last = [], {}
    for r in sorted(batch.withColumn("us", F.unix_micros("ts")).collect(), key=lambda r: r.ts):
        if r.user_id in last:
            kind, at = last[r.user_id]
            want.append((r.user_id, kind, r.event_type, r.us) if r.us - at <= 3_600_000_000 else (r.user_id, kind, None, at))
        last[r.user_id] = (r.event_type, r.us)
    key = lambda t: tuple(str(v) for v in t)
    rows = [tuple(r) for r in got]
    end = max(at for _, at in last.values())
    open_ends = {(u, k, None, at) for u, (k, at) in last.items()}
    assert sorted((r for r in rows if r not in open_ends), key=key) == sorted(want, key=key)
    ended = [r for r in rows if r in open_ends]
    assert ended and all(r[3] < end - 3_600_000_000 for r in ended)  # closed by the timer alone
    assert held[-1] == len(last) - len(ended)
