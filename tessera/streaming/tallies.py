"""Streaming tallies, windows and states over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import tally, tally_statistics
from ..store import shared_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events under a path as a stream, with ``ts`` as a zoned timestamp, which watermarks need."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream watches a folder
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def running_tally(stream: DataFrame, by: list[str], score: str, weight: str, about: float = 0.0) -> DataFrame:
    """The weighted tally of a stream so far: mergeable sums as state, statistics on top.  The sums count from ``about``; scores far from 0 need a point near them, or digits are lost."""
    return tally_statistics(tally(stream, by, score, weight, about))


def tumbling(stream: DataFrame, by: list[str], width: str, late: str, x: str = "value") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.avg(x).alias("mean")).select(F.col("window.start").alias("start"), *by, "n", "mean")


def sliding(stream: DataFrame, by: list[str], width: str, step: str, late: str, x: str = "value") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by).agg(F.count("*").alias("n"), F.max(x).alias("max")).select(F.col("window.start").alias("start"), *by, "n", "max")


def session_windows(stream: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def distinct_events(stream: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _transitions(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
    out = []
    for kind in rows["event_type"]:
        if last is not None:
            out.append((key[0], last, kind))
        last = kind
    state.update((last,))
    yield pd.DataFrame(out, columns=["user_id", "before", "after"])


def transitions(stream: DataFrame) -> DataFrame:
    """user_id, before, after of successive events of each user; the state is the user's last event type.  Events that arrive late count in the order of arrival."""
    return stream.groupBy("user_id").applyInPandasWithState(_transitions, "user_id long, before string, after string", "last string", "append", "NoTimeout")


def onset_windows(onsets: DataFrame, samples: DataFrame, by: list[str], before: str, after: str, late: str) -> DataFrame:
    """by, onset_id, onset, event_id, ts and value: each sample of ``samples`` beside the onsets of ``onsets`` from ``before`` it to ``after`` it, both streams of events.

    An interval join with watermarks on both sides: an onset leaves the state
    when no sample can fall into its window any more, and a sample when no onset
    can, so the state holds what the windows and ``late`` span, not the streams.
    """
    o = onsets.withWatermark("ts", late).select(*[F.col(c).alias(f"_o_{c}") for c in by], F.col("event_id").alias("onset_id"), F.col("ts").alias("onset"))
    s = samples.withWatermark("ts", late).select(*by, "event_id", "ts", "value")
    on = F.expr(f"ts >= onset - INTERVAL {before} AND ts <= onset + INTERVAL {after}")
    for c in by:
        on &= F.col(c) == F.col(f"_o_{c}")
    return o.join(s, on).select(*by, "onset_id", "onset", "event_id", "ts", "value")


def expiring_transitions(stream: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """user_id, before, after and at of successive events of a user that are at most ``gap_seconds`` apart; where a longer pause follows, ``after`` is null and ``at`` the last event's time.

    A timer in event time closes a user's visit once the watermark passes its
    last event by the gap: the end is emitted and the state goes, so what is
    kept are the users seen lately.  Events behind their user's last one count for nothing.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            out.append((key[0], last, None, at))
            state.remove()
        else:
            rows = pd.concat(list(pdfs)).sort_values(["us", "event_id"])
            for us, kind in zip(rows["us"].tolist(), rows["event_type"], strict=True):
                if last is not None and us < at:
                    continue
                if last is not None:
                    out.append((key[0], last, kind, us) if us - at <= gap_seconds * 1_000_000 else (key[0], last, None, at))
                last, at = kind, us
            state.update((last, at))
            # one beyond the watermark at least, or the timer would be refused
            state.setTimeoutTimestamp(max(at // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": [r[0] for r in out], "before": [r[1] for r in out], "after": [r[2] for r in out], "at": [r[3] for r in out]})

    d = stream.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return d.groupBy("user_id").applyInPandasWithState(step, "user_id long, before string, after string, at long", "last string, at long", "append", "EventTimeTimeout")


def collected(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there now into a table of the shared folder and returns it (a complete result replaces the table)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{spark.sparkContext.applicationId}-{abs(hash((name, id(stream))))}"
    sink = lambda df, epoch: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/table")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
