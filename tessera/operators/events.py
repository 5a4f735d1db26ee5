"""Event protocols: intervals of conditions, their algebra, and event-locked averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import interval_join


def event_average(samples: DataFrame, events: DataFrame, on: list[str], condition: str, t: str, x: str, onset: str, before: float, after: float, step: float, base: tuple[float, float]) -> DataFrame:
    """condition, bin, mean, sd, se and number of trials of a sample stream around events, less each trial's baseline mean."""
    same = Window.partitionBy(*events.columns).orderBy(onset)  # equal events are trials of their own
    e = events.withColumn("_trial", F.xxhash64(*events.columns, F.row_number().over(same))).select(*on, condition, F.col(onset).alias("_onset"), "_trial")
    j = interval_join(samples.select(*on, F.col(t).alias("_t"), F.col(x).alias("_x")), "_t", e, "_onset", before, after, on)
    rel = F.col("_t") - F.col("_onset")
    j = j.withColumn("bin", F.floor(rel / step).cast("int"))
    w = Window.partitionBy("_trial")
    j = j.withColumn("_b", F.avg(F.when((rel >= base[0]) & (rel < base[1]), F.col("_x"))).over(w)).where("_b is not null")
    trial = j.groupBy("_trial", condition, "bin").agg(F.avg(F.col("_x") - F.col("_b")).alias("v"))
    out = trial.groupBy(condition, "bin").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    return out.withColumn("se", F.col("sd") / F.sqrt("n"))


def event_counts(samples: DataFrame, events: DataFrame, on: list[str], condition: str, t: str, x: str, onset: str, before: float, after: float, step: float) -> DataFrame:
    """condition, bin, n and mean of the samples around events, without a baseline."""
    e = events.select(*on, condition, F.col(onset).alias("_onset"))
    j = interval_join(samples.select(*on, F.col(t).alias("_t"), F.col(x).alias("_x")), "_t", e, "_onset", before, after, on)
    return j.groupBy(condition, F.floor((F.col("_t") - F.col("_onset")) / step).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """Intervals that overlap or lie within ``gap`` as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    last = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", (last.isNull() | (F.col(start) > last + gap)).cast("int"))
    d = d.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def collapse_conditions(df: DataFrame, condition: str, mapping: dict[str, str]) -> DataFrame:
    """Conditions renamed, so that several become one."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(condition, F.coalesce(F.try_element_at(m, F.col(condition)), F.col(condition)))


def inter_event_intervals(df: DataFrame, by: list[str], t: str) -> DataFrame:
    """Number, mean and least time between successive events."""
    w = Window.partitionBy(*by).orderBy(t)
    d = df.select(*by, (F.col(t) - F.lag(t).over(w)).alias("d")).where("d is not null")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_interval"), F.min("d").alias("least_interval"))


def box_design(events: DataFrame, by: list[str], condition: str, onset: str, offset: str, step: float) -> DataFrame:
    """by, condition, t and the share of each step that an event covers: a design column for every condition."""
    t = F.explode(F.sequence(F.floor(F.col(onset) / step), F.floor((F.col(offset) - 1e-9) / step)))
    d = events.where(F.col(offset) > F.col(onset)).withColumn("t", t)
    cover = (F.least(F.col(offset), (F.col("t") + 1) * step) - F.greatest(F.col(onset), F.col("t") * step)) / step
    return d.groupBy(*by, condition, "t").agg(F.least(F.sum(cover), F.lit(1.0)).alias("value"))


def convolve(df: DataFrame, by: list[str], t: str, x: str, kernel: list[float]) -> DataFrame:
    """by, t, value: a series convolved with a kernel by spreading every sample; gaps in the series are zeros."""
    k = F.posexplode(F.array(*[F.lit(float(w)) for w in kernel]))
    d = df.select(*by, F.col(t).alias("_t"), F.col(x).alias("_x"), k.alias("_d", "_w"))
    return d.groupBy(*by, (F.col("_t") + F.col("_d")).alias(t)).agg(F.sum(F.col("_x") * F.col("_w")).alias(x))


def gamma_response(step: float, length: float = 32.0, peak: float = 6.0, under: float = 16.0, ratio: float = 6.0) -> list[float]:
    """The two-gamma response sampled every ``step`` seconds, scaled to a sum of 1."""
    import math

    out = []
    for i in range(int(length / step) + 1):
        t = i * step
        a = t ** (peak - 1) * math.exp(-t) / math.gamma(peak) if t > 0 else 0.0
        b = t ** (under - 1) * math.exp(-t) / math.gamma(under) if t > 0 else 0.0
        out.append(a - b / ratio)
    total = sum(out)
    return [v / total for v in out]


def sessions(df: DataFrame, by: list[str], t: str, gap: float) -> DataFrame:
    """by, session, first, last and n: runs of events no farther apart than ``gap``."""
    w = Window.partitionBy(*by).orderBy(t)
    d = df.withColumn("_new", F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0)))
    d = d.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "session").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))
