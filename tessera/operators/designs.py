"""Methods of protocols, design matrices and fitted models as transformations of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import drawn, good
from .windows import beside, joined_groups

# --- protocols: (run, condition, onset, offset) ---


def condition_names(events: DataFrame, condition: str) -> DataFrame:
    """The conditions, each once, and how many events they have."""
    return events.groupBy(condition).agg(F.count("*").alias("n_events"))


def add_condition(events: DataFrame, more: DataFrame, condition: str, name: str) -> DataFrame:
    """The events with those of a further condition; a name that is there already gets the new events, too."""
    return events.unionByName(more.withColumn(condition, F.lit(name)).select(*events.columns))


def to_milliseconds(events: DataFrame, onset: str, offset: str, tr: float) -> DataFrame:
    """Volume numbers (from 1, both ends included) as times in units of ``tr``."""
    return events.withColumn(onset, (F.col(onset) - 1) * tr).withColumn(offset, F.col(offset) * tr)


def set_duration(events: DataFrame, onset: str, offset: str, duration: float, chosen: Column | None = None) -> DataFrame:
    """Events (those of ``chosen``) that last ``duration``."""
    new = F.col(onset) + duration
    return events.withColumn(offset, new if chosen is None else F.when(chosen, new).otherwise(F.col(offset)))


def shift_onsets(events: DataFrame, onset: str, offset: str, by: float, chosen: Column | None = None) -> DataFrame:
    """Events (those of ``chosen``) moved by a time; no onset becomes negative."""
    step = F.greatest(F.lit(float(by)), -F.col(onset))
    step = step if chosen is None else F.when(chosen, step).otherwise(F.lit(0.0))
    return events.withColumn("_step", step).withColumn(onset, F.col(onset) + F.col("_step")).withColumn(offset, F.col(offset) + F.col("_step")).drop("_step")


def remodel_gaps(events: DataFrame, by: list[str], onset: str, offset: str, gap: Column) -> DataFrame:
    """The gaps between an event's end and the next one's onset replaced by ``gap`` (a function of the old one, the column ``gap``): every event moves by the sum of the changes before it."""
    w = Window.partitionBy(*by).orderBy(onset, offset)
    d = events.withColumn("gap", F.col(onset) - F.lag(offset).over(w))
    d = d.withColumn("_moved", F.coalesce(F.sum(gap - F.col("gap")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return d.withColumn(onset, F.col(onset) + F.col("_moved")).withColumn(offset, F.col(offset) + F.col("_moved")).drop("gap", "_moved")


def single_trials(events: DataFrame, by: list[str], condition: str, onset: str, width: int = 3) -> DataFrame:
    """Every event as a condition of its own, named by its condition and its number in time within it."""
    n = F.row_number().over(Window.partitionBy(*by, condition).orderBy(onset))
    return events.withColumn(condition, F.concat(F.col(condition), F.lit("_T"), F.lpad(n.cast("string"), width, "0")))


def shuffle_labels(events: DataFrame, by: list[str], condition: str, key: str, seed: int = 1) -> DataFrame:
    """The conditions of a run dealt anew over its events: the label of the i-th key goes to the i-th of the keys in hashed order, so a rerun gives the same."""
    place = events.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    dealt = events.select(*by, F.col(condition).alias("_label"), F.row_number().over(Window.partitionBy(*by).orderBy(drawn(key, seed), key)).alias("_i"))
    return place.join(dealt, [*by, "_i"]).withColumn(condition, F.col("_label")).select(*events.columns)


# --- design matrices: (run, t, predictor columns) ---


def add_cosines(design: DataFrame, by: list[str], t: str, n: int, name: str = "filter") -> DataFrame:
    """The first ``n`` discrete cosines over each run's length as further predictors; t counts from 1."""
    d = beside(design, by, _n=F.max(t))
    for k in range(1, n + 1):
        d = d.withColumn(f"{name}_{k}", F.cos(F.lit(3.141592653589793) * k * (2 * F.col(t) - 1) / (2 * F.col("_n"))))
    return d.drop("_n")


def add_interaction(design: DataFrame, by: list[str], course: str, condition: str, out: str = "ppi") -> DataFrame:
    """A psychophysiological interaction: the condition's regressor times the region's course in deviations of its run."""
    d = beside(design, by, _m=F.avg(course), _s=F.stddev_samp(course))
    return d.withColumn(out, F.coalesce(F.col(condition) * F.try_divide(F.col(course) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def regress_out(df: DataFrame, by: list[str], x: str, nuisance: str, out: str = "cleaned") -> DataFrame:
    """A series without what a nuisance regressor explains; its mean stays."""
    d = beside(df, by, _b=F.regr_slope(x, nuisance), _m=F.avg(nuisance))
    return d.withColumn(out, F.col(x) - F.coalesce("_b", F.lit(0.0)) * (F.col(nuisance) - F.col("_m"))).drop("_b", "_m")


def global_course(samples: DataFrame, by: list[str], t: str, x: str) -> DataFrame:
    """The mean over all voxels at each time, and its change in percent of the run's mean."""
    g = samples.groupBy(*by, t).agg(F.avg(good(x)).alias("mean"))
    d = beside(g, by, _m=F.avg("mean"))
    return d.withColumn("psc", F.coalesce(F.try_divide(100 * F.col("mean"), F.col("_m")), F.lit(0.0))).drop("_m")


def course_correlation(samples: DataFrame, by: list[str], t: str, x: str, regressor: DataFrame, y: str) -> DataFrame:
    """by, r, t and df: every series with one regressor over time, which is one row a time."""
    j = samples.join(regressor.select(t, F.col(y).alias("_y")), t)
    s = j.groupBy(*by).agg(F.corr(F.col(x), F.col("_y")).alias("r"), F.count("*").alias("n"))
    r = F.col("r")
    return s.select(*by, "r", F.try_divide(r * F.sqrt(F.col("n") - 2), F.sqrt(1 - r * r)).alias("t"), (F.col("n") - 2).alias("df"))


def cross_correlation(a: DataFrame, b: DataFrame, by: list[str], t: str, x: str) -> DataFrame:
    """by, r and n of two datasets' series of one place."""
    j = a.select(*by, t, F.col(x).alias("_a")).join(b.select(*by, t, F.col(x).alias("_b")), [*by, t])
    return j.groupBy(*by).agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))


def average_peak(averages: DataFrame, by: list[str], t: str, x: str, low: float, high: float) -> DataFrame:
    """The largest value of an average course within a stretch of time, and when: the first of equals."""
    d = averages.where(F.col(t).between(low, high))
    return d.groupBy(*by).agg(F.max(x).alias("peak"), F.min_by(t, F.struct(-F.col(x), F.col(t))).alias("time_to_peak"))


def combine_conditions(averages: DataFrame, by: list[str], x: str, sd: str, n: str) -> DataFrame:
    """Averages of several conditions as one: pooled mean, sd and number of trials."""
    total = F.sum(n)
    mean = F.try_divide(F.sum(F.col(x) * F.col(n)), total)
    d = joined_groups(averages, averages.groupBy(*by).agg(mean.alias("_m")), by)
    away = F.col(x) - F.col("_m")
    ss = F.sum(F.coalesce(F.col(sd), F.lit(0.0)) * F.col(sd) * (F.col(n) - 1)) + F.sum(F.col(n) * away * away)
    return d.groupBy(*by).agg(F.first("_m").alias("mean"), F.sqrt(F.try_divide(ss, F.sum(n) - 1)).alias("sd"), F.sum(n).alias("n"))


def retest_reliability(df: DataFrame, subject: str, by: list[str], first: Column, x: str) -> DataFrame:
    """by, r and n: the subjects' means of the first session against those of the second."""
    s = df.groupBy(*by, subject).agg(F.avg(F.when(first, F.col(x))).alias("a"), F.avg(F.when(~first, F.col(x))).alias("b")).where("a is not null and b is not null")
    return s.groupBy(*by).agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))


# --- fitted models: (subject, predictor, voxel, beta) ---


def contrast_maps(betas: DataFrame, by: list[str], predictor: str, beta: str, weights: dict[str, float]) -> DataFrame:
    """by and the weighted sum of the predictors' betas; a place that lacks one of them gets none."""
    w = F.create_map(*[F.lit(v) for k, x in weights.items() for v in (k, float(x))])
    s = betas.where(F.col(predictor).isin(*weights)).groupBy(*by).agg(F.sum(F.try_element_at(w, F.col(predictor)) * F.col(beta)).alias("contrast"), F.count_distinct(predictor).alias("_n"))
    return s.where(F.col("_n") == len(weights)).drop("_n")


def region_betas(betas: DataFrame, members: DataFrame, voxel: list[str], keys: list[str], beta: str) -> DataFrame:
    """keys and the mean beta of a region's voxels with a good value, and their number."""
    j = betas.join(members, voxel)
    return j.groupBy(*keys).agg(F.coalesce(F.avg(good(beta)), F.lit(0.0)).alias("beta"), F.count(good(beta)).alias("n_voxels"))


def second_level_correlation(maps: DataFrame, by: list[str], subject: str, x: str, covariate: DataFrame, y: str, ranks: bool = False) -> DataFrame:
    """by, r, t and df of a contrast with a covariate of the subjects, by mean ranks if ``ranks``."""
    j = maps.join(covariate.select(subject, F.col(y).alias("_y")), subject).where(good(x).isNotNull() & good("_y").isNotNull()).withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col("_y").cast("double"))
    if ranks:
        from .windows import rank_transform

        j = rank_transform(rank_transform(j, by, "_x", out="_rx"), by, "_y", out="_ry").withColumn("_x", F.col("_rx")).withColumn("_y", F.col("_ry"))
    s = j.groupBy(*by).agg(F.corr("_x", "_y").alias("r"), F.count("*").alias("n"))
    r = F.col("r")
    return s.select(*by, "r", F.coalesce(good(F.try_divide(r * F.sqrt(F.col("n") - 2), F.sqrt(1 - r * r))), F.lit(0.0)).alias("t"), (F.col("n") - 2).alias("df"))


def region_condition_correlations(betas: DataFrame, subject: str, voxel: list[str], predictor: str, beta: str) -> DataFrame:
    """subject, a, b and r over a region's voxels for every two predictors, of which a model has few."""
    a = betas.select(subject, *voxel, F.col(predictor).alias("a"), F.col(beta).alias("_a"))
    b = betas.select(subject, *voxel, F.col(predictor).alias("b"), F.col(beta).alias("_b"))
    return a.join(b, [subject, *voxel]).where("a < b").groupBy(subject, "a", "b").agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n"))


def join_models(a: DataFrame, b: DataFrame, subject: str) -> DataFrame:
    """The subjects of two models; a subject of both keeps its rows of the first."""
    return a.unionByName(b.join(a.select(subject).distinct(), subject, "left_anti").select(*a.columns))


def replace_subjects(a: DataFrame, b: DataFrame, subject: str) -> DataFrame:
    """The first model with the rows of its subjects that the second has, too, taken from there."""
    both = b.join(a.select(subject).distinct(), subject, "left_semi")
    return a.join(b.select(subject).distinct(), subject, "left_anti").select(*a.columns).unionByName(both.select(*a.columns))


def without_predictors(betas: DataFrame, predictor: str, names: list[str]) -> DataFrame:
    return betas.where(~F.col(predictor).isin(*names))


def without_subjects(betas: DataFrame, subject: str, names: list) -> DataFrame:
    return betas.where(~F.col(subject).isin(*names))


def subject_predictors(betas: DataFrame, subject: str, predictor: str) -> DataFrame:
    """Each subject with its predictors in order, and how many there are."""
    return betas.groupBy(subject).agg(F.array_sort(F.collect_set(predictor)).alias("predictors")).withColumn("n", F.size("predictors"))


def reorder_predictors(betas: DataFrame, predictor: str, order: list[str], out: str = "place") -> DataFrame:
    """Rows with their predictor's place in a stated order (from 1); those that it doesn't name follow by name."""
    known = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(predictor))
    rest = betas.select(predictor).distinct().where(~F.col(predictor).isin(*order))
    rest = rest.withColumn("_r", F.row_number().over(Window.orderBy(predictor)))  # predictors are few
    d = betas.join(F.broadcast(rest), predictor, "left")
    return d.withColumn(out, F.when(known > 0, known).otherwise(F.col("_r") + len(order)).cast("int")).drop("_r")


# --- single cases and rank correlations ---


def case_difference(x: Column, y: Column, mx: Column, my: Column, sx: Column, sy: Column, r: Column, n: Column) -> Column:
    """t of the difference between a case's two standardised scores, against controls."""
    r = F.least(F.greatest(r, F.lit(-0.99999)), F.lit(0.99999))
    return F.try_divide(F.try_divide(x - mx, sx) - F.try_divide(y - my, sy), F.sqrt((2 - 2 * r) * F.try_divide(n + 1, n)))


def case_dissociation(x: Column, y: Column, mx: Column, my: Column, sx: Column, sy: Column, r: Column, n: Column) -> Column:
    """t of the dissociation of a case's two scores, with the sign of their standardised difference."""
    r = F.least(F.greatest(r, F.lit(-0.99999)), F.lit(0.99999))
    d = F.try_divide(x - mx, sx) - F.try_divide(y - my, sy)
    a = (1 + r) * (1 - r * r)
    b = (1 - r) * (4 * (n - 1) * (n - 1) + 4 * (1 + r) * (n - 1) + (1 + r) * (5 + r))
    c = -2 * d * d * F.try_divide(n * (n - 1) * (n - 1), n + 1)
    return F.when(d < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest((F.sqrt(b * b - 4 * a * c) - b) / (2 * a), F.lit(0.0)))


def lag_to_kernel(r: Column, tr: float = 1.0, n: int | None = None) -> Column:
    """The width of the smoothing kernel that gives a lag-1 correlation; negative ones count as 0."""
    r = F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))
    scale = tr * 2.3548200450309493 * (n / (n - 1) if n else 1.0)
    return F.when(r > 0, scale * F.sqrt(F.try_divide(F.lit(-1.0), 4 * F.log(r)))).otherwise(F.lit(0.0))


def kernel_to_lags(width: Column, lags: int, n: int | None = None) -> Column:
    """The first ``lags`` lag correlations that a smoothing kernel of that width gives."""
    part = (n - 1) / n if n else 1.0
    k = 1.1774100225154747  # sqrt(2 log 2)
    return F.array(*[F.exp(-1 / ((part * width / i / k) * (part * width / i / k))) for i in range(1, lags + 1)])
