"""Growth and doubling-time statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- Student's t


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + k / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t):
        return float("nan")
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(x), float(n)) if n > 0 else float("nan") for x, n in zip(t, df)])


def critical_t(level: float):
    """Arrow function of the degrees of freedom: the two-sided critical value of a confidence level."""

    @F.pandas_udf(T.DoubleType())
    def critical(df: pd.Series) -> pd.Series:
        known = {n: t_quantile(0.5 + level / 2, n) if n > 0 else float("nan") for n in {float(x) for x in df}}
        return df.astype(float).map(known)

    return critical


# ---------------------------------------------------------------- growth

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": lambda _: F.count("*")}


def aggregate(df: DataFrame, time: str = "time", value: str = "area", agg: str = "sum", by: Sequence[str] = ()) -> DataFrame:
    """by, t, y: one value per time; rows without a time take no part, and values that are NaN only in a count, which counts rows."""
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    t, v = F.col(time).cast("double"), F.col(value).cast("double")
    clean = df.filter(t.isNotNull() & ~F.isnan(t)).withColumn("_v", F.when(~F.isnan(v), v))
    out = AGGREGATES[agg]("_v").cast("double")
    return clean.groupBy(*by, t.alias("t")).agg((F.coalesce(out, F.lit(0.0)) if agg == "sum" else out).alias("y"))


def moments(points: DataFrame, by: Sequence[str] = (), min_times: int = 2) -> DataFrame:
    """The log-linear fit's slope, intercept, R2, standard error; fails on too few times or values that aren't positive and finite."""
    bad = (F.col("y") <= 0) | F.isnan("y") | F.col("y").isNull() | (F.abs(F.col("y")) == float("inf"))
    ln = F.when(bad, F.raise_error(F.lit("growth needs finite values above 0")).cast("double")).otherwise(F.ln("y"))
    rows = points.select(*by, F.col("t"), ln.alias("z"))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    sums = grouped.agg(
        F.count("*").alias("n"),
        F.regr_slope("z", "t").alias("slope"),
        F.regr_intercept("z", "t").alias("intercept"),
        F.regr_sxx("z", "t").alias("sxx"),
        F.regr_syy("z", "t").alias("syy"),
        F.regr_sxy("z", "t").alias("sxy"),
    )
    few = F.lit(f"growth needs at least {min_times} time points")
    return sums.withColumn("n", F.when(F.col("n") < min_times, F.raise_error(few).cast("bigint")).otherwise(F.col("n")))


def standard_error() -> Column:
    """Of the slope; NaN with two points."""
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))).otherwise(F.lit(float("nan")))


def growth_rate(
    df: DataFrame, time: str = "time", value: str = "area", agg: str = "sum", by: Sequence[str] = (), ci_level: float = 0.95, inference: bool = True
) -> DataFrame:
    """growth_rate, std_err, ci_low, ci_high, doubling_time, initial_value, r_squared, p_value per group.

    Ordinary least squares of ln(y) on t. Two points give NaN errors, interval and p; a rate that
    isn't positive gives NaN doubling time; constant y gives NaN R2.
    """
    m = moments(aggregate(df, time, value, agg, by), by).withColumn("std_err", standard_error())
    nan = F.lit(float("nan"))
    out = m.select(
        *by,
        "n",
        F.col("slope").alias("growth_rate"),
        "std_err",
        F.when(F.col("slope") > 0, F.lit(math.log(2)) / F.col("slope")).otherwise(nan).alias("doubling_time"),
        F.exp("intercept").alias("initial_value"),
        F.when(F.col("syy") == 0, nan).otherwise(F.col("sxy") * F.col("sxy") / F.col("sxx") / F.nullif(F.col("syy"), F.lit(0.0))).alias("r_squared"),
    )
    if not inference:
        return out
    half = F.coalesce(critical_t(ci_level)(F.col("n") - 2), nan) * F.col("std_err")  # Arrow hands NaN back as NULL
    t = F.when(F.col("std_err") > 0, F.col("growth_rate") / F.nullif(F.col("std_err"), F.lit(0.0)))
    t = F.when(F.isnan("std_err"), nan).when(F.col("std_err") == 0, F.lit(float("inf"))).otherwise(t)
    return out.withColumns(
        {"ci_low": F.col("growth_rate") - half, "ci_high": F.col("growth_rate") + half, "p_value": F.coalesce(p_value(t, F.col("n") - 2), nan)}
    )


def extract_growth(detections: DataFrame, ctx, agg: str = "sum", time_unit: str = "hour", by: Sequence[str] = ()) -> DataFrame:
    """Frame, time and area of the detections, then the growth rate per time unit."""
    from celltide.operators import properties as P

    table = P.extract(detections, [P.TimeEx(output_unit=time_unit), P.AreaEx(), P.FrameEx()], ctx)
    return growth_rate(table, "time", "area", agg, by)


# ---------------------------------------------------------------- doubling times over time


def alive_at(intervals: DataFrame, grid: DataFrame, min_n: int = 1, value: str = "doubling_time", bucket: float | None = None) -> DataFrame:
    """t, n, mean over the intervals alive at each grid time (start <= t <= end); NULL mean below `min_n`.

    With `bucket`, intervals and grid meet through time buckets instead of a range join.
    """
    if bucket is None:
        met = grid.join(intervals, (F.col("start_time") <= F.col("t")) & (F.col("t") <= F.col("end_time")))
    else:
        spans = intervals.withColumn(
            "_b", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket)))
        )
        met = grid.withColumn("_b", F.floor(F.col("t") / bucket)).join(spans, "_b")
        met = met.filter("start_time <= t and t <= end_time")
    found = met.groupBy("t").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return grid.select("t").distinct().join(found, "t", "left").select(
        "t", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= min_n, F.col("mean")).alias("mean")
    )


def hose_bands(
    intervals: DataFrame, grid: DataFrame, ci_levels: Sequence[float] = (0.5, 0.95), min_n: int = 5, n_bootstrap: int = 1000, seed: int = 0, value: str = "doubling_time"
) -> DataFrame:
    """t, n, mean and per level (level, lo, hi): percentile bootstrap of the mean of what is alive at t; NaN below `min_n`.

    The resamples of a grid time are seeded by the seed and the time, so tasks are independent.
    """
    if n_bootstrap < 1 or min_n < 1:
        raise ValueError("n_bootstrap and min_n must be at least 1")
    levels = list(dict.fromkeys(ci_levels))
    if any(not 0 < p < 1 for p in levels):
        raise ValueError("confidence levels lie between 0 and 1")
    met = grid.select("t").distinct().join(intervals, (F.col("start_time") <= F.col("t")) & (F.col("t") <= F.col("end_time")))
    schema = "t double, n bigint, mean double, bands array<struct<level: double, lo: double, hi: double>>"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        t, v = float(group["t"].iloc[0]), np.sort(group[value].to_numpy(float))
        if len(v) < min_n:
            return pd.DataFrame({"t": [t], "n": [len(v)], "mean": [float("nan")], "bands": [[(p, float("nan"), float("nan")) for p in levels]]})
        rng = np.random.default_rng([seed, abs(hash(t)) % (1 << 32)])
        means = np.array([rng.choice(v, size=len(v)).mean() for _ in range(n_bootstrap)])
        bands = [(p, *np.percentile(means, [(1 - p) / 2 * 100, (1 + p) / 2 * 100])) for p in levels]
        return pd.DataFrame({"t": [t], "n": [len(v)], "mean": [v.mean()], "bands": [bands]})

    done = met.groupBy("t").applyInPandas(one, schema).withColumn("mean", F.coalesce("mean", F.lit(float("nan"))))
    return grid.select("t").distinct().join(done, "t", "left")
