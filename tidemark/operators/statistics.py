"""Time-series statistics as aggregates and windows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prep import by_time

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
#: Bars in a trading year of 252 days of 390 minutes, by frequency.
BARS_PER_YEAR = {"1min": 252 * 390, "5min": 252 * 78, "15min": 252 * 26, "30min": 252 * 13, "1h": 252 * 7, "1D": 252}


def moments(df: DataFrame, value: str = "ret", key: str = "symbol") -> DataFrame:
    """Mean, population deviation, skewness and excess kurtosis; the last two are 0 for a constant series."""
    x = F.col(value)
    flat = F.stddev_pop(x) == 0
    return df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"))


def sample_moments(df: DataFrame, value: str = "ret", key: str = "symbol") -> DataFrame:
    """Deviation with n - 1, and bias-corrected skewness and excess kurtosis."""
    x, n = F.col(value), F.count(value).cast("double")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return df.groupBy(key).agg(F.stddev_samp(x).alias("std"), skew.alias("skew"), kurtosis.alias("kurtosis"))


def percentiles(df: DataFrame, value: str = "ret", key: str = "symbol", approximate: bool = False) -> DataFrame:
    """Percentiles with linear interpolation; the approximate form bounds memory on series of any length."""
    points = F.array(*(F.lit(p / 100) for p in PERCENTILES))
    found = F.percentile_approx(value, points, 10_000) if approximate else F.percentile(value, points)
    return df.groupBy(key).agg(found.alias("p")).select(key, *(F.element_at("p", k + 1).alias(f"p{p:02d}") for k, p in enumerate(PERCENTILES)))


#: Size of quantile sketches; a quantile's rank is off by at most about 2.3 / K^0.9 of all rows, in 99 of 100 cases.
SKETCH = 800


def rank_error(k: int = SKETCH) -> float:
    return 2.3 / k**0.9


def quantile_sketches(df: DataFrame, *by: str, value: str = "ret", k: int = SKETCH) -> DataFrame:
    """(by, sketch): a mergeable quantile sketch of each group, some kilobytes whatever the group's size, that can be kept as a column."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str, k: int = SKETCH) -> DataFrame:
    """(by, sketch): sketches of parts merged into those of their wholes, without their rows."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame) -> DataFrame:
    """sketches with n and the columns of percentiles(), each a value of the data whose rank is near."""
    points = F.array(*(F.lit(p / 100) for p in PERCENTILES))
    named = sketches.withColumn("n", F.kll_sketch_get_n_double("sketch")).withColumn("__p", F.kll_sketch_get_quantile_double("sketch", points))
    return named.select(*(c for c in sketches.columns if c != "sketch"), "n", *(F.element_at("__p", k + 1).alias(f"p{p:02d}") for k, p in enumerate(PERCENTILES)))


def extremes(df: DataFrame, at: str, value: str = "ret", key: str = "symbol") -> DataFrame:
    """When the least and the largest values came; the first of equal ones."""
    r = F.col(value)
    return df.groupBy(key).agg(F.min_by(at, F.struct(r, at)).alias("worst_at"), F.min(r).alias("worst"), F.min_by(at, F.struct(-r, F.col(at))).alias("best_at"), F.max(r).alias("best"))


def histogram(df: DataFrame, value: str = "ret", bins: int = 50, key: str = "symbol") -> DataFrame:
    """Counts and densities in equal bins from the least to the largest value of each series."""
    low, high, n = (f(value).over(Window.partitionBy(key)) for f in (F.min, F.max, F.count))
    placed = df.select(key, F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin"), ((high - low) / bins).alias("width"), n.alias("n"))
    return placed.groupBy(key, "bin").agg(F.count("*").alias("count"), (F.count("*") / F.max("n") / F.max("width")).alias("density"))


def acf(df: DataFrame, max_lag: int, value: str = "ret", key: str = "symbol") -> DataFrame:
    """Biased autocorrelation at lags 0 to max_lag, all from one sort; zeros where the variance is under 1e-15."""
    whole = Window.partitionBy(key)
    centered = df.select(key, "seq", (F.col(value) - F.avg(value).over(whole)).alias("x"))
    lagged = centered.select(key, "x", *(F.lag("x", k).over(by_time(key)).alias(f"l{k}") for k in range(1, max_lag + 1)))
    sums = lagged.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s0"), *(F.sum(F.col("x") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)))
    rows = sums.select(key, "n", F.posexplode(F.array(*(F.coalesce(f"s{k}", F.lit(0.0)) for k in range(max_lag + 1)))).alias("lag", "s"), "s0")
    return rows.select(key, "n", "lag", F.when(F.col("s0") / F.col("n") < 1e-15, 0.0).otherwise(F.try_divide("s", "s0")).alias("acf"))


def _folded(n: Column | int, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """first taken through step(so far, k) for k from 1 to n, as one expression."""
    return F.aggregate(F.sequence(F.lit(1), n if isinstance(n, Column) else F.lit(n)), first, step)


def erfc(z: Column) -> Column:
    """Complementary error function of numbers from 0: by a series of positive terms under 2, by a continued fraction beyond."""
    square = z * z
    sums = _folded(60, F.struct(z.alias("term"), z.alias("sum")), lambda a, k: F.struct((a["term"] * 2 * square / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * 2 * square / (2 * k + 1)).alias("sum")))
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-square) * sums["sum"]
    tail = _folded(80, z, lambda a, k: z + (81 - k) / 2 / a)
    return F.when(z < 2, near).otherwise(F.exp(-square) / math.sqrt(math.pi) / tail)


def chi2_tail(q: Column, df: int) -> Column:
    """Probability that a chi-square variable exceeds q: a finite sum, with the error function where the degrees are odd."""
    if df < 1:
        raise ValueError("there must be a degree of freedom")
    half = q / 2
    if df % 2 == 0:
        return F.exp(-half) * sum((F.pow(half, F.lit(float(j))) / float(math.factorial(j)) for j in range(df // 2)), F.lit(0.0))
    terms = sum((F.pow(half, F.lit(j + 0.5)) / math.gamma(j + 1.5) for j in range(df // 2)), F.lit(0.0))
    return erfc(F.sqrt(half)) + F.exp(-half) * terms


def ljung_box(df: DataFrame, lags: int = 30, value: str = "ret", key: str = "symbol") -> DataFrame:
    n = F.col("n")
    terms = acf(df, lags, value, key).where("lag > 0 AND lag < n").groupBy(key, "n").agg(F.sum(F.col("acf") ** 2 / (n - F.col("lag"))).alias("s"))
    q = terms.select(key, (n * (n + 2) * F.col("s")).alias("q"))
    return q.withColumn("p_value", chi2_tail(F.col("q"), lags))


def block_sums(df: DataFrame, size: int, value: str = "ret", key: str = "symbol", within: str | None = None) -> DataFrame:
    """Sums of consecutive blocks of `size` rows; a rest at the end of a series (or of each `within`) is left out."""
    keys = [key, within] if within else [key]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    blocks = df.withColumn("block", F.floor((place - 1) / size)).groupBy(*keys, "block").agg(F.sum(value).alias(value), F.count("*").alias("n"))
    return blocks.where(F.col("n") == size).drop("n")


def variance_ratio(df: DataFrame, q: int, value: str = "ret", key: str = "symbol") -> DataFrame:
    """Variance of q-row sums over q times that of single rows, both with n - 1; 1 for a flat series, null with under two blocks."""
    one = df.groupBy(key).agg(F.var_samp(value).alias("v1"))
    many = block_sums(df, q, value, key).groupBy(key).agg(F.var_samp(value).alias("vq"), F.count("*").alias("blocks"))
    ratio = F.when(F.col("v1") < 1e-15, 1.0).when(F.col("blocks") >= 2, F.col("vq") / (q * F.col("v1")))
    return one.join(many, key, "left").select(key, ratio.alias("variance_ratio"))


def sums_at(df: DataFrame, sizes: dict[str, int], within: str, value: str = "ret", key: str = "symbol") -> DataFrame:
    """(series, seq, ret): sums of consecutive blocks of each size inside each `within`, all sizes as rows of one table; series is
    (key, freq). Size 0 takes a `within` whole; others leave out a rest at its end."""
    place = F.row_number().over(Window.partitionBy(key, within).orderBy("seq"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("freq"), F.lit(n).alias("size")) for f, n in sizes.items()))).alias("f")
    rows = df.select(key, within, value, place.alias("place")).select(key, within, value, "place", each).select(key, within, value, "f.*", F.when(F.col("f.size") > 0, F.floor((F.col("place") - 1) / F.greatest("f.size", F.lit(1)))).otherwise(0).alias("block"))
    blocks = rows.groupBy(key, "freq", "size", within, "block").agg(F.sum(value).alias("ret"), F.count("*").alias("n")).where("size = 0 OR n = size")
    series = F.struct(F.col(key), F.col("freq"))
    return blocks.select(series.alias("series"), F.row_number().over(Window.partitionBy(key, "freq").orderBy(within, "block")).alias("seq"), "ret")


def variance_ratios(df: DataFrame, horizons: tuple[int, ...], value: str = "ret", key: str = "symbol") -> DataFrame:
    """(key, horizon, variance_ratio) as variance_ratio() gives for each horizon, all of them as rows of one table."""
    one = df.groupBy(key).agg(F.var_samp(value).alias("v1"))
    rows = df.select(key, "seq", value, F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    blocks = rows.groupBy(key, "horizon", F.floor((F.col("seq") - 1) / F.col("horizon")).alias("block")).agg(F.sum(value).alias("b"), F.count("*").alias("n")).where("n = horizon")
    many = blocks.groupBy(key, "horizon").agg(F.var_samp("b").alias("vq"), F.count("*").alias("blocks"))
    every = one.select(key, "v1", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).join(many, [key, "horizon"], "left")
    ratio = F.when(F.col("v1") < 1e-15, 1.0).when(F.col("blocks") >= 2, F.col("vq") / (F.col("horizon") * F.col("v1")))
    return every.select(key, "horizon", ratio.alias("variance_ratio"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; null where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def seasonality(df: DataFrame, value: str = "ret", ts: str = "ts", at_least: int = 10, key: str = "symbol") -> DataFrame:
    """Mean absolute and mean value of each minute of the UTC day that has more than at_least rows. peaks() names the ends."""
    minute = (F.hour(ts) * 60 + F.minute(ts)).alias("minute")
    return df.groupBy(key, minute).agg(F.avg(F.abs(value)).alias("mean_abs"), F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") > at_least)


def peaks(season: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, peak, trough): minutes of the largest and the least mean absolute value, the earliest of equal ones."""
    return season.groupBy(key).agg(F.max_by("minute", F.struct("mean_abs", -F.col("minute"))).alias("peak"), F.min_by("minute", F.struct("mean_abs", "minute")).alias("trough"))


def snr(df: DataFrame, freq: str, value: str = "ret", key: str = "symbol") -> DataFrame:
    """|mean| over deviation, and the deviation of a year."""
    deviation = F.stddev_pop(value)
    return df.groupBy(key).agg(F.try_divide(F.abs(F.avg(value)), deviation).alias("snr"), (deviation * F.sqrt(F.lit(float(BARS_PER_YEAR[freq])))).alias("annual_vol"))


def langevin_moments(df: DataFrame, dt: float = 1.0, value: str = "ret", key: str = "symbol", level: str | None = None) -> DataFrame:
    """Starting values of a jump-diffusion by moments: plain aggregates in one pass over a sorted series.

    The first autocorrelation gives theta, the deviation sigma and sigma_obs, the excess kurtosis the jumps. With level (the
    price that scales raw changes) scale factors of sigma, sigma_obs and sigma_J come too.
    """
    if dt <= 0:
        raise ValueError("dt must be positive")
    x = F.col(value) - F.avg(value).over(Window.partitionBy(key))
    rows = df.select(key, "seq", x.alias("x"), *([F.col(level).alias("level")] if level else []))
    rows = rows.withColumn("before", F.lag("x").over(by_time(key)))
    price = [F.min_by("level", "seq").alias("level")] if level else []
    a = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("x") ** 2).alias("m2"), F.avg(F.pow("x", F.lit(4.0))).alias("m4"), (F.sum(F.col("x") * F.col("before")) / F.count("*")).alias("c1"), *price).where("n >= 3")
    phi = F.least(F.col("c1") / F.col("m2"), F.lit(1 - 1e-9))
    a = a.withColumn("std", F.greatest(F.sqrt("m2"), F.lit(1e-10)))
    a = a.withColumn("theta", F.least(F.when((F.col("m2") > 0) & (F.col("c1") / F.col("m2") > 0), F.log(phi) / dt).otherwise(-0.5 / dt), F.lit(-0.01 / dt)))
    a = a.withColumn("k", F.col("m4") / F.pow("std", F.lit(4.0)) - 3)
    a = a.withColumn("lambda_J", F.when(F.col("k") > 0, F.least(F.col("k") / (3 * dt), F.lit(10 / dt))).otherwise(0.0))
    jump = F.sqrt(F.least(F.col("k") / (F.col("k") + 3), F.lit(0.5)) * F.col("std") ** 2 / (F.col("lambda_J") * dt))
    out = {"theta": F.col("theta"), "sigma": F.col("std") * F.sqrt(2 * F.abs("theta")), "sigma_obs": 0.1 * F.col("std"), "lambda_J": F.col("lambda_J"), "mu_J": F.lit(0.0), "sigma_J": F.when(F.col("lambda_J") > 0, jump).otherwise(0.0)}
    if level:
        out |= {f"sf_{k}": out[k] / F.col("level") for k in ("sigma", "sigma_obs", "sigma_J")}
    return a.select(key, *(c.alias(k) for k, c in out.items()))


def filter_diagnostics(df: DataFrame, estimate: str, deviation: str, truth: str, key: str = "symbol") -> DataFrame:
    """Root mean square error, shares of truths within two deviations and outside them, and moments of the residuals."""
    residual = F.col(truth) - F.col(estimate)
    scaled = F.abs(residual / F.col(deviation))
    return df.groupBy(key).agg(F.sqrt(F.avg(residual**2)).alias("rmse"), F.avg((scaled <= 2).cast("double")).alias("within_2"), F.avg((scaled > 2).cast("double")).alias("outside_2"), F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"))
