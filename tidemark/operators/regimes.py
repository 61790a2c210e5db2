"""Regimes (a state for each row), comparisons of series, and searches over parameters and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import gram
from tidemark.operators.prep import by_time


def state_runs(df: DataFrame, state: str = "state", key: str = "symbol") -> DataFrame:
    """(key, state, run, length): maximal runs of equal states, the open one at the end included."""
    changed = (F.col(state) != F.lag(state).over(by_time(key))).cast("long")
    run = F.sum(F.coalesce("__c", F.lit(0))).over(by_time(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__c", changed).withColumn("run", run).groupBy(key, F.col(state).alias("state"), "run").agg(F.count("*").alias("length"))


def average_durations(df: DataFrame, state: str = "state", key: str = "symbol") -> DataFrame:
    return state_runs(df, state, key).groupBy(key, "state").agg(F.avg("length").alias("duration"))


def transition_counts(df: DataFrame, state: str = "state", key: str = "symbol") -> DataFrame:
    changed = (F.col(state) != F.lag(state).over(by_time(key))).cast("long")
    return df.withColumn("__c", changed).groupBy(key).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("transitions"))


def state_stats(df: DataFrame, k: int, state: str = "state", value: str = "ret", key: str = "symbol") -> DataFrame:
    """Rows, share, mean and population deviation of every state from 0 to k - 1; zeros for those that no row has."""
    own = df.groupBy(key, F.col(state).alias("state")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("vol"))
    every = df.groupBy(key).agg(F.count("*").alias("total")).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    joined = every.join(own.withColumn("state", F.col("state").cast("int")), [key, "state"], "left")
    return joined.select(key, "state", F.coalesce("n", F.lit(0)).alias("n"), (100 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("pct"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("vol", F.lit(0.0)).alias("vol"))


def crosstab(df: DataFrame, a: str, b: str, b_values: list[int], key: str = "symbol") -> DataFrame:
    return df.groupBy(key, F.col(a).alias("row")).pivot(b, b_values).count().na.fill(0).select(key, "row", *(F.col(str(v)).alias(f"col_{v}") for v in b_values))


def agreement_matrix(df: DataFrame, on: str, state: str = "state", key: str = "symbol") -> DataFrame:
    return gram.agreements(df, on, state, key)


def correlation_matrix(df: DataFrame, on: str, value: str, key: str = "symbol") -> DataFrame:
    return gram.correlations(df, on, value, key)


def _near(df: DataFrame, other: DataFrame, window: int, key: str, how: str) -> DataFrame:
    """Semi or anti join on |seq - seq| <= window, as an equi-join on every seq in reach: no nested loop."""
    reach = other.select(key, F.explode(F.sequence(F.col("seq") - window, F.col("seq") + window)).alias("seq")).distinct()
    return df.join(reach, [key, "seq"], how)


def jump_hits(true: DataFrame, found: DataFrame, window: int = 2, key: str = "symbol") -> DataFrame:
    """True jumps that have a detection near."""
    return _near(true, found, window, key, "left_semi")


def jump_false_positives(true: DataFrame, found: DataFrame, window: int = 2, key: str = "symbol") -> DataFrame:
    """Detections that have no true jump near."""
    return _near(found, true, window, key, "left_anti")


def parameter_grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """Every combination of parameter values with grid_idx, in the order of nested loops. Its size is known before."""
    df = None
    for name, options in values.items():
        column = spark.range(1).select(F.posexplode(F.array(*(F.lit(float(v)) for v in options))).alias(f"__{name}", name))
        df = column if df is None else df.crossJoin(column)
    order = F.row_number().over(Window.orderBy(*(f"__{n}" for n in values))) - 1
    return df.select(order.alias("grid_idx"), *values)


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the best scores; nulls and NaN come last, equal scores in the order of ties."""
    return df.orderBy(F.desc_nulls_last(F.nanvl(F.col(score), F.lit(None).cast("double"))), *ties).limit(k)


def best_by(df: DataFrame, score: str, idx: str, key: str) -> DataFrame:
    """The row of each key with the best score, the first by idx of equal ones."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(F.nanvl(F.col(score), F.lit(None).cast("double"))), idx))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def expanding_windows(df: DataFrame, at: str, initial_months: int, step_months: int, key: str = "symbol") -> DataFrame:
    """df once for each window that it falls in, with window_id, test_start and part ('train' or 'test').

    Training runs from a series' start to test_start, testing from there for step_months. Windows begin as long as data
    lie behind; how many there are follows from the dates alone, so each row meets a sequence and no join is needed.
    """
    w = Window.partitionBy(key)
    bounds = df.withColumn("__first", F.min(at).over(w)).withColumn("__last", F.max(at).over(w))
    first = F.add_months(F.col("__first"), F.lit(initial_months))
    starts = F.when(first <= F.col("__last"), F.sequence(first, F.col("__last"), F.expr(f"INTERVAL {step_months} MONTH")))
    rows = bounds.select(*df.columns, F.posexplode(starts).alias("window_id", "test_start"))
    rows = rows.where(F.col(at) < F.add_months("test_start", F.lit(step_months)))
    return rows.withColumn("part", F.when(F.col(at) < F.col("test_start"), "train").otherwise("test"))


def window_summary(rows: DataFrame) -> DataFrame:
    """Of rows with sharpe, benchmark_sharpe, max_drawdown, benchmark_drawdown: win rate and mean differences."""
    gain, relief = F.col("sharpe") - F.col("benchmark_sharpe"), F.col("benchmark_drawdown") - F.col("max_drawdown")
    return rows.agg(F.avg((gain > 0).cast("double")).alias("win_rate"), F.avg(gain).alias("mean_gain"), F.avg(relief).alias("mean_relief"), F.count_if(relief > 0).alias("relieved"))


def n_parameters(k: Column) -> Column:
    """Free parameters of a Gaussian hidden Markov model of k states."""
    return k * (k - 1) + 2 * k + (k - 1)


def aic(ll: Column, k: Column) -> Column:
    return -2 * ll + 2 * n_parameters(k)


def bic(ll: Column, k: Column, n: Column) -> Column:
    return -2 * ll + n_parameters(k) * F.log(n)
