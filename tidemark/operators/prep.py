"""Preparation of series: order, sessions, bars, returns, splits and alignment. All of it is plain Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ("09:30", "16:00")
FREQUENCIES = {"5min": "5 minutes", "15min": "15 minutes", "30min": "30 minutes", "1h": "1 hour", "1D": "1 day"}


def by_time(key: str = "symbol", *order: str):
    return Window.partitionBy(key).orderBy(*(order or ("seq",)))


def sequenced(df: DataFrame, *order: str, key: str = "symbol") -> DataFrame:
    """df with seq, from 1 in each series, in the order of the columns given."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def log_returns(prices: DataFrame, price: str = "price", key: str = "symbol", checked: bool = False) -> DataFrame:
    """prices with ret = ln(p_t / p_t-1), without each series' first row; seq starts at 1 again.

    checked: rows whose price is not positive end the query with an error.
    """
    p = F.col(price)
    ok = F.when(p > 0, p).otherwise(F.raise_error(F.lit("prices must be positive"))) if checked else p
    previous = F.lag(p).over(by_time(key))
    return prices.withColumn("ret", F.log(ok / previous)).where(F.col("seq") > 1).withColumn("seq", F.col("seq") - 1)


def simple_returns(prices: DataFrame, price: str = "price", key: str = "symbol") -> DataFrame:
    previous = F.lag(price).over(by_time(key))
    return prices.withColumn("ret", F.col(price) / previous - 1).where(F.col("seq") > 1).withColumn("seq", F.col("seq") - 1)


def eastern(ts: Column) -> Column:
    """Wall-clock time in New York of a UTC time, with daylight saving."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts.cast("timestamp_ntz"))


def filter_rth(bars: DataFrame, ts: str = "ts", session: tuple[str, str] = SESSION) -> DataFrame:
    """Rows in the regular session: Monday to Friday, from its opening to before its close, in New York."""
    local = eastern(F.col(ts))
    minute = F.hour(local) * 60 + F.minute(local)
    low, high = (int(t[:2]) * 60 + int(t[3:]) for t in session)
    return bars.where((F.weekday(local) < 5) & (minute >= low) & (minute < high))


def resample_bars(bars: DataFrame, freq: str, key: str = "symbol", ts: str = "ts", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Tumbling bars, left-closed and labelled by their beginning, aligned to UTC midnight; buckets without close go.

    First and last values skip nulls. Works on batch and, with a watermark, on streaming tables.
    """
    if freq not in FREQUENCIES:
        raise ValueError(f"freq must be one of {', '.join(FREQUENCIES)}")
    at = F.struct(*order)
    aggregates = {
        "open": lambda c: F.min_by(c, F.when(c.isNotNull(), at)), "high": F.max, "low": F.min,
        "close": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "volume": F.sum,
    }
    present = [c for c in aggregates if c in bars.columns]
    if not present:
        raise ValueError("there is no bar column")
    out = bars.groupBy(key, F.window(ts, FREQUENCIES[freq]).alias("w")).agg(*(aggregates[c](F.col(c)).alias(c) for c in present))
    out = out.select(key, F.col("w.start").alias(ts), *present)
    return out.where("close IS NOT NULL") if "close" in present else out


def train_test_split(df: DataFrame, fraction: float, key: str = "symbol") -> DataFrame:
    """df with is_train: the first floor(n * fraction) rows of each series."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("is_train", F.col("seq") <= F.floor(n * F.lit(fraction)))


def tail_slice(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The last n rows of each series."""
    return df.withColumn("__n", F.max("seq").over(Window.partitionBy(key))).where(F.col("seq") > F.col("__n") - n).drop("__n")


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null or NaN in the columns, all of them by default."""
    return df.na.drop(subset=list(columns) or None)


def min_history(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """Series with at least n rows."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= n).drop("__n")


def survivors(df: DataFrame, score: str, fallback: int = 5, *ties: str) -> DataFrame:
    """Rows with a positive score; where there is none, the best few. A row for each candidate, so a small table."""
    flagged = df.withColumn("__any", F.max(F.col(score) > 0).over(Window.partitionBy(F.lit(1))))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(score), *ties))
    return flagged.withColumn("__rank", rank).where((F.col(score) > 0) | (~F.coalesce("__any", F.lit(False)) & (F.col("__rank") <= fallback))).drop("__any", "__rank")


def subsample(df: DataFrame, step: int) -> DataFrame:
    """Every step-th row of each series, the first included."""
    return df.where((F.col("seq") - 1) % step == 0)


def inner_align(df: DataFrame, symbols: list[str], on: str = "dt", key: str = "symbol") -> DataFrame:
    """Rows of the symbols at times that all of them have: a count for each time in place of n - 1 joins."""
    rows = df.where(F.col(key).isin(symbols))
    n = F.count("*").over(Window.partitionBy(on))
    return rows.withColumn("__n", n).where(F.col("__n") == len(symbols)).drop("__n")


def align_from_end(df: DataFrame, value: str, pad: float, key: str = "symbol") -> DataFrame:
    """Series of unequal length aligned at their ends: back counts from the last row, and values before a start are pad.

    Rows of the result are those that it must have, a series times the longest. ended_means() gives means without them.
    """
    back = df.select(key, (F.max("seq").over(Window.partitionBy(key)) - F.col("seq")).alias("back"), value)
    spans = back.groupBy(key).agg(F.max("back").alias("last"))
    longest = spans.agg(F.max("last").alias("longest"))
    missing = spans.join(F.broadcast(longest), F.col("last") < F.col("longest")).select(key, F.explode(F.sequence(F.col("last") + 1, F.col("longest"))).alias("back"))
    return back.withColumn(value, F.coalesce(value, F.lit(pad).cast(df.schema[value].dataType))).unionByName(missing.withColumn(value, F.lit(pad).cast(df.schema[value].dataType)))


def ended_means(df: DataFrame, value: str, pad: float, key: str = "symbol") -> DataFrame:
    """(back, mean): mean over all series at each place from the end, those that had not begun counted as pad; no pads are made."""
    back = df.select((F.max("seq").over(Window.partitionBy(key)) - F.col("seq")).alias("back"), value)
    series = df.select(key).distinct().agg(F.count("*").alias("series"))
    sums = back.groupBy("back").agg(F.sum(F.coalesce(value, F.lit(float(pad)))).alias("sum"), F.count("*").alias("n"))
    return sums.join(F.broadcast(series), F.lit(True)).select("back", ((F.col("sum") + F.lit(float(pad)) * (F.col("series") - F.col("n"))) / F.col("series")).alias("mean"))
