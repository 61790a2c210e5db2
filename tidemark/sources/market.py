"""Market data as long tables: one row per series and time, whatever the number of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def contract_name(symbol: str) -> str:
    """File-name form of a futures symbol: `ES` and `ES.c.0` both give `ES_c_0`."""
    symbol = symbol.strip()
    if not symbol:
        raise ValueError("the symbol is empty")
    return symbol.replace(".", "_") if "." in symbol or "_c_" in symbol else f"{symbol}_c_0"


def bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Intraday bars of a table with symbol and ts, from start (kept) to end (not kept), vendor columns pruned.

    Both limits and the symbols are predicates that reach the Parquet scan; a table laid out by symbol prunes its folders.
    """
    df = require_columns(spark.read.parquet(path), "symbol", "ts", "close")
    if symbols is not None:
        if not symbols:
            raise ValueError("no symbols are asked for")
        df = df.where(F.col("symbol").isin(symbols))
    df = df.where(F.col("ts") >= F.lit(start).cast(df.schema["ts"].dataType)) if start else df
    df = df.where(F.col("ts") < F.lit(end).cast(df.schema["ts"].dataType)) if end else df
    return df.select("symbol", "ts", *(c for c in BAR_COLUMNS if c in df.columns))


def futures_bars(spark: SparkSession, folder: str, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One-minute bars of `{symbol}_ohlcv-1m_*.parquet` in a folder: the first of several files in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{contract_name(symbol)}_ohlcv-1m_*.parquet").load(folder).select("path")
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no file for {symbol} in {folder}")
    df = spark.read.parquet(first)
    df = df.withColumnRenamed("ts_event", "ts") if "ts_event" in df.columns else df
    df = df.where(F.col("ts") >= F.lit(start).cast(df.schema["ts"].dataType)) if start else df
    df = df.where(F.col("ts") < F.lit(end).cast(df.schema["ts"].dataType)) if end else df
    return df.select(F.lit(contract_name(symbol)).alias("symbol"), "ts", *(c for c in BAR_COLUMNS if c in df.columns))


def daily_prices(spark: SparkSession, path: str, tickers: list[str], start: str, end: str) -> DataFrame:
    """Daily rows (symbol, dt, ...) of several tickers in one scan."""
    if not tickers:
        raise ValueError("no tickers are asked for")
    df = require_columns(spark.read.parquet(path), "symbol", "dt")
    return df.where(F.col("symbol").isin(tickers) & (F.col("dt") >= F.lit(start).cast("date")) & (F.col("dt") < F.lit(end).cast("date")))


def close_series(prices: DataFrame) -> DataFrame:
    """prices with a `close` column of doubles: Close, else Adj Close, whatever the case of the name."""
    by_name = {c.lower().replace(" ", "_"): c for c in prices.columns}
    name = by_name.get("close") or by_name.get("adj_close")
    if name is None:
        raise ValueError("there is neither a Close nor an Adj Close column")
    return prices.withColumn("close", F.col(f"`{name}`").cast("double"))


def ticks(spark: SparkSession, sf_dir: str, symbol: Column | str = "event_type") -> DataFrame:
    """symbol, ts, event_id, price, size from the events table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    return events.select(symbol.alias("symbol"), "ts", "event_id", (1000 + F.col("value")).alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, dt, close: the mean order price of each priority and day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.avg("o_totalprice").alias("close"))


def report(rows: DataFrame, path: str) -> None:
    """Writes a report table as JSON lines."""
    rows.write.mode("overwrite").json(path)
