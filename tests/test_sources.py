"""Readers of market files and the report sink."""

import datetime

import pytest

from tidemark.sources import market as M


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(datetime.datetime(2024, 3, day, 15, minute), 10.0 + minute, 11.0, 9.0, 10.5 + day, 5, "vendor") for day in (1, 2, 3) for minute in range(3)]
    df = spark.createDataFrame(rows, "ts_event timestamp, open double, high double, low double, close double, volume long, rtype string")
    df.coalesce(1).write.parquet(str(tmp_path / "AB_c_0_ohlcv-1m_2024.parquet"))
    df.limit(1).coalesce(1).write.parquet(str(tmp_path / "AB_c_0_ohlcv-1m_2025.parquet"))
    df.selectExpr("'AB' AS symbol", "ts_event AS ts", "*").drop("ts_event").unionByName(df.selectExpr("'XY' AS symbol", "ts_event AS ts", "*").drop("ts_event")).write.partitionBy("symbol").parquet(str(tmp_path / "bars"))
    daily = [(s, datetime.date(2024, 1, d), float(d), float(d) / 2) for s in ("AB", "XY", "ZZ") for d in (3, 1, 2)]
    spark.createDataFrame(daily, "symbol string, dt date, `Adj Close` double, other double").write.parquet(str(tmp_path / "daily"))
    return str(tmp_path)


def test_bars_keep_the_start_and_not_the_end(spark, folder):
    df = M.bars(spark, f"{folder}/bars", ["AB"], "2024-03-02", "2024-03-03")
    assert df.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    assert {(r.symbol, r.ts.day) for r in df.collect()} == {("AB", 2)} and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(ts" in plan and "rtype" not in plan
    with pytest.raises(ValueError):
        M.bars(spark, f"{folder}/bars", [])


def test_daily_prices_of_several_tickers(spark, folder):
    df = M.close_series(M.daily_prices(spark, f"{folder}/daily", ["AB", "ZZ"], "2024-01-02", "2024-01-04"))
    assert sorted((r.symbol, r.dt.day, r.close) for r in df.collect()) == [("AB", 2, 2.0), ("AB", 3, 3.0), ("ZZ", 2, 2.0), ("ZZ", 3, 3.0)]
    with pytest.raises(ValueError):
        M.daily_prices(spark, f"{folder}/daily", [], "2024-01-02", "2024-01-04")
    with pytest.raises(ValueError):
        M.close_series(df.select("symbol"))


def test_reports_come_back(spark, folder):
    M.report(spark.createDataFrame([("sharpe", 1.5)], "name string, value double"), f"{folder}/report")
    M.report(spark.createDataFrame([("sharpe", 2.5)], "name string, value double"), f"{folder}/report")
    assert [tuple(r) for r in spark.read.schema("name string, value double").json(f"{folder}/report").collect()] == [("sharpe", 2.5)]


def test_columns_that_are_missing_are_named(spark, folder):
    with pytest.raises(ValueError, match="symbol"):
        M.bars(spark, f"{folder}/AB_c_0_ohlcv-1m_2024.parquet")


@pytest.fixture
def vendor(spark, tmp_path):
    """Files of three contracts: one as a folder of parts, one with a second file, one without a volume and without a zone."""
    from tidemark.sources.vendor import register

    register(spark)
    at = lambda d, m: datetime.datetime(2024, 3, d, 15, m, tzinfo=datetime.timezone.utc)
    columns = "ts_event timestamp, open double, high double, low double, close double, volume long, rtype string"
    rows = [(at(d, m), 10.0 + m, 11.0, 9.0, 10.5 + d, 5, "vendor") for d in (1, 2, 3) for m in range(3)]
    spark.createDataFrame(rows, columns).repartition(2).write.parquet(str(tmp_path / "AB_c_0_ohlcv-1m_2024.parquet"))
    spark.createDataFrame(rows[:4], columns).coalesce(1).write.parquet(str(tmp_path / "AB_c_0_ohlcv-1m_2025.parquet"))
    spark.createDataFrame(rows[:5], columns).coalesce(1).write.parquet(str(tmp_path / "XY_c_0_ohlcv-1m_2024.parquet"))
    spark.createDataFrame(rows, columns).selectExpr("CAST(ts_event AS timestamp_ntz) AS ts_event", "close", "CAST(open AS float) AS open").coalesce(1).write.parquet(str(tmp_path / "ZZ_c_0_ohlcv-1m_2024.parquet"))
    (tmp_path / "notes.txt").write_text("not a file of bars")
    return str(tmp_path)


def test_vendor_files_are_a_data_source(spark, vendor):
    load = lambda **o: spark.read.format("vendor_bars").options(**o).load(vendor)
    df = load()
    assert df.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"] and df.rdd.getNumPartitions() == 4
    assert {r.symbol: r["count"] for r in df.groupBy("symbol").count().collect()} == {"AB_c_0": 9, "XY_c_0": 5, "ZZ_c_0": 9}
    assert {(r.ts.day, r.close) for r in load(symbols="AB, XY.c.0", start="2024-03-02", end="2024-03-03").collect()} == {(2, 12.5)}
    assert df.where("symbol = 'ZZ_c_0' AND volume IS NULL AND high IS NULL").count() == 9
    with pytest.raises(Exception, match="no file for QQ_c_0"):
        load(symbols="QQ").collect()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("vendor_bars").load().collect()


def test_filters_and_columns_reach_the_vendor_files(spark, vendor):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan
    from pyspark.sql.types import StructType

    from tidemark.sources.vendor import BatchReader

    narrow = StructType.fromDDL("close double, ts timestamp")
    reader = BatchReader(narrow, {"path": vendor})
    limits = [datetime.datetime(2024, 3, d, tzinfo=datetime.timezone.utc) for d in (2, 3)]
    pushed = [EqualTo(("symbol",), "AB_c_0"), GreaterThanOrEqual(("ts",), limits[0]), LessThan(("ts",), limits[1]), EqualTo(("close",), 12.5)]
    assert list(reader.pushFilters(pushed)) == pushed
    parts = reader.partitions()
    assert {p.symbol for p in parts} == {"AB_c_0"}
    batches = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 3 and batches[0].schema.names == ["close", "ts"]
    df = spark.read.format("vendor_bars").schema(narrow).load(vendor).where("ts >= TIMESTAMP '2024-03-02 00:00:00' AND ts < TIMESTAMP '2024-03-03 00:00:00'")
    assert df.columns == ["close", "ts"] and sorted(r.close for r in df.collect()) == [12.5] * 8


def test_new_vendor_files_are_streamed(spark, vendor, tmp_path):
    import shutil

    def counts():
        q = spark.readStream.format("vendor_bars").option("symbols", "AB,XY").load(vendor).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.symbol: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("symbol").count().collect()}

    assert counts() == {"AB_c_0": 13, "XY_c_0": 5}
    shutil.copytree(f"{vendor}/AB_c_0_ohlcv-1m_2025.parquet", f"{vendor}/XY_c_0_ohlcv-1m_2026.parquet")
    assert counts() == {"AB_c_0": 13, "XY_c_0": 9}
