"""Registered queries: those with SQL against DuckDB on the smallest tables, and streams against batches."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import registry
from tidemark.streaming import causal

DATA = "/root/testdata/sf0.001"


def same(value):
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else "nan" if value != value else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_duckdb(spark, duck, name):
    df, expected = registry.QUERIES[name](spark, DATA), duck.sql(registry.ORACLE[name])
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    found = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    assert found == sorted(tuple(same(v) for _, v in sorted(zip(expected.columns, r, strict=True))) for r in expected.fetchall())


#: A plan that needs days that four series share has none at the smallest scale.
LARGER = {"plan_multi_asset": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - {"plan_walkthrough"}))
def test_others_give_rows(spark, name):
    assert registry.QUERIES[name](spark, LARGER.get(name, DATA)).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _run(spark, build, schema, tmp_path, name):
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _stream(spark, df, build, tmp_path, name):
    """Results of df's rows in three files of any order, and then one row of another series that moves the watermark past them all."""
    df.repartition(3, F.rand(5)).write.parquet(str(tmp_path / "in"))
    end = df.limit(1).withColumn("symbol", F.lit("~end")).withColumn("ts", F.to_timestamp_ntz(F.lit("2031-01-01 00:00:00")))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = _run(spark, build, df.schema, tmp_path, name)
    assert causal.late_rows(found).count() == 0
    return causal.on_time(found)


DELAY = "2000 days"


def test_streamed_ewma_and_filter_equal_batch(spark, tmp_path):
    df = registry.returns(spark, DATA).select("symbol", "ts", "seq", "ret").orderBy("ts").coalesce(1)
    batch = {(r.symbol, r.ts): r.variance for r in registry.S.ewma_volatility(df).collect()}
    streamed = _stream(spark, df, lambda s: causal.streaming_ewma(s, delay=DELAY), tmp_path / "a", "ewma").collect()
    assert len(streamed) == len(batch) and all(batch[r.symbol, r.ts] == pytest.approx(r.variance, rel=1e-9) for r in streamed)
    model = registry.A2, registry.PI2, registry.MU2, registry.S2
    batch = {(r.symbol, r.ts): r.probs[0] for r in registry.H.infer(df, *model).collect()}
    streamed = _stream(spark, df, lambda s: causal.streaming_filter(s, *model, delay=DELAY), tmp_path / "b", "filter").collect()
    assert len(streamed) == len(batch) and all(batch[r.symbol, r.ts] == pytest.approx(r.p0, abs=1e-9) for r in streamed)


def _equal(streamed, batch, columns, **tolerance):
    found = {(r.symbol, r.ts): tuple(r[c] for c in columns) for r in streamed.collect()}
    expected = {(r.symbol, r.ts): tuple(r[c] for c in columns) for r in batch.collect()}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k], **tolerance) for k in expected)


def test_streamed_recurrences_and_filters_equal_batch(spark, tmp_path):
    df = registry.returns(spark, DATA).withColumn("signal", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ret") / 0.05))).select("symbol", "ts", "seq", "ret", "signal", "price").orderBy("ts").coalesce(1)
    _equal(_stream(spark, df, lambda s: causal.streaming_smooth(s, 0.3, delay=DELAY), tmp_path / "a", "smooth"), registry.S.smooth_signal(df, 0.3), ["smooth"], abs=1e-9)
    _equal(_stream(spark, df, lambda s: causal.streaming_igarch(s, 0.06, 0.0004, delay=DELAY), tmp_path / "b", "igarch"), registry.S.igarch_scale(df, 0.06, 0.0004), ["position"], rel=1e-9)
    kalman = (-0.2, 5.0, 20.0, (None, 0.0), ((100.0, 0.0), (0.0, 25.0)))
    _equal(_stream(spark, df, lambda s: causal.streaming_kalman(s, *kalman, delay=DELAY), tmp_path / "c", "kalman"), registry.SS.kalman_filter(df, *kalman), ["level", "trend", "level_var", "trend_var", "ll"], rel=1e-8, abs=1e-8)
    _equal(_stream(spark, df, lambda s: causal.streaming_rbpf(s, registry.LANGEVIN, 20, delay=DELAY), tmp_path / "d", "rbpf"), registry.SS.particle_filters(df, registry.LANGEVIN, 20), ["level", "trend", "level_std", "ll", "n_eff"], rel=1e-8, abs=1e-8)


def test_table_functions(spark):
    from tidemark.functions import generators

    generators.register(spark)
    assert spark.sql("SELECT * FROM langevin_path(50, 100D, -0.2D, 0.3D, 0.1D, 0.5D, 1D, 3)").where("jumped").count() > 5
    assert spark.sql("SELECT * FROM regime_path(30, array(array(0.9D, 0.1D), array(0.2D, 0.8D)), array(0.5D, 0.5D), array(-1D, 1D), array(0.01D, 0.01D), 3)").where("(ret > 0) <> (state = 1)").count() == 0
    rows = spark.sql("SELECT s.k, p.* FROM VALUES (1), (2) AS s(k), LATERAL trending_prices(20, 100D, 0D, 0.01D, s.k) p").collect()
    assert len(rows) == 40 and len({r.price for r in rows}) == 40


def test_streamed_backtest_and_bars(spark, tmp_path):
    df = registry.signalled(spark, DATA).select("symbol", "ts", "seq", "ret", "signal").orderBy("ts").coalesce(1)
    batch = {(r.symbol, r.ts): r.cumulative for r in registry.BT.backtest(df).collect()}
    streamed = _stream(spark, df, lambda s: causal.streaming_backtest(s, delay=DELAY), tmp_path / "a", "curve").collect()
    assert len(streamed) == len(batch) and all(batch[r.symbol, r.ts] == pytest.approx(r.cumulative, rel=1e-9) for r in streamed)
    ticks = registry.M.ticks(spark, DATA)
    ticks.repartition(3, F.rand(5)).write.parquet(str(tmp_path / "b" / "in"))
    ticks.limit(1).withColumn("ts", F.to_timestamp_ntz(F.lit("2031-01-01 00:00:00"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "b" / "in"))
    final = _run(spark, lambda s: causal.streaming_bars(s, "1h", DELAY), ticks.schema, tmp_path / "b", "bars")
    whole = {(r.symbol, r.ts): r.close for r in registry.P.resample_bars(ticks.select("symbol", "ts", "event_id", F.col("price").alias("close")), "1h", order=("ts", "event_id")).collect()}
    rows = {(r.symbol, r.ts): r.close for r in final.collect()}
    assert rows == whole


def test_rows_that_lost_their_place_are_counted(spark, tmp_path):
    """A row that comes after a later one of its series was folded goes out as late; one that only its own series lets in does not."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    files = [[("a", at(1), 0.1), ("a", at(3), 0.3)], [("a", at(2), 0.2), ("b", at(30), 1.0)], [("a", at(10), 0.4)], [("a", at(2.5), 9.0), ("c", at(5), 2.0), ("a", at(1.5), 9.0)], [("~end", at(99), 1.0)]]
    schema = "symbol string, ts timestamp_ntz, ret double"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = _run(spark, lambda s: causal.streaming_ewma(s, 0.5, delay="2 hours"), spark.createDataFrame([], schema).schema, tmp_path, "late").collect()
    late = sorted((r.symbol, r.ts, r.late_count) for r in found if r.late)
    assert late == [("a", at(1.5), 2), ("a", at(2.5), 1)] and all(r.variance is None for r in found if r.late)
    folded = sorted((r.symbol, r.ts, r.variance) for r in found if not r.late)
    expected = [("a", at(1), 0.01), ("a", at(2), 0.01), ("a", at(3), 0.025), ("a", at(10), 0.0575), ("b", at(30), 1.0), ("c", at(5), 4.0)]
    assert [f[:2] for f in folded] == [e[:2] for e in expected] and [f[2] for f in folded] == pytest.approx([e[2] for e in expected])
