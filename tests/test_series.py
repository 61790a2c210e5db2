"""Hand-checked values of preparation, features, signals and backtests."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as BT
from tidemark.operators import prep as P
from tidemark.operators import regimes as R
from tidemark.operators import signals as S
from tidemark.operators import statistics as ST
from tidemark.sources import market as M


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "seq").collect()]


def test_log_returns(series):
    out = P.log_returns(series({"a": [100.0, 110, 121], "b": [5.0]}, "price"))
    assert column(out, "ret") == pytest.approx([math.log(1.1)] * 2)
    assert column(out, "seq") == [1, 2]


def test_log_returns_reject_prices_that_are_not_positive(series):
    with pytest.raises(Exception, match="positive"):
        P.log_returns(series({"a": [1.0, 0.0]}, "price"), checked=True).collect()


def test_ewma_uses_the_square_before(series):
    out = S.ewma_volatility(series({"a": [0.1, -0.2, 0.05]}, "ret"), 0.8)
    assert column(out, "variance") == pytest.approx([0.01, 0.01, 0.016])


def test_zscore(series):
    out = column(S.normalize_returns(series({"a": [1.0, 2, 3, 4], "b": [2.0, 2, 2, 2]}, "ret"), 3), "z")
    assert out[:2] == [None, None] and out[2:4] == pytest.approx([1.2247448714] * 2) and out[4:] == [None] * 4


def test_discretize_rounds_halves_to_even(series):
    out = series({"a": [0.125, 0.375, 0.10, 0.20, -0.10, -0.30]}, "x").withColumn("t", S.discretize(F.col("x"), 0.25))
    assert column(out, "t") == pytest.approx([0, 0.5, 0, 0.25, 0, -0.25])


def test_vote_and_no_trade_zone(spark):
    df = spark.createDataFrame([([0.7, 0.1, 0.2], [-0.01, 0.0, 0.01], 0.8)], "p array<double>, mu array<double>, s double")
    assert df.select(S.vote_signal(F.col("p"), F.col("mu"))).first()[0] == pytest.approx(-0.5)
    assert df.select(S.no_trade_zone(F.col("s"), F.col("p"), 0, 0.7)).first()[0] == 0.0
    assert df.select(S.no_trade_zone(F.col("s"), F.col("p"), 1, 0.5)).first()[0] == 0.8


def test_smooth_signal(series):
    assert column(S.smooth_signal(series({"a": [1.0, -1, 1, -1]}, "signal"), 0.5), "smooth") == pytest.approx([1, 0, 0.5, -0.25])


def test_fir(series):
    assert column(S.fir_momentum(series({"a": [1.0, 2, 3, 4, 5, -1, -2, -3, -4]}, "x"), "x", 4), "signal") == pytest.approx([1, 1, 0.5, 0, -0.5, -1])


def test_igarch(series):
    out = S.igarch_scale(series({"a": [(1.0, 0.1), (1.0, -0.2), (1.0, 0.05)]}, "signal", "ret"), 0.25, 0.04)
    assert column(out, "position") == pytest.approx([v**-0.5 for v in (0.04, 0.0325, 0.034375)])


def test_backtest_lags_the_signal(series):
    df = series({"a": [(0.01, 0.0), (0.02, 0.0), (0.03, 1.0), (0.04, 1.0), (0.05, -1.0)]}, "ret", "signal")
    assert column(BT.backtest(df, 0), "net") == pytest.approx([0, 0, 0, 0.04, 0.05])


def test_backtest_charges_lagged_changes(series):
    df = series({"a": [(0.0, 1.0), (0.0, -1.0), (0.0, 1.0)]}, "ret", "signal")
    assert column(BT.backtest(df, 100), "net") == pytest.approx([0, -0.01, -0.02])


def test_drawdown_and_sharpe(series):
    curve = BT.drawdowns(series({"a": [1.0, 1.2, 1.1, 0.9, 1.3]}, "cumulative"))
    assert -min(column(curve, "drawdown")) == pytest.approx(0.25)
    assert series({"a": [0.01, 0.01]}, "r").agg(BT.sharpe(F.col("r"))).first()[0] == 0.0


def test_resampled_bar(spark):
    rows = [("x", f"2024-01-02 14:3{k}:00", 100.0 + k, 105.0 + k, 99.0 - k, 101.0 + k, 10 * (k + 1)) for k in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, t string, open double, high double, low double, close double, volume long").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    assert tuple(P.resample_bars(bars, "5min").first())[2:] == (100.0, 109.0, 95.0, 105.0, 150)
    with pytest.raises(ValueError, match="freq"):
        P.resample_bars(bars, "7min")


def test_session_follows_daylight_saving(spark):
    times = ["2024-01-02 14:30:00", "2024-01-02 14:29:00", "2024-01-02 20:59:00", "2024-01-02 21:00:00", "2024-01-06 15:00:00", "2024-03-11 13:30:00", "2024-03-11 13:29:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert sorted(r.t for r in P.filter_rth(df).collect()) == ["2024-01-02 14:30:00", "2024-01-02 20:59:00", "2024-03-11 13:30:00"]


def test_survivors_fall_back_to_the_best(spark):
    df = spark.createDataFrame([(k, float(s)) for k, s in enumerate([-5, -1, -3])], "k int, s double")
    assert sorted(r.k for r in P.survivors(df, "s", 2, "k").collect()) == [1, 2]
    assert [r.k for r in P.survivors(df.union(spark.createDataFrame([(9, 1.0)], df.schema)), "s", 2, "k").collect()] == [9]


def test_variance_ratio_and_acf_of_flat_series(series):
    flat = series({"a": [0.0] * 6}, "ret")
    assert ST.variance_ratio(flat, 2).first().variance_ratio == 1.0
    assert [r.acf for r in ST.acf(flat, 2).orderBy("lag").collect()] == [0.0] * 3


def test_chi_square_tail(spark):
    assert spark.range(1).select(ST.chi2_tail(F.lit(43.773), 30)).first()[0] == pytest.approx(0.05, abs=1e-4)


def test_runs_and_windows(spark, series):
    df = series({"a": [0.0, 0, 1, 1, 1, 0]}, "state")
    assert {(r.state, r.duration) for r in R.average_durations(df).collect()} == {(0.0, 1.5), (1.0, 3.0)}
    assert R.transition_counts(df).first().transitions == 2
    days = spark.sql("SELECT 'a' AS symbol, explode(sequence(date'2020-01-01', date'2021-12-31', interval 1 month)) AS dt")
    parts = R.expanding_windows(days, "dt", 12, 6).groupBy("window_id", "part").count()
    assert {(r[0], r[1], r[2]) for r in parts.collect()} == {(0, "train", 12), (0, "test", 6), (1, "train", 18), (1, "test", 6)}


def test_range_joins(series):
    at = lambda df: sorted(r.seq for r in df.collect())
    true, found = (series({"a": [0.0] * 30}, "x").where(F.col("seq").isin(s)).select("symbol", "seq") for s in ([5, 20], [7, 12, 21]))
    assert at(R.jump_hits(true, found)) == [5, 20] and at(R.jump_false_positives(true, found)) == [12]


def test_sources(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-02 14:30:00' AS ts_event, 1.0D AS open, 2.0D AS close, 5L AS volume, 'v' AS publisher_id")
    for name in ("ES_c_0_ohlcv-1m_2024.parquet", "ES_c_0_ohlcv-1m_2025.parquet"):
        rows.toPandas().to_parquet(tmp_path / name, coerce_timestamps="us", allow_truncated_timestamps=True)
    out = M.futures_bars(spark, str(tmp_path), "ES.c.0", "2024-01-01", "2025-01-01")
    assert out.columns == ["symbol", "ts", "open", "close", "volume"] and out.count() == 1
    with pytest.raises(ValueError, match="no file"):
        M.futures_bars(spark, str(tmp_path), "NQ")
    with pytest.raises(ValueError, match="Close"):
        M.close_series(rows.select("open"))


@pytest.mark.parametrize("call", [lambda: S.prediction_signal(F.lit(1.0), "cubic"), lambda: P.train_test_split(None, 1.5), lambda: S.ewma_volatility(None, 1.0), lambda: BT.backtest(None, -1), lambda: ST.chi2_tail(F.lit(1.0), 0)])
def test_argument_errors(call, spark):
    with pytest.raises(ValueError):
        call()


def test_chi_square_tails_of_odd_degrees(spark):
    """Against the recurrence Q(a + 1, x) = Q(a, x) + x^a exp(-x) / gamma(a + 1) from Q(1/2, x) = erfc(sqrt x)."""
    qs = [0.0, 1e-6, 0.3, 2.0, 7.9, 8.1, 30.0, 90.0, 400.0]
    df = spark.createDataFrame([(q,) for q in qs], "q double")
    for degrees in (1, 3, 9, 21):
        found = [r.p for r in df.select("q", ST.chi2_tail(F.col("q"), degrees).alias("p")).orderBy("q").collect()]
        for q, p in zip(qs, found, strict=True):
            x, a, expected = q / 2, 0.5, math.erfc(math.sqrt(q / 2))
            while 2 * a < degrees:
                expected += x**a * math.exp(-x) / math.gamma(a + 1)
                a += 1
            assert p == pytest.approx(expected, rel=1e-9, abs=1e-14)
    both = df.where("q >= 2").select((ST.chi2_tail(F.col("q"), 20) < ST.chi2_tail(F.col("q"), 21)).alias("a"), (ST.chi2_tail(F.col("q"), 21) < ST.chi2_tail(F.col("q"), 22)).alias("b")).distinct().collect()
    assert [tuple(r) for r in both] == [(True, True)]


def test_means_of_series_that_end_together(series):
    df = series({"a": [1.0, 2.0, 3.0], "b": [10.0], "c": [5.0, 7.0]}, "x")
    aligned = P.align_from_end(df, "x", 0.5)
    assert {(r.symbol, r.back): r.x for r in aligned.collect()} == {("a", 0): 3.0, ("a", 1): 2.0, ("a", 2): 1.0, ("b", 0): 10.0, ("b", 1): 0.5, ("b", 2): 0.5, ("c", 0): 7.0, ("c", 1): 5.0, ("c", 2): 0.5}
    assert {r.back: r["mean"] for r in P.ended_means(df, "x", 0.5).collect()} == pytest.approx({r.back: r.m for r in aligned.groupBy("back").agg(F.avg("x").alias("m")).collect()})


def test_sums_at_several_sizes_equal_one_at_a_time(spark):
    df = spark.range(60).selectExpr("CAST(id % 2 AS string) AS symbol", "id DIV 2 + 1 AS seq", "(id DIV 2) DIV 7 AS day", "CAST(id * id % 17 AS double) AS ret")
    found = ST.sums_at(df, {"one": 1, "three": 3, "day": 0}, "day").select("series.*", "seq", "ret").collect()
    rows = {s: [(r.day, r.ret) for r in df.where(F.col("symbol") == s).orderBy("seq").collect()] for s in "01"}
    for s, pairs in rows.items():
        days = [[x for d, x in pairs if d == day] for day in sorted({d for d, _ in pairs})]
        for freq, n in (("one", 1), ("three", 3), ("day", 0)):
            sums = [sum(day[k : k + n]) for day in days for k in range(0, len(day) // n * n, n)] if n else [sum(day) for day in days]
            assert [r.ret for r in sorted((r for r in found if (r.symbol, r.freq) == (s, freq)), key=lambda r: r.seq)] == pytest.approx(sums)
    ratios = {(r.symbol, r.horizon): r.variance_ratio for r in ST.variance_ratios(df, (2, 5, 16)).collect()}
    for q in (2, 5, 16):
        assert {r.symbol: r.variance_ratio for r in ST.variance_ratio(df, q).collect()} == pytest.approx({s: ratios[s, q] for s in "01"})


@pytest.mark.parametrize("values", [[-0.4] * 2000, [-0.4] * 1450, [-1.0, 0.5], [-3.0, -1.5, 0.1]])
def test_compounded_returns_are_rounded_once(series, values):
    """A product below the smallest double is 0, and one near it does not hang on the order of its factors."""
    exact = float(math.prod((1 + Fraction(v) for v in values), start=Fraction(1)))
    assert series({"a": values}, "net").select(BT.compounded(F.col("net"))).first()[0] == pytest.approx(exact, rel=1e-9, abs=0.0)
    assert series({"a": values[::-1]}, "net").select(BT.annualized_return(F.col("net"))).first()[0] == pytest.approx(exact ** (252 / len(values)) - 1, rel=1e-9)
