"""Every registered query with, where SQL can express it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as BT
from tidemark.operators import hmm as H
from tidemark.operators import prep as P
from tidemark.operators import regimes as R
from tidemark.operators import signals as S
from tidemark.operators import statespace as SS
from tidemark.operators import statistics as ST
from tidemark.sources import market as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: A two-state model used where parameters are given.
A2, PI2, MU2, S2 = ((0.92, 0.08), (0.15, 0.85)), (0.55, 0.45), (-0.01, 0.01), (4e-4, 9e-4)
LANGEVIN = {"theta": -0.2, "sigma": 5.0, "sigma_obs": 20.0, "lambda_J": 0.05, "mu_J": 0.0, "sigma_J": 10.0}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def r(c, digits: int = 6, name: str | None = None):
    """c rounded, so that the last bits of floating sums do not count; -0 becomes 0."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + 0.0).alias(name) if name else F.round(c, digits) + 0.0


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """df with all columns of doubles rounded; keep: the columns to return, all by default."""
    kinds = dict(df.dtypes)
    return df.select(*(r(c, digits, c) if kinds[c] in ("double", "float") else F.col(c) for c in keep or df.columns))


# Series that the queries share.


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sequenced(M.ticks(spark, sf_dir), "ts", "event_id")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.log_returns(ticks(spark, sf_dir))


def user_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.log_returns(P.sequenced(M.ticks(spark, sf_dir, "user_id"), "ts", "event_id"))


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """returns with signal: the mean sign of the last four returns, 0 before there are four."""
    w = P.by_time().rowsBetween(-3, 0)
    return returns(spark, sf_dir).withColumn("signal", F.when(F.col("seq") >= 4, F.avg(F.signum("ret")).over(w)).otherwise(0.0))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """returns with state: thirds by size, a label that does not hang on a fit."""
    w = Window.partitionBy("symbol").orderBy("ret", "event_id")
    return returns(spark, sf_dir).withColumn("state", F.ntile(3).over(w) - 1)


TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id, 1000 + value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events),
seqd AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS seq FROM ticks)"""
RETURNS = TICKS + """,
rets AS (SELECT symbol, ts, event_id, price, size, seq - 1 AS seq, ln(price / prev) AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM seqd) WHERE seq > 1)"""
SIGNALLED = RETURNS + """,
sig AS (SELECT *, CASE WHEN seq >= 4 THEN avg(sign(ret)) OVER (PARTITION BY symbol ORDER BY seq ROWS 3 PRECEDING) ELSE 0.0 END AS signal FROM rets)"""
BACKTEST = SIGNALLED + """,
lagd AS (SELECT *, coalesce(lag(signal) OVER w, 0.0) AS lagged, coalesce(lag(signal, 2) OVER w, 0.0) AS lagged2, abs(signal - lag(signal) OVER w) AS change FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
nets AS (SELECT *, lagged * ret - abs(lagged - lagged2) * 5 / 1e4 AS net FROM lagd),
curve AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cumulative FROM nets)"""
STATES = RETURNS + """,
labels3 AS (SELECT *, ntile(3) OVER (PARTITION BY symbol ORDER BY ret, event_id) - 1 AS state FROM rets)"""
DAILY = """daily AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2),
dseq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS seq FROM daily),
drets AS (SELECT symbol, dt, close, seq - 1 AS seq, close / prev - 1 AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM dseq) WHERE seq > 1)"""
USERS = RETURNS.replace("event_type AS symbol", "user_id AS symbol")


def rnd(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# Preparation


@query("log_returns", f"WITH {RETURNS} SELECT symbol, event_id, seq, {rnd('ret', 'ret', 9)} FROM rets")
def _(spark, d):
    return rounded(returns(spark, d), "symbol", "event_id", "seq", "ret", digits=9)


@query("simple_returns", f"WITH {DAILY} SELECT symbol, dt, seq, {rnd('ret', 'ret', 9)} FROM drets")
def _(spark, d):
    return rounded(daily_returns(spark, d), "symbol", "dt", "seq", "ret", digits=9)


def daily_returns(spark, d):
    return P.simple_returns(P.sequenced(M.daily(spark, d), "dt"), "close")


_NY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


@query("filter_rth", f"WITH {TICKS} SELECT symbol, event_id, ts FROM ticks WHERE isodow({_NY}) <= 5 AND hour({_NY}) * 60 + minute({_NY}) BETWEEN 570 AND 959")
def _(spark, d):
    return P.filter_rth(M.ticks(spark, d)).select("symbol", "event_id", "ts")


def _resample(freq: str, width: str):
    sql = f"""WITH {TICKS} SELECT symbol, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '2000-01-01') AS ts, round(min_by(price, ROW(ts, event_id)), 6) + 0.0 AS open, round(max(price), 6) + 0.0 AS high,
round(min(price), 6) + 0.0 AS low, round(max_by(price, ROW(ts, event_id)), 6) + 0.0 AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2"""

    @query(f"resample_{freq.lower()}", sql)
    def _(spark, d):
        bars = M.ticks(spark, d).select("symbol", "ts", "event_id", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.col("size").alias("volume"))
        return rounded(P.resample_bars(bars, freq, order=("ts", "event_id")))


for _freq, _width in (("5min", "5 minutes"), ("15min", "15 minutes"), ("30min", "30 minutes"), ("1h", "1 hour"), ("1D", "1 day")):
    _resample(_freq, _width)


@query("vendor_bars", f"""WITH {TICKS} SELECT symbol || '_c_0' AS symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS ts, {rnd('max(price)', 'high')}, {rnd('max_by(price, ROW(ts, event_id))', 'close')}, CAST(sum(size) AS BIGINT) AS volume
FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND symbol IN ('click', 'view', 'purchase') GROUP BY 1, 2""")
def _(spark, d):
    """Bars of each event type go to a file of its own in the vendor's form, and come back through the data source."""
    from tidemark.shared import new_path
    from tidemark.sources.vendor import KIND, register

    register(spark)
    folder = new_path(spark, "vendor")
    source = M.ticks(spark, d).select("symbol", "ts", "event_id", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.col("size").alias("volume"))
    bars = P.resample_bars(source, "1h", order=("ts", "event_id")).withColumnRenamed("ts", "ts_event")
    for (symbol,) in bars.select("symbol").distinct().collect():  # a contract each
        bars.where(F.col("symbol") == symbol).drop("symbol").write.parquet(f"{folder}/{M.contract_name(symbol)}{KIND}2024.parquet")
    found = spark.read.format("vendor_bars").options(symbols="click,view,purchase", start="2024-01-05", end="2024-01-20").load(folder)
    return rounded(found.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "high", "close", "volume"))


@query("train_test_split", f"WITH {RETURNS} SELECT symbol, event_id, seq <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) AS is_train FROM rets")
def _(spark, d):
    return P.train_test_split(returns(spark, d), 0.7).select("symbol", "event_id", "is_train")


@query("min_history_filter", f"WITH {USERS} SELECT symbol, count(*) AS n FROM rets GROUP BY 1 HAVING count(*) >= 60")
def _(spark, d):
    return P.min_history(user_returns(spark, d), 60).groupBy("symbol").agg(F.count("*").alias("n"))


@query("tail_slice", f"WITH {RETURNS} SELECT symbol, event_id FROM rets QUALIFY seq > max(seq) OVER (PARTITION BY symbol) - 100")
def _(spark, d):
    return P.tail_slice(returns(spark, d), 100).select("symbol", "event_id")


@query("subsample", f"WITH {RETURNS} SELECT symbol, event_id FROM rets WHERE (seq - 1) % 10 = 0")
def _(spark, d):
    return P.subsample(returns(spark, d), 10).select("symbol", "event_id")


PAIR = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_PAIR = ", ".join(f"'{p}'" for p in PAIR)


@query("inner_align", f"WITH {DAILY} SELECT symbol, dt, {rnd('close', 'close', 4)} FROM daily WHERE symbol IN ({_PAIR}) QUALIFY count(*) OVER (PARTITION BY dt) = 3")
def _(spark, d):
    return rounded(P.inner_align(M.daily(spark, d), PAIR), "symbol", "dt", "close", digits=4)


@query("align_from_end", f"""WITH {DAILY}, b AS (SELECT symbol, max(seq) OVER (PARTITION BY symbol) - seq AS back, close FROM dseq), n AS (SELECT max(back) AS n FROM b),
g AS (SELECT s.symbol, unnest(range(0, n.n + 1)) AS back FROM (SELECT DISTINCT symbol FROM dseq) s, n)
SELECT g.symbol, CAST(g.back AS BIGINT) AS back, {rnd('coalesce(b.close, 1.0)', 'close', 4)} FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.back = b.back""")
def _(spark, d):
    out = P.align_from_end(P.sequenced(M.daily(spark, d), "dt"), "close", 1.0)
    return rounded(out.withColumn("back", F.col("back").cast("long")), "symbol", "back", "close", digits=4)


@query("drop_missing", f"WITH {RETURNS} SELECT symbol, event_id FROM rets WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def _(spark, d):
    holed = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("ret"))
    return P.drop_missing(returns(spark, d).withColumn("x", holed), "x").select("symbol", "event_id")


# Features and signals


@query("zscore_returns", f"""WITH {RETURNS} SELECT symbol, event_id, CASE WHEN n = 20 AND sd > 0 THEN {rnd('(ret - m) / sd', 'z', 6).removesuffix(' AS z')} END AS z
FROM (SELECT *, count(*) OVER w AS n, avg(ret) OVER w AS m, stddev_pop(ret) OVER w AS sd FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING))""")
def _(spark, d):
    return rounded(S.normalize_returns(returns(spark, d)), "symbol", "event_id", "z")


@query("discretize", f"WITH {RETURNS} SELECT symbol, event_id, {rnd('round_even(ret / 0.001, 0) * 0.001', 'tick', 6)} FROM rets")
def _(spark, d):
    return returns(spark, d).select("symbol", "event_id", r(S.discretize(F.col("ret"), 0.001), 6, "tick"))


@query("tick_variance_floor", f"""WITH {RETURNS}, t AS (SELECT symbol, tick, round_even(ret / tick, 0) * tick AS x FROM rets, (SELECT unnest([0.01::DOUBLE, 0.25, 1.0]) AS tick))
SELECT symbol, tick, {rnd('any_value(tick * tick / 2)', 'floor', 8)}, {rnd('greatest(var_pop(x), any_value(tick * tick / 2))', 'variance', 8)} FROM t GROUP BY 1, 2""")
def _(spark, d):
    """Variances of returns on grids of ticks, which the grid itself keeps from vanishing."""
    rows = [returns(spark, d).groupBy("symbol").agg(F.var_pop(S.discretize(F.col("ret"), tick)).alias("v")).select("symbol", F.lit(tick).alias("tick"), F.lit(S.tick_variance_floor(tick)).alias("floor"), F.greatest("v", F.lit(S.tick_variance_floor(tick))).alias("variance")) for tick in (0.01, 0.25, 1.0)]
    return rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), digits=8)


@query("discretized_log_pmf", f"""WITH {RETURNS}, z AS (SELECT ln(sum(exp(-0.5 * pow(g * 0.001, 2) / 4e-4))) AS log_z FROM range(-200, 201) t(g))
SELECT symbol, event_id, {rnd('-0.5 * pow(round_even(ret / 0.001, 0) * 0.001, 2) / 4e-4 - log_z', 'log_pmf', 6)} FROM rets, z""")
def _(spark, d):
    return returns(spark, d).select("symbol", "event_id", r(S.discretized_log_pmf(S.discretize(F.col("ret"), 0.001), 0.0, 4e-4, 0.001), 6, "log_pmf"))


@query("fir_momentum", f"WITH {SIGNALLED} SELECT symbol, event_id, {rnd('signal', 'signal')} FROM sig WHERE seq >= 4")
def _(spark, d):
    return rounded(S.fir_momentum(returns(spark, d), "ret", 4), "symbol", "event_id", "signal")


@query("soft_sign", f"WITH {RETURNS}, dd AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS d FROM rets) SELECT symbol, event_id, {rnd('d / sqrt(d * d + 100.0)', 'signal')} FROM dd WHERE d IS NOT NULL")
def _(spark, d):
    return rounded(S.soft_sign(returns(spark, d), "price", 10.0), "symbol", "event_id", "signal")


@query("linear_signal", f"WITH {RETURNS} SELECT symbol, event_id, {rnd('greatest(-1, least(1, ret / 0.02))', 'signal')} FROM rets")
def _(spark, d):
    return returns(spark, d).select("symbol", "event_id", r(S.prediction_signal(F.col("ret"), "linear", 0.02), 6, "signal"))


@query("sign_signal", f"WITH {RETURNS} SELECT symbol, event_id, CAST(sign(ret) AS DOUBLE) AS signal FROM rets")
def _(spark, d):
    return returns(spark, d).select("symbol", "event_id", (S.prediction_signal(F.col("ret")) + 0.0).alias("signal"))


@query("normalized_full", f"WITH {RETURNS} SELECT symbol, event_id, {rnd('greatest(-1, least(1, ret / stddev_pop(ret) OVER (PARTITION BY symbol)))', 'signal')} FROM rets")
def _(spark, d):
    return rounded(S.normalized_full(returns(spark, d), "ret"), "symbol", "event_id", "signal")


_PROBS = "1 / (1 + exp(-100 * ret))"


def _two_state(df):
    p = 1 / (1 + F.exp(-100 * F.col("ret")))
    return df.withColumn("probs", F.array(1 - p, p))


@query("vote_signal", f"WITH {RETURNS} SELECT symbol, event_id, {rnd(f'greatest(-1, least(1, {_PROBS} - (1 - {_PROBS})))', 'signal')} FROM rets")
def _(spark, d):
    mu = F.array(F.lit(-0.01), F.lit(0.01))
    return _two_state(returns(spark, d)).select("symbol", "event_id", r(S.vote_signal(F.col("probs"), mu), 6, "signal"))


@query("no_trade_zone", f"WITH {SIGNALLED} SELECT symbol, event_id, {rnd(f'CASE WHEN 1 - {_PROBS} < 0.4 THEN signal ELSE 0 END', 'signal')} FROM sig")
def _(spark, d):
    df = _two_state(signalled(spark, d))
    return df.select("symbol", "event_id", r(S.no_trade_zone(F.col("signal"), F.col("probs"), 0, 0.4), 6, "signal"))


# Recurrences, on the many short series of users


def _recursive(first: str, following: str, out: str) -> str:
    """SQL of x_1 = first, x_t = following over rows c (now) and p (before), by series."""
    return f"""WITH RECURSIVE {USERS}, base AS MATERIALIZED (SELECT *, greatest(-1, least(1, ret / 0.02)) AS signal FROM rets),
rec AS (SELECT symbol, event_id, seq, {first} AS x FROM base WHERE seq = 1
UNION ALL SELECT c.symbol, c.event_id, c.seq, {following} FROM rec JOIN base c ON c.symbol = rec.symbol AND c.seq = rec.seq + 1 JOIN base p ON p.symbol = rec.symbol AND p.seq = rec.seq)
SELECT rec.symbol, rec.event_id, {out} FROM rec JOIN base b ON b.symbol = rec.symbol AND b.seq = rec.seq"""


def _user_signal(spark, d):
    return user_returns(spark, d).withColumn("signal", S.prediction_signal(F.col("ret"), "linear", 0.02))


@query("ewma_vol", _recursive("ret * ret", "0.94 * rec.x + (1 - 0.94) * p.ret * p.ret", rnd("rec.x", "variance", 9)))
def _(spark, d):
    return rounded(S.ewma_volatility(user_returns(spark, d)), "symbol", "event_id", "variance", digits=9)


@query("ema_signal", _recursive("signal", "0.9 * rec.x + 0.1 * c.signal", rnd("greatest(-1, least(1, rec.x))", "smooth")))
def _(spark, d):
    return rounded(S.smooth_signal(_user_signal(spark, d), 0.1), "symbol", "event_id", "smooth")


@query("igarch_scale", _recursive("CAST(0.0004 AS DOUBLE)", "0.06 * p.ret * p.ret + 0.94 * rec.x", rnd("b.signal / sqrt(rec.x)", "position")))
def _(spark, d):
    return rounded(S.igarch_scale(_user_signal(spark, d), 0.06, 0.0004), "symbol", "event_id", "position")


_F = "WITH RECURSIVE"
_NORMAL = lambda mu, v: f"exp(-0.5 * pow(c.ret - ({mu}), 2) / {v}) / sqrt(2 * pi() * {v})"
_HMM = f"""{_F} {USERS}, c AS MATERIALIZED (SELECT *, {_NORMAL(MU2[0], S2[0])} AS b0, {_NORMAL(MU2[1], S2[1])} AS b1 FROM rets c),
fwd AS (SELECT symbol, event_id, seq, 0.55 * b0 / (0.55 * b0 + 0.45 * b1) AS f0, ln(0.55 * b0 + 0.45 * b1) AS gain, CAST(0.55 * -0.01 + 0.45 * 0.01 AS DOUBLE) AS prediction FROM c WHERE seq = 1
UNION ALL SELECT symbol, event_id, seq, q0 * b0 / (q0 * b0 + (1 - q0) * b1), ln(q0 * b0 + (1 - q0) * b1), q0 * -0.01 + (1 - q0) * 0.01
FROM (SELECT c.symbol, c.event_id, c.seq, c.b0, c.b1, f.f0 * 0.92 + (1 - f.f0) * 0.15 AS q0 FROM fwd f JOIN c ON c.symbol = f.symbol AND c.seq = f.seq + 1))"""


@query("hmm_filter", f"{_HMM} SELECT symbol, event_id, {rnd('f0', 'p0')}, {rnd('prediction', 'prediction', 8)} FROM fwd")
def _(spark, d):
    out = H.infer(user_returns(spark, d), A2, PI2, MU2, S2)
    return out.select("symbol", "event_id", r(F.element_at("probs", 1), 6, "p0"), r("prediction", 8, "prediction"))


@query("hmm_forward_ll", f"{_HMM} SELECT symbol, {rnd('sum(gain)', 'll', 5)}, count(*) AS n FROM fwd GROUP BY 1")
def _(spark, d):
    return H.likelihoods(user_returns(spark, d), A2, PI2, MU2, S2).select("symbol", r("ll", 5, "ll"), "n")


@query("hmm_log_alpha", f"{_HMM} SELECT symbol, event_id, {rnd('ln(f0) + sum(gain) OVER w', 'log_alpha0', 5)}, {rnd('ln(1 - f0) + sum(gain) OVER w', 'log_alpha1', 5)} FROM fwd WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    out = H.log_alpha(user_returns(spark, d), A2, PI2, MU2, S2)
    return out.select("symbol", "event_id", r(F.element_at("log_alpha", 1), 5, "log_alpha0"), r(F.element_at("log_alpha", 2), 5, "log_alpha1"))


@query("hmm_backward", f"""{_F} {USERS}, c AS MATERIALIZED (SELECT *, max(seq) OVER (PARTITION BY symbol) - seq AS back, {_NORMAL(MU2[0], S2[0])} AS b0, {_NORMAL(MU2[1], S2[1])} AS b1 FROM rets c),
bwd AS (SELECT symbol, event_id, back, CAST(0 AS DOUBLE) AS l0, CAST(0 AS DOUBLE) AS l1 FROM c WHERE back = 0
UNION ALL SELECT c.symbol, c.event_id, c.back, ln(0.92 * n.b0 + 0.08 * n.b1 * exp(w.l1 - w.l0)) + w.l0, ln(0.15 * n.b0 * exp(w.l0 - w.l1) + 0.85 * n.b1) + w.l1
FROM bwd w JOIN c ON c.symbol = w.symbol AND c.back = w.back + 1 JOIN c n ON n.symbol = w.symbol AND n.back = w.back)
SELECT symbol, event_id, {rnd('l0', 'log_beta0', 5)}, {rnd('l1', 'log_beta1', 5)} FROM bwd""")
def _(spark, d):
    out = H.backward(user_returns(spark, d), A2, MU2, S2)
    return out.select("symbol", "event_id", r(F.element_at("log_beta", 1), 5, "log_beta0"), r(F.element_at("log_beta", 2), 5, "log_beta1"))


_SMOOTHED = _HMM + """,
sm AS (SELECT f.symbol, f.event_id, f.seq, f.f0 AS g0 FROM fwd f JOIN (SELECT symbol, max(seq) AS n FROM c GROUP BY 1) l ON l.symbol = f.symbol AND l.n = f.seq
UNION ALL SELECT f.symbol, f.event_id, f.seq, f.f0 * (0.92 * s.g0 / (f.f0 * 0.92 + (1 - f.f0) * 0.15) + 0.08 * (1 - s.g0) / (f.f0 * 0.08 + (1 - f.f0) * 0.85))
FROM sm s JOIN fwd f ON f.symbol = s.symbol AND f.seq = s.seq - 1)"""


_FULL_STEP = _SMOOTHED + """, nx AS (SELECT f.symbol, f.f0, s.g0 AS n0 FROM fwd f JOIN sm s ON s.symbol = f.symbol AND s.seq = f.seq + 1),
pr AS (SELECT symbol, f0, n0, f0 * 0.92 + (1 - f0) * 0.15 AS p0 FROM nx),
x AS (SELECT symbol, sum(f0 * 0.92 * n0 / p0) AS x00, sum(f0 * 0.08 * (1 - n0) / (1 - p0)) AS x01, sum((1 - f0) * 0.15 * n0 / p0) AS x10, sum((1 - f0) * 0.85 * (1 - n0) / (1 - p0)) AS x11 FROM pr GROUP BY 1),
st AS (SELECT symbol, g0 FROM sm WHERE seq = 1)"""


@query("m_step_moves", f"""{_FULL_STEP} SELECT x.symbol, 0 AS state, {rnd('g0', 'start', 5)}, {rnd('x00 / (x00 + x01)', 'a0', 5)}, {rnd('x01 / (x00 + x01)', 'a1', 5)} FROM x JOIN st USING (symbol)
UNION ALL SELECT x.symbol, 1, {rnd('1 - g0', 'start', 5)}, {rnd('x10 / (x10 + x11)', 'a0', 5)}, {rnd('x11 / (x10 + x11)', 'a1', 5)} FROM x JOIN st USING (symbol)""")
def _(spark, d):
    out = H.m_step(user_returns(spark, d), A2, PI2, MU2, S2)
    return out.select("symbol", "state", r("start", 5, "start"), r(F.element_at("A", 1), 5, "a0"), r(F.element_at("A", 2), 5, "a1"))


@query("hmm_posteriors", f"{_SMOOTHED} SELECT symbol, event_id, {rnd('g0', 'g0')} FROM sm")
def _(spark, d):
    return H.posteriors(user_returns(spark, d), A2, PI2, MU2, S2).select("symbol", "event_id", r(F.element_at("gamma", 1), 6, "g0"))


@query("transition_posteriors", f"""{_SMOOTHED}, nx AS (SELECT f.symbol, f.f0, s.g0 AS n0 FROM fwd f JOIN sm s ON s.symbol = f.symbol AND s.seq = f.seq + 1),
pr AS (SELECT symbol, f0, n0, f0 * 0.92 + (1 - f0) * 0.15 AS p0 FROM nx),
x AS (SELECT symbol, sum(f0 * 0.92 * n0 / p0) AS x00, sum(f0 * 0.08 * (1 - n0) / (1 - p0)) AS x01, sum((1 - f0) * 0.15 * n0 / p0) AS x10, sum((1 - f0) * 0.85 * (1 - n0) / (1 - p0)) AS x11 FROM pr GROUP BY 1)
SELECT symbol, 0 AS i, 0 AS j, {rnd('x00', 'xi', 5)} FROM x UNION ALL SELECT symbol, 0, 1, {rnd('x01', 'xi', 5)} FROM x UNION ALL SELECT symbol, 1, 0, {rnd('x10', 'xi', 5)} FROM x UNION ALL SELECT symbol, 1, 1, {rnd('x11', 'xi', 5)} FROM x""")
def _(spark, d):
    return rounded(H.transition_posteriors(user_returns(spark, d), A2, PI2, MU2, S2), digits=5)


@query("m_step", f"""{_SMOOTHED}, w AS (SELECT symbol, 0 AS state, g0 AS g, ret FROM sm JOIN c USING (symbol, seq) UNION ALL SELECT symbol, 1, 1 - g0, ret FROM sm JOIN c USING (symbol, seq)),
m AS (SELECT symbol, state, sum(g) AS weight, sum(g * ret) / sum(g) AS mu, sum(g * ret * ret) / sum(g) AS yy FROM w GROUP BY 1, 2)
SELECT symbol, state, {rnd('weight', 'weight')}, {rnd('mu', 'mu', 8)}, {rnd('greatest(yy - mu * mu, 1e-8)', 'sigma2', 8)} FROM m""")
def _(spark, d):
    out = H.emission_m_step(H.posteriors(user_returns(spark, d), A2, PI2, MU2, S2))
    return out.select("symbol", "state", r("weight", 6, "weight"), r("mu", 8, "mu"), r("sigma2", 8, "sigma2"))


@query("viterbi", f"""{_F} {USERS}, c AS MATERIALIZED (SELECT *, -0.5 * (ln(2 * pi() * {S2[0]}) + pow(ret - ({MU2[0]}), 2) / {S2[0]}) AS b0, -0.5 * (ln(2 * pi() * {S2[1]}) + pow(ret - {MU2[1]}, 2) / {S2[1]}) AS b1 FROM rets),
vit AS (SELECT symbol, event_id, seq, ln(0.55) + b0 AS d0, ln(0.45) + b1 AS d1, 0 AS k0, 0 AS k1 FROM c WHERE seq = 1
UNION ALL SELECT c.symbol, c.event_id, c.seq, greatest(v.d0 + ln(0.92), v.d1 + ln(0.15)) + b0, greatest(v.d0 + ln(0.08), v.d1 + ln(0.85)) + b1, CASE WHEN v.d0 + ln(0.92) >= v.d1 + ln(0.15) THEN 0 ELSE 1 END, CASE WHEN v.d0 + ln(0.08) >= v.d1 + ln(0.85) THEN 0 ELSE 1 END
FROM vit v JOIN c ON c.symbol = v.symbol AND c.seq = v.seq + 1),
path AS (SELECT v.symbol, v.event_id, v.seq, CASE WHEN d0 >= d1 THEN 0 ELSE 1 END AS state, v.k0, v.k1 FROM vit v JOIN (SELECT symbol, max(seq) AS n FROM c GROUP BY 1) l ON l.symbol = v.symbol AND l.n = v.seq
UNION ALL SELECT v.symbol, v.event_id, v.seq, CASE WHEN p.state = 0 THEN p.k0 ELSE p.k1 END, v.k0, v.k1 FROM path p JOIN vit v ON v.symbol = p.symbol AND v.seq = p.seq - 1)
SELECT symbol, event_id, state FROM path""")
def _(spark, d):
    return H.viterbi(user_returns(spark, d), A2, PI2, MU2, S2).select("symbol", "event_id", "state")


# Filters of the level and trend

import math as _math  # noqa: E402

_E, _TH, _SG = _math.exp(-0.2), -0.2, 5.0
_F01 = (_E - 1) / _TH
_Q11 = _SG**2 * (_E * _E - 1) / (2 * _TH)
_Q01 = _SG**2 * (_E - 1) ** 2 / (2 * _TH**2)
_Q00 = _SG**2 / _TH**2 * ((_E * _E - 1) / (2 * _TH) - 2 * (_E - 1) / _TH + 1)


def _kalman_sql() -> str:
    """Means and covariances as a recursion of five numbers; a and b are the predicted covariance's first row."""
    update = "pm0 + a / (a + 400.0) * (price - pm0) AS m0, pm1 + b / (a + 400.0) * (price - pm0) AS m1, a * 400.0 / (a + 400.0) AS c00, b * 400.0 / (a + 400.0) AS c01, e - b * b / (a + 400.0) AS c11"
    return f"""WITH RECURSIVE {USERS}, c AS MATERIALIZED (SELECT * FROM rets),
k AS (SELECT symbol, event_id, seq, {update} FROM (SELECT *, CAST(price AS DOUBLE) AS pm0, CAST(0 AS DOUBLE) AS pm1, CAST(100 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(25 AS DOUBLE) AS e FROM c WHERE seq = 1)
UNION ALL SELECT symbol, event_id, seq, {update} FROM (SELECT c.symbol, c.event_id, c.seq, c.price, k.m0 + {_F01!r} * k.m1 AS pm0, {_E!r} * k.m1 AS pm1,
k.c00 + 2 * {_F01!r} * k.c01 + {_F01!r} * {_F01!r} * k.c11 + {_Q00!r} AS a, {_E!r} * (k.c01 + {_F01!r} * k.c11) + {_Q01!r} AS b, {_E!r} * {_E!r} * k.c11 + {_Q11!r} AS e FROM k JOIN c ON c.symbol = k.symbol AND c.seq = k.seq + 1))
SELECT symbol, event_id, {rnd('m0', 'level', 5)}, {rnd('m1', 'trend', 5)}, {rnd('c00', 'level_var', 5)} FROM k"""


@query("kalman_filter", _kalman_sql())
def _(spark, d):
    out = SS.kalman_filter(user_returns(spark, d), -0.2, 5.0, 20.0, (None, 0.0), ((100.0, 0.0), (0.0, 25.0)))
    return rounded(out, "symbol", "event_id", "level", "trend", "level_var", digits=5)


@query("resampled_particles", f"""WITH {TICKS}, w AS (SELECT symbol, seq - 1 AS particle, sum(size + 1) OVER (PARTITION BY symbol ORDER BY seq)::DOUBLE AS upto, (sum(size + 1) OVER (PARTITION BY symbol ORDER BY seq) - size - 1)::DOUBLE AS before, count(*) OVER (PARTITION BY symbol) AS n, sum(size + 1) OVER (PARTITION BY symbol)::DOUBLE AS total FROM seqd),
t AS (SELECT symbol, particle, CASE WHEN before = 0 THEN 0 ELSE greatest(0, least(n, floor(before * (n / total) - 0.25) + 1)) END::BIGINT AS low, greatest(0, least(n, floor(upto * (n / total) - 0.25) + 1))::BIGINT AS high FROM w)
SELECT symbol, unnest(range(low, high)) AS place, particle FROM t""")
def _(spark, d):
    weighted = ticks(spark, d).select("symbol", (F.col("seq") - 1).alias("particle"), (F.col("size") + 1).cast("double").alias("weight"))
    return SS.resampled(weighted, 0.25, block_rows=256)


def _split(name: str, sql_of: str, result, columns: str, digits: int):
    """The query and SQL of another on the few long series of event types, with blocks of 200 rows: as many tasks as blocks."""

    @query(name, ORACLE[sql_of].replace(USERS, RETURNS))
    def _(spark, d):
        return rounded(result(returns(spark, d)), *columns.split(), digits=digits)


_split("ewma_vol_split", "ewma_vol", lambda df: S.ewma_volatility(df, block_rows=200), "symbol event_id variance", 9)
_split("kalman_split", "kalman_filter", lambda df: SS.kalman_filter(df, -0.2, 5.0, 20.0, (None, 0.0), ((100.0, 0.0), (0.0, 25.0)), block_rows=200), "symbol event_id level trend level_var", 5)
_split("hmm_filter_split", "hmm_filter", lambda df: H.infer(df, A2, PI2, MU2, S2, block_rows=200).withColumn("p0", r(F.element_at("probs", 1), 6)).withColumn("prediction", r("prediction", 8)), "symbol event_id p0 prediction", 9)
_split("hmm_posteriors_split", "hmm_posteriors", lambda df: H.posteriors(df, A2, PI2, MU2, S2, block_rows=200).withColumn("g0", F.element_at("gamma", 1)), "symbol event_id g0", 6)
_split("viterbi_split", "viterbi", lambda df: H.viterbi(df, A2, PI2, MU2, S2, block_rows=200), "symbol event_id state", 6)


# Backtests and portfolios


@query("backtest_curve", f"WITH {BACKTEST} SELECT symbol, event_id, {rnd('net', 'net', 9)}, {rnd('cumulative', 'cumulative')} FROM curve")
def _(spark, d):
    return BT.backtest(signalled(spark, d)).select("symbol", "event_id", r("net", 9, "net"), r("cumulative", 6, "cumulative"))


_METRICS = f"""WITH {BACKTEST}, full_curve AS (SELECT *, cumulative / max(cumulative) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve)
SELECT symbol, %s FROM full_curve GROUP BY 1"""
_SHARPE = "CASE WHEN stddev_pop(net) = 0 THEN 0 ELSE sqrt(252.0) * avg(net) / stddev_pop(net) END"
_ANNUAL = "pow(product(1 + net), 252.0 / count(*)) - 1"


@query("backtest_metrics", _METRICS % ", ".join((rnd(_SHARPE, "sharpe"), rnd(_ANNUAL, "annualized_return"), rnd("-min(dd)", "max_drawdown"), rnd("coalesce(avg(change), 0)", "turnover"))))
def backtest_metrics(spark, d):
    return rounded(backtested(spark, d))


def backtested(spark, d):
    return BT.metrics(BT.backtest(signalled(spark, d)))


for _name, _expression in (("sharpe", _SHARPE), ("annualized_return", _ANNUAL), ("max_drawdown", "-min(dd)"), ("turnover", "coalesce(avg(change), 0)")):
    query(_name, _METRICS % rnd(_expression, _name))(lambda spark, d, n=_name: backtest_metrics(spark, d).select("symbol", n))


@query("buy_and_hold", f"WITH {RETURNS} SELECT symbol, event_id, {rnd('product(1 + CASE WHEN seq = 1 THEN 0 ELSE ret END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)', 'cumulative')} FROM rets")
def _(spark, d):
    return rounded(BT.backtest(returns(spark, d).withColumn("signal", F.lit(1.0)), 0), "symbol", "event_id", "cumulative")


_DSIG = DAILY + """,
dsig AS (SELECT *, CASE WHEN seq >= 4 THEN avg(sign(ret)) OVER (PARTITION BY symbol ORDER BY seq ROWS 3 PRECEDING) ELSE 0.0 END AS signal FROM drets),
dnet AS (SELECT symbol, dt, seq, ret, signal, l1 * ret - abs(l1 - l2) * 5 / 1e4 AS net FROM (SELECT *, coalesce(lag(signal) OVER w, 0.0) AS l1, coalesce(lag(signal, 2) OVER w, 0.0) AS l2 FROM dsig WINDOW w AS (PARTITION BY symbol ORDER BY seq)))"""


def daily_backtest(spark, d):
    w = P.by_time().rowsBetween(-3, 0)
    signal = F.when(F.col("seq") >= 4, F.avg(F.signum("ret")).over(w)).otherwise(0.0)
    return BT.backtest(daily_returns(spark, d).withColumn("signal", signal))


@query("portfolio_equal_weight", f"WITH {_DSIG} SELECT dt, {rnd('avg(net)', 'net', 8)} FROM dnet GROUP BY 1")
def _(spark, d):
    return rounded(BT.equal_weight(daily_backtest(spark, d)), digits=8)


@query("portfolio_sharpe", f"""WITH {SIGNALLED}, own AS (SELECT symbol, avg(o) AS m, stddev_pop(o) AS s FROM (SELECT symbol, lag(signal) OVER (PARTITION BY symbol ORDER BY seq) * ret AS o FROM sig) GROUP BY 1)
SELECT {rnd('avg(sqrt(98280.0) * m / s)', 'portfolio_sharpe', 5)} FROM own WHERE s >= 1e-12""")
def _(spark, d):
    return rounded(BT.portfolio_sharpe(signalled(spark, d)), digits=5)


@query("signal_stats", f"""WITH {SIGNALLED} SELECT symbol, {rnd('avg(signal)', 'mean')}, {rnd('stddev_pop(signal)', 'std')}, {rnd('avg((signal > 0)::DOUBLE)', 'long')}, {rnd('avg((signal < 0)::DOUBLE)', 'short')}, {rnd('avg((signal = 0)::DOUBLE)', 'flat')} FROM sig GROUP BY 1""")
def _(spark, d):
    return rounded(BT.signal_stats(signalled(spark, d)))


@query("signal_corr_agreement", f"WITH {SIGNALLED} SELECT symbol, {rnd('corr(signal, ret)', 'correlation')}, {rnd('avg((sign(signal) = sign(ret))::DOUBLE)', 'agreement')} FROM sig GROUP BY 1")
def _(spark, d):
    return rounded(BT.signal_agreement(signalled(spark, d), "signal", "ret"))


# Statistics


@query("return_moments", f"""WITH {RETURNS}, m AS (SELECT symbol, avg(ret) AS m, stddev_pop(ret) AS s FROM rets GROUP BY 1)
SELECT symbol, {rnd('any_value(m)', 'mean', 9)}, {rnd('any_value(s)', 'std', 9)}, {rnd('avg(pow((ret - m) / s, 3))', 'skew', 5)}, {rnd('avg(pow((ret - m) / s, 4)) - 3', 'kurtosis', 5)} FROM rets JOIN m USING (symbol) GROUP BY 1""")
def _(spark, d):
    return ST.moments(returns(spark, d)).select("symbol", r("mean", 9, "mean"), r("std", 9, "std"), r("skew", 5, "skew"), r("kurtosis", 5, "kurtosis"))


@query("sample_moments", f"WITH {RETURNS} SELECT symbol, {rnd('stddev_samp(ret)', 'std', 9)}, {rnd('skewness(ret)', 'skew', 5)}, {rnd('kurtosis(ret)', 'kurtosis', 5)} FROM rets GROUP BY 1")
def _(spark, d):
    return ST.sample_moments(returns(spark, d)).select("symbol", r("std", 9, "std"), r("skew", 5, "skew"), r("kurtosis", 5, "kurtosis"))


@query("percentiles", f"WITH {RETURNS} SELECT symbol, {', '.join(rnd(f'quantile_cont(ret, {p / 100})', f'p{p:02d}', 8) for p in ST.PERCENTILES)} FROM rets GROUP BY 1")
def _(spark, d):
    return rounded(ST.percentiles(returns(spark, d)), digits=8)


@query("sketched_percentiles", f"WITH {RETURNS}, points AS (SELECT unnest([{', '.join(map(str, ST.PERCENTILES))}]) AS percentile) SELECT symbol, percentile::INTEGER AS percentile, count(*) AS n, TRUE AS within FROM rets, points GROUP BY 1, 2")
def _(spark, d):
    """Sketches of each day merged into those of a series; within: whether the rank is as near as stated."""
    df = returns(spark, d)
    found = ST.sketched_percentiles(ST.merged_sketches(ST.quantile_sketches(df.withColumn("day", F.to_date("ts")), "symbol", "day"), "symbol"))
    long = found.select("symbol", "n", F.explode(F.array(*(F.struct(F.lit(p).alias("percentile"), F.col(f"p{p:02d}").alias("value")) for p in ST.PERCENTILES))).alias("q")).select("symbol", "n", "q.*")
    ranks = df.select("symbol", "ret").join(F.broadcast(long), "symbol").groupBy("symbol", "n", "percentile").agg(F.avg((F.col("ret") < F.col("value")).cast("double")).alias("under"), F.avg((F.col("ret") <= F.col("value")).cast("double")).alias("upto"))
    error = ST.rank_error()
    return ranks.select("symbol", "percentile", "n", ((F.col("under") <= F.col("percentile") / 100 + error) & (F.col("upto") >= F.col("percentile") / 100 - error)).alias("within"))


@query("extreme_dates", f"WITH {RETURNS} SELECT symbol, min_by(ts, ROW(ret, ts)) AS worst_at, {rnd('min(ret)', 'worst', 8)}, min_by(ts, ROW(-ret, ts)) AS best_at, {rnd('max(ret)', 'best', 8)} FROM rets GROUP BY 1")
def _(spark, d):
    return rounded(ST.extremes(returns(spark, d), "ts"), digits=8)


@query("histogram", f"""WITH {RETURNS}, b AS (SELECT symbol, ret, min(ret) OVER w AS lo, max(ret) OVER w AS hi, count(*) OVER w AS n FROM rets WINDOW w AS (PARTITION BY symbol))
SELECT symbol, CAST(least(floor((ret - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS count, {rnd('count(*) / max(n) / max((hi - lo) / 50)', 'density', 4)} FROM b GROUP BY 1, 2""")
def _(spark, d):
    return ST.histogram(returns(spark, d)).select("symbol", F.col("bin").cast("long").alias("bin"), "count", r("density", 4, "density"))


_ACF = f"""{RETURNS}, ctr AS (SELECT symbol, seq, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM rets),
s0 AS (SELECT symbol, count(*) AS n, sum(x * x) AS s0 FROM ctr GROUP BY 1),
acfs AS (SELECT symbol, n, lag, s / s0 AS acf FROM (SELECT a.symbol, k.lag, sum(a.x * b.x) AS s FROM ctr a, range(0, 31) k(lag), ctr b WHERE b.symbol = a.symbol AND b.seq = a.seq + k.lag GROUP BY 1, 2) JOIN s0 USING (symbol))"""


@query("acf", f"WITH {_ACF} SELECT symbol, CAST(lag AS INTEGER) AS lag, {rnd('acf', 'acf')} FROM acfs WHERE lag <= 20")
def _(spark, d):
    return ST.acf(returns(spark, d), 20).select("symbol", "lag", r("acf", 6, "acf"))


@query("ljung_box", f"""WITH {_ACF}, lb AS (SELECT symbol, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM acfs WHERE lag BETWEEN 1 AND 30 GROUP BY 1)
SELECT symbol, {rnd('any_value(q)', 'q', 4)}, {rnd('exp(-any_value(q) / 2) * sum(pow(any_q / 2, j) / gamma(j + 1))', 'p_value')} FROM (SELECT symbol, q, q AS any_q, unnest(range(0, 15)) AS j FROM lb) GROUP BY 1""")
def _(spark, d):
    return ST.ljung_box(returns(spark, d)).select("symbol", r("q", 4, "q"), r("p_value", 6, "p_value"))


@query("ljung_box_odd", f"""WITH {_ACF}, lb AS (SELECT symbol, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) / 2 AS x FROM acfs WHERE lag BETWEEN 1 AND 21 GROUP BY 1),
s AS (SELECT symbol, x, list_reduce(list_prepend([1.0, 1.0], list_transform(range(1, 400), lambda k: [k::DOUBLE, 0.0])), lambda a, k: [a[1] * x / (10.5 + k[1]), a[2] + a[1] * x / (10.5 + k[1])])[2] AS total FROM lb)
SELECT symbol, {rnd('2 * x', 'q', 4)}, {rnd('1 - exp(10.5 * ln(x) - x - lgamma(11.5)) * total', 'p_value')} FROM s""")
def _(spark, d):
    """21 degrees of freedom; the SQL sums the series of the lower incomplete gamma function."""
    return ST.ljung_box(returns(spark, d), 21).select("symbol", r("q", 4, "q"), r("p_value", 6, "p_value"))


@query("variance_ratio", f"""WITH {RETURNS}, blk AS (SELECT symbol, sum(ret) AS b FROM rets GROUP BY symbol, (seq - 1) // 5 HAVING count(*) = 5),
v AS (SELECT symbol, var_samp(b) AS vq FROM blk GROUP BY 1), o AS (SELECT symbol, var_samp(ret) AS v1 FROM rets GROUP BY 1) SELECT symbol, {rnd('vq / (5 * v1)', 'variance_ratio')} FROM o JOIN v USING (symbol)""")
def _(spark, d):
    return rounded(ST.variance_ratio(returns(spark, d), 5))


@query("block_returns_by_day", f"""WITH {RETURNS}, p AS (SELECT symbol, CAST(ts AS DATE) AS day, ret, (row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY seq) - 1) // 5 AS block FROM rets)
SELECT symbol, day, block, {rnd('sum(ret)', 'ret', 8)} FROM p GROUP BY 1, 2, 3 HAVING count(*) = 5""")
def _(spark, d):
    df = returns(spark, d).withColumn("day", F.to_date("ts"))
    return rounded(ST.block_sums(df, 5, within="day"), "symbol", "day", "block", "ret", digits=8)


@query("daily_returns", f"WITH {RETURNS} SELECT symbol, CAST(ts AS DATE) AS day, {rnd('sum(ret)', 'ret', 8)} FROM rets GROUP BY 1, 2")
def _(spark, d):
    return returns(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(r(F.sum("ret"), 8, "ret"))


@query("seasonality", f"WITH {RETURNS} SELECT symbol, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute, {rnd('avg(abs(ret))', 'mean_abs', 8)}, {rnd('avg(ret)', 'mean', 8)}, count(*) AS n FROM rets GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return rounded(ST.seasonality(returns(spark, d), at_least=1), digits=8)


@query("snr", f"WITH {RETURNS} SELECT symbol, {rnd('abs(avg(ret)) / stddev_pop(ret)', 'snr', 8)}, {rnd('stddev_pop(ret) * sqrt(19656.0)', 'annual_vol')} FROM rets GROUP BY 1")
def _(spark, d):
    return ST.snr(returns(spark, d), "5min").select("symbol", r("snr", 8, "snr"), r("annual_vol", 6, "annual_vol"))


def _moments_sql(value: str, source: str, level: bool) -> str:
    scaled = "".join(f", {rnd(f'{e} / level', f'sf_{n}', 7)}" for n, e in (("sigma", "std * sqrt(2 * abs(theta))"), ("sigma_obs", "0.1 * std"), ("sigma_J", "CASE WHEN lam > 0 THEN sqrt(least(k / (k + 3), 0.5) * std * std / lam) ELSE 0 END"))) if level else ""
    return f"""WITH {source}, x AS (SELECT symbol, seq, price, {value} - avg({value}) OVER (PARTITION BY symbol) AS x FROM rets),
l AS (SELECT *, lag(x) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM x),
a AS (SELECT symbol, avg(x * x) AS m2, avg(pow(x, 4)) AS m4, sum(x * b) / count(*) AS c1, min_by(price, seq) AS level FROM l GROUP BY 1 HAVING count(*) >= 3),
p AS (SELECT symbol, level, greatest(sqrt(m2), 1e-10) AS std, least(CASE WHEN m2 > 0 AND c1 / m2 > 0 THEN ln(least(c1 / m2, 1 - 1e-9)) ELSE -0.5 END, -0.01) AS theta, m4 / pow(greatest(sqrt(m2), 1e-10), 4) - 3 AS k FROM a),
q AS (SELECT *, CASE WHEN k > 0 THEN least(k / 3, 10.0) ELSE 0.0 END AS lam FROM p)
SELECT symbol, {rnd('theta', 'theta')}, {rnd('std * sqrt(2 * abs(theta))', 'sigma', 7)}, {rnd('0.1 * std', 'sigma_obs', 7)}, {rnd('lam', 'lambda_J', 5)}, CAST(0 AS DOUBLE) AS "mu_J", {rnd('CASE WHEN lam > 0 THEN sqrt(least(k / (k + 3), 0.5) * std * std / lam) ELSE 0 END', 'sigma_J', 7)}{scaled} FROM q"""


def _moments(df):
    digits = {"theta": 6, "lambda_J": 5}
    return df.select("symbol", *(r(c, digits.get(c, 7), c) for c in df.columns if c != "symbol"))


@query("langevin_moments", _moments_sql("ret", RETURNS, False))
def _(spark, d):
    return _moments(ST.langevin_moments(returns(spark, d)))


@query("langevin_moments_raw", _moments_sql("change", RETURNS.replace("ln(price / prev) AS ret", "price - prev AS change"), True))
def _(spark, d):
    changes = returns(spark, d).withColumn("change", F.col("price") * (1 - F.exp(-F.col("ret"))))
    return _moments(ST.langevin_moments(changes, value="change", level="price"))


# Regimes


@query("regime_stats", f"""WITH {STATES} SELECT symbol, CAST(state AS INTEGER) AS state, count(*) AS n, {rnd('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol)', 'pct')}, {rnd('avg(ret)', 'mean', 8)}, {rnd('stddev_pop(ret)', 'vol', 8)} FROM labels3 GROUP BY symbol, state""")
def _(spark, d):
    return R.state_stats(labelled(spark, d), 3).select("symbol", "state", "n", r("pct", 6, "pct"), r("mean", 8, "mean"), r("vol", 8, "vol"))


_RUNS = STATES + """,
chg AS (SELECT *, CASE WHEN state <> lag(state) OVER (PARTITION BY symbol ORDER BY seq) THEN 1 ELSE 0 END AS c FROM labels3),
islands AS (SELECT symbol, state, sum(c) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM chg),
runs AS (SELECT symbol, state, run, count(*) AS length FROM islands GROUP BY 1, 2, 3)"""


@query("run_lengths", f"WITH {_RUNS} SELECT symbol, CAST(state AS INTEGER) AS state, {rnd('avg(length)', 'duration')} FROM runs GROUP BY 1, 2")
def _(spark, d):
    return rounded(R.average_durations(labelled(spark, d)))


@query("transition_counts", f"WITH {_RUNS} SELECT symbol, CAST(sum(c) AS BIGINT) AS transitions FROM chg GROUP BY 1")
def _(spark, d):
    return R.transition_counts(labelled(spark, d))


@query("crosstab", f"""WITH {STATES}, l4 AS (SELECT *, ntile(4) OVER (PARTITION BY symbol ORDER BY ret, event_id) - 1 AS s4 FROM labels3)
SELECT symbol, CAST(state AS INTEGER) AS "row", {', '.join(f'count(*) FILTER (s4 = {k}) AS col_{k}' for k in range(4))} FROM l4 GROUP BY symbol, state""")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("ret", "event_id")
    return R.crosstab(labelled(spark, d).withColumn("s4", F.ntile(4).over(w) - 1), "state", "s4", [0, 1, 2, 3])


_DSTATE = DAILY + ", dstate AS (SELECT symbol, dt, CAST(sign(ret) AS INTEGER) AS state, ret FROM drets)"


def _daily_state(spark, d):
    return daily_returns(spark, d).select("symbol", "dt", F.signum("ret").cast("int").alias("state"), "ret")


@query("agreement_matrix", f"WITH {_DSTATE} SELECT i.symbol AS symbol_i, j.symbol AS symbol_j, {rnd('avg((i.state = j.state)::DOUBLE)', 'agreement')} FROM dstate i JOIN dstate j USING (dt) GROUP BY 1, 2")
def _(spark, d):
    return rounded(R.agreement_matrix(_daily_state(spark, d), "dt"))


@query("posterior_corr", f"WITH {_DSTATE} SELECT i.symbol AS symbol_i, j.symbol AS symbol_j, {rnd('coalesce(corr(i.ret, j.ret), 0)', 'correlation')} FROM dstate i JOIN dstate j USING (dt) GROUP BY 1, 2")
def _(spark, d):
    return rounded(R.correlation_matrix(_daily_state(spark, d), "dt", "ret"))


# Joins and searches

_JUMPS = RETURNS + """,
dj AS (SELECT *, ret - lag(ret) OVER (PARTITION BY symbol ORDER BY seq) AS d FROM rets),
found AS (SELECT symbol, seq FROM dj QUALIFY abs(d) > 2 * stddev_pop(d) OVER (PARTITION BY symbol)),
truth AS (SELECT symbol, seq FROM rets QUALIFY abs(ret) > 2 * stddev_pop(ret) OVER (PARTITION BY symbol))"""


def _jumps(spark, d):
    df = returns(spark, d)
    deviation = F.stddev_pop("ret").over(Window.partitionBy("symbol"))
    true = df.withColumn("__d", deviation).where(F.abs("ret") > 2 * F.col("__d")).select("symbol", "seq")
    return true, S.jumps(df, "ret").where("is_jump").select("symbol", "seq")


@query("jump_hits", f"WITH {_JUMPS} SELECT symbol, seq FROM truth t WHERE EXISTS (SELECT 1 FROM found f WHERE f.symbol = t.symbol AND abs(f.seq - t.seq) <= 2)")
def _(spark, d):
    return R.jump_hits(*_jumps(spark, d)).select("symbol", "seq")


@query("jump_false_positives", f"WITH {_JUMPS} SELECT symbol, seq FROM found f WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE f.symbol = t.symbol AND abs(f.seq - t.seq) <= 2)")
def _(spark, d):
    return R.jump_false_positives(*_jumps(spark, d)).select("symbol", "seq")


@query("grid_cross_join", f"""WITH {RETURNS}, n AS (SELECT symbol, stddev_pop(ret) AS s FROM rets GROUP BY 1),
g AS (SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INTEGER) AS grid_idx, CAST(theta AS DOUBLE) AS theta, CAST(l AS DOUBLE) AS "lambda_J", CAST(alpha AS DOUBLE) AS alpha FROM (VALUES (0, -0.05), (1, -0.2), (2, -1.0)) t(a, theta), (VALUES (0, 0.0), (1, 0.05)) l(b, l), (VALUES (0, 0.06), (1, 0.1)) m(c, alpha))
SELECT symbol, grid_idx, theta, "lambda_J", alpha, {rnd('s * sqrt(2 * abs(theta))', 'sigma', 8)} FROM n, g""")
def _(spark, d):
    """Every series with every point of a grid, and the deviation that a point's theta takes from the series' own."""
    grid = R.parameter_grid(spark, theta=[-0.05, -0.2, -1.0], lambda_J=[0.0, 0.05], alpha=[0.06, 0.1])
    own = returns(spark, d).groupBy("symbol").agg(F.stddev_pop("ret").alias("s"))
    return rounded(own.crossJoin(F.broadcast(grid)).withColumn("sigma", F.col("s") * F.sqrt(2 * F.abs("theta"))).drop("s"), digits=8)


@query("top_k", f"{_METRICS % rnd(_SHARPE, 'sharpe')} ORDER BY sharpe DESC, symbol LIMIT 3")
def _(spark, d):
    return R.top_k(backtest_metrics(spark, d).select("symbol", "sharpe"), "sharpe", 3, "symbol")


@query("best_row", f"WITH {RETURNS} SELECT symbol, event_id, {rnd('ret', 'ret', 9)} FROM rets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ret DESC, seq) = 1")
def _(spark, d):
    return rounded(R.best_by(returns(spark, d), "ret", "seq", "symbol"), "symbol", "event_id", "ret", digits=9)


@query("survivors", f"SELECT symbol, sharpe FROM ({_METRICS % rnd(_SHARPE, 'sharpe')}) QUALIFY sharpe > 0 OR (NOT bool_or(sharpe > 0) OVER () AND row_number() OVER (ORDER BY sharpe DESC, symbol) <= 5)")
def _(spark, d):
    return P.survivors(backtest_metrics(spark, d).select("symbol", "sharpe"), "sharpe", 5, "symbol")


@query("survivors_fallback", f"SELECT symbol, loss FROM (SELECT symbol, -1 - abs(sharpe) AS loss FROM ({_METRICS % rnd(_SHARPE, 'sharpe')})) QUALIFY row_number() OVER (ORDER BY loss DESC, symbol) <= 2")
def _(spark, d):
    return P.survivors(backtest_metrics(spark, d).select("symbol", (-1 - F.abs("sharpe")).alias("loss")), "loss", 2, "symbol")


@query("window_summary", f"""WITH {BACKTEST}, dd AS (SELECT *, cumulative / max(cumulative) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve),
own AS (SELECT symbol, {_SHARPE} AS sharpe, -min(dd) AS mdd FROM dd GROUP BY 1),
hold AS (SELECT symbol, seq, CASE WHEN seq = 1 THEN 0 ELSE ret END AS net FROM rets),
held AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM hold),
falls AS (SELECT *, c / max(c) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM held),
bench AS (SELECT symbol, {_SHARPE} AS b_sharpe, -min(dd) AS b_mdd FROM falls GROUP BY 1)
SELECT {rnd('avg((sharpe > b_sharpe)::DOUBLE)', 'win_rate')}, {rnd('avg(sharpe - b_sharpe)', 'mean_gain', 5)}, {rnd('avg(b_mdd - mdd)', 'mean_relief', 5)}, count(*) FILTER (b_mdd > mdd) AS relieved FROM own JOIN bench USING (symbol)""")
def _(spark, d):
    own = backtested(spark, d).select("symbol", "sharpe", "max_drawdown")
    hold = BT.metrics(BT.backtest(returns(spark, d).withColumn("signal", F.lit(1.0)), 0)).select("symbol", F.col("sharpe").alias("benchmark_sharpe"), F.col("max_drawdown").alias("benchmark_drawdown"))
    out = R.window_summary(own.join(hold, "symbol"))
    return out.select(r("win_rate", 6, "win_rate"), r("mean_gain", 5, "mean_gain"), r("mean_relief", 5, "mean_relief"), "relieved")


@query("concatenated_windows", f"""WITH {DAILY}, b AS (SELECT *, CAST(min(dt) OVER (PARTITION BY symbol) + INTERVAL 36 MONTH AS DATE) AS f FROM drets)
SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS place, {rnd('ret', 'ret', 8)} FROM b WHERE dt >= f""")
def _(spark, d):
    test = R.expanding_windows(daily_returns(spark, d), "dt", 36, 6).where("part = 'test'")
    return test.select("symbol", "dt", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")).cast("long").alias("place"), r("ret", 8, "ret"))


@query("expanding_windows", f"""WITH {_DSIG}, b AS (SELECT *, min(dt) OVER (PARTITION BY symbol) AS f, max(dt) OVER (PARTITION BY symbol) AS l FROM drets),
w AS (SELECT *, unnest(generate_series(0, 40)) AS k FROM b), s AS (SELECT *, CAST(f + to_months(CAST(36 + 6 * k AS INTEGER)) AS DATE) AS test_start FROM w)
SELECT symbol, CAST(k AS INTEGER) AS window_id, test_start, count(*) FILTER (dt < test_start) AS n_train, count(*) FILTER (dt >= test_start) AS n_test FROM s
WHERE test_start <= l AND dt < test_start + INTERVAL 6 MONTH GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = R.expanding_windows(daily_returns(spark, d), "dt", 36, 6)
    return rows.groupBy("symbol", "window_id", "test_start").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))


@query("aic_bic", f"{_HMM} SELECT symbol, {rnd('-2 * sum(gain) + 2 * 7', 'aic', 4)}, {rnd('-2 * sum(gain) + 7 * ln(count(*))', 'bic', 4)} FROM fwd GROUP BY 1")
def _(spark, d):
    ll, k = F.col("ll"), F.lit(2)
    return H.likelihoods(user_returns(spark, d), A2, PI2, MU2, S2).select("symbol", r(R.aic(ll, k), 4, "aic"), r(R.bic(ll, k, F.col("n")), 4, "bic"))


# Fits and samplers: SQL cannot express them; tests hold them against identities


@query("em_fit")
def _(spark, d):
    return H.fit(returns(spark, d), 3).select("symbol", "k", "mu", "sigma2", "A", "ll", "n_iter")


@query("select_k")
def _(spark, d):
    return H.select_k(daily_returns(spark, d), [1, 2, 3, 4, 5])


@query("gibbs")
def _(spark, d):
    return H.posterior_summary(H.gibbs(daily_returns(spark, d), 3))


@query("expected_durations", f"""WITH {STATES}, m AS (SELECT symbol, CAST(state AS INTEGER) AS state, lead(state) OVER (PARTITION BY symbol ORDER BY seq) AS later FROM labels3)
SELECT symbol, state, {rnd('1.0 / greatest(1 - count(*) FILTER (state = later) / count(*), 1e-12)', 'duration')} FROM m WHERE later IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    """From moves between states as counted in each series."""
    moves = labelled(spark, d).select("symbol", "state", F.lead("state").over(P.by_time()).alias("into")).where("into IS NOT NULL")
    whole = Window.partitionBy("symbol", "state")
    shares = moves.groupBy("symbol", "state", "into").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(whole))
    row = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    rows = shares.groupBy("symbol", "state").agg(F.map_from_entries(F.collect_list(F.struct("into", "share"))).alias("m")).select("symbol", "state", row.alias("row"))
    models = rows.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "row"))), lambda x: x["row"]).alias("A"))
    return rounded(H.expected_durations(models))


@query("fitted_durations")
def _(spark, d):
    return H.expected_durations(H.fit(daily_returns(spark, d), 2))


@query("fit_retried")
def _(spark, d):
    return H.fit_retried(daily_returns(spark, d), [3]).select("symbol", "k", "mu", "sigma2", "A", "ll", "n_iter", "attempts")


@query("stationary")
def _(spark, d):
    return H.stationary(H.fit(daily_returns(spark, d), 2))


@query("particle_filter")
def _(spark, d):
    return SS.particle_filters(user_returns(spark, d), LANGEVIN, 200, "bootstrap").select("symbol", "event_id", "level", "trend", "ll")


@query("rbpf")
def _(spark, d):
    return SS.particle_filters(user_returns(spark, d), LANGEVIN, 200).select("symbol", "event_id", "level", "trend", "ll", "n_eff", "jump_share")


@query("rbpf_grid")
def _(spark, d):
    grid = R.parameter_grid(spark, theta=[-0.05, -0.1, -0.2, -0.5, -1.0, -2.0], sigma=[0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0], sigma_obs=[1.0, 5.0, 10.0, 20.0, 50.0, 100.0], lambda_J=[0.0, 0.05])
    return SS.searched(ticks(spark, d), grid, LANGEVIN, n=20)


@query("last_price_diagnostics", f"""WITH {RETURNS}, x AS (SELECT symbol, price - lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS e FROM rets)
SELECT symbol, {rnd('sqrt(avg(e * e))', 'rmse', 5)}, {rnd('avg((abs(e) <= 50)::DOUBLE)', 'within_2')}, {rnd('avg((abs(e) > 50)::DOUBLE)', 'outside_2')}, {rnd('avg(e)', 'mean', 5)}, {rnd('stddev_pop(e)', 'std', 5)} FROM x WHERE e IS NOT NULL GROUP BY 1""")
def _(spark, d):
    last = returns(spark, d).withColumn("last", F.lag("price").over(P.by_time())).where("last IS NOT NULL").withColumn("sd", F.lit(25.0))
    digits = {"within_2": 6, "outside_2": 6}
    out = ST.filter_diagnostics(last, "last", "sd", "price")
    return out.select("symbol", *(r(c, digits.get(c, 5), c) for c in out.columns if c != "symbol"))


@query("filter_diagnostics", _kalman_sql().rpartition("SELECT symbol, event_id")[0] + f"""SELECT symbol, {rnd('sqrt(avg(e * e))', 'rmse', 5)}, {rnd('avg((abs(e / sqrt(c00)) <= 2)::DOUBLE)', 'within_2')}, {rnd('avg((abs(e / sqrt(c00)) > 2)::DOUBLE)', 'outside_2')}, {rnd('avg(e)', 'mean', 5)}, {rnd('stddev_pop(e)', 'std', 5)}
FROM (SELECT k.symbol, c.price - k.m0 AS e, k.c00 FROM k JOIN c ON c.symbol = k.symbol AND c.seq = k.seq) GROUP BY 1""")
def _(spark, d):
    """How far prices lie from the filtered level of each series."""
    out = SS.kalman_filter(user_returns(spark, d), -0.2, 5.0, 20.0, (None, 0.0), ((100.0, 0.0), (0.0, 25.0)))
    found = ST.filter_diagnostics(out.withColumn("sd", F.sqrt("level_var")), "level", "sd", "price")
    return found.select("symbol", *(r(c, n, c) for c, n in (("rmse", 5), ("within_2", 6), ("outside_2", 6), ("mean", 5), ("std", 5))))


from tidemark.plans import regimes as _regime_plans  # noqa: E402
from tidemark.plans import trends as _trend_plans  # noqa: E402

_LOG_DAILY = DAILY + """,
ld AS MATERIALIZED (SELECT symbol, dt, seq - 1 AS seq, ln(close / prev) AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM dseq) WHERE seq > 1)"""
_EXPLORATION = f"""WITH RECURSIVE {_LOG_DAILY},
m AS (SELECT symbol, avg(ret) AS m, stddev_pop(ret) AS s FROM ld GROUP BY 1),
mo AS (SELECT symbol, {rnd('any_value(m)', 'mean', 9)}, {rnd('any_value(s)', 'std', 9)}, {rnd('avg(pow((ret - m) / s, 3))', 'skew', 5)}, {rnd('avg(pow((ret - m) / s, 4)) - 3', 'kurtosis', 5)} FROM ld JOIN m USING (symbol) GROUP BY 1),
ex AS (SELECT symbol, min_by(dt, ROW(ret, dt)) AS worst_at, {rnd('min(ret)', 'worst', 8)}, min_by(dt, ROW(-ret, dt)) AS best_at, {rnd('max(ret)', 'best', 8)} FROM ld GROUP BY 1),
pe AS (SELECT symbol, {', '.join(rnd(f'quantile_cont(ret, {p / 100})', f'p{p:02d}', 8) for p in ST.PERCENTILES)} FROM ld GROUP BY 1),
rec AS (SELECT symbol, seq, ret * ret AS x FROM ld WHERE seq = 1
UNION ALL SELECT c.symbol, c.seq, 0.94 * rec.x + (1 - 0.94) * p.ret * p.ret FROM rec JOIN ld c ON c.symbol = rec.symbol AND c.seq = rec.seq + 1 JOIN ld p ON p.symbol = rec.symbol AND p.seq = rec.seq),
vo AS (SELECT symbol, {', '.join(rnd(f'{f}(sqrt(252 * x))', f'vol_{n}') for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg')))} FROM rec GROUP BY 1)
SELECT * FROM mo JOIN ex USING (symbol) JOIN pe USING (symbol) JOIN vo USING (symbol)"""


def _exploration(spark, d):
    digits = {"mean": 9, "std": 9, "skew": 5, "kurtosis": 5, "worst": 8, "best": 8} | {f"p{p:02d}": 8 for p in ST.PERCENTILES}
    out = _regime_plans.exploration(spark, d)
    return out.select(*(r(c, digits.get(c, 6), c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


_RTH = RETURNS.replace("FROM events)", f"FROM events WHERE isodow({_NY}) <= 5 AND hour({_NY}) * 60 + minute({_NY}) BETWEEN 570 AND 959)")
_SIZES = ", ".join(f"('{f}', {n})" for f, n in _regime_plans.FREQUENCIES.items())
_BARS = ", ".join(f"('{f}', {n})" for f, n in ST.BARS_PER_YEAR.items())
_value = lambda e: f"CASE WHEN abs({e}) >= 1000 THEN round({e}, 3) ELSE round({e}, 5) END + 0.0"
_AUTOCORRELATION = f"""WITH {_RTH}, sizes(freq, size) AS (VALUES {_SIZES}), bars(freq, bars) AS (VALUES {_BARS}),
d AS (SELECT symbol, seq, ret, ts, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY seq) - 1 AS place FROM rets),
blk AS (SELECT symbol, freq, day, CASE WHEN size > 0 THEN place // greatest(size, 1) ELSE 0 END AS block, sum(ret) AS ret FROM d, sizes GROUP BY symbol, freq, size, day, 4 HAVING size = 0 OR count(*) = size),
f AS (SELECT symbol, freq, ret, row_number() OVER (PARTITION BY symbol, freq ORDER BY day, block) AS seq FROM blk),
ctr AS MATERIALIZED (SELECT symbol, freq, seq, ret - avg(ret) OVER (PARTITION BY symbol, freq) AS x FROM f),
s0 AS (SELECT symbol, freq, count(*) AS n, sum(x * x) AS s0 FROM ctr GROUP BY 1, 2),
sums AS (SELECT a.symbol, a.freq, k.lag, sum(a.x * b.x) AS s FROM ctr a, range(1, 31) k(lag), ctr b WHERE b.symbol = a.symbol AND b.freq = a.freq AND b.seq = a.seq + k.lag GROUP BY 1, 2, 3),
acfs AS (SELECT symbol, freq, n, lag, CASE WHEN s0 / n < 1e-15 THEN 0 ELSE coalesce(s, 0) / s0 END AS acf FROM (s0 CROSS JOIN range(1, 31) k(lag)) LEFT JOIN sums USING (symbol, freq, lag)),
q AS (SELECT symbol, freq, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) FILTER (lag < n) AS q, max(acf) FILTER (lag = 1) AS acf1 FROM acfs GROUP BY 1, 2),
p AS (SELECT symbol, freq, exp(-any_value(q) / 2) * sum(pow(q / 2, j) / gamma(j + 1)) AS p FROM q, range(0, 15) r(j) GROUP BY 1, 2),
z AS (SELECT symbol, freq, CASE WHEN stddev_pop(ret) > 0 THEN abs(avg(ret)) / stddev_pop(ret) END AS snr, stddev_pop(ret) * sqrt(any_value(bars)) AS vol FROM f JOIN bars USING (freq) GROUP BY 1, 2),
hb AS (SELECT symbol, h, sum(ret) AS b FROM rets, (SELECT unnest([{', '.join(map(str, _regime_plans.HORIZONS))}]) AS h) GROUP BY symbol, h, (seq - 1) // h HAVING count(*) = h),
hv AS (SELECT symbol, h, var_samp(b) AS vq, count(*) AS blocks FROM hb GROUP BY 1, 2),
vr AS (SELECT o.symbol, o.h, CASE WHEN v1 < 1e-15 THEN 1 WHEN blocks >= 2 THEN vq / (o.h * v1) END AS ratio FROM (SELECT symbol, var_samp(ret) AS v1, unnest([{', '.join(map(str, _regime_plans.HORIZONS))}]) AS h FROM rets GROUP BY 1) o LEFT JOIN hv USING (symbol, h)),
mi AS (SELECT symbol, hour(ts) * 60 + minute(ts) AS minute, avg(abs(ret)) AS a FROM rets GROUP BY 1, 2 HAVING count(*) > 10),
pk AS (SELECT symbol, max_by(minute, ROW(a, -minute)) AS peak, min_by(minute, ROW(a, minute)) AS trough FROM mi GROUP BY 1),
listed AS (SELECT symbol, 'ljung_box' AS kind, freq AS "at", q AS value FROM q UNION ALL SELECT symbol, 'acf1', freq, acf1 FROM q UNION ALL SELECT symbol, 'p_value', freq, p FROM p UNION ALL SELECT symbol, 'snr', freq, snr FROM z UNION ALL SELECT symbol, 'annual_vol', freq, vol FROM z
UNION ALL SELECT symbol, 'variance_ratio', h::VARCHAR, ratio FROM vr UNION ALL SELECT symbol, 'peak', 'minute', peak FROM pk UNION ALL SELECT symbol, 'trough', 'minute', trough FROM pk)
SELECT symbol, kind, "at", {_value("value")} AS value FROM listed"""


def _autocorrelation(spark, d):
    value = F.col("value")
    return _regime_plans.autocorrelation(spark, d).withColumn("value", F.when(F.abs(value) >= 1000, F.round(value, 3)).otherwise(F.round(value, 5)) + 0.0)


_SQL_PLANS = {"plan_exploration": (_exploration, _EXPLORATION), "plan_autocorrelation": (_autocorrelation, _AUTOCORRELATION)}
for _name, _plan in {**_regime_plans.PLANS, **_trend_plans.PLANS}.items():
    _plan, _sql = _SQL_PLANS.get(_name, (_plan, None))
    query(_name, _sql)(_plan)
