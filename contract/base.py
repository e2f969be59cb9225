"""Inputs of the registered queries, in Spark and in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.constants import REGIMES
from tickforge.operators.bars import ticks_to_bars, value_bars
from tickforge.operators.events import DayEvents, calendar_of
from tickforge.operators.series import segment
from tickforge.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# ── Spark inputs ────────────────────────────────────────────────────────────

def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark, sf):
    bid = F.greatest("value", F.lit(0.01))
    return table(spark, sf, "events").select(
        F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        bid.alias("bid"), (bid + 0.2).alias("ask"))


def bars(spark, sf, width="1 hour"):
    return ticks_to_bars(ticks(spark, sf), width)


def seg(spark, sf, **kw):
    return segment(bars(spark, sf), **kw)


def daily(spark, sf):
    """Daily bars of lineitem prices per supplier; line order breaks ties inside a day."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("sym"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return value_bars(rows, "1 day", "price", F.col("qty"), F.col("seq"))


def calendar(spark) -> DayEvents:
    return calendar_of(spark, [2024])


def probs(spark, sf):
    """Shared arithmetic probabilities and outcomes per event."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("time"),
        ((F.col("event_id") * 37 % 1000) / F.lit(1000.0)).alias("p"), (F.col("value") > 40).cast("double").alias("y"),
        F.col("value"), (F.col("event_id") % 2).cast("double").alias("direction"))


def _m(mult: int, mod: int, scale: float, shift: float = 0.0) -> Column:
    return (F.col("event_id") * mult % mod) / F.lit(scale) + F.lit(shift)


FEATS = {"trend_ema": (37, 600, 100.0, -3.0), "trend_slope": (53, 200, 100.0, -1.0), "bb_pctile": (29, 100, 100.0, 0.0),
         "atr_pctile": (31, 100, 100.0, 0.0), "vol_spike": (41, 300, 100.0, 0.0), "news_candle": (43, 60, 100.0, 0.0),
         "spread_z": (47, 300, 100.0, 0.0), "rsi_14": (59, 100, 1.0, 0.0)}


def outcomes(spark, sf):
    """Outcome journal derived from events; the amount comes out of the JSON column."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "k int")["k"]
    names = F.array(*[F.lit(r) for r in REGIMES])
    kind = F.col("event_id") % 3
    feats = F.create_map(*[x for n, a in FEATS.items() for x in (F.lit(n), _m(*a))])
    return e.select(
        "event_id", F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("time"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"),
        F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("dir"),
        F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.0).alias("direction"),
        F.col("value").alias("entry"), (F.col("value") - 5).alias("sl"), (F.col("value") + 5).alias("tp"),
        F.when(kind == 0, k / F.lit(10.0)).when(kind == 1, -k / F.lit(10.0)).otherwise(0.0).alias("pnl"),
        F.when(kind == 0, "TP").when(kind == 1, "SL").otherwise("UNVERIFIED").alias("result"),
        _m(37, 1000, 1000.0).alias("conf"),
        F.get(names, (F.col("event_id") % 8).cast("int")).alias("regime"), _m(13, 40, 10.0, 0.5).alias("sl_atr"),
        F.struct(F.lit(0.0).alias("day_pnl"), F.lit(0.0).alias("streak"), F.lit(0.0).alias("trades_today")).alias("state"),
        feats.alias("feats"))


PRIOR_ROWS = [(r, d, 1.5 + 0.1 * i, 1.4, 2.0 + 0.2 * i, 2.5, 0.8 + 0.1 * i) for i, r in enumerate(REGIMES) for d in (1.0, 0.0)]


def prior(spark, rows=None):
    return spark.createDataFrame(
        rows or PRIOR_ROWS, "regime string, direction double, sl_atr double, tp_ratio double, mfe_p50 double, mfa_p90 double, mfa_p50 double")


def epoch(name="time"):
    return F.unix_seconds(name).alias("t")


def rd(*names: str, d: int = 6):
    return [F.round(F.col(n).cast("double"), d).alias(n) for n in names]


# ── oracle SQL ──────────────────────────────────────────────────────────────

TICKS = """ticks AS (SELECT event_type AS sym, ts, event_id, greatest(value, 0.01) AS bid,
  greatest(value, 0.01) + 0.2 AS ask, value, props FROM events)"""


def sql_bars(trunc="hour"):
    return TICKS + f""", bars AS MATERIALIZED (SELECT sym, date_trunc('{trunc}', ts) AS time, arg_min(bid, ts) AS open, max(bid) AS high,
  min(bid) AS low, arg_max(bid, ts) AS close, (count(*) - 1)::DOUBLE AS tick_volume,
  arg_max(round_even((ask - bid) * 100, 0), ts) AS spread, 0.0::DOUBLE AS real_volume FROM ticks GROUP BY 1, 2)"""


BARS = sql_bars()


def sql_seg(gap=21600, src="bars"):
    return f"""seg0 AS (SELECT *, CASE WHEN epoch(time) - epoch(lag(time) OVER (PARTITION BY sym ORDER BY time)) > {gap} THEN 1 ELSE 0 END AS g FROM {src}),
 seg1 AS (SELECT *, sum(g) OVER (PARTITION BY sym ORDER BY time)::BIGINT AS period_id FROM seg0),
 seg AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sym, period_id ORDER BY time) - 1 AS rn,
   count(*) OVER (PARTITION BY sym, period_id) AS period_rows, {lagc('close', 1)} AS c1, {lagc('high', 1)} AS h1,
   {lagc('low', 1)} AS l1, {lagc('open', 1)} AS o1 FROM seg1)"""


PW = "PARTITION BY sym, period_id ORDER BY time"


def lagc(c, n):
    return f"lag({c}, {n}) OVER ({PW})"


def roll(agg, expr, n, valid=None):
    first = n - 1 if valid is None else valid
    return f"CASE WHEN rn >= {first} THEN {agg}({expr}) OVER ({PW} ROWS {n - 1} PRECEDING) END"


def ewm(name, src, specs):
    """Recursive exponential means {out: (expr, alpha)} over (sym, period_id, rn) of src."""
    xs = ", ".join(f"({e}) AS x_{o}" for o, (e, _) in specs.items())
    first = ", ".join(f"x_{o} AS {o}" for o in specs)
    step = ", ".join(f"CASE WHEN e.{o} IS NULL THEN x.x_{o} WHEN x.x_{o} IS NULL THEN e.{o} ELSE e.{o} * (1 - {a}) + {a} * x.x_{o} END"
                     for o, (_, a) in specs.items())
    return f"""x_{name} AS MATERIALIZED (SELECT sym, period_id, rn, {xs} FROM {src}),
 {name} AS (SELECT sym, period_id, rn, {first} FROM x_{name} WHERE rn = 0
  UNION ALL SELECT x.sym, x.period_id, x.rn, {step} FROM {name} e JOIN x_{name} x
  ON x.sym = e.sym AND x.period_id = e.period_id AND x.rn = e.rn + 1)"""


def R(expr, alias, d=6):
    return f"round({expr}, {d}) + 0.0 AS {alias}"


TR = "greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0))"
A14 = "(1.0::DOUBLE/14)"
W = "WITH RECURSIVE "
HEAD = W + BARS + ", " + sql_seg()
ATR = HEAD + ", " + ewm("ea", "seg", {"atr": (TR, A14)}) + \
    ", b AS MATERIALIZED (SELECT s.*, e.atr AS atr_14 FROM seg s JOIN ea e USING (sym, period_id, rn))"
KEY = "sym, epoch(time)::BIGINT AS t"
PROBS = """pr AS (SELECT event_id, event_type AS sym, ts AS time, (event_id * 37 % 1000) / 1000.0::DOUBLE AS p,
 (value > 40)::INT::DOUBLE AS y, value, (event_id % 2)::DOUBLE AS direction FROM events)"""


def _ms(mult, mod, scale, shift):
    return f"((event_id * {mult} % {mod}) / {scale}::DOUBLE + {shift}::DOUBLE)"


_RG = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REGIMES)) + " END"
_K = "regexp_extract(props, '([0-9]+)', 1)::INT"
OUTCOMES = f"""oc AS (SELECT event_id, event_type AS sym, ts AS time, floor(epoch(ts))::DOUBLE AS t,
 CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS dir, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS direction,
 value AS entry, value - 5 AS sl, value + 5 AS tp,
 CASE event_id % 3 WHEN 0 THEN {_K} / 10.0::DOUBLE WHEN 1 THEN -{_K} / 10.0::DOUBLE ELSE 0.0 END AS pnl,
 CASE event_id % 3 WHEN 0 THEN 'TP' WHEN 1 THEN 'SL' ELSE 'UNVERIFIED' END AS result,
 {_ms(37, 1000, 1000.0, 0.0)} AS conf, {_RG} AS regime, {_ms(13, 40, 10.0, 0.5)} AS sl_atr,
 {', '.join(f'{_ms(*a)} AS {n}' for n, a in FEATS.items())} FROM events)"""
def sql_prior(rows):
    return "prior(regime, direction, sl_atr, tp_ratio, mfe_p50, mfa_p90, mfa_p50) AS (VALUES " + ", ".join(
        "('" + r[0] + "', " + ", ".join(f"{x!r}::DOUBLE" for x in r[1:]) + ")" for r in rows) + ")"


PRIOR = sql_prior(PRIOR_ROWS)

# regime inputs of the hourly bars
_RS = ewm("er", "seg", {"atr": (TR, A14), "ema20": ("close", "(2.0::DOUBLE/21)"), "ema50": ("close", "(2.0::DOUBLE/51)"),
                        "ru": ("greatest(close - c1, 0)", A14), "rd": ("greatest(c1 - close, 0)", A14)}).replace(
    "(greatest(close - c1, 0)) AS x_ru", "(CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END) AS x_ru").replace(
    "(greatest(c1 - close, 0)) AS x_rd", "(CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END) AS x_rd")


def pctrank(col, valid):
    return (f"CASE WHEN rn >= {valid} THEN (len(list_filter(l_{col}, lambda v: v < {col})) + len(list_filter(l_{col}, lambda v: v <= {col})) + 1)"
            f" / 400.0::DOUBLE END")


RX = HEAD + ", " + _RS + f""",
 r1 AS MATERIALIZED (SELECT s.*, e.atr AS atr_14, ema20, ema50, ru, rd, {lagc('ema20', 5)} AS ema20_5,
   {roll('avg', '(close > ema50)::INT::DOUBLE', 20)} AS above_ema50,
   {roll('stddev_samp', 'close', 20)} * 2 / ({roll('avg', 'close', 20)}) * 100 AS bb_w_20,
   (tick_volume - ({roll('avg', 'tick_volume', 20)})) / (({roll('stddev_samp', 'tick_volume', 20)}) + 1e-9) AS vol_z,
   abs(close - open) / (e.atr + 1e-9) AS body_atr,
   (spread - ({roll('avg', 'spread', 100)})) / (({roll('stddev_samp', 'spread', 100)}) + 1e-9) AS spread_z,
   (close - ({roll('min', 'low', 20)})) / (({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}) + 1e-9) AS range_pos
   FROM seg s JOIN er e USING (sym, period_id, rn)),
 r2 AS MATERIALIZED (SELECT *, (ema20 - ema50) / (atr_14 + 1e-9) AS trend_ema, (ema20 - ema20_5) / (atr_14 + 1e-9) AS trend_slope,
   100 - 100 / (1 + ru / (rd + 1e-9)) AS rsi_14, vol_z AS vol_spike,
   {roll('avg', '(body_atr > 2.5)::INT::DOUBLE', 5)} AS news_candle,
   list(bb_w_20) OVER ({PW} ROWS 199 PRECEDING) AS l_bb_w_20, list(atr_14) OVER ({PW} ROWS 199 PRECEDING) AS l_atr_14 FROM r1),
 r3 AS MATERIALIZED (SELECT * EXCLUDE (l_bb_w_20, l_atr_14), {pctrank('bb_w_20', 218)} AS bb_pctile, {pctrank('atr_14', 199)} AS atr_pctile FROM r2)"""


def sql_regime(src="r3"):
    te, ts = "coalesce(trend_ema, 0)", "coalesce(trend_slope, 0)"
    vs, ns = "coalesce(vol_spike, 0)", "coalesce(news_candle, 0)"
    ap, bb, rsi = "coalesce(atr_pctile, 0.5)", "coalesce(bb_pctile, 0.5)", "coalesce(rsi_14, 50)"
    return f"""SELECT *, CASE WHEN {te} > 1.2 AND {te} * {ts} > 0 THEN 'STRONG_UP' WHEN {te} > 0.4 THEN 'UP'
 WHEN {te} < -1.2 AND {te} * {ts} > 0 THEN 'STRONG_DOWN' WHEN {te} < -0.4 THEN 'DOWN'
 WHEN {vs} > 2.0 OR {ns} > 0.4 OR {ap} > 0.85 THEN 'HIGH_VOL' WHEN {ap} < 0.15 AND {ns} < 0.2 THEN 'QUIET_LOW_VOL'
 WHEN {bb} < 0.35 THEN 'RANGE_TIGHT' WHEN {rsi} > 60 AND {vs} > 1.2 THEN 'UP' WHEN {rsi} < 40 AND {vs} > 1.2 THEN 'DOWN'
 ELSE 'RANGE_WIDE' END AS regime FROM {src}"""


REG = RX + ", rg AS MATERIALIZED (" + sql_regime() + ")"

# forward pairs and grid outcomes on frame b (needs rn, atr_14, close, high, low)
CELLS = "cells AS (SELECT m AS sl_mult, r AS tp_ratio, d AS direction FROM unnest([0.8,1.2,1.8,2.6,3.4,4.5]::DOUBLE[]) a(m), unnest([1.3,1.8,2.5,3.0,4.0,5.5,7.0]::DOUBLE[]) c(r), unnest([1.0,0.0]::DOUBLE[]) e(d))"


def sql_levels(src):
    return f"""lv AS MATERIALIZED (SELECT s.sym, s.period_id, s.rn, s.time, s.close, s.atr_14, sl_mult, tp_ratio, direction,
   greatest(s.atr_14 * sl_mult, 0.30) AS sl_dist, (greatest(s.atr_14 * sl_mult, 0.30) + s.spread / 100.0) * tp_ratio AS tp_dist FROM {src} s, cells),
 lw AS MATERIALIZED (SELECT *, CASE WHEN direction = 1 THEN close + 0.2 ELSE close END AS entry,
   CASE WHEN direction = 1 THEN close + 0.2 - sl_dist - 0.2 ELSE close + sl_dist + 0.2 END AS sl,
   CASE WHEN direction = 1 THEN close + 0.2 + tp_dist ELSE close - tp_dist END AS tp FROM lv)"""


def sql_touch(src, levels, horizon):
    """hit(sl_k, tp_k): rows ahead (from 1) of the first touches; last_close of the horizon."""
    return f"""fw AS MATERIALIZED (SELECT a.sym, a.period_id, a.rn, f.rn - a.rn AS k, f.high, f.low, f.close AS fc FROM {src} a JOIN {src} f
   ON a.sym = f.sym AND a.period_id = f.period_id AND f.rn BETWEEN a.rn + 1 AND a.rn + {horizon}),
 ht AS MATERIALIZED (SELECT l.*, h.sl_k, h.tp_k, h.last_close, h.n_ahead FROM {levels} l JOIN (
   SELECT l.sym, l.period_id, l.rn, l.sl_mult, l.tp_ratio, l.direction,
     min(CASE WHEN direction = 1 AND low <= sl OR direction = 0 AND high >= sl THEN k END) AS sl_k,
     min(CASE WHEN direction = 1 AND high >= tp OR direction = 0 AND low <= tp THEN k END) AS tp_k,
     arg_max(fc, k) AS last_close, max(k) AS n_ahead
   FROM {levels} l JOIN fw USING (sym, period_id, rn) GROUP BY ALL) h USING (sym, period_id, rn, sl_mult, tp_ratio, direction)),
 tg AS MATERIALIZED (SELECT *, CASE WHEN sl_k IS NULL AND tp_k IS NULL THEN
     CASE WHEN direction = 1 THEN last_close > entry ELSE last_close < entry END
   ELSE sl_k IS NULL OR coalesce(tp_k < sl_k, false) END::INT::DOUBLE AS target,
   coalesce(least(sl_k, tp_k), n_ahead + 1) AS res_k FROM ht)"""


def sql_excursions():
    return """ex AS MATERIALIZED (SELECT t.sym, t.period_id, t.rn, t.sl_mult, t.tp_ratio, t.direction,
   max(CASE WHEN t.direction = 1 THEN f.high - entry ELSE entry - f.low END / CASE WHEN atr_14 > 0 THEN atr_14 ELSE 1 END) AS mfe_atr,
   max(CASE WHEN t.direction = 1 THEN entry - f.low ELSE f.high - entry END / CASE WHEN atr_14 > 0 THEN atr_14 ELSE 1 END) AS mfa_atr
   FROM tg t JOIN fw f ON f.sym = t.sym AND f.period_id = t.period_id AND f.rn = t.rn AND f.k < t.res_k GROUP BY ALL),
 mx AS MATERIALIZED (SELECT t.*, mfe_atr, mfa_atr FROM tg t LEFT JOIN ex USING (sym, period_id, rn, sl_mult, tp_ratio, direction))"""
