"""Registered queries: sources, bars, features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contract.base import (
    A14, ATR, BARS, HEAD, KEY, PW, R, RX, TICKS, TR, W, bars, calendar, daily, epoch, ewm, lagc, query, rd, roll, seg,
    sql_bars, sql_seg, table, ticks,
)
from tickforge.operators import bars as B
from tickforge.operators import events as EV
from tickforge.constants import RAW_PRICE_COLS
from tickforge.operators.features import GROUPS, NEEDS_BINS, complete_rows, features, market_columns
from tickforge.operators.series import segment
from tickforge.session import checkpointed, shared_folder
from tickforge.sources.readers import read_bars_csv, read_live_bars, schema_fingerprint

OHLC = ["open", "high", "low", "close", "tick_volume", "spread"]
OHLC_SQL = "open, high, low, close, tick_volume, spread"


@query("ticks_to_bars", "WITH " + sql_bars("minute") + f" SELECT {KEY}, {OHLC_SQL} FROM bars")
def _(spark, sf):
    return bars(spark, sf, "1 minute").select("sym", epoch(), *OHLC)


@query("bars_tf", "WITH " + sql_bars("minute") + f""" SELECT sym, epoch(time_bucket(INTERVAL 5 MINUTES, time))::BIGINT AS t, arg_min(open, time) AS open,
 max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(tick_volume) AS tick_volume, avg(spread) AS spread FROM bars GROUP BY 1, 2""")
def _(spark, sf):
    return B.resample(bars(spark, sf, "1 minute"), "5 minutes").select("sym", epoch(), *OHLC)


DAILY_SQL = """bars AS MATERIALIZED (SELECT l_suppkey::VARCHAR AS sym, l_shipdate AS time, arg_min(l_extendedprice, l_orderkey * 8 + l_linenumber) AS open,
 max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, l_orderkey * 8 + l_linenumber) AS close,
 sum(l_quantity) AS tick_volume, 20.0::DOUBLE AS spread, 0.0::DOUBLE AS real_volume FROM lineitem GROUP BY 1, 2)"""


@query("daily_bars", f"WITH {DAILY_SQL} SELECT {KEY}, {OHLC_SQL} FROM bars")
def _(spark, sf):
    return daily(spark, sf).select("sym", epoch(), *OHLC)


@query("bar_scan", "SELECT l_returnflag AS sym, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"))
    return li.groupBy(F.col("l_returnflag").alias("sym")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def written(df, kind, **options):
    """Writes a table for a reader in the shared folder; returns its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(path)
    return path


@query("csv_scan", "SELECT l_returnflag AS sym, year(l_shipdate) AS y, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    """The table written as CSV in another order of columns and read back by its header."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("note"), F.col("l_shipdate").cast("timestamp").alias("time"), F.col("l_returnflag").alias("sym"))
    got = read_bars_csv(spark, written(li, "csv", header=True), ["sym", "time", "close"])
    return got.groupBy("sym", F.year("time").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("live_scan", "SELECT count(*) AS n, sum(floor(epoch(ts)))::BIGINT AS t, round(sum(value), 4) AS total, sum(event_id % 100)::DOUBLE AS volume FROM events")
def _(spark, sf):
    """Ticks written as JSON lines and read back as live bars."""
    e = table(spark, sf, "events").select(
        F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("t"), *[F.col("value").alias(c) for c in "ohlc"],
        F.lit(20).alias("spread"), (F.col("event_id") % 100).cast("int").alias("v"))
    got = read_live_bars(spark, written(e, "json"), "ALL")
    return got.agg(F.count("*").alias("n"), F.sum(F.unix_seconds("time")).alias("t"), F.round(F.sum("open"), 4).alias("total"), F.sum("tick_volume").alias("volume"))


@query("json_scan", "SELECT event_type AS sym, sum(regexp_extract(props, '([0-9]+)', 1)::INT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy(F.col("event_type").alias("sym")).agg(F.sum("k").alias("k_sum"), F.count("k").alias("n"))


@query("hist_utc_shift", "WITH " + BARS + " SELECT sym, epoch(time)::BIGINT - 10800 AS t, close FROM bars")
def _(spark, sf):
    return B.shift_to_utc(bars(spark, sf), 3.0).select("sym", epoch(), "close")


@query("bar_integrity", "WITH " + sql_bars("minute") + """, d AS (SELECT sym, epoch(time) - epoch(lag(time) OVER (PARTITION BY sym ORDER BY time)) AS g FROM bars)
 SELECT sym, count(*) AS n_bars, count(*) FILTER (g > 120 OR g <= 0) AS bad_gaps, count(*) FILTER (g > 120 OR g <= 0) <= count(*) * 0.02 AS ok FROM d GROUP BY 1""")
def _(spark, sf):
    return B.integrity(bars(spark, sf, "1 minute"))


@query("merge_bars", "WITH " + BARS + f""", s AS (SELECT sym, time, close, 0 AS p FROM bars UNION ALL SELECT sym, time, close + 1, 1 FROM bars WHERE hour(time) < 12
 UNION ALL SELECT sym, time, close + 2, 2 FROM bars WHERE hour(time) < 6), r AS (SELECT *, row_number() OVER (PARTITION BY sym, time ORDER BY p DESC) AS k FROM s)
 SELECT {KEY}, round(close, 6) AS close, p AS src FROM r WHERE k = 1""")
def _(spark, sf):
    b = bars(spark, sf).select("sym", "time", "close")
    hour = F.hour("time")
    parts = [b.withColumn("src", F.lit(0)), b.filter(hour < 12).withColumns({"close": F.col("close") + 1, "src": F.lit(1)}),
             b.filter(hour < 6).withColumns({"close": F.col("close") + 2, "src": F.lit(2)})]
    return B.merge_bars(parts).select("sym", epoch(), *rd("close"), "src")


@query("tail_union", "WITH " + BARS + f""", a AS (SELECT * FROM bars WHERE time < TIMESTAMP '2024-01-20'), e AS (SELECT sym, max(time) AS m FROM a GROUP BY 1)
 SELECT {KEY}, close, 20.0::DOUBLE AS spread, tick_volume AS real_volume FROM a UNION ALL
 SELECT b.sym, epoch(b.time)::BIGINT, round(b.close + 1, 6), b.spread, b.real_volume FROM bars b JOIN e USING (sym) WHERE b.time > e.m""")
def _(spark, sf):
    b = bars(spark, sf)
    old = b.filter(F.col("time") < F.lit("2024-01-20").cast("timestamp")).drop("spread", "real_volume")
    new = b.withColumn("close", F.round(F.col("close") + 1, 6))
    return B.tail_union(old, new).select("sym", epoch(), "close", "spread", "real_volume")


@query("poison_drop", "SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT AS t FROM lineitem WHERE year(l_shipdate) >= 2000")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("time"))
    return B.poison_drop(li).select("l_orderkey", "l_linenumber", epoch())


WINDOWS = [("early", "1996-03-01", "1996-06-30"), ("late", "1999-01-01", "1999-12-31")]


@query("window_pick", f"""WITH {DAILY_SQL}, w(src, a, z) AS (VALUES ('early', TIMESTAMP '1996-03-01', TIMESTAMP '1996-07-01'), ('late', TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-01'))
 SELECT src, year(time)::BIGINT AS year, count(*) AS n FROM bars JOIN w ON time >= a AND time < z GROUP BY 1, 2""")
def _(spark, sf):
    return B.year_coverage(B.pick_windows(daily(spark, sf), WINDOWS)).select("src", F.col("year").cast("bigint").alias("year"), "n")


@query("periods", HEAD + f" SELECT {KEY}, period_id, rn, period_rows FROM seg WHERE period_rows >= 5")
def _(spark, sf):
    return seg(spark, sf, min_bars=5).select("sym", epoch(), "period_id", "rn", "period_rows")


@query("periods_daily", f"WITH {DAILY_SQL}, {sql_seg(12 * 86400)} SELECT sym, period_id, count(*) AS n, min(epoch(time))::BIGINT AS t0 FROM seg WHERE period_rows >= 3 GROUP BY 1, 2")
def _(spark, sf):
    s = segment(daily(spark, sf), gap_secs=12 * 86400, min_bars=3, bucket_secs=512 * 86400)
    return s.groupBy("sym", "period_id").agg(F.count("*").alias("n"), F.min(F.unix_seconds("time")).alias("t0"))


@query("bar_subsample", "WITH " + BARS + f""", r AS (SELECT *, dense_rank() OVER (PARTITION BY sym ORDER BY time) - 1 AS k FROM bars) SELECT {KEY}, close FROM r WHERE k % 3 = 0""")
def _(spark, sf):
    return B.subsample(bars(spark, sf), 3).select("sym", epoch(), "close")


@query("to_float32", "WITH " + BARS + f" SELECT {KEY}, close::FLOAT::DOUBLE AS close, high::FLOAT::DOUBLE AS high FROM bars")
def _(spark, sf):
    return B.to_float32(bars(spark, sf)).select("sym", epoch(), F.col("close").cast("double").alias("close"), F.col("high").cast("double").alias("high"))


@query("macro_join", """WITH d AS (SELECT l_returnflag AS s, l_shipdate::DATE AS date, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
 SELECT date::VARCHAR AS date, round(max(v) FILTER (s = 'A'), 4) AS a, round(max(v) FILTER (s = 'N'), 4) AS n, round(max(v) FILTER (s = 'R'), 4) AS r FROM d GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("s"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("value"))
    return B.macro_outer([(x.lower(), d.filter(F.col("s") == x)) for x in "ANR"]).select(F.col("date").cast("string").alias("date"), *rd("a", "n", "r", d=4))


@query("retention", """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch(ts) END AS t FROM events)
 SELECT event_id FROM e WHERE t IS NULL OR 1706659200 - t <= 7 * 86400""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return B.keep_recent(e, 1706659200.0, 7).select("event_id")


@query("keep_last", "SELECT event_id FROM events ORDER BY ts DESC LIMIT 500")
def _(spark, sf):
    return B.keep_last(table(spark, sf, "events"), 500, "ts").select("event_id")


@query("recent_window", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 180 DAYS")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    return B.recent_window(li, 180, "l_shipdate").select("l_orderkey", "l_linenumber")


# ── features ────────────────────────────────────────────────────────────────

def feat(spark, sf, groups, **kw):
    base = seg(spark, sf, streak_of="close")
    if NEEDS_BINS & set(groups):
        # bars feed three timeframes: write the narrow frame once instead of deriving it for each
        base = checkpointed(base)
    return features(base, groups, kw.pop("events", None), bar_secs=3600, **kw)


def feature_query(name, sql, d=6, **kw):
    cols = GROUPS[name]

    @query(name, sql)
    def _(spark, sf):
        return feat(spark, sf, [name], **kw).select("sym", epoch(), *rd(*cols, d=d))


def cols_sql(pairs, d=6):
    return ", ".join(R(e, a, d) for a, e in pairs.items())


ret = {f"ret_{n}": f"ln(close / {lagc('close', n)})" for n in (1, 2, 3, 5, 10, 15, 30, 60)}
ret["ret_mom"] = f"({ret['ret_5']}) - ({ret['ret_60']})"
feature_query("returns", HEAD + f" SELECT {KEY}, {cols_sql(ret)} FROM seg")
feature_query("atr", ATR + f" SELECT {KEY}, {R('atr_14', 'atr_14')} FROM b")
MA20, SD20 = f"({roll('avg', 'close', 20)})", f"({roll('stddev_samp', 'close', 20)})"
feature_query("bollinger", HEAD + f" SELECT {KEY}, {R(f'2 * {SD20} / {MA20} * 100', 'bb_w_20')}, {R(f'(close - ({MA20} - 2 * {SD20})) / (4 * {SD20} + 1e-9)', 'bb_pos_20')} FROM seg")

_vol = {f"m{n}_{k}": (x, f"(2.0::DOUBLE/{n + 1})") for n in (10, 30, 60) for k, x in ((1, "close / c1 - 1"), (2, "(close / c1 - 1) * (close / c1 - 1)"))}


def _vol_sql(n):
    a = 2.0 / (n + 1)
    q = f"pow({1 - a!r}, 2 * (rn - 1))"
    return R(f"CASE WHEN rn >= 2 THEN sqrt(greatest(m{n}_2 - m{n}_1 * m{n}_1, 0) / (1 - ({q} + {a * a!r} * (1 - {q}) / {1 - (1 - a) ** 2!r}))) * sqrt(1440) END", f"vol_ewma_{n}", 3)


feature_query("ewma_vol", HEAD + ", " + ewm("ev", "seg", _vol) + f" SELECT {KEY}, {', '.join(_vol_sql(n) for n in (10, 30, 60))} FROM seg JOIN ev USING (sym, period_id, rn)", d=3)
feature_query("rsi", RX + f" SELECT {KEY}, {R('rsi_14', 'rsi_14')} FROM r2")
_macd = HEAD + ", " + ewm("em", "seg", {"f": ("close", "(2.0::DOUBLE/13)"), "s": ("close", "(2.0::DOUBLE/27)")}) + ", " + ewm("es", "em", {"sig": ("f - s", "(0.2::DOUBLE)")})
feature_query("macd", _macd + f" SELECT {KEY}, {R('f - s', 'macd')}, {R('sig', 'macd_sig')}, {R('f - s - sig', 'macd_hist')} FROM seg JOIN em USING (sym, period_id, rn) JOIN es USING (sym, period_id, rn)")
_k = f"(close - ({roll('min', 'low', 14)})) / (({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}) + 1e-9) * 100"
feature_query("stochastic", HEAD + f", s2 AS (SELECT *, {_k} AS k FROM seg) SELECT {KEY}, {R('k', 'stoch_k')}, {R(roll('avg', 'k', 3, 15), 'stoch_d')} FROM s2")
_rp = f"(close - ({roll('min', 'low', 20)})) / (({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}) + 1e-9)"
feature_query("price_shape", HEAD + " SELECT " + KEY + ", " + cols_sql({
    "range_pos_20": _rp + " * 100", "body": "close - open", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low",
    "body_frac": "abs(close - open) / (high - low + 1e-9)",
    "wick_ratio": "(high - greatest(open, close) + least(open, close) - low) / (high - low + 1e-9)"}) + " FROM seg")
feature_query("ret_streak", HEAD + f""", s2 AS (SELECT *, coalesce(sign(close - c1), 0)::DOUBLE AS sg FROM seg),
 s3 AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER ({PW}) THEN 1 ELSE 0 END AS ch FROM s2),
 s4 AS (SELECT *, sum(ch) OVER ({PW}) AS isl FROM s3)
 SELECT {KEY}, sg * row_number() OVER (PARTITION BY sym, period_id, isl ORDER BY time) + 0.0 AS ret_streak FROM s4""")
_day = "max(high) OVER (PARTITION BY sym, period_id, time::DATE ORDER BY time)"
_dlo = "min(low) OVER (PARTITION BY sym, period_id, time::DATE ORDER BY time)"
@query("structure", HEAD + f""" SELECT {KEY}, hour(time)::BIGINT AS hour, (isodow(time) - 1)::BIGINT AS dow,
 CASE WHEN hour(time) >= 17 THEN 3 WHEN hour(time) >= 12 THEN 2 WHEN hour(time) >= 7 THEN 1 ELSE 0 END::BIGINT AS session,
 {R(f'(close - {_dlo}) / ({_day} - {_dlo} + 1e-9) * 100', 'daily_pos')}, {R(f'({_day} - {_dlo}) / {_dlo} * 100', 'daily_range_pct', 4)} FROM seg""")
def _(spark, sf):
    f = feat(spark, sf, ["structure"])
    return f.select("sym", epoch(), *[F.col(c).cast("bigint").alias(c) for c in ("hour", "dow", "session")], *rd("daily_pos"), *rd("daily_range_pct", d=4))


feature_query("volume", RX + f" SELECT {KEY}, {R('vol_z', 'vol_z')}, {R('tick_volume / (atr_14 + 1e-9)', 'vol_atr_ratio')} FROM r1")
feature_query("regime_feats", RX + f" SELECT {KEY}, " + cols_sql({
    "trend_ema": "trend_ema", "trend_slope": "trend_slope", "above_ema50": "above_ema50",
    "trend_quality": "abs(trend_ema) / (bb_w_20 / 100 + 1e-9)", "body_atr": "body_atr", "news_candle": "news_candle",
    "vol_spike": "vol_spike", "vol_spike_bin": "(coalesce(vol_spike, 0) > 2)::INT::DOUBLE", "spread_z": "spread_z", "range_pos": "range_pos"}) + " FROM r2")
feature_query("rolling_pctrank", RX + f" SELECT {KEY}, {R('bb_pctile', 'bb_pctile')}, {R('atr_pctile', 'atr_pctile')} FROM r3")


def _htf(rule, trunc, fast, slow):
    src = f"b_{rule}"
    return f"""{src}0 AS (SELECT sym, period_id, {trunc} AS bin, arg_min(open, time) AS op, max(high) AS hi, min(low) AS lo, arg_max(close, time) AS cl FROM seg GROUP BY 1, 2, 3),
 {src} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sym, period_id ORDER BY bin) - 1 AS rn, lag(hi) OVER (PARTITION BY sym, period_id ORDER BY bin) AS {rule}_hi,
   lag(lo) OVER (PARTITION BY sym, period_id ORDER BY bin) AS {rule}_lo, lag(cl) OVER (PARTITION BY sym, period_id ORDER BY bin) AS {rule}_cl FROM {src}0),
 {ewm('e_' + rule, src, {'ef': (rule + '_cl', f'(2.0::DOUBLE/{fast + 1})'), 'es': (rule + '_cl', f'(2.0::DOUBLE/{slow + 1})')})},
 t_{rule} AS MATERIALIZED (SELECT s.*, (ef - es) / nullif(CASE WHEN rn >= 14 THEN avg({rule}_hi - {rule}_lo) OVER (PARTITION BY sym, period_id ORDER BY bin ROWS 13 PRECEDING) END, 0) AS {rule}_tr
   FROM {src} s JOIN e_{rule} USING (sym, period_id, rn))"""


_Q15, _H, _D = "time_bucket(INTERVAL 15 MINUTES, time)", "date_trunc('hour', time)", "date_trunc('day', time)"
HTF = ATR + ", " + _htf("m15", _Q15, 12, 48) + ", " + _htf("h1", _H, 12, 48) + ", " + _htf("d1", _D, 5, 20) + f""",
 x AS MATERIALIZED (SELECT b.*, m15_hi, m15_lo, m15_tr, h1_hi, h1_lo, h1_tr, d1_hi, d1_lo, d1_cl, d1_tr, d.op AS d_open FROM b
  JOIN t_m15 m ON m.sym = b.sym AND m.period_id = b.period_id AND m.bin = {_Q15.replace('time)', 'b.time)')}
  JOIN t_h1 h ON h.sym = b.sym AND h.period_id = b.period_id AND h.bin = {_H.replace('time)', 'b.time)')}
  JOIN t_d1 d ON d.sym = b.sym AND d.period_id = b.period_id AND d.bin = {_D.replace('time)', 'b.time)')})"""


def _z(e):
    return f"coalesce({e}, 0)"


def htf_query(name, exprs):
    """Values of a zero range are divided by 1e-9; from 1e5 on, whole numbers are compared, as far as doubles go."""
    whole = lambda e: f"CASE WHEN abs({e}) < 1e5 THEN round({e}, 4) ELSE round({e}, 0) END + 0.0"

    @query(name, HTF + f" SELECT {KEY}, " + ", ".join(f"{whole(e)} AS {a}" for a, e in exprs.items()) + " FROM x")
    def _(spark, sf):
        f = feat(spark, sf, [name])
        return f.select("sym", epoch(), *[F.when(F.abs(c) < 1e5, F.round(c, 4)).otherwise(F.round(c, 0)).alias(c) for c in GROUPS[name]])


htf_query("levels", {
    "dist_prev_close": _z("(close - d1_cl) / (atr_14 + 1e-9)"), "dist_prev_high": _z("(close - d1_hi) / (atr_14 + 1e-9)"),
    "dist_prev_low": _z("(close - d1_lo) / (atr_14 + 1e-9)"), "dist_day_open": "(close - d_open) / (atr_14 + 1e-9)",
    "round50_dist": "(close - round_even(close / 50.0, 0) * 50.0) / (atr_14 + 1e-9)", "dow_cos": "cos(2 * pi() * (isodow(time) - 1) / 7.0)"})
htf_query("htf_context", {
    **{f"{r}_trend": _z(f"{r}_tr") for r in ("h1", "d1", "m15")}, **{f"{r}_pos": _z(f"(close - {r}_lo) / ({r}_hi - {r}_lo + 1e-9)") for r in ("h1", "d1", "m15")},
    "m1_h1_vol_ratio": _z("atr_14 / ((h1_hi - h1_lo) / 60 + 1e-9)"), "m1_d1_vol_ratio": _z("atr_14 / ((d1_hi - d1_lo) / 1440 + 1e-9)"),
    "m15_m1_vol_ratio": _z("(m15_hi - m15_lo) / (atr_14 * 3 + 1e-9)"),
    **{f"dist_{r}_hi": _z(f"({r}_hi - close) / (atr_14 + 1e-9)") for r in ("h1", "m15")}, **{f"dist_{r}_lo": _z(f"(close - {r}_lo) / (atr_14 + 1e-9)") for r in ("h1", "m15")},
    "htf_align": _z("sign(h1_tr) * sign(d1_tr)"), "m15_align": _z("sign(m15_tr) * sign(h1_tr)")})
_ma = {n: f"({roll('avg', 'close', n)} + 1e-9)" for n in (100, 200)}
feature_query("scale_free", ATR + ", " + ewm("em", "seg", {"f": ("close", "(2.0::DOUBLE/13)"), "s": ("close", "(2.0::DOUBLE/27)")}) + ", " + ewm("es", "em", {"sig": ("f - s", "(0.2::DOUBLE)")}) + f" SELECT {KEY}, " + cols_sql({
    **{f"{c}_ma100": f"{c} / ({_ma[100]})" for c in ("close", "open", "high", "low")}, "close_ma200": f"close / ({_ma[200]})",
    "atr_pct": "atr_14 / (close + 1e-9) * 100", "macd_hist_atr": "(f - s - sig) / (atr_14 + 1e-9)",
    "vol_rel": f"tick_volume / (({roll('avg', 'tick_volume', 100)}) + 1e-9)"}) + " FROM b JOIN em USING (sym, period_id, rn) JOIN es USING (sym, period_id, rn)")
_at = "(hour(time) + minute(time) / 60.0::DOUBLE)"
feature_query("session_clock", HEAD + f" SELECT {KEY}, " + cols_sql({
    "hour_sin": f"sin(2 * pi() * {_at} / 24)", "hour_cos": f"cos(2 * pi() * {_at} / 24)", "min_to_london": f"(7 - {_at}) * 60",
    "min_to_ny": f"(12 - {_at}) * 60", "min_to_close": f"(21 - {_at}) * 60", "dow_sin": "sin(2 * pi() * (isodow(time) - 1) / 7.0)",
    "dow_cos": "cos(2 * pi() * (isodow(time) - 1) / 7.0)"}) + " FROM seg")

# the same calendar, written out for the oracle
CAL = """cal AS (SELECT unnest([TIMESTAMP '2024-01-31 19:00:00', TIMESTAMP '2024-03-20 19:00:00', TIMESTAMP '2024-05-01 19:00:00', TIMESTAMP '2024-06-12 19:00:00',
 TIMESTAMP '2024-07-31 19:00:00', TIMESTAMP '2024-09-18 19:00:00', TIMESTAMP '2024-11-07 19:00:00', TIMESTAMP '2024-12-18 19:00:00']) AS ts, 'fomc' AS kind
 UNION ALL SELECT d + ((12 - isodow(d)) % 7) * INTERVAL 1 DAY + INTERVAL '13 hours 30 minutes', 'nfp' FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH)) AS d)
 UNION ALL SELECT d + INTERVAL '11 days 13 hours 30 minutes', 'cpi' FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH)) AS d))"""


@query("event_calendar", f"WITH {CAL} SELECT epoch(ts)::BIGINT AS t, kind FROM cal WHERE year(ts) IN (SELECT DISTINCT year(ts) FROM events)")
def _(spark, sf):
    years = table(spark, sf, "events").select(F.year("ts").alias("year")).distinct()
    return EV.event_calendar(years).select(epoch("ts"), "kind")


_NEXT = "(SELECT min(epoch(ts)) FROM cal WHERE epoch(ts) >= epoch(time))"
_PREV = "(SELECT max(epoch(ts)) FROM cal WHERE epoch(ts) < epoch(time))"
_EV = f", e AS (SELECT sym, time, ({_NEXT} - epoch(time)) / 60 AS a, (epoch(time) - {_PREV}) / 60 AS z FROM seg)"


@query("event_proximity", HEAD + ", " + CAL + _EV + f" SELECT {KEY}, {R('a', 'min_to_event')}, {R('z', 'min_since_event')}, coalesce(a <= 30, false)::INT::DOUBLE AS pre_event, coalesce(z <= 60, false)::INT::DOUBLE AS post_event FROM e")
def _(spark, sf):
    return feat(spark, sf, ["event_proximity"], events=calendar(spark)).select("sym", epoch(), *rd(*GROUPS["event_proximity"]))


@query("event_asof", HEAD + ", " + CAL + _EV + f" SELECT {KEY}, {R('a', 'min_to_event')}, {R('z', 'min_since_event')} FROM e")
def _(spark, sf):
    b = bars(spark, sf)
    cal = EV.event_calendar(b.select(F.year("time").alias("year")).distinct())
    return EV.event_asof(b, cal).select("sym", epoch(), *rd("min_to_event", "min_since_event"))


_of = """, o AS (SELECT *, nullif(high - low, 0) AS rg FROM r1), o2 AS (SELECT *, (close - open) / rg AS bs, (close - low) / rg AS cl FROM o)"""


def _full10(c):
    return f"CASE WHEN count({c}) OVER ({PW} ROWS 9 PRECEDING) = 10 THEN avg({c}) OVER ({PW} ROWS 9 PRECEDING) END"


feature_query("order_flow", RX + _of + f" SELECT {KEY}, " + cols_sql({
    "close_loc": _z("cl"), "body_signed": _z("bs"), "up_wick_frac": _z("(high - greatest(open, close)) / rg"), "dn_wick_frac": _z("(least(open, close) - low) / rg"),
    "flow_mom": _z(_full10("bs")), "close_loc_mom": _z(f"({_full10('cl')}) - 0.5"),
    "flow_conviction": "coalesce(bs, 0) * CASE WHEN vol_z IS NOT NULL THEN greatest(least(vol_z, 3), -3) END"}) + " FROM o2")

_adx = ATR + ", " + ewm("ed", "seg", {
    "p": ("CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0 END", A14), "m": ("CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0 END", A14)}) + """,
 di AS MATERIALIZED (SELECT b.*, 100 * p / (atr_14 + 1e-9) AS pdi, 100 * m / (atr_14 + 1e-9) AS mdi FROM b JOIN ed USING (sym, period_id, rn)), """ + \
    ewm("ex", "di", {"adx": ("100 * abs(pdi - mdi) / (pdi + mdi + 1e-9)", A14)})
feature_query("adx", _adx + f" SELECT {KEY}, {R('adx', 'adx_14')}, {R('(pdi - mdi) / (pdi + mdi + 1e-9)', 'di_bias')} FROM di JOIN ex USING (sym, period_id, rn)")
feature_query("cci", HEAD + f""", c2 AS (SELECT *, (high + low + close) / 3.0::DOUBLE AS tp FROM seg), c3 AS (SELECT *, {roll('avg', 'tp', 20)} AS sma FROM c2),
 c4 AS (SELECT *, {roll('avg', 'abs(tp - sma)', 20, 38)} AS md FROM c3)
 SELECT {KEY}, {R('coalesce(CASE WHEN md IS NOT NULL THEN greatest(least((tp - sma) / (0.015 * md + 1e-9), 400), -400) END, 0)', 'cci_20')} FROM c4""")
feature_query("squeeze", ATR + f""", q AS (SELECT *, 4 * {SD20} / (3 * ({roll('avg', 'atr_14', 20)}) + 1e-9) - 1 AS s FROM b),
 q2 AS (SELECT *, coalesce(CASE WHEN s IS NOT NULL THEN greatest(least(s, 3), 0) END, 0) AS sq FROM q)
 SELECT {KEY}, {R('sq', 'squeeze')}, (sq <= 0)::INT::DOUBLE AS squeeze_bin FROM q2""")
_rng = "CASE WHEN high = low THEN 1e-9 ELSE high - low END"
feature_query("candles", HEAD + f""" SELECT {KEY}, coalesce(abs(c1 - o1) > 0.6 * CASE WHEN h1 = l1 THEN 1e-9 ELSE h1 - l1 END AND abs(close - open) > abs(c1 - o1)
   AND (close > open) <> (c1 > o1) AND greatest(close, open) > greatest(c1, o1) AND least(close, open) < least(c1, o1), false)::INT::DOUBLE AS engulf,
 (abs(close - open) / ({_rng}) < 0.1)::INT::DOUBLE AS doji, ((least(close, open) - low) / ({_rng}) > 0.6)::INT::DOUBLE AS hammer,
 ((high - greatest(close, open)) / ({_rng}) > 0.5 OR (least(close, open) - low) / ({_rng}) > 0.5)::INT::DOUBLE AS pin, coalesce(sign(c1 - o1), 0)::DOUBLE AS patt_dir FROM seg""")
feature_query("obv_slope", HEAD + f""", v AS (SELECT *, sum(coalesce(sign(close - c1), 0) * tick_volume) OVER ({PW}) AS obv FROM seg)
 SELECT {KEY}, {R(f'coalesce(CASE WHEN rn >= 20 THEN greatest(least((obv - {lagc("obv", 20)}) / (({roll("stddev_samp", "obv", 20)}) + 1e-9), 3), -3) END, 0)', 'obv_slope')} FROM v""")
feature_query("donchian", HEAD + f""", d AS (SELECT *, {roll('max', 'high', 20)} AS hh, {roll('min', 'low', 20)} AS ll FROM seg)
 SELECT {KEY}, {R('coalesce((close - ll) / (hh - ll + 1e-9), 0.5)', 'donch_pos')},
 coalesce((close > {lagc('hh', 1)})::INT, 0)::DOUBLE - coalesce((close < {lagc('ll', 1)})::INT, 0)::DOUBLE + 0.0 AS donch_break FROM d""")


@query("feature_block", RX + f""" SELECT {KEY}, {R('atr_14', 'atr_14')}, {R('rsi_14', 'rsi_14')}, {R('bb_pctile', 'bb_pctile')}, {R('trend_ema', 'trend_ema')}, {R('news_candle', 'news_candle')} FROM r3""")
def _(spark, sf):
    full = features(checkpointed(seg(spark, sf, streak_of="close")), None, calendar(spark), bar_secs=3600)
    return full.select("sym", epoch(), *rd("atr_14", "rsi_14", "bb_pctile", "trend_ema", "news_candle"))


@query("daily_features", f"WITH RECURSIVE {DAILY_SQL}, {sql_seg(10 ** 9)}, {ewm('ea', 'seg', {'atr': (TR, A14)})} SELECT {KEY}, {R('atr', 'atr_14', 4)} FROM seg JOIN ea USING (sym, period_id, rn)")
def _(spark, sf):
    s = segment(daily(spark, sf), gap_secs=10 ** 9, bucket_secs=512 * 86400)
    return features(s, ["atr"], None, bar_secs=86400, gap_secs=10 ** 9).select("sym", epoch(), *rd("atr_14", d=4))


@query("complete_rows", HEAD + f" SELECT {KEY}, {R(ret['ret_60'], 'ret_60')} FROM seg QUALIFY {lagc('close', 60)} IS NOT NULL")
def _(spark, sf):
    return complete_rows(feat(spark, sf, ["returns"])).select("sym", epoch(), *rd("ret_60"))


@query("market_columns", HEAD + f" SELECT {KEY}, {R(ret['ret_1'], 'ret_1')} FROM seg")
def _(spark, sf):
    """Anti-list projection: raw prices never reach the model frame."""
    f = feat(spark, sf, ["returns"])
    names = market_columns(f, RAW_PRICE_COLS)
    return f.select(*names).select("sym", epoch(), *rd("ret_1"))


@query("schema_guard")
def _(spark, sf):
    b = bars(spark, sf)
    return b.groupBy("sym").agg(F.count("*").alias("n"), F.lit(schema_fingerprint(b)).alias("fingerprint"))
