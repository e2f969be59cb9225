"""Causal bar features.

All groups are columns of one staged pipeline: stage k holds every window that
needs the columns of stage k-1, so Spark runs one sort and a few window passes
for about a hundred columns. A single group is a select on that pipeline, and
Catalyst prunes the windows it does not use.

Input: segmented bars (operators.series.segment). Windows stay inside
(sym, period_id, block); a block sees enough earlier rows for every bounded
frame and for exponential means to forget their start.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickforge.constants import HTF_COLS
from tickforge.functions.windows import (
    clip, ewm_mean, ewm_memory, ewm_std, flag, full, last_rows, span_alpha, warm,
)
from tickforge.functions.paths import BlockPass, run_block_pass
from tickforge.operators.events import DayEvents, event_proximity
from tickforge.operators.series import BLOCK_ROWS, block_window, blocks, core_rows

EPS = 1e-9
RETURN_LAGS = (1, 2, 3, 5, 10, 15, 30, 60)
WILDER = 1.0 / 14

GROUPS = {
    "returns": [*[f"ret_{n}" for n in RETURN_LAGS], "ret_mom"],
    "atr": ["atr_14"],
    "bollinger": ["bb_w_20", "bb_pos_20"],
    "ewma_vol": ["vol_ewma_10", "vol_ewma_30", "vol_ewma_60"],
    "rsi": ["rsi_14"],
    "macd": ["macd", "macd_sig", "macd_hist"],
    "stochastic": ["stoch_k", "stoch_d"],
    "price_shape": ["range_pos_20", "body", "upper_wick", "lower_wick", "body_frac", "wick_ratio"],
    "ret_streak": ["ret_streak"],
    "structure": ["hour", "dow", "session", "daily_pos", "daily_range_pct"],
    "volume": ["vol_z", "vol_atr_ratio"],
    "regime_feats": ["trend_ema", "trend_slope", "above_ema50", "trend_quality", "body_atr",
                     "news_candle", "vol_spike", "vol_spike_bin", "spread_z", "range_pos"],
    "rolling_pctrank": ["bb_pctile", "atr_pctile"],
    "levels": ["dist_prev_close", "dist_prev_high", "dist_prev_low", "dist_day_open", "round50_dist", "dow_cos"],
    "scale_free": ["close_ma100", "close_ma200", "open_ma100", "high_ma100", "low_ma100",
                   "atr_pct", "macd_hist_atr", "vol_rel"],
    "htf_context": HTF_COLS,
    "session_clock": ["hour_sin", "hour_cos", "min_to_london", "min_to_ny", "min_to_close", "dow_sin", "dow_cos"],
    "event_proximity": ["min_to_event", "min_since_event", "pre_event", "post_event"],
    "order_flow": ["close_loc", "body_signed", "up_wick_frac", "dn_wick_frac",
                   "flow_mom", "close_loc_mom", "flow_conviction"],
    "adx": ["adx_14", "di_bias"],
    "cci": ["cci_20"],
    "squeeze": ["squeeze", "squeeze_bin"],
    "candles": ["engulf", "doji", "hammer", "pin", "patt_dir"],
    "obv_slope": ["obv_slope"],
    "donchian": ["donch_pos", "donch_break"],
}
BAR_COLS = ["sym", "time", "open", "high", "low", "close", "tick_volume", "spread", "real_volume"]
ROW_COLS = ["period_id", "rn", "period_rows"]
NEEDS_BINS = {"levels", "htf_context"}

# slowest chain of exponential means in the pipeline: the 60-span volatility, or
# the Wilder mean of Wilder means behind the 200-row rank; plus the longest frames
FEATURE_HALO = max(ewm_memory(span_alpha(60)), 2 * ewm_memory(WILDER)) + 260


def feature_names(groups: Sequence[str] | None = None) -> list[str]:
    names: list[str] = []
    for group in groups or GROUPS:
        names += [c for c in GROUPS[group] if c not in names]
    return names


def _c(name: str) -> Column:
    return F.col(name)


# ── higher timeframes ───────────────────────────────────────────────────────

HTF_RULES = {"m15": ("15 minutes", 12, 48, 900), "h1": ("1 hour", 12, 48, 3600), "d1": ("1 day", 5, 20, 86400)}


def _htf_bins(lower: DataFrame, rule: str, order: str) -> DataFrame:
    out = lower.groupBy("sym", "period_id", F.window(order, HTF_RULES[rule][0]).alias("_w")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"))
    return out.select("sym", "period_id", _c("_w.start").alias("bin"), "open", "high", "low", "close")


def _htf_series(bins: DataFrame, rule: str, gap_secs: float) -> DataFrame:
    """What a base bar may know of its timeframe: the bins before its own.

    Inside a period two bins are at most gap + one width apart, so a halo of
    time covers the rows an exponential mean remembers, and blocks of time need
    no row numbers.
    """
    width, fast, slow, w_secs = HTF_RULES[rule]
    back = int((ewm_memory(span_alpha(slow)) + 15) * (gap_secs + w_secs))
    size = 4 * back
    at = F.unix_seconds("bin")
    k = F.floor(at / size)
    homes = F.array_compact(F.array(k, F.when(at >= (k + 1) * size - back, k + 1)))
    framed = bins.withColumns({"block": F.explode(homes), "core_block": k})
    w = block_window("bin")
    framed = framed.withColumns({
        f"{rule}_{name}": F.lag(col).over(w) for name, col in (("hi", "high"), ("lo", "low"), ("close", "close"))})
    framed = framed.withColumns({
        "_ef": ewm_mean(_c(f"{rule}_close"), span_alpha(fast), w),
        "_es": ewm_mean(_c(f"{rule}_close"), span_alpha(slow), w),
        "_rng": full(w, 14, F.avg, _c(f"{rule}_hi") - _c(f"{rule}_lo"))})
    trend = (_c("_ef") - _c("_es")) / F.nullif(_c("_rng"), F.lit(0.0))
    keep = ["sym", "period_id", "bin", f"{rule}_hi", f"{rule}_lo", trend.alias(f"{rule}_trend_raw")]
    if rule == "d1":
        keep += ["d1_close", _c("open").alias("d1_open")]
    return framed.filter(_c("block") == _c("core_block")).select(*keep)


def with_higher_timeframes(bars: DataFrame, gap_secs: float = 6 * 3600) -> DataFrame:
    """Attach completed 15-minute, hourly and daily context to bars.

    Every base bar lies in an existing bin, so the backward as-of join is an
    equi-join. Bins are built from the next finer bins, and the coarse context
    rides on the finer one: the bars themselves are joined once.
    """
    m15 = _htf_bins(bars, "m15", "time")
    h1 = _htf_bins(m15, "h1", "bin")
    d1 = _htf_bins(h1, "d1", "bin")
    on = ["sym", "period_id", "_d"]
    h1x = _htf_series(h1, "h1", gap_secs).withColumn("_d", F.date_trunc("day", "bin"))
    h1x = h1x.join(_htf_series(d1, "d1", gap_secs).withColumnRenamed("bin", "_d"), on).drop("_d")
    m15x = _htf_series(m15, "m15", gap_secs).withColumn("_h", F.date_trunc("hour", "bin"))
    m15x = m15x.join(h1x.withColumnRenamed("bin", "_h"), ["sym", "period_id", "_h"]).drop("_h")
    bin15 = F.window(_c("time"), "15 minutes")["start"]
    return bars.withColumn("_m15", bin15).join(
        m15x.withColumnRenamed("bin", "_m15"), ["sym", "period_id", "_m15"]).drop("_m15")


# ── the staged pipeline ─────────────────────────────────────────────────────

# Columns are unresolved expressions, so each stage is built once per process.

@lru_cache(maxsize=None)
def _windows():
    """Row order of a block, and of a day in it; days are ordered like rows, so both share one sort."""
    return block_window("_day", "rn"), W.partitionBy("sym", "period_id", "block", "_day").orderBy("rn")


@lru_cache(maxsize=None)
def _stage_1() -> dict[str, Column]:
    w, wd = _windows()
    c, h, low, v, s = (_c(x) for x in ("close", "high", "low", "tick_volume", "spread"))
    day = wd.rowsBetween(W.unboundedPreceding, 0)
    last20, last14 = last_rows(w, 20), last_rows(w, 14)
    cols = {f"_c{n}": F.lag("close", n).over(w) for n in RETURN_LAGS}
    cols |= {f"_{x[0]}1": F.lag(x).over(w) for x in ("open", "high", "low")}
    cols |= {f"_ema{n}": ewm_mean(c, span_alpha(n), w) for n in (12, 20, 26, 50)}
    cols |= {
        "_ma20": F.avg(c).over(last20), "_sd20": F.stddev_samp(c).over(last20),
        "_ma100": F.avg(c).over(last_rows(w, 100)), "_ma200": F.avg(c).over(last_rows(w, 200)),
        "_hh20": F.max(h).over(last20), "_ll20": F.min(low).over(last20),
        "_hh14": F.max(h).over(last14), "_ll14": F.min(low).over(last14),
        "_vm20": F.avg(v).over(last20), "_vs20": F.stddev_samp(v).over(last20),
        "_vm100": F.avg(v).over(last_rows(w, 100)),
        "_sm100": full(w, 100, F.avg, s), "_ss100": full(w, 100, F.stddev_samp, s),
        "_dhi": F.max(h).over(day), "_dlo": F.min(low).over(day),
    }
    return cols


@lru_cache(maxsize=None)
def _scalars_1() -> dict[str, Column]:
    o, h, low, c, v = (_c(x) for x in ("open", "high", "low", "close", "tick_volume"))
    rng = F.when(h != low, h - low)
    return {
        "_tr": F.greatest(h - low, F.abs(h - _c("_c1")), F.abs(low - _c("_c1"))),
        "_ret": F.try_divide(c, _c("_c1")) - 1.0,
        "_up": F.when(_c("_c1").isNotNull(), F.greatest(c - _c("_c1"), F.lit(0.0))),
        "_dn": F.when(_c("_c1").isNotNull(), F.greatest(_c("_c1") - c, F.lit(0.0))),
        "_pdm": F.when((h - _c("_h1") > _c("_l1") - low) & (h > _c("_h1")), h - _c("_h1")).otherwise(0.0),
        "_mdm": F.when((_c("_l1") - low > h - _c("_h1")) & (_c("_l1") > low), _c("_l1") - low).otherwise(0.0),
        "macd": _c("_ema12") - _c("_ema26"),
        "bb_w_20": warm(_c("rn"), 19, F.try_divide(2 * _c("_sd20"), _c("_ma20")) * 100),
        "stoch_k": warm(_c("rn"), 13, (c - _c("_ll14")) / (_c("_hh14") - _c("_ll14") + EPS) * 100),
        "_tp": (h + low + c) / 3.0,
        "_signed_v": F.coalesce(F.signum(c - _c("_c1")), F.lit(0.0)) * v,
        "_rng": rng, "_bsig": (c - o) / rng, "_cloc": (c - low) / rng,
        "vol_z": warm(_c("rn"), 19, (v - _c("_vm20")) / (_c("_vs20") + EPS)),
    }


@lru_cache(maxsize=None)
def _stage_2() -> dict[str, Column]:
    w, _ = _windows()
    cols = {
        "atr_14": ewm_mean(_c("_tr"), WILDER, w),
        "_ru": ewm_mean(_c("_up"), WILDER, w), "_rd": ewm_mean(_c("_dn"), WILDER, w),
        "_pdm_s": ewm_mean(_c("_pdm"), WILDER, w), "_mdm_s": ewm_mean(_c("_mdm"), WILDER, w),
        "macd_sig": ewm_mean(_c("macd"), span_alpha(9), w),
        "_ema20_5": F.lag("_ema20", 5).over(w),
        "_above": F.avg(flag(_c("close") > _c("_ema50"))).over(last_rows(w, 20)),
        "_sma_tp": F.avg("_tp").over(last_rows(w, 20)),
        "_stoch_d": F.avg("stoch_k").over(last_rows(w, 3)),
        "_obv": F.sum("_signed_v").over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_hh20_1": F.lag("_hh20").over(w), "_ll20_1": F.lag("_ll20").over(w),
        "_flow": full(w, 10, F.avg, _c("_bsig")), "_locm": full(w, 10, F.avg, _c("_cloc")),
    }
    cols |= {f"_vol{n}": ewm_std(_c("_ret"), span_alpha(n), w) for n in (10, 30, 60)}
    return cols


@lru_cache(maxsize=None)
def _scalars_2() -> dict[str, Column]:
    pdi, mdi = (100 * _c(x) / (_c("atr_14") + EPS) for x in ("_pdm_s", "_mdm_s"))
    return {
        "di_bias": (pdi - mdi) / (pdi + mdi + EPS),
        "_dx": 100 * F.abs(pdi - mdi) / (pdi + mdi + EPS),
        "_dev_tp": warm(_c("rn"), 19, F.abs(_c("_tp") - _c("_sma_tp"))),
        "body_atr": F.abs(_c("close") - _c("open")) / (_c("atr_14") + EPS),
    }


@lru_cache(maxsize=None)
def _stage_3() -> dict[str, Column]:
    w, _ = _windows()
    last20 = last_rows(w, 20)
    return {
        "adx_14": ewm_mean(_c("_dx"), WILDER, w),
        "_md20": F.avg("_dev_tp").over(last20), "_atr20": F.avg("atr_14").over(last20),
        "_news": F.avg(flag(_c("body_atr") > 2.5)).over(last_rows(w, 5)),
        "_obv20": F.lag("_obv", 20).over(w), "_obv_sd": F.stddev_samp("_obv").over(last20),
    }


@lru_cache(maxsize=None)
def _clock() -> dict[str, Column]:
    t = _c("time")
    hour = F.hour(t)
    at = hour + F.minute(t) / 60.0
    dow = F.weekday(t)
    turn = 2 * math.pi
    return {
        "hour": hour, "dow": dow,
        "session": F.when(hour >= 17, 3).when(hour >= 12, 2).when(hour >= 7, 1).otherwise(0),
        "hour_sin": F.sin(turn * at / 24.0), "hour_cos": F.cos(turn * at / 24.0),
        "min_to_london": (7.0 - at) * 60.0, "min_to_ny": (12.0 - at) * 60.0, "min_to_close": (21.0 - at) * 60.0,
        "dow_sin": F.sin(turn * dow / 7.0), "dow_cos": F.cos(turn * dow / 7.0),
    }


@lru_cache(maxsize=None)
def _finals(legacy: bool) -> dict[str, Column]:
    o, h, low, c, v = (_c(x) for x in ("open", "high", "low", "close", "tick_volume"))
    rn, atr = _c("rn"), _c("atr_14") + EPS
    top, bottom = F.greatest(o, c), F.least(o, c)
    full_rng = h - low + EPS
    safe_rng = F.when(h == low, F.lit(EPS)).otherwise(h - low)
    prev_rng = F.when(_c("_h1") == _c("_l1"), F.lit(EPS)).otherwise(_c("_h1") - _c("_l1"))
    body, body1 = F.abs(c - o), F.abs(_c("_c1") - _c("_o1"))
    zero = F.lit(0.0)
    cols: dict[str, Column] = {f"ret_{n}": F.ln(F.try_divide(c, _c(f"_c{n}"))) for n in RETURN_LAGS}
    cols["ret_mom"] = cols["ret_5"] - cols["ret_60"]
    cols["bb_pos_20"] = warm(rn, 19, (c - (_c("_ma20") - 2 * _c("_sd20"))) / (4 * _c("_sd20") + EPS))
    cols |= {f"vol_ewma_{n}": _c(f"_vol{n}") * math.sqrt(1440) for n in (10, 30, 60)}
    cols["rsi_14"] = 100 - 100 / (1 + _c("_ru") / (_c("_rd") + EPS))
    cols["macd_hist"] = _c("macd") - _c("macd_sig")
    cols["stoch_d"] = warm(rn, 15, _c("_stoch_d"))
    cols["range_pos_20"] = warm(rn, 19, (c - _c("_ll20")) / (_c("_hh20") - _c("_ll20") + EPS) * 100)
    cols |= {
        "body": c - o, "upper_wick": h - top, "lower_wick": bottom - low,
        "body_frac": body / full_rng, "wick_ratio": ((h - top) + (bottom - low)) / full_rng,
        "daily_pos": (c - _c("_dlo")) / (_c("_dhi") - _c("_dlo") + EPS) * 100,
        "daily_range_pct": F.try_divide(_c("_dhi") - _c("_dlo"), _c("_dlo")) * 100,
        "vol_atr_ratio": v / atr,
        "trend_ema": (_c("_ema20") - _c("_ema50")) / atr,
        "trend_slope": (_c("_ema20") - _c("_ema20_5")) / atr,
        "above_ema50": warm(rn, 19, _c("_above")),
        "news_candle": warm(rn, 4, _c("_news")),
        "vol_spike": _c("vol_z"), "vol_spike_bin": flag(_c("vol_z") > 2.0),
        "spread_z": (_c("spread") - _c("_sm100")) / (_c("_ss100") + EPS),
        "range_pos": warm(rn, 19, (c - _c("_ll20")) / (_c("_hh20") - _c("_ll20") + EPS)),
        "bb_pctile": warm(rn, 218, _c("_bb_rank")), "atr_pctile": warm(rn, 199, _c("_atr_rank")),
    }
    cols["trend_quality"] = F.abs(cols["trend_ema"]) / (_c("bb_w_20") / 100 + EPS)
    ma100 = warm(rn, 99, _c("_ma100")) + EPS
    cols |= {
        "close_ma100": c / ma100, "close_ma200": c / (warm(rn, 199, _c("_ma200")) + EPS),
        "open_ma100": o / ma100, "high_ma100": h / ma100, "low_ma100": low / ma100,
        "atr_pct": _c("atr_14") / (c + EPS) * 100.0, "macd_hist_atr": cols["macd_hist"] / atr,
        "vol_rel": v / (warm(rn, 99, _c("_vm100")) + EPS),
        "round50_dist": (c - F.bround(c / 50.0) * 50.0) / atr,
    }
    bsig = _c("_bsig") if legacy else F.coalesce("_bsig", zero)
    cols |= {
        "close_loc": F.coalesce("_cloc", zero), "body_signed": F.coalesce("_bsig", zero),
        "up_wick_frac": F.coalesce((h - top) / _c("_rng"), zero),
        "dn_wick_frac": F.coalesce((bottom - low) / _c("_rng"), zero),
        "flow_mom": F.coalesce("_flow", zero), "close_loc_mom": F.coalesce(_c("_locm") - 0.5, zero),
        "flow_conviction": bsig * clip(_c("vol_z"), -3, 3),
    }
    cols["cci_20"] = F.coalesce(
        warm(rn, 38, clip((_c("_tp") - _c("_sma_tp")) / (0.015 * _c("_md20") + EPS), -400, 400)), zero)
    kelt = 3.0 * _c("_atr20") + EPS
    cols["squeeze"] = F.coalesce(warm(rn, 19, clip(4 * _c("_sd20") / kelt - 1.0, 0, 3)), zero)
    cols["squeeze_bin"] = flag(cols["squeeze"] <= 0.0)
    lower_frac = (low - bottom if legacy else bottom - low) / safe_rng
    cols |= {
        "engulf": flag(
            (body1 > 0.6 * prev_rng) & (body > body1) & ((c > o) != (_c("_c1") > _c("_o1")))
            & (top > F.greatest("_c1", "_o1")) & (bottom < F.least("_c1", "_o1"))),
        "doji": flag(body / safe_rng < 0.1),
        "hammer": flag(lower_frac > 0.6),
        "pin": flag(((h - top) / safe_rng > 0.5) | ((bottom - low) / safe_rng > 0.5)),
        "patt_dir": F.coalesce(F.signum(_c("_c1") - _c("_o1")), zero),
        "obv_slope": F.coalesce(
            warm(rn, 20, clip((_c("_obv") - _c("_obv20")) / (_c("_obv_sd") + EPS), -3, 3)), zero),
        "donch_pos": F.coalesce(warm(rn, 19, (c - _c("_ll20")) / (_c("_hh20") - _c("_ll20") + EPS)), F.lit(0.5)),
        "donch_break": warm(rn, 20, flag(c > _c("_hh20_1")) - flag(c < _c("_ll20_1"))),
    }
    cols["donch_break"] = F.coalesce(cols["donch_break"], zero)
    return cols


@lru_cache(maxsize=None)
def _bin_finals() -> dict[str, Column]:
    c, atr, zero = _c("close"), _c("atr_14"), F.lit(0.0)

    def or_zero(x: Column) -> Column:
        return F.coalesce(x, zero)

    def pos(rule: str) -> Column:
        return (c - _c(f"{rule}_lo")) / (_c(f"{rule}_hi") - _c(f"{rule}_lo") + EPS)

    span = {r: _c(f"{r}_hi") - _c(f"{r}_lo") for r in HTF_RULES}
    sign = {r: F.signum(f"{r}_trend_raw") for r in HTF_RULES}
    cols = {f"{r}_trend": or_zero(_c(f"{r}_trend_raw")) for r in HTF_RULES}
    cols |= {f"{r}_pos": or_zero(pos(r)) for r in HTF_RULES}
    cols |= {
        "m1_h1_vol_ratio": or_zero(atr / (span["h1"] / 60 + EPS)),
        "m1_d1_vol_ratio": or_zero(atr / (span["d1"] / 1440 + EPS)),
        "m15_m1_vol_ratio": or_zero(span["m15"] / (atr * 3 + EPS)),
        "htf_align": or_zero(sign["h1"] * sign["d1"]), "m15_align": or_zero(sign["m15"] * sign["h1"]),
        "dist_prev_close": or_zero((c - _c("d1_close")) / (atr + EPS)),
        "dist_prev_high": or_zero((c - _c("d1_hi")) / (atr + EPS)),
        "dist_prev_low": or_zero((c - _c("d1_lo")) / (atr + EPS)),
        "dist_day_open": (c - _c("d1_open")) / (atr + EPS),
    }
    for r in ("h1", "m15"):
        cols[f"dist_{r}_hi"] = or_zero((_c(f"{r}_hi") - c) / (atr + EPS))
        cols[f"dist_{r}_lo"] = or_zero((c - _c(f"{r}_lo")) / (atr + EPS))
    return cols


def _columns_used(groups: Sequence[str], bins: bool, legacy: bool) -> set[str]:
    """Frame columns the final expressions of these groups read."""
    known = {**_finals(legacy), **(_bin_finals() if bins else {})}
    names = feature_names(groups)
    text = " ".join(str(known[n]) for n in names if n in known)
    used = set(re.findall(r"[A-Za-z_]\w*", text))
    return used | {*names, *BAR_COLS, *ROW_COLS, "atr_14", "block", "core"}


def features(
    bars: DataFrame,
    groups: Sequence[str] | None = None,
    events: DayEvents | None = None,
    bar_secs: int = 60,
    gap_secs: float = 6 * 3600,
    block_rows: int = BLOCK_ROWS,
    ahead: int = 0,
    legacy: bool = False,
    carry: Sequence[str] = (),
    grid_horizon: int = 0,
) -> DataFrame:
    """Feature columns of the chosen groups (default all) on segmented bars.

    With ahead > 0 the frame stays cut in blocks (columns block and core, with
    `ahead` following rows) so that forward labels can run on it without another
    shuffle; otherwise only the bars themselves are returned. grid_horizon adds
    the outcomes of all grid placements (columns cells and path_close) in the
    same pass over the blocks that ranks the volatility columns.
    """
    groups = list(groups or GROUPS)
    if "ret_streak" in groups and "ret_streak" not in bars.columns:
        raise ValueError("ret_streak is computed by segment(streak_of='close')")
    # a day must fit in the halo for the running day range
    halo = max(FEATURE_HALO, math.ceil(86400 / bar_secs))
    block_rows = max(block_rows, halo)
    base = with_higher_timeframes(bars, gap_secs) if NEEDS_BINS & set(groups) else bars
    framed = blocks(base, back=halo, ahead=max(ahead, grid_horizon), rows=block_rows)
    framed = framed.withColumns({"_day": F.to_date("time"), "tick_volume": _c("tick_volume").cast("double")})
    framed = framed.withColumns(_stage_1()).withColumns(_scalars_1())
    framed = framed.withColumns(_stage_2()).withColumns(_scalars_2())
    framed = framed.withColumns(_stage_3())
    ranks = {"_bb_rank": "bb_w_20", "_atr_rank": "atr_14"} if "rolling_pctrank" in groups else {}
    if ranks or grid_horizon:
        todo = BlockPass(ranks=ranks, horizon=grid_horizon, grid=grid_horizon > 0)
        # the block pass moves all its input through Arrow: give it only what is used later
        used = _columns_used(groups, bool(NEEDS_BINS & set(groups)), legacy)
        framed = run_block_pass(framed.select(*[c for c in framed.columns if c in used or c in carry or c in ranks.values()]), todo)
    known = {**_clock(), **_finals(legacy)}
    if NEEDS_BINS & set(groups):
        known |= _bin_finals()
    if events is not None:
        known |= event_proximity(_c("time"), events, legacy)
    elif "event_proximity" in groups:
        groups.remove("event_proximity")
    names = feature_names(groups)
    passing = [c for c in [*BAR_COLS, *ROW_COLS, *carry] if c in bars.columns and c not in names]
    passing += ["cells", "path_close"] if grid_horizon else []
    out = framed.select(
        *passing, "block", "core", *[known[n].alias(n) if n in known else _c(n) for n in names])
    return out if ahead else core_rows(out)


def feature_block(bars: DataFrame, **options) -> DataFrame:
    """All feature groups, the column set of the placement matrix."""
    return features(bars, None, **options)


def market_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """Feature columns offered to a model: everything but the exclusion list."""
    return [c for c in df.columns if c not in set(drop)]


def complete_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (warm-up rows of the features)."""
    return df.dropna()
