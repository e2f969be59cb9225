"""Forward-looking labels. All of them look a bounded number of rows ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.constants import EXTENSION, MAX_BARS_M1, SPREAD
from tickforge.functions.paths import BlockPass, run_block_pass
from tickforge.operators.series import BLOCK_ROWS, block_window, blocks, core_rows


def _framed(df: DataFrame, ahead: int, block_rows: int) -> DataFrame:
    return df if "block" in df.columns else blocks(df, ahead=ahead, rows=block_rows)


def with_outcome(
    df: DataFrame,
    horizon: int,
    entry: Column,
    sl: Column,
    tp: Column,
    buy: Column,
    unit: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Outcome of one placement per row: columns entry, sl, tp, buy, p, path_close, path_time.

    p is a struct: touch (rows ahead, from 0; -1 none), hit_sl, hit_tp, mfe, mfa.
    """
    framed = _framed(df, horizon, block_rows).withColumns({
        "entry": entry, "sl": sl, "tp": tp, "buy": buy, "_unit": F.lit(1.0) if unit is None else unit})
    todo = BlockPass(horizon=horizon, levels={"p": ("entry", "sl", "tp", "buy", "_unit")})
    return core_rows(run_block_pass(framed, todo)).drop("_unit")


def fwd_target(bars: DataFrame, horizon: int = 15, threshold: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fwd_return over `horizon` rows; target 1 above the threshold (0 where unknown)."""
    ahead = F.lead("close", horizon).over(block_window())
    out = _framed(bars, horizon, block_rows).withColumn("fwd_return", (ahead - F.col("close")) / F.col("close"))
    out = out.withColumn("target", F.when(F.col("fwd_return") > threshold, 1).otherwise(0))
    return core_rows(out)


def trade_levels(direction: Column, close: Column, sl_dist: Column, tp_dist: Column, spread=SPREAD) -> dict[str, Column]:
    """Entry and exit levels: a buy enters at the ask, a sell's exit pays the spread."""
    spread = spread if isinstance(spread, Column) else F.lit(spread)
    buy = direction > 0.5
    entry = F.when(buy, close + spread).otherwise(close)
    return {
        "entry": entry,
        "sl": F.when(buy, entry - sl_dist - spread).otherwise(entry + sl_dist + spread),
        "tp": F.when(buy, entry + tp_dist).otherwise(entry - tp_dist),
    }


def resolved_target(p: Column, direction: Column, entry: Column, path_close: Column, tie: str = "SL", legacy: bool = False) -> Column:
    """1 when TP was reached first; without a touch the last close decides.

    legacy judges an unresolved sell by a rise as well.
    """
    won = p["hit_tp"] if tie == "TP" else p["hit_tp"] & ~p["hit_sl"]
    rose = path_close > entry
    late = rose if legacy else F.when(direction > 0.5, rose).otherwise(path_close < entry)
    return F.when(path_close.isNull(), None).when(p["touch"] >= 0, won).otherwise(late).cast("double")


def first_touch(
    bars: DataFrame,
    sl_dist: Column,
    tp_dist: Column,
    direction: Column,
    max_bars: int = MAX_BARS_M1,
    block_rows: int = BLOCK_ROWS,
    legacy: bool = False,
) -> DataFrame:
    """target, mfe_atr, mfa_atr of one placement per bar.

    The horizon is max_bars, extended four times when nothing was touched, which
    equals the earliest touch in the longer horizon.
    """
    lv = trade_levels(direction, F.col("close"), sl_dist, tp_dist)
    unit = F.when(F.col("atr_14") > 0, F.col("atr_14")).otherwise(1.0)
    out = with_outcome(bars.withColumn("direction", direction.cast("double")), EXTENSION * max_bars,
                       lv["entry"], lv["sl"], lv["tp"], direction > 0.5, unit, block_rows)
    known = F.col("path_close").isNotNull()
    return out.select(
        *bars.columns, "direction",
        resolved_target(F.col("p"), F.col("direction"), F.col("entry"), F.col("path_close"), legacy=legacy).alias("target"),
        F.when(known, F.col("p.mfe")).alias("mfe_atr"), F.when(known, F.col("p.mfa")).alias("mfa_atr"))


def dir_first_touch(bars: DataFrame, horizon: int = 60, band: float = 1.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1 when close + band*ATR is reached before close - band*ATR (a tie counts up).

    0.5 when neither is reached (drop those rows before training), null without
    a following bar.
    """
    atr = F.greatest(F.coalesce("atr_14", F.lit(1.0)), F.lit(0.05))
    c = F.col("close")
    out = with_outcome(bars, horizon, c, c - band * atr, c + band * atr, F.lit(True), None, block_rows)
    label = (F.when(F.col("path_close").isNull(), None).when(F.col("p.touch") < 0, 0.5)
             .otherwise(F.col("p.hit_tp").cast("double")))
    return out.select(*bars.columns, label.alias("target"))


def dir_price(bars: DataFrame, horizon: int = 240, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Price move over horizon + 1 rows and its direction; null where unknown."""
    ahead = F.lead("close", horizon + 1).over(block_window())
    out = _framed(bars, horizon + 1, block_rows).withColumn("fwd_return", ahead - F.col("close"))
    out = out.withColumn("target", (F.col("fwd_return") > 0).cast("double"))
    return core_rows(out)


def big_move(bars: DataFrame, horizon: int = 15, move_atr: float = 3.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Will the close move move_atr ATRs within `horizon` bars, and to which side mainly?"""
    w = block_window().rowsBetween(1, horizon)
    c, atr = F.col("close"), F.col("atr_14") + 1e-9
    whole = F.count("close").over(w) == horizon
    up = F.when(whole, F.max("close").over(w) - c) / atr
    down = F.when(whole, c - F.min("close").over(w)) / atr
    out = _framed(bars, horizon, block_rows).withColumns({"up_move": up, "dn_move": down})
    out = out.withColumns({
        "regime_label": F.when(F.greatest("up_move", "dn_move") >= move_atr, 1).otherwise(0),
        "regime_dir": F.when(F.col("up_move") >= F.col("dn_move"), 1.0).otherwise(0.0)})
    return core_rows(out).drop("up_move", "dn_move")


def big_move_30(bars: DataFrame, horizon: int = 30, move_atr: float = 2.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the next closes against the close in ATRs: move_atr, is_event, post_ret."""
    w = block_window().rowsBetween(1, horizon)
    mean = F.when(F.count("close").over(w) == horizon, F.avg("close").over(w))
    out = _framed(bars, horizon, block_rows).withColumn("_mean", mean)
    out = out.withColumns({
        "move_atr": (F.col("_mean") - F.col("close")) / (F.col("atr_14") + 1e-9),
        "post_ret": (F.col("_mean") - F.col("close")) / F.col("close")})
    out = out.withColumn("is_event", F.coalesce(F.abs("move_atr") >= move_atr, F.lit(False)))
    return core_rows(out).drop("_mean")


def recency_weight(df: DataFrame, tau_days: float = 120.0, time: str = "time") -> DataFrame:
    """exp(-age/tau), scaled to mean 1. Both constants come from one small aggregate each."""
    edge = df.agg(F.max(F.unix_seconds(time)).alias("_now"))
    raw = F.exp(-((F.col("_now") - F.unix_seconds(time)) / 86400.0) / tau_days)
    mean = df.crossJoin(F.broadcast(edge)).agg(F.max("_now").alias("_now"), F.avg(raw).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn("weight", raw / F.col("_mean")).drop("_now", "_mean")
