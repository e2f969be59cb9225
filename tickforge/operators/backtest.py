"""Entries to exits, one position at a time, and reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators.ahead import first_ahead, follow
from tickforge.operators.labels import trade_levels, with_outcome
from tickforge.operators.series import BLOCK_ROWS, exact_quantiles, running
from tickforge.session import checkpointed


def threshold_levels(p: Column, conf: float, atr: Column, close: Column, spread: float = 0.20,
                     sl_atr: float = 1.6, tp_ratio: float = 1.3) -> dict[str, Column]:
    """Fixed rule: buy at p >= conf, sell at p <= 1 - conf; null side otherwise."""
    side = F.when(p >= conf, 1.0).when(p <= 1 - conf, 0.0)
    sl_dist = F.greatest(atr * sl_atr, F.lit(4.0)) + spread
    tp_dist = F.greatest(sl_dist * tp_ratio, atr * 2.0)
    buy = side > 0.5
    return {"direction": side, "entry": close, "sl": F.when(buy, close - sl_dist).otherwise(close + sl_dist),
            "tp": F.when(buy, close + tp_dist).otherwise(close - tp_dist)}


def grid_levels(direction: Column, close: Column, sl_dist: Column, tp_dist: Column, spread: Column) -> dict[str, Column]:
    return {"direction": direction, **trade_levels(direction, close, sl_dist, tp_dist, spread)}


def entry_exit(bars: DataFrame, levels: dict[str, Column], horizon: int, tie: str = "SL", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exit of a trade entered at every bar with a side: kind SL, TP or TIME, exit_rn, pnl.

    All bars are resolved at once. TIME closes at the last close of the horizon.
    """
    buy = F.coalesce(levels["direction"] > 0.5, F.lit(True))
    out = with_outcome(bars.withColumn("direction", levels["direction"]), horizon,
                       levels["entry"], levels["sl"], levels["tp"], buy, None, block_rows)
    out = out.filter(F.col("direction").isNotNull() & F.col("path_close").isNotNull())
    p = F.col("p")
    first = F.when(p["touch"] < 0, "TIME").when((p["hit_sl"] if tie == "SL" else ~p["hit_tp"]), "SL").otherwise("TP")
    out = out.withColumn("kind", first)
    px = F.when(F.col("kind") == "SL", F.col("sl")).when(F.col("kind") == "TP", F.col("tp")).otherwise(F.col("path_close"))
    left = F.least(F.lit(horizon), F.col("period_rows") - 1 - F.col("rn"))
    return out.withColumns({
        "exit_rn": F.col("rn") + F.when(p["touch"] < 0, left).otherwise(p["touch"] + 1),
        "pnl": F.when(F.col("buy"), px - F.col("entry")).otherwise(F.col("entry") - px),
    }).drop("p", "buy", "path_close", "path_time")


def exit_ahead(bars: DataFrame, levels: dict[str, Column], tie: str = "SL", keys: Sequence[str] = ("sym", "period_id"), at: str = "rn",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exit of a trade entered at every bar with a side, held until a level is touched, however long: kind SL or TP, exit_rn, pnl.

    A trade that touches neither level to the end of its series stays open (kind OPEN, null exit and pnl).
    """
    keys = list(keys)
    named = checkpointed(bars.withColumns(dict(levels)))
    buy = F.col("direction") > 0.5
    side = lambda a, b: F.when(F.col("direction").isNotNull(), F.when(buy, a).otherwise(b))
    found = first_ahead(named, keys, at, [-F.col("low"), F.col("high")], [side(-F.col("sl"), -F.col("tp")), side(F.col("tp"), F.col("sl"))],
                        name="exit_rn", block_rows=block_rows)
    touched = bars.select(*keys, F.col(at).cast("long").alias("exit_rn"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    out = named.where("direction IS NOT NULL").join(found, [*keys, at]).join(touched, [*keys, "exit_rn"], "left")
    hit_sl = F.when(buy, F.col("_low") <= F.col("sl")).otherwise(F.col("_high") >= F.col("sl"))
    hit_tp = F.when(buy, F.col("_high") >= F.col("tp")).otherwise(F.col("_low") <= F.col("tp"))
    kind = F.when(F.col("exit_rn").isNull(), "OPEN").when(hit_sl if tie == "SL" else ~hit_tp, "SL").otherwise("TP")
    px = F.when(F.col("kind") == "SL", F.col("sl")).when(F.col("kind") == "TP", F.col("tp"))
    out = out.withColumn("kind", kind).withColumn("pnl", F.when(buy, px - F.col("entry")).otherwise(F.col("entry") - px))
    return out.select(*bars.columns, *[c for c in levels if c not in bars.columns], "kind", "exit_rn", "pnl")


def one_position(bars: DataFrame, trades: DataFrame, skip: int = 1, keys: Sequence[str] = ("sym", "period_id"), at: str = "rn",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades of a one-position-at-a-time run over bars numbered densely, with exits any number of bars ahead.

    From a bar without a trade the run goes on with the next bar, from a trade with the bar `skip` after its
    exit; an open trade ends it. trades: as from exit_ahead.
    """
    keys = list(keys)
    entered = trades.select(*keys, at, F.lit(True).alias("_trade"), (F.col("exit_rn") + skip).alias("_free"))
    steps = bars.select(*keys, at).join(entered, [*keys, at], "left").withColumn("_to", F.when(F.col("_trade"), F.col("_free")).otherwise(F.col(at) + 1))
    return trades.join(follow(steps, keys, at, "_to", block_rows), [*keys, at], "left_semi")


def _chain(rn: np.ndarray, exit_rn: np.ndarray, skip: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate of a block: the next candidate it allows, and where its chain leaves the block."""
    nxt = np.searchsorted(rn, exit_rn + skip)
    leaves = np.empty(len(rn), dtype=np.int64)
    for i in range(len(rn) - 1, -1, -1):
        free = exit_rn[i] + skip
        leaves[i] = leaves[nxt[i]] if nxt[i] < len(rn) else max(free, end)
    return nxt, leaves


def non_overlap(candidates: DataFrame, horizon: int, skip: int = 1, keys: Sequence[str] = ("sym", "period_id"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades of a one-position-at-a-time run: the next entry at exit + skip or later.

    A trade lasts at most `horizon` rows, so a block can be entered in only
    horizon + 1 states. Each block maps entry states to exit states; chaining
    these short maps gives every block its state, and the blocks then pick their
    trades independently.
    """
    keys = list(keys)
    size = max(block_rows, horizon + skip + 1)
    states = horizon + skip + 1
    rows = candidates.withColumn("_blk", F.floor(F.col("rn") / size))
    kf = [candidates.schema[k] for k in keys]
    map_schema = T.StructType([*kf, T.StructField("_blk", T.LongType()), T.StructField("_out", T.ArrayType(T.LongType()))])

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, ex, blk = pdf["rn"].to_numpy(), pdf["exit_rn"].to_numpy(), int(pdf["_blk"].iloc[0])
        start, end = blk * size, (blk + 1) * size
        _, leaves = _chain(rn, ex, skip, end)
        at = np.searchsorted(rn, start + np.arange(states))
        out = np.where(at < len(rn), np.append(leaves, end)[at], np.maximum(end, start + np.arange(states)))
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], blk, out.tolist()]], columns=map_schema.names)

    maps = rows.select(*keys, "_blk", "rn", "exit_rn").groupBy(*keys, "_blk").applyInPandas(block_map, map_schema)
    state_schema = T.StructType([*kf, T.StructField("_blk", T.LongType()), T.StructField("_free", T.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        free, out = 0, []
        for blk, moves in zip(pdf["_blk"], pdf["_out"]):
            free = max(free, int(blk) * size)
            out.append(free)
            free = int(moves[free - int(blk) * size])
        return pdf[[*keys, "_blk"]].assign(_free=out)

    entered = maps.groupBy(*keys).applyInPandas(fold, state_schema)
    names = candidates.columns

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, ex = pdf["rn"].to_numpy(), pdf["exit_rn"].to_numpy()
        i, take = int(np.searchsorted(rn, pdf["_free"].iloc[0])), []
        while i < len(rn):
            take.append(i)
            i = int(np.searchsorted(rn, ex[i] + skip))
        return pdf.iloc[take][[*keys, "rn"]]

    pick_schema = T.StructType([*kf, T.StructField("rn", candidates.schema["rn"].dataType)])
    chosen = rows.select(*keys, "_blk", "rn", "exit_rn").join(entered, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(pick, pick_schema)
    return candidates.join(chosen, [*keys, "rn"], "left_semi").select(*names)


def drawdown(trades: DataFrame, keys: Sequence[str] = ("sym",), bucket_secs: int = 30 * 86400) -> DataFrame:
    """Cumulated pnl in time order, its running peak and the distance to it."""
    bucket = F.floor(F.unix_seconds("time") / bucket_secs)
    out = running(trades, keys, ["time"], bucket, {"cum": ("sum", "pnl")})
    out = running(out, keys, ["time"], bucket, {"peak": ("max", "cum")})
    return out.withColumn("dd", F.col("cum") - F.col("peak"))


def report(trades: DataFrame, keys: Sequence[str] = ("sym",)) -> DataFrame:
    """Trades, win rates, profit factor, expectancy, net, drawdown and exit mix per key."""
    keys = list(keys)
    pnl, buy = F.col("pnl"), F.col("direction") > 0.5
    gain = F.sum(F.when(pnl > 0, pnl).otherwise(0.0))
    loss = F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    n_win, n_loss = F.count_if(pnl > 0), F.count_if(pnl < 0)
    won = (pnl > 0).cast("double")
    main = drawdown(trades, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), n_win.alias("wins"), n_loss.alias("losses"), F.avg(won).alias("win_rate"),
        F.try_divide(gain, loss).alias("profit_factor"), F.avg(pnl).alias("expectancy"), F.sum(pnl).alias("net"),
        F.min("dd").alias("max_drawdown"),
        F.avg(F.when(buy, won)).alias("buy_wr"), F.avg(F.when(~buy, won)).alias("sell_wr"),
        (gain / F.greatest(n_win, F.lit(1))).alias("avg_win"), (loss / F.greatest(n_loss, F.lit(1))).alias("avg_loss"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("SL", "TP", "TIME")])
    return main


def report_by_regime(trades: DataFrame, min_trades: int = 5, keys: Sequence[str] = ("regime",)) -> DataFrame:
    """Win rate, profit factor, net and mean result in units of risk, groups of min_trades or more."""
    pnl = F.col("pnl")
    risk = F.greatest(F.abs(F.col("entry") - F.col("sl")), F.lit(1e-9))
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"),
        (gain / F.greatest(loss, F.lit(1e-9))).alias("profit_factor"), F.sum(pnl).alias("net"), F.avg(pnl / risk).alias("ev_r"))
    return out.filter(F.col("trades") >= min_trades)


def entries_with_regime(trades: DataFrame, regimes: DataFrame, default: str = "MIXED") -> DataFrame:
    """Regime of each entry bar by time; a default where the bar is unknown."""
    out = trades.join(regimes.select("sym", "time", F.col("regime").alias("_r")), ["sym", "time"], "left")
    return out.withColumn("regime", F.coalesce("_r", F.lit(default))).drop("_r")


# Probability thresholds of the calibration report
THRESHOLDS = [0.55, 0.60, 0.65, 0.70, 0.75, 0.80]


def prob_calibration(df: DataFrame, p: str = "p", y: str = "y", min_rows: int = 20, thresholds: Sequence[float] = tuple(THRESHOLDS)) -> DataFrame:
    """Share of right calls when p >= th (BUY) or p <= 1 - th (SELL).

    One pass with two conditional sums per threshold, then a small unpivot.
    """
    py, yy = F.col(p), F.col(y)
    aggs = []
    for i, th in enumerate(thresholds):
        for side, ok, right in (("BUY", py >= th, yy), ("SELL", py <= F.lit(1.0) - F.lit(th), 1 - yy)):
            aggs.append(F.struct(F.lit(float(th)).alias("threshold"), F.lit(side).alias("side"),
                                 F.count_if(ok).alias("n"), F.avg(F.when(ok, right)).alias("correct")).alias(f"s{i}{side}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.col(c) for c in wide.columns])).alias("s")).select("s.*")
    return long.filter(F.col("n") >= min_rows)


def selectivity(df: DataFrame, q: float, p: str = "p", width: float = 1e-3) -> DataFrame:
    """Rows whose probability is in the top of its own distribution (percentile q of non-zero p)."""
    cut = exact_quantiles(df.filter(F.col(p) != 0), [], p, [q / 100.0], width, "_cut")
    return df.crossJoin(F.broadcast(cut)).filter(F.col(p) >= F.col("_cut")[0]).drop("_cut")


def selective_runs(bars: DataFrame, levels: dict[str, Column], p: Column, qs: Sequence[float] = (90, 95, 99), width: float = 1e-3, tie: str = "TP",
                   keys: Sequence[str] = ("sym", "period_id"), at: str = "rn", **options) -> DataFrame:
    """Trades taken one at a time when p is in the top of its own distribution, once per percentile q of the non-zero p.

    Exits are found once; each q then has its own chain over the bars. Adds q.
    """
    keys = list(keys)
    rows = checkpointed(bars.withColumn("_conf", p))
    cuts = exact_quantiles(rows.where("_conf <> 0"), [], "_conf", [q / 100.0 for q in qs], width, "_cut")
    named = {k: v for k, v in levels.items()}
    trades = exit_ahead(rows, named, tie, keys, at, **options)
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(i).alias("i")) for i, q in enumerate(qs)])).alias("_q")
    chosen = trades.crossJoin(F.broadcast(cuts)).select("*", each).where(F.col("_conf") >= F.get("_cut", F.col("_q.i"))).withColumn("q", F.col("_q.q"))
    chosen = checkpointed(chosen.drop("_q", "_cut", "_conf"))
    run = rows.select(*keys, at, each).withColumn("q", F.col("_q.q")).drop("_q")
    return one_position(run, chosen, 1, [*keys, "q"], at)


def rerun_at_spreads(bars: DataFrame, levels_of, horizon: int, spreads: Sequence[float] = (0.20, 0.30, 0.41), skip: int = 1, **options) -> DataFrame:
    """Trades taken one at a time under each assumed spread: exits and chains are found again for each.

    levels_of(spread column) gives the levels. Every spread makes its own series, so the
    work is one pass over bars times spreads.
    """
    each = at_spreads(bars, spreads).withColumn("_sym", F.col("sym")).withColumn("sym", F.concat_ws("@", "sym", F.col("cost").cast("string")))
    trades = non_overlap(entry_exit(each, levels_of(F.col("cost")), horizon, **options), horizon, skip)
    return trades.withColumn("sym", F.col("_sym")).drop("_sym")


def at_spreads(df: DataFrame, spreads: Sequence[float] = (0.20, 0.30, 0.41)) -> DataFrame:
    """Each row once per assumed spread (cost), a plan constant."""
    return df.withColumn("cost", F.explode(F.array(*[F.lit(float(s)) for s in spreads])))
