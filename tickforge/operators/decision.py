"""From scored placements to a decision and its rating."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.constants import SL_MULTS, TP_RATIOS
from tickforge.functions.windows import clip
from tickforge.operators.ahead import first_ahead, follow
from tickforge.operators.grid import distances
from tickforge.operators.series import BLOCK_ROWS, running
from tickforge.session import checkpointed


def expectancy(p: Column, sl_dist: Column, tp_dist: Column, spread: Column) -> dict[str, Column]:
    """Reward-risk with the spread in the risk, expectancy per unit risked, and in dollars."""
    risk = sl_dist + spread
    rr = tp_dist / (risk + 1e-9)
    return {"rr": rr, "exp": p * rr - (1 - p), "ev": p * tp_dist - (1 - p) * risk}


def nearest(value: Column, grid: Sequence[float]) -> Column:
    """The grid value nearest to a value (of two equally near the lesser)."""
    return F.array_min(F.transform(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.struct(F.abs(g - value).alias("d"), g.alias("g"))))["g"]


def with_learned_pair(cells: DataFrame, prior: DataFrame) -> DataFrame:
    """Cells and, per bar and side, the stop and target pair learned for its regime as a further candidate.

    The pair takes the probability of the grid cell of nearest target ratio and stop, as
    its curve is the one of the nearest ratio. Adds `learned`. Every bar keeps its other
    rows; the prior is joined by regime and side, nothing is grouped.
    """
    pair = prior.select("regime", "direction", F.col("sl_atr").alias("_sl"), F.col("tp_ratio").alias("_tp"))
    base = cells.join(pair, ["regime", "direction"])
    at = (F.col("tp_ratio") == nearest(F.col("_tp"), TP_RATIOS)) & (F.col("sl_mult") == nearest(F.col("_sl"), SL_MULTS))
    dist = distances(F.col("atr_14"), F.col("spread"), F.col("_sl"), F.col("_tp"))
    added = base.filter(at).withColumns({"sl_mult": F.col("_sl"), "tp_ratio": F.col("_tp"), **dist, "is_anchor": F.lit(False), "learned": F.lit(True)})
    return cells.withColumn("learned", F.lit(False)).unionByName(added.drop("_sl", "_tp"))


def reachable_band(cells: DataFrame, prior: DataFrame) -> DataFrame:
    """Drop cells beyond the learned stop and run of their regime and side; anchors and learned pairs stay.

    Input columns regime, direction, sl_dist, tp_dist, atr_14, is_anchor and, after
    with_learned_pair, learned, so that no bar of a known regime is left without a cell.
    """
    caps = prior.select("regime", "direction", F.col("sl_atr").alias("_cap_sl"),
                        F.coalesce("mfe_p50", F.col("sl_atr") * F.col("tp_ratio")).alias("_cap_tp"))
    unit = F.greatest("atr_14", F.lit(1e-9))
    inside = (F.col("sl_dist") / unit <= F.col("_cap_sl")) & (F.col("tp_dist") / unit <= F.col("_cap_tp"))
    free = F.col("_cap_sl").isNull() | F.col("is_anchor")
    if "learned" in cells.columns:
        free = free | F.col("learned")
    return cells.join(caps, ["regime", "direction"], "left").filter(free | inside).drop("_cap_sl", "_cap_tp")


def best_placement(cells: DataFrame, keys: Sequence[str] = ("sym", "time", "direction")) -> DataFrame:
    """Per bar and side the cell with the highest expectancy.

    Expectancies within 1e-9 tie; the anchor wins a tie, then the narrower stop
    and the nearer target. Input: sl_mult, tp_ratio, sl_dist, tp_dist, p, spread
    (dollars), is_anchor.
    """
    scored = cells.withColumns(expectancy(F.col("p"), F.col("sl_dist"), F.col("tp_dist"), F.col("spread")))
    cols = ["sl_mult", "tp_ratio", "sl_dist", "tp_dist", "p", "rr", "exp", "ev"]
    order = F.struct(F.round("exp", 9), F.col("is_anchor").cast("int"), -F.col("sl_mult"), -F.col("tp_ratio"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_b"))
    return best.select(*keys, "_b.*")


def side_choice(best: DataFrame, p_up: DataFrame | None = None) -> DataFrame:
    """One row per bar: the side with the higher weighted expectancy (a tie buys).

    fire is true only when the chosen side's own expectancy is positive. p_up
    holds (sym, time, p_up); missing means 0.5.
    """
    cols = ["sl_mult", "tp_ratio", "sl_dist", "tp_dist", "p", "rr", "exp", "ev"]
    row = F.struct(*cols)
    sides = best.groupBy("sym", "time").agg(
        F.max(F.when(F.col("direction") > 0.5, row)).alias("b"), F.max(F.when(F.col("direction") <= 0.5, row)).alias("s"))
    sides = sides.join(p_up, ["sym", "time"], "left") if p_up is not None else sides.withColumn("p_up", F.lit(None).cast("double"))
    up = F.coalesce("p_up", F.lit(0.5))
    bw, sw = F.col("b.exp") * up, F.col("s.exp") * (1 - up)
    buy = F.col("s").isNull() | F.coalesce(bw >= sw, F.lit(False))
    out = sides.withColumns({"buy_w": bw, "sell_w": sw, "p_up": up, "_buy": buy})
    pick = F.when(F.col("_buy"), F.col("b")).otherwise(F.col("s"))
    out = out.withColumn("_r", pick)
    return out.select("sym", "time", "p_up", "buy_w", "sell_w", F.when(F.col("_buy"), 1.0).otherwise(0.0).alias("direction"),
                      "_r.*", (F.col("_r.exp") > 0).alias("fire"))


def direction_gate(df: DataFrame, metrics: DataFrame, prior: DataFrame) -> DataFrame:
    """p_up of the model (p_model) if its metrics show an edge, else the regime prior.

    metrics is one row (acc, acc_price, base_up); prior holds (regime, p_up).
    """
    m = metrics.limit(1).select(F.col("acc").alias("_a"), F.col("acc_price").alias("_ap"),
                                F.greatest(F.col("base_up"), 1 - F.col("base_up")).alias("_maj"))
    out = df.crossJoin(F.broadcast(m)).join(prior.select("regime", F.col("p_up").alias("_prior")), "regime", "left")
    weak = (F.coalesce(F.col("_a") <= 0.53, F.lit(False)) | F.coalesce(F.col("_ap") <= F.col("_maj") + 0.02, F.lit(False))
            | F.coalesce(F.col("_ap") <= 0.53, F.lit(False)))
    p = F.when(weak, F.coalesce("_prior", F.lit(0.5))).otherwise(clip(F.col("p_model"), 0.05, 0.95))
    return out.withColumn("p_up", p).drop("_a", "_ap", "_maj", "_prior")


COMPONENTS = ["p_comp", "e_comp", "r_comp", "x_comp"]


def components(sl_level: Column, noise: Column) -> dict[str, Column]:
    """Rating inputs of a decided row, from the learned stop and the winners' usual adverse move of its regime and side."""
    te = F.abs(F.coalesce("trend_ema", F.lit(0.0)))
    dist = F.least(F.abs(te - 0.4), F.abs(te - 1.2), F.lit(1.0))
    known = (sl_level > 0) & (noise > 0) & F.col("sl_atr").isNotNull()
    room = (F.when(~F.coalesce(known, F.lit(False)), 0.5).when(F.col("sl_atr") >= sl_level, 1.0)
            .when(F.col("sl_atr") > noise, 0.6).otherwise(0.2))
    ap = F.coalesce("atr_pctile", F.lit(0.5))
    return {"p_comp": clip(F.col("p"), 0, 1), "e_comp": clip((F.col("exp") + 0.25) / 3.0, 0, 1),
            "r_comp": clip(0.5 * (1 - dist) + 0.5 * F.abs(ap - 0.5), 0, 1), "x_comp": room}


def rating_components(df: DataFrame, prior: DataFrame) -> DataFrame:
    """Four inputs of the rating: probability, expectancy, regime confidence, stop headroom."""
    lv = prior.select("regime", "direction", F.col("sl_atr").alias("_sl"), F.col("mfa_p50").alias("_noise"))
    out = df.join(lv, ["regime", "direction"], "left")
    return out.withColumns(components(F.col("_sl"), F.col("_noise"))).drop("_sl", "_noise")


def _best_cell(direction: float, p: Callable[[Column, Column, Column], Column], learned: Column | None, anchor: tuple[float, float] | None) -> Column:
    """The best reachable cell of one side, as a struct; null where no cell has an expectancy.

    The cells of the grid, and the pair learned for the regime, are an array in the row: scored, filtered and reduced in place.
    """
    pair = lambda m, r, is_anchor, own: F.struct(m.alias("sl_mult"), r.alias("tp_ratio"), F.lit(is_anchor).alias("is_anchor"), F.lit(own).alias("learned"))
    pairs = F.array(*[pair(F.lit(float(m)), F.lit(float(r)), (m, r) == anchor, False) for m in SL_MULTS for r in TP_RATIOS])
    if learned is not None:
        own = pair(learned["sl_atr"], learned["tp_ratio"], False, True)
        pairs = F.concat(pairs, F.when(learned["sl_atr"].isNotNull() & learned["tp_ratio"].isNotNull(), F.array(own)).otherwise(F.slice(F.array(own), 1, 0)))
    side, spread, unit = F.lit(direction), F.col("_spread"), F.greatest("atr_14", F.lit(1e-9))

    def placed(c: Column) -> Column:
        d = distances(F.col("atr_14"), spread, c["sl_mult"], c["tp_ratio"])
        return F.struct(c["sl_mult"].alias("sl_mult"), c["tp_ratio"].alias("tp_ratio"), c["is_anchor"].alias("is_anchor"), c["learned"].alias("learned"),
                        d["sl_dist"].alias("sl_dist"), d["tp_dist"].alias("tp_dist"), p(side, c["sl_mult"], c["tp_ratio"]).alias("p"))

    def reachable(c: Column) -> Column:
        cap = F.coalesce(learned["mfe_p50"], learned["sl_atr"] * learned["tp_ratio"])
        return c["is_anchor"] | c["learned"] | learned["sl_atr"].isNull() | ((c["sl_dist"] / unit <= learned["sl_atr"]) & (c["tp_dist"] / unit <= cap))

    def ranked(c: Column) -> Column:
        e = expectancy(c["p"], c["sl_dist"], c["tp_dist"], spread)
        rank = [F.round(e["exp"], 9).alias("_1"), c["is_anchor"].cast("int").alias("_2"), (-c["sl_mult"]).alias("_3"), (-c["tp_ratio"]).alias("_4")]
        cell = [c[n].alias(n) for n in ("sl_mult", "tp_ratio", "sl_dist", "tp_dist", "p")] + [e[n].alias(n) for n in ("rr", "exp", "ev")]
        return F.struct(*rank, *cell, c["learned"].alias("learned"))

    cells = F.transform(pairs, placed)
    if learned is not None:
        cells = F.filter(cells, lambda c: F.coalesce(reachable(c), F.lit(False)))
    return F.array_max(F.filter(F.transform(cells, ranked), lambda c: c["exp"].isNotNull()))


def decide(
    bars: DataFrame,
    p: Callable[[Column, Column, Column], Column],
    prior: DataFrame | None = None,
    weights: DataFrame | None = None,
    threshold: float | None = None,
    anchor: tuple[float, float] | None = None,
) -> DataFrame:
    """Bars to decisions in one pass: placements, reachable band, learned pair, side, rating.

    Input: atr_14, spread (points), regime, trend_ema, atr_pctile and, if known, p_up. p(side, sl_mult, tp_ratio) is the
    probability of a placement, also of the learned pair, from the row's columns. prior (regime, direction, sl_atr,
    tp_ratio, mfe_p50, mfa_p50) has one row a regime and side, and is joined as one small row a regime;
    nothing is exploded, grouped or shuffled, so it also runs on a stream. Adds direction, the chosen
    cell, fire, rating and signal (fired at or above the threshold); a bar without any scored cell is dropped.
    """
    rows = bars.withColumn("_spread", F.coalesce("spread", F.lit(20.0)) / 100.0)
    sides: list[Column | None] = [None, None]
    if prior is not None:
        level = F.struct("sl_atr", "tp_ratio", "mfe_p50", "mfa_p50")
        per = prior.groupBy(F.col("regime").alias("_regime")).agg(F.max(F.when(F.col("direction") > 0.5, level)).alias("_b"),
                                                                  F.max(F.when(F.col("direction") <= 0.5, level)).alias("_s"))
        rows = rows.join(F.broadcast(per), F.col("regime") == F.col("_regime"), "left").drop("_regime")  # a row a regime
        sides = [F.col("_b"), F.col("_s")]
    up = F.coalesce("p_up", F.lit(0.5)) if "p_up" in bars.columns else F.lit(0.5)
    rows = rows.withColumns({"_buy": _best_cell(1.0, p, sides[0], anchor), "_sell": _best_cell(0.0, p, sides[1], anchor), "p_up": up})
    rows = rows.withColumns({"buy_w": F.col("_buy.exp") * F.col("p_up"), "sell_w": F.col("_sell.exp") * (1 - F.col("p_up"))})
    buys = F.col("_sell").isNull() | F.coalesce(F.col("buy_w") >= F.col("sell_w"), F.lit(False))
    rows = rows.withColumn("direction", F.when(buys, 1.0).otherwise(0.0)).withColumn("_cell", F.when(F.col("direction") > 0.5, F.col("_buy")).otherwise(F.col("_sell")))
    cell = ["sl_mult", "tp_ratio", "sl_dist", "tp_dist", "p", "rr", "exp", "ev", "learned"]
    rows = rows.where(F.col("_cell").isNotNull()).withColumns({c: F.col("_cell")[c] for c in cell})
    rows = rows.withColumns({"fire": F.col("exp") > 0, "sl_atr": F.col("sl_dist") / F.greatest("atr_14", F.lit(1e-9))})
    null = F.lit(None).cast("double")
    own = F.when(F.col("direction") > 0.5, F.col("_b")).otherwise(F.col("_s")) if prior is not None else None
    rows = rows.withColumns(components(null if own is None else own["sl_atr"], null if own is None else own["mfa_p50"]))
    rows = rate_signal(rows, weights)
    if threshold is not None:
        rows = rows.withColumn("signal", F.col("fire") & (F.col("rating") >= threshold))
    return rows.drop("_spread", "_buy", "_sell", "_cell", *(["_b", "_s"] if prior is not None else []))


def cross_products(df: DataFrame, target: str = "target") -> DataFrame:
    """One row of sums X'X and X'y for the four components and an intercept (map-side combined)."""
    xs = [*[F.col(c) for c in COMPONENTS], F.lit(1.0)]
    sums = [F.sum(xs[i] * xs[j]).alias(f"x{i}{j}") for i in range(5) for j in range(i, 5)]
    return df.agg(*sums, *[F.sum(xs[i] * F.col(target)).alias(f"y{i}") for i in range(5)])


def rating_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Least-squares weights of the components, normalised, not negative, sum 1.

    Only the 20 sums reach the driver. A singular system takes the least-norm solution.
    """
    r = cross_products(df, target).first()
    a = np.array([[r[f"x{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)], dtype=float)
    w = np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(5)], dtype=float), rcond=None)[0][:4]
    total = w.sum() if abs(w.sum()) > 1e-9 else 1.0
    w = np.maximum(w / total, 0.0)
    w = w / w.sum() if w.sum() > 0 else w
    return df.sparkSession.createDataFrame([tuple(map(float, w))], ", ".join(f"w_{c} double" for c in COMPONENTS))


def rate_signal(df: DataFrame, weights: DataFrame | None) -> DataFrame:
    """rating 0..100 with one decimal; without weights a plain formula of p and exp."""
    if weights is None:
        raw = 50.0 + (F.col("p") - 0.5) * 120.0 + F.col("exp") * 25.0
        return df.withColumn("rating", F.bround(clip(raw, 0, 100), 1))
    out = df.crossJoin(F.broadcast(weights.limit(1)))
    ws = [F.col(f"w_{c}") for c in COMPONENTS]
    score = sum((w * F.col(c) for w, c in zip(ws[1:], COMPONENTS[1:])), ws[0] * F.col(COMPONENTS[0]))
    total = F.greatest(ws[0] + ws[1] + ws[2] + ws[3], F.lit(1e-9))
    return out.withColumn("rating", F.bround(clip(100.0 * score / total, 0, 100), 1)).drop(*[f"w_{c}" for c in COMPONENTS])


def rating_deciles(df: DataFrame, rating: str = "rating", rr: str = "rr", target: str = "target") -> DataFrame:
    """Ten fixed bins of the rating with realised expectancy (100 falls in the last bin)."""
    bin_ = F.least(F.floor(F.col(rating) / 10.0), F.lit(9)).cast("int")
    per = df.groupBy(bin_.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("win_rate"), F.avg(rr).alias("rr_mean"))
    p = F.col("win_rate")
    return per.select("decile", (F.col("decile") * 10.0).alias("lo"), (F.col("decile") * 10.0 + 10.0).alias("hi"),
                      "n", p, "rr_mean", (p * F.col("rr_mean") - (1 - p)).alias("realized_exp"))


def rating_threshold(deciles: DataFrame, min_rows: int = 5000) -> DataFrame:
    """Lower edge of the lowest profitable decile with enough rows, else 100."""
    good = (F.col("realized_exp") > 0) & (F.col("n") >= min_rows)
    return deciles.agg(F.coalesce(F.min(F.when(good, F.col("lo"))), F.lit(100.0)).alias("threshold"))


def same_idea(
    signals: DataFrame,
    min_gap_secs: float = 30.0,
    move_atr: float = 0.5,
    tp_band: float = 1.0,
    bucket_secs: int = 7 * 86400,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Marks signals kept (True) or suppressed as repeats of the last kept one.

    Input: sym, time, direction, regime, px, atr, tp_dist. Every signal finds the next
    that would be kept after it, were it kept itself: the first that follows by min_gap and
    differs in side, regime, price or target. These steps are followed from the first
    signal of a series. Both work in blocks of rows, however long one state lasts.
    """
    gap, names = int(min_gap_secs * 1e6), signals.columns
    bucket = F.floor(F.unix_micros("time") / (bucket_secs * 1_000_000))
    rows = signals.withColumns({"_us": F.unix_micros("time"), "_one": F.lit(1), "_state": F.concat_ws("|", F.col("direction").cast("string"), "regime")})
    rows = checkpointed(running(rows, ["sym"], ["time"], bucket, {"_n": ("sum", "_one")}))
    high = F.lit(float("inf"))
    code = F.pmod(F.xxhash64("_state"), F.lit(1 << 40)).cast("double")
    # limits a little tighter than the rule; `differs` has the last word
    px, reach, slack = F.col("px"), F.col("atr") * move_atr, (F.abs("px") + F.abs("atr")) * 1e-9
    heights = [px - reach + slack, slack - px - reach, F.col("tp_dist"), -F.col("tp_dist"), code, -code]
    limits = [px, -px, F.col("tp_dist") + tp_band * (1 - 1e-9), tp_band * (1 - 1e-9) - F.col("tp_dist"), code + 0.5, 0.5 - code]

    def differs(at: pd.DataFrame, last: pd.DataFrame) -> np.ndarray:
        near = np.abs(at["px"].to_numpy(float) - last["px"].to_numpy(float)) < move_atr * at["atr"].to_numpy(float)
        close = np.abs(at["tp_dist"].to_numpy(float) - last["tp_dist"].to_numpy(float)) <= tp_band
        return ~((at["_state"].to_numpy() == last["_state"].to_numpy()) & near & close)

    steps = first_ahead(rows, ["sym"], "_n", [F.coalesce(h, high) for h in heights], [F.coalesce(x, -high) for x in limits], F.col("_us"),
                        F.col("_us") + gap, ["_state", "px", "atr", "tp_dist"], differs, block_rows)
    met = follow(steps, ["sym"], "_n", "ahead", block_rows).withColumn("_met", F.lit(True))
    return rows.join(met, ["sym", "_n"], "left").select(*names, F.coalesce("_met", F.lit(False)).alias("kept"))
