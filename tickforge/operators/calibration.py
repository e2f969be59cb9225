"""Priors from labelled rows and probability calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators.series import asof_join, exact_quantiles


def placement_prior(rows: DataFrame, sl_pct: float = 0.90, tp_pct: float = 0.50, min_side: int = 200, width: float = 0.02) -> DataFrame:
    """Per regime and side: stop beyond the adverse moves of losers, target at the favourable run of winners.

    Input columns: regime, direction, target, mfe_atr, mfa_atr, sl_atr. The stop
    is clamped to the 10-90 % range of the tested stops. Null with fewer than
    min_side winners or losers.
    """
    keys = ["regime", "direction"]
    rows = rows.dropna(subset=["mfe_atr", "mfa_atr", "target", "direction"])
    won = F.col("target") == 1.0
    counts = rows.groupBy(*keys).agg(F.count_if(won).alias("n_winners"), F.count_if(~won).alias("n_losers"))
    win = exact_quantiles(rows.filter(won), keys, "mfe_atr", [tp_pct], width, "w")
    lose = exact_quantiles(rows.filter(~won), keys, "mfa_atr", [0.5, sl_pct], width, "l")
    tested = exact_quantiles(rows, keys, "sl_atr", [0.1, 0.9], width, "t")
    out = counts.join(win, keys, "left").join(lose, keys, "left").join(tested, keys, "left")
    enough = (F.col("n_winners") >= min_side) & (F.col("n_losers") >= min_side)
    w, l, t = F.col("w"), F.col("l"), F.col("t")
    sl = F.greatest(F.least(l[1], t[1]), t[0])
    ratio = F.when(sl > 0, F.greatest(w[0] / sl, F.lit(1.0))).otherwise(1.0)
    made = {"sl_atr": sl, "tp_ratio": ratio, "mfe_p50": w[0], "mfa_p90": l[1], "mfa_p50": l[0]}
    return out.select(*keys, *[F.when(enough, v).alias(n) for n, v in made.items()], "n_winners", "n_losers")


def dir_prior(
    bars: DataFrame,
    horizons: Sequence[int],
    bar_secs: int,
    recent_days: float = 90.0,
    same_regime: bool = False,
    min_recent: int = 50,
    full_weight: int = 500,
    bucket_secs: int = 7 * 86400,
) -> DataFrame:
    """P(close rises) per regime and horizon, thin recent samples shrunk to the full history.

    The later price is the first at or after the horizon, in the whole series or
    (same_regime) among bars of the same regime only.
    """
    keys = ["sym", "regime"] if same_regime else ["sym"]
    base = bars.select("sym", "regime", "time", "close").dropDuplicates(["sym", "time"])
    later = base.select(*keys, F.col("time").alias("t2"), F.col("close").alias("later"))
    edge = base.groupBy("regime").agg(F.max("time").alias("_last"))
    cut = F.unix_micros("_last") - int(recent_days * 86_400_000_000)
    recent = F.unix_micros("time") >= cut
    sizes = base.join(edge, "regime").groupBy("regime").agg(F.count_if(recent).alias("_rows_recent"))
    steps = F.array(*[F.lit(int(h)) for h in horizons])
    probes = base.withColumn("horizon", F.explode(steps)).withColumn(
        "_due", F.timestamp_micros(F.unix_micros("time") + F.col("horizon") * int(bar_secs * 1_000_000)))
    hit = asof_join(probes, later, keys, "_due", "t2", ["later"], bucket_secs, forward=True)
    hit = hit.filter(F.col("later").isNotNull()).join(edge, "regime").withColumn("up", (F.col("later") > F.col("close")).cast("int"))
    per = hit.groupBy("regime", "horizon").agg(
        F.count(F.lit(1)).alias("n_full"), F.avg("up").alias("p_full"),
        F.count_if(recent).alias("_nr"), F.avg(F.when(recent, F.col("up"))).alias("_pr"))
    per = per.join(sizes, "regime")
    usable = F.col("_rows_recent") > min_recent
    n_rec = F.when(usable, F.col("_nr")).otherwise(0)
    p_rec = F.when(usable, F.coalesce("_pr", F.lit(0.0))).otherwise(F.col("p_full"))
    weight = F.least(n_rec / float(full_weight), F.lit(1.0))
    return per.select("regime", "horizon", (weight * p_rec + (1 - weight) * F.col("p_full")).alias("p_up"),
                      "p_full", "n_full", n_rec.alias("n_recent"))


def quantile_bins(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", n_bins: int = 100, width: float = 1e-3) -> DataFrame:
    """Equal-count bins of p per key: bin, mean_p, sum_y, n."""
    keys = list(keys)
    edges = exact_quantiles(df, keys, p, [i / n_bins for i in range(n_bins + 1)], width, "_edges")
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    rows = df.join(edges, keys) if keys else df.crossJoin(F.broadcast(edges))
    at = F.size(F.filter("_edges", lambda e: e <= F.col(p))) - 1
    rows = rows.withColumn("bin", F.greatest(F.least(at, F.size("_edges") - 2), F.lit(0)))
    return rows.groupBy(*keys, "bin").agg(F.avg(p).alias("mean_p"), F.sum(y).cast("double").alias("sum_y"), F.count(F.lit(1)).alias("n"))


def shrink_bins(bins: DataFrame, keys: Sequence[str], min_support: int = 2000) -> DataFrame:
    """Adds rate; thin bins are drawn to the base rate of their key."""
    keys = list(keys)
    base = bins.groupBy(*keys).agg((F.sum("sum_y") / F.sum("n")).alias("_base"))
    out = bins.join(base, keys) if keys else bins.crossJoin(F.broadcast(base))
    rate = F.col("sum_y") / F.col("n")
    drawn = (F.col("sum_y") + F.col("_base") * min_support) / (F.col("n") + min_support)
    return out.withColumn("rate", F.when(F.col("n") < min_support, drawn).otherwise(rate)).drop("_base")


def pool_adjacent(p: np.ndarray, rate: np.ndarray, n: np.ndarray, eps: float = 1e-12) -> tuple[list[float], list[float]]:
    """Isotonic regression on ordered bins: pooled blocks as (mean p, rate)."""
    kept: list[list[float]] = []
    for x, r, w in zip(p, rate, n):
        kept.append([x * w, r * w, w])
        while len(kept) > 1 and kept[-1][1] / kept[-1][2] < kept[-2][1] / kept[-2][2] - eps:
            top = kept.pop()
            kept[-1] = [a + b for a, b in zip(kept[-1], top)]
    return [a / w for a, _, w in kept], [b / w for _, b, w in kept]


def isotonic(bins: DataFrame, keys: Sequence[str], clamp: tuple[float, float] | None = (0.05, 0.95)) -> DataFrame:
    """Knots (knots_p, knots_y, n) per key from bins with rate (a key has at most n_bins rows)."""
    keys = list(keys)
    fields = [bins.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("knots_p", T.ArrayType(T.DoubleType())),
                           T.StructField("knots_y", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mean_p")
        kp, ky = pool_adjacent(pdf["mean_p"].to_numpy(), pdf["rate"].to_numpy(), pdf["n"].to_numpy(float))
        ky = np.maximum.accumulate(ky)
        if clamp:
            ky = np.clip(ky, *clamp)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], kp, list(map(float, ky)), int(pdf["n"].sum())]], columns=schema.names)

    return bins.groupBy(*(keys or [F.lit(0)])).applyInPandas(fit, schema)


def fit_curves(df: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y", n_bins: int = 100,
               min_rows: int = 5000, min_support: int | None = 2000, clamp: tuple[float, float] | None = None) -> DataFrame:
    """Calibration curves per key; keys with fewer than min_rows rows get none."""
    bins = quantile_bins(df, keys, p, y, n_bins)
    bins = shrink_bins(bins, keys, min_support or 0)
    return isotonic(bins, keys, clamp).filter(F.col("n") >= min_rows)


def interpolate(p: Column, knots_p: Column, knots_y: Column) -> Column:
    """Piecewise-linear, flat outside the knots; p itself without a curve."""
    i = F.size(F.filter(knots_p, lambda k: k <= p))
    x0, x1 = F.get(knots_p, i - 1), F.get(knots_p, i)
    y0, y1 = F.get(knots_y, i - 1), F.get(knots_y, i)
    inside = y0 + F.try_divide((y1 - y0) * (p - x0), x1 - x0)
    return F.when(knots_p.isNull(), p).when(i == 0, F.get(knots_y, F.lit(0))).when(i == F.size(knots_p), y0).otherwise(inside)


def apply_curves(df: DataFrame, curves: DataFrame, keys: Sequence[str], p: str = "p", out: str = "p_cal") -> DataFrame:
    """Calibrated probability by a left join with the curve table (one row per key)."""
    joined = df.join(curves.select(*keys, "knots_p", "knots_y"), list(keys), "left")
    return joined.withColumn(out, interpolate(F.col(p), F.col("knots_p"), F.col("knots_y"))).drop("knots_p", "knots_y")


def apply_nearest(df: DataFrame, curves: DataFrame, keys: Sequence[str], ratio: str, p: str = "p", out: str = "p_cal") -> DataFrame:
    """Calibrated probability by the curve of the row's keys whose ratio is nearest (of two equally near the lesser); p without one.

    curves: keys, ratio, knots_p, knots_y. The curves of a key are one small row, so df is joined once and not multiplied.
    """
    keys = list(keys)
    curve = F.struct(F.col(ratio).alias("r"), "knots_p", "knots_y")
    per = curves.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.collect_list(curve).alias("_curves"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    near = F.array_min(F.transform("_curves", lambda c: F.struct(F.abs(c["r"] - F.col(ratio)).alias("d"), c["r"].alias("r"), c["knots_p"].alias("knots_p"), c["knots_y"].alias("knots_y"))))
    joined = df.join(per, on, "left").withColumn("_near", near)
    return joined.withColumn(out, interpolate(F.col(p), F.col("_near.knots_p"), F.col("_near.knots_y"))).drop("_curves", "_near", *[f"_k_{k}" for k in keys])
