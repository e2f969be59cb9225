"""Results must not depend on where a series is cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.functions.windows import ewm_mean, ewm_mean_bounded
from tickforge.operators import backtest as BT
from tickforge.operators import decision as D
from tickforge.operators.calibration import pool_adjacent
from tickforge.operators.events import calendar_of
from tickforge.operators.features import FEATURE_HALO, features
from tickforge.operators.grid import placement_matrix
from tickforge.operators.models import auc
from tickforge.operators.series import asof_join, block_window, blocks, exact_quantiles, running, segment


def walk(n, seed=0, step=300, gaps=(), sym="A"):
    rng = np.random.default_rng(seed)
    move = rng.choice([-1.0, 0.0, 1.0], n, p=[0.45, 0.1, 0.45]) * rng.random(n).round(2)
    close = (100 + np.cumsum(move)).round(2).clip(10)
    open_ = np.concatenate([[100.0], close[:-1]])
    secs = np.arange(n) * step + 1_704_067_200
    for at, extra in gaps:
        secs[at:] += extra
    return pd.DataFrame({
        "sym": sym, "time": pd.to_datetime(secs, unit="s"), "open": open_, "high": np.maximum(open_, close) + rng.random(n).round(2),
        "low": np.minimum(open_, close) - rng.random(n).round(2), "close": close, "tick_volume": rng.integers(1, 50, n).astype(float),
        "spread": 20.0, "real_volume": 0.0})


def test_segment_across_buckets(spark):
    pdf = walk(900, 1, gaps=[(100, 6 * 3600), (300, 6 * 3600 - 300), (301, 7 * 3600), (302, 9 * 3600), (700, 86400)])
    got = segment(spark.createDataFrame(pdf), bucket_secs=3000, streak_of="close").toPandas().sort_values("time").reset_index(drop=True)
    gap = pdf["time"].diff().dt.total_seconds() > 6 * 3600
    pid = gap.cumsum()
    assert (got["period_id"] == pid).all()
    assert (got["rn"] == pdf.groupby(pid).cumcount()).all()
    assert (got["period_rows"] == pid.map(pid.value_counts())).all()
    sign = np.sign(pdf.groupby(pid)["close"].diff()).fillna(0)
    run = (sign != sign.shift()).cumsum()
    expected = sign * (pdf.groupby([pid, run]).cumcount() + 1)
    assert (got["ret_streak"] == expected).all()


def test_exact_six_hours_does_not_split(spark):
    pdf = walk(20, 2, gaps=[(10, 6 * 3600 - 300)])
    assert segment(spark.createDataFrame(pdf)).select("period_id").distinct().count() == 1


def test_features_do_not_depend_on_blocks(spark):
    pdf = walk(5200, 3)
    seg = segment(spark.createDataFrame(pdf), streak_of="close").persist()
    cal = calendar_of(spark, [2024])
    whole = features(seg, None, cal, bar_secs=300, block_rows=10_000).toPandas().sort_values("rn").reset_index(drop=True)
    cut = features(seg, None, cal, bar_secs=300, block_rows=FEATURE_HALO + 100).toPandas().sort_values("rn").reset_index(drop=True)
    assert len(whole) == len(cut) == len(pdf)
    for c in whole.columns:
        if whole[c].dtype.kind in "fi":
            np.testing.assert_allclose(cut[c].astype(float), whole[c].astype(float), rtol=1e-6, atol=1e-7, err_msg=c)


def test_day_of_short_bars_fits_in_the_halo(spark):
    pdf = walk(21_000, 11, step=4)
    got = features(segment(spark.createDataFrame(pdf)), ["structure"], bar_secs=4).select("rn", "daily_pos").toPandas().sort_values("rn")["daily_pos"]
    day = pdf.groupby(pdf["time"].dt.date)
    hi, lo = day["high"].cummax(), day["low"].cummin()
    np.testing.assert_allclose(got.astype(float), (pdf["close"] - lo) / (hi - lo + 1e-9) * 100, rtol=1e-6, atol=1e-6)


def test_features_are_causal(spark):
    pdf = walk(700, 4)
    cal = calendar_of(spark, [2024])

    def run(part):
        return features(segment(spark.createDataFrame(part), streak_of="close"), None, cal, bar_secs=300).toPandas().sort_values("rn").reset_index(drop=True)

    whole, early = run(pdf), run(pdf.iloc[:500])
    for c in early.columns:
        if early[c].dtype.kind in "fi" and c != "period_rows":
            np.testing.assert_allclose(early[c].astype(float), whole[c].iloc[:500].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_matrix_blocks_and_row_count(spark):
    pdf = walk(4000, 5)
    seg = segment(spark.createDataFrame(pdf)).persist()
    a = placement_matrix(seg, 9, bar_secs=300, groups=["atr"], only_complete=False, block_rows=8192)
    b = placement_matrix(seg, 9, bar_secs=300, groups=["atr"], only_complete=False, block_rows=FEATURE_HALO)
    keys = ["time", "direction", "sl_mult", "tp_ratio"]
    a, b = (x.select(*keys, "target", "mfe_atr", "mfa_atr").toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == (len(pdf) - 1) * 84
    pd.testing.assert_frame_equal(a, b)


def test_constant_prices(spark):
    pdf = walk(250, 6)
    pdf[["open", "high", "low", "close"]] = 50.0
    f = features(segment(spark.createDataFrame(pdf), streak_of="close"), None, None, bar_secs=300).toPandas()
    assert not np.isinf(f.select_dtypes("float").to_numpy(dtype=float)).any()
    assert (f["close_loc"] == 0).all() and (f["ret_streak"] == 0).all()


def test_ewm_helper_and_public_fallback(spark):
    pdf = walk(400, 7)
    df = blocks(segment(spark.createDataFrame(pdf)))
    w = block_window()
    got = df.select("rn", ewm_mean(F.col("close"), 0.25, w).alias("a"), ewm_mean_bounded(F.col("close"), 0.25, w).alias("b")).toPandas().sort_values("rn")
    want = pdf["close"].ewm(alpha=0.25, adjust=False).mean().to_numpy()
    np.testing.assert_allclose(got["a"], want, rtol=1e-12)
    np.testing.assert_allclose(got["b"], want, rtol=1e-12)


def test_running_and_quantiles(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 500, p=[0.8, 0.2]), "i": np.arange(500), "v": np.where(rng.random(500) < 0.3, 1.0, rng.normal(size=500)).round(3)})
    df = spark.createDataFrame(pdf)
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 37), {"s": ("sum", "v"), "m": ("max", "v")}).toPandas().sort_values("i")
    np.testing.assert_allclose(got["s"], pdf.groupby("k")["v"].cumsum(), atol=1e-9)
    np.testing.assert_allclose(got["m"], pdf.groupby("k")["v"].cummax())
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs, 0.05).collect():
        np.testing.assert_allclose(r["q"], np.quantile(pdf.loc[pdf["k"] == r["k"], "v"], probs), atol=1e-12)


@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False)])
def test_asof_join(spark, forward, strict):
    rng = np.random.default_rng(9)
    left = pd.DataFrame({"sym": "A", "t": pd.to_datetime(np.sort(rng.integers(0, 90_000, 200)), unit="s")})
    right = pd.DataFrame({"sym": "A", "t": pd.to_datetime(np.sort(rng.choice(60_000, 40, replace=False)) + 5_000, unit="s"), "v": np.arange(40.0)})
    got = asof_join(spark.createDataFrame(left).withColumnRenamed("t", "lt"), spark.createDataFrame(right).withColumnRenamed("t", "rt"),
                    ["sym"], "lt", "rt", ["v"], 3600, forward, strict).toPandas().sort_values(["lt", "v"])
    want = pd.merge_asof(left, right[["t", "v"]], on="t", direction="forward" if forward else "backward", allow_exact_matches=not strict)
    np.testing.assert_allclose(got["v"].astype(float), want["v"])


@pytest.mark.parametrize("skip", [0, 1])
def test_non_overlap_any_block_size(spark, skip):
    rng = np.random.default_rng(10)
    rn = np.sort(rng.choice(3000, 900, replace=False))
    pdf = pd.DataFrame({"sym": "A", "period_id": 0, "rn": rn, "exit_rn": rn + rng.integers(1, 24, 900)})
    want, free = [], 0
    for a, z in zip(pdf["rn"], pdf["exit_rn"]):
        if a >= free:
            want.append(a)
            free = z + skip
    df = spark.createDataFrame(pdf)
    for size in (64, 4096):
        got = BT.non_overlap(df, 24, skip, block_rows=size).toPandas()["rn"].sort_values().tolist()
        assert got == want


def test_same_idea_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({
        "sym": "A", "time": pd.to_datetime(1_704_067_200 + np.cumsum(rng.integers(5, 90, n)), unit="s"), "direction": rng.choice([0.0, 1.0], n, p=[0.1, 0.9]),
        "regime": rng.choice(["UP", "DOWN"], n, p=[0.9, 0.1]), "px": 100 + np.cumsum(rng.normal(0, 0.3, n)), "atr": 1.0, "tp_dist": 5 + rng.random(n) * 1.5})
    kept, last = [], None
    for r in pdf.itertuples():
        ok = last is None or not ((r.time - last.time).total_seconds() < 30 or (
            r.direction == last.direction and r.regime == last.regime and abs(r.px - last.px) < 0.5 * r.atr and abs(r.tp_dist - last.tp_dist) <= 1.0))
        kept.append(ok)
        last = r if ok else last
    got = D.same_idea(spark.createDataFrame(pdf), bucket_secs=1800).toPandas().sort_values("time")
    assert got["kept"].tolist() == kept


def test_pool_adjacent_is_isotonic():
    rng = np.random.default_rng(12)
    p, w = np.sort(rng.random(60)), rng.integers(1, 9, 60).astype(float)
    rate = p + rng.normal(0, 0.2, 60)
    kp, ky = pool_adjacent(p, rate, w)
    assert (np.diff(ky) >= -1e-12).all() and (np.diff(kp) > 0).all()
    assert len(ky) < 60


def test_auc_with_ties(spark):
    rng = np.random.default_rng(13)
    p, y = rng.integers(0, 20, 300) / 20.0, rng.integers(0, 2, 300)
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    want = ((pos > neg) + 0.5 * (pos == neg)).mean()
    got = auc(spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))).first()["auc"]
    assert abs(got - want) < 1e-12


def test_ranks_with_one_hot_bucket(spark):
    from tickforge.operators.series import ranked_counts

    df = spark.range(3000).selectExpr("'k' sym", "CAST(id % 1000 AS double) / 1e7 v")
    got = ranked_counts(df, ["sym"], "v", 1.0, bucket_rows=16).orderBy("v").toPandas()
    assert got["n"].tolist() == [3] * 1000 and got["below"].tolist() == list(range(0, 3000, 3)) and (got["total"] == 3000).all()
