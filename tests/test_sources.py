import lzma
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_series import walk
from tickforge.operators import audit as A
from tickforge.operators import maintenance as MN
from tickforge.operators.grid import placement_matrix
from tickforge.operators.series import segment
from tickforge.sources import readers as R
from tickforge.streaming import live


def test_candles_round_trip(spark, tmp_path):
    recs = [(60 * i, 1500000 + i, 1500010 + i, 1499990 + i, 1500020 + i, 0.25) for i in range(10)]
    (tmp_path / "day.bi5").write_bytes(lzma.compress(b"".join(struct.pack(">5if", *r) for r in recs)))
    (tmp_path / "bad.bi5").write_bytes(b"not lzma")
    got = R.read_candles(spark, str(tmp_path)).orderBy("sec").toPandas()
    assert len(got) == 10 and got["sec"].tolist() == [60 * i for i in range(10)]
    np.testing.assert_allclose(got["open"], [1500 + i / 1000 for i in range(10)])
    assert (got["high"] >= got["close"]).all() and (got["tick_volume"] == 250).all()


def test_live_bars_skip_malformed(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"t": 60, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "spread": 21, "v": 3}\nnot json\n{"t": 120, "o": 1, "h": 2, "l": 1, "c": 1}\n')
    got = R.read_live_bars(spark, str(tmp_path / "b.jsonl"), "X").orderBy("time").toPandas()
    assert len(got) == 2 and got["spread"].tolist() == [21.0, 20.0]


def test_csv_scan_is_pruned(spark, tmp_path):
    (tmp_path / "b.csv").write_text("sym,time,open,high,low,close,tick_volume,spread,real_volume,src\nA,2024-01-01 00:00:00,1,2,0.5,1.5,10,20,0,x\n")
    df = R.read_bars_csv(spark, str(tmp_path / "b.csv"), ["sym", "close"])
    assert df.collect()[0]["close"] == 1.5
    assert "ReadSchema: struct<sym:string,close:double>" in df._jdf.queryExecution().executedPlan().toString()


def test_schema_guard(spark):
    df = spark.range(1)
    R.check_schema(df, R.schema_fingerprint(df))
    with pytest.raises(ValueError):
        R.check_schema(df.withColumn("x", F.lit(1)), R.schema_fingerprint(df))


def test_incremental_equals_rebuild(spark, tmp_path):
    pdf = walk(900, 21, gaps=[(400, 86400)])
    opts = dict(max_bars=5, bar_secs=300, groups=["atr", "rsi"], only_complete=False)
    bars = spark.createDataFrame(pdf)
    full = placement_matrix(segment(bars, streak_of="close"), **opts)
    cut = pdf["time"].iloc[700]
    old = placement_matrix(segment(spark.createDataFrame(pdf[pdf["time"] <= cut]), streak_of="close"), **opts)
    path = str(tmp_path / "m")
    R.write_time_ordered(old, path)
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("time")).first()[0]
    new = MN.incremental_rows(bars, stored, min_bars=0, **opts)
    keys = ["time", "direction", "sl_mult", "tp_ratio"]
    want = full.filter(F.col("time") > F.lit(last)).select(*keys, "target", "rsi_14").toPandas().sort_values(keys).reset_index(drop=True)
    got = new.select(*keys, "target", "rsi_14").toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    R.write_time_ordered(new, path, mode="append")
    assert MN.incremental_rows(bars, spark.read.parquet(path), min_bars=0, **opts).count() == 0


def test_merge_outcomes_is_idempotent(spark):
    rows = [(1.0, "BUY", "TP", {"trend_ema": 1.0, "bb_pctile": 0.2}), (2.0, "SELL", "SL", {"trend_ema": 1.0}), (3.0, "SELL", "SL", {"trend_ema": -1.0, "bb_pctile": 0.1}),
            (4.0, "BUY", "UNVERIFIED", {"trend_ema": 1.0, "bb_pctile": 0.2})]
    df = spark.createDataFrame([(*r[:3], r[3], (0.0, 1.0, 2.0)) for r in rows],
                               "t double, dir string, result string, feats map<string,double>, state struct<day_pnl:double,streak:double,trades_today:double>")
    first = A.merge_outcomes(df, None, ["trend_ema", "rsi_14"])
    assert sorted(r["target"] for r in first.collect()) == [0.0, 1.0]
    assert A.merge_outcomes(df, first, ["trend_ema"]).count() == 0


def test_merge_outcomes_counts_contradictions(spark):
    f = {"trend_ema": 1.0, "bb_pctile": 0.2}
    rows = [(1.0, "BUY", "TP"), (1.0, "BUY", "SL"), (1.0, "SELL", "SL"), (2.0, "BUY", "TP"), (2.0, "BUY", "TP"), (3.0, "BUY", "UNVERIFIED"), (3.0, "BUY", "SL")]
    df = spark.createDataFrame([(*r, f, (0.0, 1.0, 2.0)) for r in rows],
                               "t double, dir string, result string, feats map<string,double>, state struct<day_pnl:double,streak:double,trades_today:double>")
    got = {r["uid"]: (r["n_results"], r["target"]) for r in A.merge_outcomes(df, None, ["trend_ema"]).collect()}
    assert got == {"1.0|BUY": (2, 0.0), "1.0|SELL": (1, 0.0), "2.0|BUY": (1, 1.0), "3.0|BUY": (1, 0.0)}


def test_legacy_streak(spark):
    pnl = [1, 1, -1, -1, 1, 1, 1, -1, 1]
    df = spark.createDataFrame(pd.DataFrame({"sym": "A", "time": pd.to_datetime(np.arange(9) * 86400 * 40, unit="s"), "pnl": np.array(pnl, float)}))
    got = A.position_state(df).orderBy("time").toPandas()["streak"].tolist()
    assert got == [1, 2, -1, -2, 1, 2, 3, -1, 1]
    legacy = A.position_state(df, legacy=True).orderBy("time").toPandas()["streak"].tolist()
    assert legacy == [1, 2, -1, -1, 0, 1, 2, -1, 0]


def test_position_state_of_trades_at_one_time(spark):
    """Against the query's SQL with its open ties closed by event_id."""
    import duckdb

    rng = np.random.default_rng(3)
    oc = pd.DataFrame({"event_id": rng.permutation(400), "sym": rng.choice(["A", "B"], 400), "time": pd.to_datetime(rng.integers(0, 12, 400) * 21600, unit="s"),
                       "pnl": rng.choice([-1.0, 1.0, 1.0, 1.0, 0.0], 400)})
    oc.loc[oc["time"].dt.hour < 12, "pnl"] = 1.0
    assert duckdb.sql("SELECT count(*) FROM (SELECT DISTINCT sym, time FROM oc)").fetchall()[0][0] < 30
    want = duckdb.sql("""WITH q AS (SELECT *, sum(pnl) OVER (PARTITION BY sym, time::DATE ORDER BY time) AS dp, count(*) OVER (PARTITION BY sym, time::DATE ORDER BY time) AS tt, sign(pnl) AS sg FROM oc),
 i AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER (PARTITION BY sym ORDER BY time, event_id) THEN 1 ELSE 0 END AS ch FROM q),
 j AS (SELECT *, sum(ch) OVER (PARTITION BY sym ORDER BY time) AS isl FROM i)
 SELECT event_id, dp, tt, (sg * row_number() OVER (PARTITION BY sym, isl ORDER BY time, event_id))::BIGINT AS streak FROM j ORDER BY event_id""").fetchall()
    got = A.position_state(spark.createDataFrame(oc), ties=["event_id"]).orderBy("event_id").select("event_id", "day_pnl", "trades_today", F.col("streak").cast("bigint"))
    assert [tuple(r) for r in got.collect()] == want


def test_microstructure_across_buckets(spark):
    rng = np.random.default_rng(5)
    secs = np.sort(rng.choice(20_000, 600, replace=False))
    pdf = pd.DataFrame({"sym": "A", "ts": pd.to_datetime(secs, unit="s"), "bid": 100 + rng.integers(-3, 4, 600).cumsum() * 0.1})
    pdf["ask"] = pdf["bid"] + 0.2
    df = spark.createDataFrame(pdf)
    cols = ["ts", "ticks_60s", "ticks_300s", "imb_60s", "imb_300s"]
    a, b = (live.microstructure(df, bucket_secs=s).select(*cols).toPandas().sort_values("ts").reset_index(drop=True) for s in (400, 10 ** 6))
    pd.testing.assert_frame_equal(a, b)


def test_microstructure_windows_longer_than_buckets(spark):
    """Windows over several buckets, dense ticks of equal times and missing bids, against each tick's own window; no frame is scanned a tick."""
    rng = np.random.default_rng(6)
    secs = np.sort(rng.integers(0, 3000, 800))
    pdf = pd.DataFrame({"sym": "A", "ts": pd.to_datetime(secs, unit="s"), "bid": 100.0 + secs % 7, "ask": 100.0 + secs % 7 + secs % 5 / 10})
    pdf.loc[secs % 11 == 0, "bid"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("bid", F.nanvl("bid", F.lit(None)))
    found = live.microstructure(df, 60, 900, bucket_secs=400)
    got = found.toPandas().sort_values("ts", kind="stable").reset_index(drop=True)
    assert "RangeFrame, -" not in found._jdf.queryExecution().toString()
    spread = (pdf["ask"] - pdf["bid"]).to_numpy()
    for i, t in enumerate(secs):
        short, long = (secs <= t) & (secs >= t - 60), (secs <= t) & (secs >= t - 900)
        known = spread[short][~np.isnan(spread[short])]
        want = [pdf["bid"][short].count(), pdf["bid"][long].count(), known.mean() if len(known) else np.nan, known.std(ddof=1) if len(known) > 1 else 0.0]
        np.testing.assert_allclose(got.loc[i, ["ticks_60s", "ticks_300s", "spread_mean_60s", "spread_std_60s"]].astype(float), want, atol=1e-9)


def test_csv_is_read_by_its_header(spark, tmp_path):
    from tickforge.sources.readers import read_bars_csv

    (tmp_path / "a.csv").write_text("close,time,open,note\n1.5,2024-01-01 00:00:00,1.25,x\n,2024-01-01 00:01:00,2.0,y\n")
    got = read_bars_csv(spark, str(tmp_path / "a.csv")).collect()
    assert (got[0].close, got[0].open, str(got[0].time), got[0].note) == (1.5, 1.25, "2024-01-01 00:00:00", "x") and got[1].close is None
    assert read_bars_csv(spark, str(tmp_path / "a.csv"), ["sym", "time", "open"]).columns == ["time", "open"]


def test_readers_report_what_they_leave_out(spark, tmp_path):
    import lzma

    from tickforge.sources.readers import candle_rejects, live_rejects

    (tmp_path / "good.bi5").write_bytes(lzma.compress(bytes(48)))
    (tmp_path / "cut.bi5").write_bytes(lzma.compress(bytes(50)))
    (tmp_path / "bad.bi5").write_bytes(b"no archive")
    got = candle_rejects(spark.read.format("binaryFile").load(str(tmp_path / "*.bi5"))).collect()
    assert sorted((r.path.rsplit("/")[-1], r.reason, r.bytes) for r in got) == [("bad.bi5", "corrupt", 10), ("cut.bi5", "partial", 2)]
    (tmp_path / "live.jsonl").write_text('{"t": 1, "o": 2.0}\nno json\n{"o": 1.0}\n')
    assert live_rejects(spark, str(tmp_path / "live.jsonl")).count() == 2


def test_window_keeps_nulls(spark):
    from tickforge.operators.bars import pick_windows

    df = spark.sql("SELECT TIMESTAMP '2024-01-05' AS time, CAST(NULL AS double) AS open, 1.0D AS close")
    row = pick_windows(df, [("w", "2024-01-01", "2024-01-31")]).first()
    assert row.open is None and row.src == "w"


def test_models_keep_rows_with_missing_features(spark):
    from tickforge.operators.models import gbt, p_win

    df = spark.range(60).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(id AS double)) x", "CAST(id > 30 AS double) target")
    scored = p_win(gbt(["x"], max_iter=2, max_depth=2).fit(df), df)
    assert scored.count() == 60 and scored.columns == ["id", "x", "target", "p"]
