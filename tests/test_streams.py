"""Stateful streams over three files, with a restart in between, against the batch operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract import base
from tests.conftest import SF
from tickforge.operators.decision import decide
from tickforge.operators.features import features
from tickforge.operators.regime import with_regime
from tickforge.operators.series import segment
from tickforge.plans.pipelines import REGIME_GROUPS
from tickforge.streaming import live, state


def thirds(df, time, folder, upto=3):
    """Writes the rows as files by thirds of the time range, each one file; the later ones only up to `upto`."""
    lo, hi = (x.timestamp() for x in df.agg(F.min(time), F.max(time)).first())
    part = F.least(F.floor((F.unix_micros(time) / 1e6 - lo) / ((hi - lo) / 3 + 1e-6)), F.lit(2))
    for i in range(upto):
        if not os.path.exists(f"{folder}/{i}"):
            df.where(part == i).coalesce(1).write.parquet(f"{folder}/{i}")
    return df.schema


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b, keys, tol=1e-9):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert (a[c].isna() == b[c].isna()).all() and np.nanmax(np.abs(a[c] - b[c]) / (1 + np.abs(b[c])), initial=0) < tol, c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def twice(spark, df, time, make, tmp_path, keys, want, tol=1e-9):
    """The first file, then a restart with the other two: the appended rows are the batch's."""
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = thirds(df, time, src, 1)
    state.run_files(make(read(spark, src, schema)), out, ckpt)
    thirds(df, time, src, 3)
    same(state.run_files(make(read(spark, src, schema)), out, ckpt), want, keys, tol)


def p(side, sl_mult, tp_ratio):
    return 0.3 + 0.02 * sl_mult - 0.01 * tp_ratio + 0.05 * side + 0 * F.col("atr_14")


def test_scores_equal_batch(spark, tmp_path):
    bars = base.bars(spark, SF.replace("0.001", "0.01")).cache()
    batch = features(segment(bars), [*REGIME_GROUPS, "structure"], None, bar_secs=3600)
    names = ["sym", "time", *state.BAR_FEATURES]
    twice(spark, bars, "time", lambda s: state.stream_features(s).select(*names), tmp_path / "f", ["sym", "time"], batch.select(*names), 1e-6)
    want = ["sym", "time", "regime", "direction", "sl_mult", "tp_ratio", "exp", "rating"]
    options = {"prior": base.prior(spark), "anchor": (1.2, 1.8)}
    twice(spark, bars, "time", lambda s: state.score_stream(s, p, **options).select(*want), tmp_path / "d", ["sym", "time"],
          decide(with_regime(batch), p, **options).select(*want), 1e-6)


def test_microstructure_equals_batch(spark, tmp_path):
    ticks = base.ticks(spark, SF).drop("event_id").dropDuplicates(["sym", "ts"])
    want = live.microstructure(ticks, 600, 3000)
    twice(spark, ticks, "ts", lambda s: state.stream_microstructure(s, 600, 3000), tmp_path, ["sym", "ts"], want)


def test_micro_batches_keep_their_size(spark, monkeypatch):
    """More rows make more files, not larger ones; pieces of a micro-batch see the ticks before them, rows of one time stay together."""
    from contract.model_catalog import appended, as_files

    monkeypatch.setattr(state, "PIECE", 7)
    ticks = base.ticks(spark, SF).drop("event_id").dropDuplicates(["sym", "ts"])
    n = ticks.count()
    stream, place = as_files(ticks, "ts", n // 8)
    sizes = [r["n"] for r in spark.read.parquet(f"{place}/in").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 8 and sum(sizes) == n and max(sizes) < n // 4
    same(appended(state.stream_microstructure(stream, 600, 3000), place), live.microstructure(ticks, 600, 3000), ["sym", "ts"])


@pytest.mark.parametrize("partial", [1.0, 1e9])
def test_touch_equals_batch(spark, tmp_path, partial):
    ticks = base.ticks(spark, SF).drop("event_id").dropDuplicates(["sym", "ts"])
    trades = ticks.where(F.pmod(F.xxhash64("ts"), F.lit(9)) == 0).select(
        F.monotonically_increasing_id().alias("trade_id"), "sym", F.col("ts").alias("opened"), F.pmod(F.xxhash64("ts", "sym"), F.lit(2)).cast("double").alias("direction"), "bid")
    trades = trades.withColumns({"sl": F.col("bid") + F.when(F.col("direction") > 0.5, -20).otherwise(20),
                                 "tp": F.col("bid") + F.when(F.col("direction") > 0.5, 30).otherwise(-30)}).drop("bid").cache()
    none = F.lit(None).cast("double")
    events = ticks.select("sym", "ts", "bid", "ask", none.cast("long").alias("trade_id"), none.alias("direction"), none.alias("sl"), none.alias("tp")).unionByName(
        trades.select("sym", F.col("opened").alias("ts"), none.alias("bid"), none.alias("ask"), "trade_id", "direction", "sl", "tp"))
    cols = ["trade_id", "verdict", "touched", "partial", "verdict_ts"]
    want = live.tick_first_touch(ticks, trades, partial).where("touched IS NOT NULL")
    twice(spark, events, "ts", lambda s: state.stream_touch(s, partial).select(*cols), tmp_path, ["trade_id"], want.select(*cols))
    assert want.count() > 10


def test_new_bars_upserts_and_duplicates(spark, tmp_path):
    """Bars sent again are dropped, also after a restart; updates rewrite only the days they touch, also when a batch is repeated."""
    bars = base.bars(spark, SF).cache()
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = thirds(bars, "time", src, 2)
    make = lambda: state.new_bars(read(spark, src, schema))
    state.run_files(make(), out, ckpt)
    bars.where(F.hour("time") < 12).coalesce(1).write.parquet(f"{src}/again")  # old ones and some of the last third
    sent = state.run_files(make(), out, ckpt)
    assert sent.count() == sent.select("sym", "time").distinct().count()
    assert sent.join(bars, ["sym", "time"], "left_anti").count() == 0 and sent.count() > bars.count() * 2 // 3

    table = str(tmp_path / "table")
    live.write_days(bars, table)
    days = bars.select(F.to_date("time").alias("d")).distinct().orderBy("d").limit(2)
    update = bars.join(days, F.to_date("time") == F.col("d"), "left_semi").withColumns({"high": F.col("high") + 1, "close": F.col("close") + 0.5})
    stamp = {f for d, _, fs in os.walk(table) for f in fs if f.endswith(".parquet")}
    thirds(update, "time", str(tmp_path / "up"))
    stream = read(spark, str(tmp_path / "up"), update.schema)
    for run in range(2):  # the second run repeats all batches
        live.upsert_stream(stream, table, str(tmp_path / f"upc{run}")).awaitTermination()
    same(live.read_days(spark, table), live.upsert_bars(bars, update), ["sym", "time"])
    after = {f for d, _, fs in os.walk(table) for f in fs if f.endswith(".parquet")}
    assert len(stamp - after) == 2 and stamp & after


def test_duplicates_within_watermark(spark, tmp_path):
    rows = base.ticks(spark, SF).select("sym", "ts", "bid").dropDuplicates(["sym", "ts"])
    src = str(tmp_path / "in")
    schema = thirds(rows.union(rows), "ts", src)
    out = state.run_files(live.dedupe_stream(read(spark, src, schema), ["sym", "ts"], "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    same(out, rows, ["sym", "ts"])
