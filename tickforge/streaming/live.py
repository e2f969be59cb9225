"""Structured Streaming forms of the tick and bar operators, and their batch twins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.functions.paths import tick_windows
from tickforge.operators.ahead import first_ahead
from tickforge.operators.bars import ticks_to_bars
from tickforge.operators.series import BLOCK_ROWS, previous, running
from tickforge.session import checkpointed


def stream_bars(ticks: DataFrame, width: str = "1 minute", late: str = "60 seconds") -> DataFrame:
    """Bars of a tick stream, final once the watermark passes their end (append mode)."""
    return ticks_to_bars(ticks.withWatermark("ts", late), width)


MICRO = {"ticks_60s": "bigint", "ticks_300s": "bigint", "imb_60s": "double", "imb_300s": "double", "spread_now": "double", "spread_mean_60s": "double",
         "spread_std_60s": "double"}


def microstructure(ticks: DataFrame, short: int = 60, long: int = 300, bucket_secs: int = 3600) -> DataFrame:
    """Per tick: counts, up/down imbalance and spread statistics of the last seconds.

    Time buckets with a halo of `long` seconds (which they are never shorter than) are the groups; in a group
    windows are differences of running totals. The direction of a bucket's first tick comes from the last bid of the bucket before it.
    """
    us = F.unix_micros("ts")
    size = max(bucket_secs, long) * 1_000_000
    rows = previous(ticks.withColumns({"_us": us, "_home": F.floor(us / size)}), ["sym"], "_us", "_home", "bid", "_was")
    rows = rows.withColumn("_d", F.signum(F.col("bid") - F.col("_was"))).drop("_was")
    homes = F.array_compact(F.array(F.col("_home"), F.when(F.col("_us") >= (F.col("_home") + 1) * size - long * 1_000_000, F.col("_home") + 1)))
    rows = rows.withColumn("_b", F.explode(homes))
    names = ticks.columns
    schema = T.StructType([*ticks.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in MICRO.items())).fields])

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["_us"]))
        values = lambda c: group[c].cast(pa.float64()).to_numpy()
        b, us = group["_b"][0].as_py(), group["_us"].to_numpy()
        n = int(np.searchsorted(us, b * size))
        bid = values("bid")
        found = tick_windows(us, bid, values("_d"), values("ask") - bid, n, short, long)
        own = group.slice(n).select(names)
        for c, t in MICRO.items():
            own = own.append_column(c, pa.array(found[c], pa.int64() if t == "bigint" else pa.float64(), from_pandas=True))
        return own

    return rows.groupBy("sym", "_b").applyInArrow(run, schema)


def tick_first_touch(ticks: DataFrame, trades: DataFrame, partial_secs: float = 5.0, bucket_secs: int = 3600, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Verdict per open trade on fill sides: buys close at the bid, sells at the ask; a tie is SL.

    trades: trade_id, sym, opened, direction, sl, tp. Openings and ticks are numbered as one series, an opening before
    the ticks of its time; a trade then finds its first touch by extremes of blocks of ticks, and only in the
    block of the touch by ticks, so no trade is joined with the ticks it lives through. min_bid and max_ask are
    those of all ticks since the opening, by running extremes from the end. The live twin is `state.stream_touch`.
    """
    none = F.lit(None).cast("double")
    both = ticks.select("sym", "ts", F.lit(1).alias("_tick"), F.lit(None).cast("long").alias("trade_id"), *[none.alias(c) for c in ("direction", "sl", "tp")], "bid", "ask").unionByName(
        trades.select("sym", F.col("opened").alias("ts"), F.lit(0).alias("_tick"), F.col("trade_id").cast("long").alias("trade_id"), "direction", "sl", "tp", none.alias("bid"), none.alias("ask")))
    us = F.unix_micros("ts")
    both = both.withColumns({"_one": F.lit(1), "_back": -us, "_last": -F.col("_tick"), "_us": F.when(F.col("_tick") == 1, us)})
    bucket = F.floor(us / (bucket_secs * 1_000_000))
    rows = running(both, ["sym"], ["ts", "_tick", "trade_id"], bucket, {"_n": ("sum", "_one")})
    rows = checkpointed(running(rows, ["sym"], ["_back", "_last"], -bucket, {"min_bid": ("min", "bid"), "max_ask": ("max", "ask"), "_first": ("min", "_us")}))
    buy, high = F.col("direction") > 0.5, F.lit(float("inf"))
    side = lambda b, s: F.when(F.col("_tick") == 0, F.when(buy, b).otherwise(s))
    limits = [side(-F.col("sl"), high), side(F.col("tp"), high), side(high, F.col("sl")), side(high, -F.col("tp"))]
    found = first_ahead(rows, ["sym"], "_n", [-F.col("bid"), F.col("bid"), F.col("ask"), -F.col("ask")], limits, block_rows=block_rows)
    at = rows.select("sym", F.col("_n").alias("ahead"), F.col("bid").alias("_b"), F.col("ask").alias("_a"), F.col("ts").alias("verdict_ts"))
    out = rows.where("_tick = 0").drop("bid", "ask").join(found, ["sym", "_n"]).join(at, ["sym", "ahead"], "left").where(F.col("_first").isNotNull())
    hit_sl = F.when(buy, F.col("_b") <= F.col("sl")).otherwise(F.col("_a") >= F.col("sl"))
    out = out.withColumns({"touched": F.when(F.col("ahead").isNotNull(), F.when(hit_sl, "SL").otherwise("TP")), "partial": F.col("_first") - us > int(partial_secs * 1e6)})
    verdict = F.when(F.col("touched").isNotNull() & F.col("partial"), "UNVERIFIED").otherwise(F.col("touched"))
    return out.select("trade_id", "sym", verdict.alias("verdict"), "touched", "partial", "verdict_ts", "min_bid", "max_ask")


def fresh_ticks(ticks: DataFrame, server_time: str, arrival: str, offset_hours: float = 3.0, max_age_secs: float = 60.0) -> DataFrame:
    """Ticks whose true age on arrival is under the limit; the rest means a closed market."""
    age = F.unix_micros(arrival) - (F.unix_micros(server_time) - int(offset_hours * 3_600_000_000))
    return ticks.filter(F.abs(age) < int(max_age_secs * 1e6))


def upsert_bars(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Bars after updates: same (sym, time) keeps the widest range, the first open and the last close."""
    both = current.withColumn("_v", F.lit(0)).unionByName(updates.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("sym", "time").agg(
        F.max_by("open", "_v").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "_v").alias("close"), F.max_by("tick_volume", "_v").alias("tick_volume"),
        F.max_by("spread", F.when(F.col("spread").isNotNull(), F.col("_v"))).alias("spread"))


def write_days(bars: DataFrame, path: str) -> None:
    """Bars as a table partitioned by day, one file a day."""
    bars.withColumn("day", F.to_date("time")).repartition("day").write.partitionBy("day").mode("overwrite").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def upsert_stream(bars: DataFrame, path: str, checkpoint: str):
    """Merges a stream of bar updates into a table of `write_days`, rewriting only the days that a micro-batch touches.

    The days are read by partition pruning, merged, written to the shared folder and then swapped in day by day. An update
    applied twice changes nothing, so a micro-batch repeated after a failure is harmless.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = [r.day for r in batch.select(F.to_date("time").alias("day")).distinct().collect()]  # days of one micro-batch
        if not days:
            return
        current = spark.read.parquet(path).where(F.col("day").isin(days)).drop("day")
        merged = checkpointed(upsert_bars(current, batch).withColumn("day", F.to_date("time")))
        merged.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(rows: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """First row of every key of a stream; a key is forgotten once the watermark has passed it by `late`."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def after_watermark(bars: DataFrame, last_times: DataFrame) -> DataFrame:
    """Bars newer than the last processed time of their series."""
    return bars.join(last_times, "sym", "left").filter(
        F.col("last_time").isNull() | (F.col("time") > F.col("last_time"))).drop("last_time")


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over the data available now and return the result table (tests, small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
