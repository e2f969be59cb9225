"""Bar sources to clean bars: shift, merge, resample, subsample, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickforge.constants import SPREAD_POINTS
from tickforge.operators.series import ranked_counts

PRICES = ["open", "high", "low", "close"]


def ticks_to_bars(
    ticks: DataFrame,
    width: str = "1 minute",
    order: Column | None = None,
) -> DataFrame:
    """Bars of the bid; spread is the last ask-bid in points, the first tick of a bar is not counted.

    order breaks ties of ticks with equal ts and must be a plain number or time
    so that the aggregation stays a hash aggregation.
    """
    order = F.col("ts") if order is None else order
    points = F.bround((F.col("ask") - F.col("bid")) * 100)
    bars = ticks.groupBy("sym", F.window("ts", width).alias("_w")).agg(
        F.min_by("bid", order).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"),
        F.max_by("bid", order).alias("close"),
        (F.count(F.lit(1)) - 1).cast("double").alias("tick_volume"),
        F.max_by(points, order).alias("spread"))
    return bars.select("sym", F.col("_w.start").alias("time"), *PRICES, "tick_volume", "spread",
                       F.lit(0.0).alias("real_volume"))


def value_bars(rows: DataFrame, width: str, price: str, volume: Column, order: Column) -> DataFrame:
    """Bars of any valued rows (sym, ts): price extremes, summed volume."""
    bars = rows.groupBy("sym", F.window("ts", width).alias("_w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(volume).cast("double").alias("tick_volume"))
    return bars.select("sym", F.col("_w.start").alias("time"), *PRICES, "tick_volume",
                       F.lit(SPREAD_POINTS).alias("spread"), F.lit(0.0).alias("real_volume"))


def resample(bars: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Coarser bars; a missing spread becomes the default in points."""
    out = bars.groupBy("sym", F.window("time", width).alias("_w")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "time").alias("close"), F.sum("tick_volume").alias("tick_volume"),
        F.avg("spread").alias("spread"), F.sum("real_volume").alias("real_volume"))
    return out.select("sym", F.col("_w.start").alias("time"), *PRICES, "tick_volume",
                      F.coalesce("spread", F.lit(SPREAD_POINTS)).alias("spread"), "real_volume"
                      ).dropna(subset=["open", "close"])


def shift_to_utc(bars: DataFrame, offset_hours: float = 3.0, time: str = "time") -> DataFrame:
    return bars.withColumn(time, F.timestamp_micros(F.unix_micros(time) - int(offset_hours * 3_600_000_000)))


def merge_bars(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of sources; for a time that several hold, the last source wins.

    max_by over a priority is a hash aggregation with map-side combine, so equal
    times meet without a sort of each source.
    """
    tagged = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("sym", "time", "_prio")]
    return both.groupBy("sym", "time").agg(F.max_by(F.struct(*cols), "_prio").alias("_r")).select("sym", "time", "_r.*")


def tail_union(seed: DataFrame, current: DataFrame) -> DataFrame:
    """Seed plus only those current rows that are newer than the seed's last time."""
    def filled(df: DataFrame) -> DataFrame:
        if "spread" not in df.columns:
            df = df.withColumn("spread", F.lit(None).cast("double"))
        if "real_volume" not in df.columns:
            df = df.withColumn("real_volume", F.lit(None).cast("double"))
        return df.withColumns({
            "spread": F.coalesce("spread", F.lit(SPREAD_POINTS)),
            "real_volume": F.coalesce("real_volume", "tick_volume", F.lit(0.0))})
    edge = seed.groupBy("sym").agg(F.max("time").alias("_edge"))
    newer = current.join(edge, "sym", "left").filter(F.col("_edge").isNull() | (F.col("time") > F.col("_edge"))).drop("_edge")
    return filled(seed).unionByName(filled(newer), allowMissingColumns=True)


def poison_drop(bars: DataFrame, first_year: int = 2000, time: str = "time") -> DataFrame:
    return bars.filter(F.col(time) >= F.lit(f"{first_year:04d}-01-01").cast("timestamp"))


def pick_windows(bars: DataFrame, windows: Sequence[tuple[str, str, str]], whole_end_day: bool = True) -> DataFrame:
    """Rows of named date windows, tagged with the name in src.

    The windows are a fixed list in the plan, so each becomes a time predicate
    that reaches the scan. A row in two windows appears once per window.
    """
    parts = []
    for name, first, last in windows:
        end = F.lit(last).cast("timestamp")
        stop = F.col("time") < end + F.expr("INTERVAL 1 DAY") if whole_end_day else F.col("time") <= end
        parts.append(bars.filter((F.col("time") >= F.lit(first).cast("timestamp")) & stop).withColumn("src", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def year_coverage(bars: DataFrame, keys: Sequence[str] = ("src",)) -> DataFrame:
    return bars.groupBy(*keys, F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def integrity(bars: DataFrame, max_step_secs: int = 120, tolerance: float = 0.02, bucket_secs: int = 14 * 86400) -> DataFrame:
    """Share of steps that are too long or not forward, per series.

    Steps inside a time bucket are counted there; the one step between two
    buckets is counted on the bucket summaries.
    """
    us = F.unix_micros("time")
    rows = bars.select("sym", us.alias("us"), F.floor(us / (bucket_secs * 1_000_000)).alias("b"))
    bad = (F.col("step") > max_step_secs * 1_000_000) | (F.col("step") <= 0)
    rows = rows.withColumn("step", F.col("us") - F.lag("us").over(W.partitionBy("sym", "b").orderBy("us")))
    per = rows.groupBy("sym", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"),
                                      F.min("us").alias("lo"), F.max("us").alias("hi"))
    per = per.withColumn("step", F.col("lo") - F.lag("hi").over(W.partitionBy("sym").orderBy("b")))
    out = per.groupBy("sym").agg(F.sum("n").alias("n_bars"), (F.sum("bad") + F.count_if(bad)).alias("bad_gaps"))
    return out.withColumn("ok", F.col("bad_gaps") <= F.col("n_bars") * tolerance)


def subsample(rows: DataFrame, every: int, bucket_secs: int = 86400) -> DataFrame:
    """Rows of every k-th distinct time of a series (the first is kept)."""
    us = F.unix_micros("time")
    times = rows.select("sym", "time", us.alias("_us"))
    ranked = ranked_counts(times.distinct(), ["sym"], "_us", float(bucket_secs * 1_000_000))
    keep = ranked.filter(F.col("below") % every == 0).select("sym", F.timestamp_micros("_us").alias("time"))
    return rows.join(keep, ["sym", "time"], "left_semi")


GRID_KEY = ["time", "direction", "sl_dist_buy", "tp_dist_buy"]


def dedupe_grid(matrix: DataFrame, keys: Sequence[str] = ("sym", *GRID_KEY)) -> DataFrame:
    return matrix.dropDuplicates(list(keys))


def dedupe_report(matrix: DataFrame, keys: Sequence[str] = ("sym", *GRID_KEY)) -> DataFrame:
    per = matrix.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("kept"), (F.sum("n") - F.count(F.lit(1))).alias("dropped"))


def to_float32(df: DataFrame, keep: Sequence[str] = ("sym", "time")) -> DataFrame:
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("double", "integer", "long", "float", "decimal")}
    return df.select(*[F.col(c).cast("float").alias(c) if c in numeric and c not in keep else F.col(c) for c in df.columns])


def target_balance(df: DataFrame, target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("n"))


def macro_outer(series: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Full outer concatenation of daily (date, value) series.

    One grouping over the tagged union replaces a chain of outer joins.
    """
    both = None
    for name, df in series:
        part = df.select("date", F.lit(name).alias("_s"), F.col("value"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("date").agg(
        *[F.max(F.when(F.col("_s") == n, F.col("value"))).alias(n) for n, _ in series])


def latest_complete(df: DataFrame, order: str = "date") -> DataFrame:
    return df.dropna().orderBy(F.col(order).desc()).limit(1)


def keep_last(df: DataFrame, n: int, order: str = "t") -> DataFrame:
    """Newest n rows. orderBy + limit keeps n rows per task, then merges them."""
    return df.orderBy(F.col(order).desc_nulls_last()).limit(n)


def keep_recent(df: DataFrame, now_epoch: float | Column, days: float, epoch: str = "t") -> DataFrame:
    """Rows at most `days` old; rows without a time are kept."""
    return df.filter(F.col(epoch).isNull() | (F.lit(now_epoch) - F.col(epoch) <= days * 86400))


def recent_window(df: DataFrame, days: float = 180.0, time: str = "time") -> DataFrame:
    """Rows newer than the last time minus `days`."""
    edge = df.agg(F.max(F.unix_micros(time)).alias("_edge"))
    cut = F.col("_edge") - int(days * 86_400_000_000)
    return df.crossJoin(F.broadcast(edge)).filter(F.unix_micros(time) >= cut).drop("_edge")
