"""Incremental upkeep of the placement matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators.grid import placement_matrix
from tickforge.operators.series import segment


def newer_periods(bars: DataFrame, last_times: DataFrame, gap_secs: float = 6 * 3600, min_bars: int = 300) -> DataFrame:
    """Segmented bars of the periods that hold a bar after the series' last matrix time.

    last_times: (sym, last_time), null or absent for a new series.
    """
    seg = segment(bars, gap_secs, min_bars=min_bars, streak_of="close")
    touched = seg.join(last_times, "sym", "left").filter(F.col("last_time").isNull() | (F.col("time") > F.col("last_time")))
    return seg.join(touched.select("sym", "period_id").distinct(), ["sym", "period_id"], "left_semi")


def updated_matrix(bars: DataFrame, matrix: DataFrame, gap_secs: float = 6 * 3600, min_bars: int = 300, **options) -> DataFrame:
    """The stored matrix with new bars worked in, equal to a full rebuild.

    Rows near the end of the stored matrix had a shorter path ahead than the new bars
    give them, so the rows of every period with a new bar are replaced, not only added
    to; stored rows before the first such period of a series stay. Columns must agree.
    """
    last = matrix.groupBy("sym").agg(F.max("time").alias("last_time"))
    touched = newer_periods(bars, last, gap_secs, min_bars)
    fresh = placement_matrix(touched, gap_secs=gap_secs, **options)
    if set(fresh.columns) != set(matrix.columns):
        raise ValueError(f"columns differ: {sorted(set(fresh.columns) ^ set(matrix.columns))}")
    since = touched.groupBy("sym").agg(F.min("time").alias("since"))
    kept = matrix.join(since, "sym", "left").filter(F.col("since").isNull() | (F.col("time") < F.col("since"))).select(*fresh.columns)
    return kept.unionByName(fresh)


def incremental_rows(bars: DataFrame, matrix: DataFrame, gap_secs: float = 6 * 3600, min_bars: int = 300, **options) -> DataFrame:
    """Matrix rows newer than the matrix, equal to those of a full rebuild.

    Whole touched periods are computed again: long exponential means and daily
    context make a fixed number of context bars inexact.
    """
    last = matrix.groupBy("sym").agg(F.max("time").alias("last_time"))
    fresh = placement_matrix(newer_periods(bars, last, gap_secs, min_bars), gap_secs=gap_secs, **options)
    return (fresh.join(last, "sym", "left")
            .filter(F.col("last_time").isNull() | (F.col("time") > F.col("last_time"))).drop("last_time"))
