"""Placement grid: bars x direction x stop width x target ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.constants import EXTENSION, MAX_BARS_M5, MIN_SL_FLOOR, RAW_PRICE_COLS, SL_MULTS, TP_RATIOS
from tickforge.operators.events import DayEvents
from tickforge.operators.features import GROUPS, feature_names, features
from tickforge.operators.labels import resolved_target, trade_levels
from tickforge.operators.series import BLOCK_ROWS


def grid(spark: SparkSession) -> DataFrame:
    """The 42 (sl_mult, tp_ratio) cells."""
    return spark.createDataFrame([(m, r) for m in SL_MULTS for r in TP_RATIOS], "sl_mult double, tp_ratio double")


def distances(atr: Column, spread: Column, sl_mult: Column, tp_ratio: Column) -> dict[str, Column]:
    """Stop distance (never below the floor) and target distance; the risk includes the spread."""
    sl = F.greatest(atr * sl_mult, F.lit(MIN_SL_FLOOR))
    return {"sl_dist": sl, "tp_dist": (sl + spread) * tp_ratio}


def spread_dollars(default: float = 20.0) -> Column:
    return F.coalesce("spread", F.lit(default)) / 100.0


def live_geometry(bars: DataFrame) -> DataFrame:
    """All cells of the grid for each bar with atr_14."""
    out = bars.crossJoin(F.broadcast(grid(bars.sparkSession)))
    return out.withColumns(distances(F.col("atr_14"), spread_dollars(), F.col("sl_mult"), F.col("tp_ratio")))


def geometry(df: DataFrame, sl_dist: Column, tp_dist: Column) -> DataFrame:
    """Placement as model input: distances, stop in ATRs, reward-risk without spread, per side."""
    atr, rr = sl_dist / (F.col("atr_14") + 1e-9), tp_dist / (sl_dist + 1e-9)
    cols: dict[str, Column] = {}
    for side in ("buy", "sell"):
        cols |= {f"sl_dist_{side}": sl_dist, f"tp_dist_{side}": tp_dist, f"sl_atr_{side}": atr, f"rr_{side}": rr}
    return df.withColumns(cols)


def placement_matrix(
    bars: DataFrame,
    max_bars: int = MAX_BARS_M5,
    events: DayEvents | None = None,
    bar_secs: int = 300,
    gap_secs: float = 6 * 3600,
    groups: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    only_complete: bool = True,
    legacy: bool = False,
) -> DataFrame:
    """84 rows per bar: features, geometry, first-touch target and excursions.

    Features are computed once per bar and exploded last; the forward arrays of
    a bar never leave the block pass. `only_complete` drops warm-up bars
    before the explode and rows without a forward path after it.
    """
    groups = list(groups or GROUPS)
    if "atr" not in groups:
        groups.append("atr")
    fx = features(bars, groups, events, bar_secs, gap_secs, block_rows, legacy=legacy, grid_horizon=EXTENSION * max_bars)
    fx = fx.filter(F.col("path_close").isNotNull())
    if only_complete:
        # the calendar may end inside the series: event columns are null there, which is no warm-up
        fx = fx.dropna(subset=[n for n in feature_names(groups) if n in fx.columns and n not in GROUPS["event_proximity"]])
    out = fx.select("*", F.inline("cells")).drop("cells")
    dist = distances(F.col("atr_14"), spread_dollars(), F.col("sl_mult"), F.col("tp_ratio"))
    entry = trade_levels(F.col("direction"), F.col("close"), dist["sl_dist"], dist["tp_dist"])["entry"]
    outcome = F.struct("touch", "hit_sl", "hit_tp")
    out = geometry(out, dist["sl_dist"], dist["tp_dist"]).withColumn(
        "target", resolved_target(outcome, F.col("direction"), entry, F.col("path_close"), legacy=legacy))
    out = out.withColumnsRenamed({"mfe": "mfe_atr", "mfa": "mfa_atr"})
    return out.drop("touch", "hit_sl", "hit_tp", "path_close")


def model_columns(matrix: DataFrame, without_htf: bool = True) -> list[str]:
    """Matrix columns a placement model may see."""
    from tickforge.constants import HTF_COLS

    out = {"sym", "time", "period_id", "rn", "period_rows", "sl_mult", "tp_ratio", "spread",
           "target", "fwd_return", "mfe_atr", "mfa_atr", *RAW_PRICE_COLS, *(HTF_COLS if without_htf else [])}
    return [c for c in matrix.columns if c not in out]
