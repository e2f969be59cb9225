"""End-to-end plans built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickforge.constants import MAX_BARS_M5
from tickforge.operators.events import DayEvents
from tickforge.operators.features import features
from tickforge.operators.grid import placement_matrix
from tickforge.operators.regime import with_regime
from tickforge.operators.series import segment
from tickforge.session import checkpointed
from tickforge.sources.readers import write_time_ordered

REGIME_GROUPS = ["atr", "rsi", "bollinger", "volume", "regime_feats", "rolling_pctrank"]


def regime_frame(bars: DataFrame, gap_secs: float = 6 * 3600, min_bars: int = 0, bar_secs: int = 300) -> DataFrame:
    """Bars with the regime inputs and their regime."""
    return with_regime(features(segment(bars, gap_secs, min_bars), REGIME_GROUPS, None, bar_secs, gap_secs))


def nightly_matrix(bars: DataFrame, path: str, events: DayEvents | None = None, gap_secs: float = 6 * 3600,
                   min_bars: int = 300, bar_secs: int = 300, max_bars: int = MAX_BARS_M5) -> None:
    """Bars to the stored placement matrix."""
    seg = checkpointed(segment(bars, gap_secs, min_bars, streak_of="close"))
    write_time_ordered(placement_matrix(seg, max_bars, events, bar_secs, gap_secs), path)
