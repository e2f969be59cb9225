"""Array kernels over one block of a series: forward first touch, window ranks.

Spark partitions and sorts the blocks; a task hands one bounded block at a time
to numpy. Sliding collect_list frames would rebuild a few hundred boxed values
per row for the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickforge.constants import MIN_SL_FLOOR, SL_MULTS, SPREAD, TP_RATIOS

_OUTCOME = [("touch", T.IntegerType()), ("hit_sl", T.BooleanType()), ("hit_tp", T.BooleanType()),
            ("mfe", T.DoubleType()), ("mfa", T.DoubleType())]
_PLACE = [("direction", T.DoubleType()), ("sl_mult", T.DoubleType()), ("tp_ratio", T.DoubleType())]
TOUCH = T.StructType([T.StructField(n, t) for n, t in _OUTCOME])
CELLS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _PLACE + _OUTCOME]))
ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class BlockPass:
    """What one pass over the blocks adds.

    ranks: {new column: column} average-tie percentile ranks among rank_rows rows.
    horizon: rows ahead; adds path_close (last close) and path_time (its time).
    grid: adds cells, the outcome of every grid placement (needs atr_14, spread).
    levels: {new column: (entry, sl, tp, buy, unit)} outcome of one placement per row.
    """

    ranks: dict[str, str] = field(default_factory=dict)
    rank_rows: int = 200
    horizon: int = 0
    grid: bool = False
    levels: dict[str, tuple[str, str, str, str, str]] = field(default_factory=dict)


def rolling_pct_rank(x: np.ndarray, n: int) -> np.ndarray:
    """Average-tie percentile rank of each value among the last n; nan until n values exist."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        win = sliding_window_view(x, n)
        newest = x[n - 1:, None]
        rank = ((win < newest).sum(axis=1) + (win <= newest).sum(axis=1) + 1) / (2.0 * n)
        out[n - 1:] = np.where(np.isnan(win).any(axis=1), np.nan, rank)
    return out


def _first_reaching(extremes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Per row and level: first position whose running maximum reaches the level (width if none)."""
    width = extremes.shape[1]
    lo = np.zeros(levels.shape, dtype=np.int64)
    hi = np.full(levels.shape, width, dtype=np.int64)
    for _ in range(int(width).bit_length()):
        mid = np.minimum((lo + hi) >> 1, width - 1)
        below = np.take_along_axis(extremes, mid, axis=1) < levels
        active = lo < hi
        lo = np.where(active & below, mid + 1, lo)
        hi = np.where(active & ~below, mid, hi)
    return lo


def resolve_paths(high, low, horizon, entry, sl, tp, buy, unit):
    """Outcome of placements (columns) on the `horizon` bars after each row.

    Returns touch position (0 is the next bar, -1 none), SL and TP flags and the
    excursions before the touch, in `unit`. A bar reaching both levels sets both
    flags.
    """
    n = len(high)
    ahead_high = sliding_window_view(np.concatenate([high[1:], np.full(horizon, -np.inf)]), horizon)
    ahead_low = sliding_window_view(np.concatenate([low[1:], np.full(horizon, np.inf)]), horizon)
    parts = []
    for a in range(0, n, ROWS_AT_ONCE):
        s = slice(a, min(a + ROWS_AT_ONCE, n))
        top = np.maximum.accumulate(ahead_high[s], axis=1)
        bottom = np.minimum.accumulate(ahead_low[s], axis=1)
        b, e = buy[s], entry[s]
        up = _first_reaching(top, np.where(b, tp[s], sl[s]))
        down = _first_reaching(-bottom, -np.where(b, sl[s], tp[s]))
        sl_at, tp_at = np.where(b, down, up), np.where(b, up, down)
        first = np.minimum(sl_at, tp_at)
        hit = first < horizon
        left = np.minimum(horizon, n - 1 - np.arange(s.start, s.stop))[:, None]
        seen = np.where(hit, first, left)
        at = np.clip(seen - 1, 0, horizon - 1)
        hi_seen, lo_seen = np.take_along_axis(top, at, axis=1), np.take_along_axis(bottom, at, axis=1)
        with np.errstate(invalid="ignore"):
            mfe = np.where(b, hi_seen - e, e - lo_seen) / unit[s]
            mfa = np.where(b, e - lo_seen, hi_seen - e) / unit[s]
        none = seen <= 0
        parts.append((np.where(hit, first, -1).astype(np.int32), hit & (sl_at == first), hit & (tp_at == first),
                      np.where(none, np.nan, mfe), np.where(none, np.nan, mfa)))
    return [np.concatenate(x) for x in zip(*parts)]


def _nullable(values: np.ndarray) -> pa.Array:
    flat = values.ravel()
    return pa.array(flat, mask=np.isnan(flat))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return pc.cast(table.column(name), pa.float64()).to_numpy(zero_copy_only=False)


_DIRS, _MULTS, _RATIOS = (a.ravel() for a in np.meshgrid([1.0, 0.0], SL_MULTS, TP_RATIOS, indexing="ij"))


def _grid_cells(table: pa.Table, horizon: int) -> pa.Array:
    close, atr = _numbers(table, "close")[:, None], _numbers(table, "atr_14")[:, None]
    spread = np.nan_to_num(_numbers(table, "spread"), nan=100 * SPREAD)[:, None] / 100.0
    sl_dist = np.maximum(atr * _MULTS, MIN_SL_FLOOR)
    tp_dist = (sl_dist + spread) * _RATIOS
    buy = np.broadcast_to(_DIRS > 0.5, sl_dist.shape)
    entry = np.where(buy, close + SPREAD, close)
    sl = np.where(buy, close - sl_dist, close + sl_dist + SPREAD)
    tp = np.where(buy, entry + tp_dist, entry - tp_dist)
    touch, hit_sl, hit_tp, mfe, mfa = resolve_paths(
        _numbers(table, "high"), _numbers(table, "low"), horizon, entry, sl, tp, buy, np.where(atr > 0, atr, 1.0))
    rows, cells = touch.shape
    flat = pa.StructArray.from_arrays(
        [pa.array(np.tile(x, rows)) for x in (_DIRS, _MULTS, _RATIOS)]
        + [pa.array(touch.ravel()), pa.array(hit_sl.ravel()), pa.array(hit_tp.ravel()), _nullable(mfe), _nullable(mfa)],
        names=[n for n, _ in _PLACE + _OUTCOME])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * cells), flat)


def _one_placement(table: pa.Table, horizon: int, spec: tuple[str, str, str, str, str]) -> pa.Array:
    entry, sl, tp = (_numbers(table, c)[:, None] for c in spec[:3])
    buy = table.column(spec[3]).to_numpy(zero_copy_only=False).astype(bool)[:, None]
    got = resolve_paths(_numbers(table, "high"), _numbers(table, "low"), horizon, entry, sl, tp, buy,
                        _numbers(table, spec[4])[:, None])
    touch, hit_sl, hit_tp, mfe, mfa = got
    return pa.StructArray.from_arrays(
        [pa.array(touch.ravel()), pa.array(hit_sl.ravel()), pa.array(hit_tp.ravel()), _nullable(mfe), _nullable(mfa)],
        names=[n for n, _ in _OUTCOME])


def run_block_pass(framed: DataFrame, todo: BlockPass) -> DataFrame:
    """Apply a BlockPass to a frame cut by operators.series.blocks."""
    fields = [T.StructField(n, T.DoubleType()) for n in todo.ranks]
    if todo.horizon:
        fields += [T.StructField("path_close", T.DoubleType()), T.StructField("path_time", framed.schema["time"].dataType)]
    if todo.grid:
        fields.append(T.StructField("cells", CELLS))
    fields += [T.StructField(n, TOUCH) for n in todo.levels]
    schema = T.StructType([*framed.schema.fields, *fields])

    def per_block(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        n = table.num_rows
        new: list[pa.Array] = [
            _nullable(rolling_pct_rank(_numbers(table, c), todo.rank_rows)) for c in todo.ranks.values()]
        if todo.horizon:
            at = np.minimum(np.arange(n) + todo.horizon, n - 1)
            pick = pa.array(at, mask=at == np.arange(n))
            new += [table.column("close").take(pick), table.column("time").take(pick)]
        if todo.grid:
            new.append(_grid_cells(table, todo.horizon))
        new += [_one_placement(table, todo.horizon, spec) for spec in todo.levels.values()]
        for f, values in zip(fields, new):
            table = table.append_column(f.name, values)
        return table

    return framed.groupBy("sym", "period_id", "block").applyInArrow(per_block, schema)


def tick_windows(us: np.ndarray, bid: np.ndarray, move: np.ndarray, spread: np.ndarray, n: int, short: int, long: int) -> dict[str, np.ndarray]:
    """Counts, imbalance of moves and spread statistics of the last seconds at the ticks from the n-th on; us must be sorted.

    Ticks of one time see each other. Every window is a difference of running totals, so the cost
    is the number of ticks, not the ticks in all windows. NaN is a missing value.
    """
    at = us[n:]
    until = np.searchsorted(us, at, "right")
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    ticks, ups, downs = total(~np.isnan(bid)), total(move > 0), total(move < 0)
    out = {}
    for name, secs in (("60s", short), ("300s", long)):
        since = np.searchsorted(us, at - secs * 1_000_000, "left")
        up, dn = ups[until] - ups[since], downs[until] - downs[since]
        out[f"ticks_{name}"], out[f"imb_{name}"] = ticks[until] - ticks[since], (up - dn) / (up + dn + 1e-9)
    since = np.searchsorted(us, at - short * 1_000_000, "left")
    known = ~np.isnan(spread)
    centre = spread[known].mean() if known.any() else 0.0
    shift = np.where(known, spread - centre, 0.0)
    s1, s2, k = total(shift), total(shift * shift), total(known)
    k = k[until] - k[since]
    mean = (s1[until] - s1[since]) / np.maximum(k, 1)
    var = np.maximum((s2[until] - s2[since]) - k * mean * mean, 0.0) / np.maximum(k - 1, 1)
    return out | {"spread_now": spread[n:], "spread_mean_60s": np.where(k > 0, mean + centre, np.nan), "spread_std_60s": np.where(k > 1, np.sqrt(var), 0.0)}
