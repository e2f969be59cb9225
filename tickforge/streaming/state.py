"""Stateful streams: what the batch operators compute, carried from micro-batch to micro-batch per symbol.

A symbol's state is a few numbers and the tails its windows need, so a micro-batch costs its
own rows and never re-reads history. Results are appended once and equal the batch operators'
on the whole input. Rows must arrive in time order per symbol across micro-batches (within one
they are sorted); a row not newer than the last one processed is dropped, which also makes
re-sent rows harmless. Symbols run in parallel, the rows of one symbol in order.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickforge.functions.paths import tick_windows
from tickforge.functions.windows import span_alpha
from tickforge.operators.decision import decide
from tickforge.operators.features import EPS, WILDER
from tickforge.operators.regime import with_regime

STATE = "scalars array<double>, tails array<array<double>>"
NAN = float("nan")
PIECE = 1 << 16

#: Columns that a stream of bars gains; names and values are those of the batch features.
BAR_FEATURES = ["period_id", "rn", "atr_14", "bb_w_20", "rsi_14", "vol_z", "trend_ema", "trend_slope", "above_ema50", "trend_quality", "body_atr", "news_candle",
                "vol_spike", "vol_spike_bin", "spread_z", "range_pos", "bb_pctile", "atr_pctile", "daily_pos", "daily_range_pct"]


def _ewm(last: float, x: float, alpha: float) -> float:
    return last if x != x else x if last != last else last * (1 - alpha) + alpha * x


def _full(tail: deque) -> np.ndarray | None:
    """The tail as an array once it is full of values."""
    if len(tail) < tail.maxlen:
        return None
    out = np.array(tail)
    return None if np.isnan(out).any() else out


class BarState:
    """Exponential means, window tails and the day's range of one symbol."""

    SIZES = {"close": 20, "high": 20, "low": 20, "volume": 20, "spread": 100, "above": 20, "news": 5, "bb": 200, "atr": 200, "ema20": 6}
    SCALARS = ["last", "period", "rn", "c1", "atr14", "e20", "e50", "up", "dn", "day", "day_high", "day_low"]

    def __init__(self, scalars=None, tails=None):
        self.x = dict(zip(self.SCALARS, scalars or [NAN] * len(self.SCALARS)))
        self.tail = {n: deque(t, maxlen=k) for (n, k), t in zip(self.SIZES.items(), tails or [()] * len(self.SIZES))}

    def saved(self) -> tuple:
        return [float(v) for v in self.x.values()], [list(map(float, t)) for t in self.tail.values()]

    def reset(self, period: float) -> None:
        last = self.x["last"]
        self.__init__()
        self.x |= {"last": last, "period": period, "rn": -1.0}

    def step(self, us: float, o: float, h: float, low: float, c: float, v: float, spread: float, gap_us: float) -> list[float]:
        """Features of the next bar."""
        x, tail = self.x, self.tail
        if x["last"] != x["last"] or us - x["last"] > gap_us:
            self.reset(0.0 if x["last"] != x["last"] else x["period"] + 1)
            x, tail = self.x, self.tail
        c1 = x["c1"]
        x["last"], x["rn"], x["c1"] = us, x["rn"] + 1, c
        rn, change = x["rn"], c - c1
        x["atr14"] = _ewm(x["atr14"], h - low if c1 != c1 else max(h - low, abs(h - c1), abs(low - c1)), WILDER)
        x["e20"], x["e50"] = _ewm(x["e20"], c, span_alpha(20)), _ewm(x["e50"], c, span_alpha(50))
        x["up"] = _ewm(x["up"], NAN if change != change else max(change, 0.0), WILDER)
        x["dn"] = _ewm(x["dn"], NAN if change != change else max(-change, 0.0), WILDER)
        day = math.floor(us / 86_400e6)
        fresh = x["day"] != day
        x["day"], x["day_high"], x["day_low"] = day, h if fresh else max(x["day_high"], h), low if fresh else min(x["day_low"], low)
        atr = x["atr14"] + EPS
        body = abs(c - o) / atr
        for name, value in (("close", c), ("high", h), ("low", low), ("volume", v), ("spread", spread), ("above", float(c > x["e50"])),
                            ("news", float(body > 2.5)), ("atr", x["atr14"]), ("ema20", x["e20"])):
            tail[name].append(value)
        bb = vol_z = spread_z = range_pos = above = NAN
        if (closes := _full(tail["close"])) is not None and closes.mean() != 0:
            bb = 2 * closes.std(ddof=1) / closes.mean() * 100
        tail["bb"].append(bb)
        if (volumes := _full(tail["volume"])) is not None:
            vol_z = (v - volumes.mean()) / (volumes.std(ddof=1) + EPS)
        if (spreads := _full(tail["spread"])) is not None:
            spread_z = (spread - spreads.mean()) / (spreads.std(ddof=1) + EPS)
        if rn >= 19:
            floor, top = min(tail["low"]), max(tail["high"])
            range_pos, above = (c - floor) / (top - floor + EPS), sum(tail["above"]) / 20
        news = sum(tail["news"]) / 5 if rn >= 4 else NAN
        slope = (x["e20"] - tail["ema20"][0]) / atr if rn >= 5 else NAN
        trend = (x["e20"] - x["e50"]) / atr
        ranks = []
        for name in ("bb", "atr"):
            window = _full(tail[name])
            ranks.append(NAN if window is None else ((window < window[-1]).sum() + (window <= window[-1]).sum() + 1) / 400.0)
        rsi = 100 - 100 / (1 + x["up"] / (x["dn"] + EPS)) if x["up"] == x["up"] else NAN
        width = x["day_high"] - x["day_low"]
        return [x["period"], rn, x["atr14"], bb, rsi, vol_z, trend, slope, above, abs(trend) / (bb / 100 + EPS), body, news, vol_z, float(vol_z > 2.0), spread_z,
                range_pos, *ranks, (c - x["day_low"]) / (width + EPS) * 100, width / x["day_low"] * 100 if x["day_low"] else NAN]


def _keyed(stream: DataFrame, schema: str, run: Callable) -> DataFrame:
    return stream.groupBy("sym").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(by, kind="stable")


def stream_features(bars: DataFrame, gap_secs: float = 6 * 3600) -> DataFrame:
    """A stream of completed bars with period_id, rn and the regime inputs, bar by bar as the batch features."""
    names = ["sym", "time", "open", "high", "low", "close", "tick_volume", "spread"]
    raw = bars.select(*names[:2], F.unix_micros("time").alias("_us"), *[F.col(c).cast("double").alias(c) for c in names[2:]])
    whole = {"period_id", "rn"}
    schema = "sym string, time timestamp, " + ", ".join(f"{c} double" for c in names[2:]) + ", " + ", ".join(f"{c} {'bigint' if c in whole else 'double'}" for c in BAR_FEATURES)
    columns = [*names, *BAR_FEATURES]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = BarState(*state.get) if state.exists else BarState()
        rows = _ordered(pdfs, ["_us"])
        out = []
        for r in rows.itertuples(index=False):
            if not r[2] <= own.x["last"]:
                out.append((*r[:2], *r[3:], *own.step(*r[2:], gap_secs * 1e6)))
        state.update(own.saved())
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({c: "int64" for c in whole})

    out = _keyed(raw, schema, run)
    return out.select(*names, *[F.nanvl(c, F.lit(None)).alias(c) if c not in whole else F.col(c) for c in BAR_FEATURES])


def score_stream(bars: DataFrame, p: Callable[[Column, Column, Column], Column], gap_secs: float = 6 * 3600, **options) -> DataFrame:
    """Decisions of a stream of completed bars, one appended row a bar: stateful features, then the batch `decide` on each row."""
    return decide(with_regime(stream_features(bars, gap_secs)), p, **options)


def stream_microstructure(ticks: DataFrame, short: int = 60, long: int = 300) -> DataFrame:
    """Per tick of a stream: counts, imbalance of moves and spread statistics of the last seconds, as in batch.

    The state is the last bid and the ticks of the last `long` seconds. Ticks of one time see each other, as in a range window.
    A micro-batch is held as three numbers a tick and answered in runs of about `PIECE` ticks.
    """
    raw = ticks.select("sym", F.unix_micros("ts").alias("_us"), F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"))
    schema = ("sym string, ts timestamp, bid double, ask double, ticks_60s bigint, ticks_300s bigint, imb_60s double, imb_300s double, "
              "spread_now double, spread_mean_60s double, spread_std_60s double")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last, bid), held = state.get if state.exists else ([NAN, NAN], [[], [], [], []])
        parts = [(x["_us"].to_numpy(np.int64), x["bid"].to_numpy(float), x["ask"].to_numpy(float)) for x in pdfs]
        us1, b1, a1 = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(us1, kind="stable")
        order = order[~(us1[order] <= last)]
        us0, bid0, move0, spread0 = (np.array(t, dtype=float) for t in held)
        us0, at = us0.astype(np.int64), 0
        while at < len(order):
            stop = min(at + PIECE, len(order))
            stop += int(np.searchsorted(us1[order[stop - 1:]], us1[order[stop - 1]], "right")) - 1  # ticks of one time stay together
            mine = order[at:stop]
            b, a = b1[mine], a1[mine]
            us, bids = np.concatenate([us0, us1[mine]]), np.concatenate([bid0, b])
            move, spread = np.concatenate([move0, np.sign(np.diff(b, prepend=bid))]), np.concatenate([spread0, a - b])
            out = pd.DataFrame({"sym": key[0], "ts": pd.to_datetime(us1[mine], unit="us", utc=True), "bid": b, "ask": a}
                               | tick_windows(us, bids, move, spread, len(us0), short, long))
            keep = us >= us[-1] - long * 1_000_000
            us0, bid0, move0, spread0 = us[keep], bids[keep], move[keep], spread[keep]
            last, bid, at = us[-1], b[-1], stop
            yield out[names]
        state.update(([float(last), float(bid)], [x.astype(float).tolist() for x in (us0, bid0, move0, spread0)]))

    found = _keyed(raw, schema, run)
    return found.select(*names[:2], *[F.nanvl(c, F.lit(None)).alias(c) if c in ("bid", "ask", "spread_now", "spread_mean_60s") else F.col(c) for c in names[2:]])


def stream_touch(events: DataFrame, partial_secs: float = 5.0) -> DataFrame:
    """Verdicts of a stream of ticks and trade openings: one row when a trade first touches a level.

    events: sym, ts, bid, ask of ticks; trade_id, direction, sl, tp with a null bid for an opening at ts. Buys close at
    the bid, sells at the ask, a tie is SL; min_bid and max_ask are those up to the verdict. The state is the open trades, so a
    tick is compared with the trades open at its time only. A trade whose first tick comes late is UNVERIFIED.
    """
    raw = events.select("sym", "ts", F.unix_micros("ts").alias("_us"), *[F.col(c).cast("double").alias(c) for c in ("bid", "ask", "direction", "sl", "tp")],
                        F.col("trade_id").cast("double").alias("trade_id"))
    schema = "sym string, trade_id bigint, verdict string, touched string, partial boolean, verdict_ts timestamp, min_bid double, max_ask double"

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pdfs, ["_us", "trade_id"])  # an opening comes before the ticks of its time
        (last,), held = state.get if state.exists else ([NAN], [])
        live = np.array(held, dtype=float).reshape(len(held), 8)  # id, side, sl, tp, opened, first tick, least bid, greatest ask
        out = []
        for r in rows.itertuples(index=False):
            if r.trade_id == r.trade_id:
                live = np.vstack([live, [r.trade_id, r.direction, r.sl, r.tp, r[2], NAN, np.inf, -np.inf]])
                continue
            if r[2] < last or not len(live):
                continue
            live[:, 5] = np.where(np.isnan(live[:, 5]), r[2], live[:, 5])
            live[:, 6], live[:, 7] = np.minimum(live[:, 6], r.bid), np.maximum(live[:, 7], r.ask)
            buy = live[:, 1] > 0.5
            sl = np.where(buy, r.bid <= live[:, 2], r.ask >= live[:, 2])
            done = sl | np.where(buy, r.bid >= live[:, 3], r.ask <= live[:, 3])
            for trade, stopped in zip(live[done], sl[done]):
                late = bool(trade[5] - trade[4] > partial_secs * 1e6)
                kind = "SL" if stopped else "TP"
                out.append((key[0], int(trade[0]), "UNVERIFIED" if late else kind, kind, late, r.ts, trade[6], trade[7]))
            live = live[~done]
        times = rows.loc[rows["bid"].notna(), "_us"]
        state.update(([float(times.iloc[-1]) if len(times) else last], live.tolist()))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return _keyed(raw, schema, run)


def new_bars(bars: DataFrame) -> DataFrame:
    """Bars of a stream newer than the last one processed of their symbol; re-sent and older bars are dropped."""
    names = bars.columns
    rows = bars.withColumn("_us", F.unix_micros("time"))

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(pdfs, ["_us"]).drop_duplicates("_us", keep="last")
        (last,), _ = state.get if state.exists else ([NAN], [])
        rows = rows[~(rows["_us"] <= last)]
        state.update(([float(rows["_us"].iloc[-1]) if len(rows) else last], []))
        yield rows[names]

    return _keyed(rows, T.StructType(bars.schema.fields), run)


def run_files(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over the data available now into a Parquet folder (append) and returns the folder's rows.

    Started again with the same checkpoint it goes on after the last completed micro-batch.
    """
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
