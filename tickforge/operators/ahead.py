"""First row ahead that breaks a limit, however far ahead it is, and chains of such rows.

A row gives heights, a query (also a row) gives limits; a row lets a query pass while every
height is below its limit. A series is cut into blocks of `block_rows` rows. Inside a block
all queries are answered at once from range maxima of doubling width. A query that its own
block lets pass climbs a pyramid of block maxima, `FANOUT` blocks to a node: each level
is one join on the parent node, so a query costs a few joins however long it waits, and no
task holds more than a block of rows, a block of queries or the FANOUT children of a node.

Limits may be tighter than what a query really demands, if `exact` then decides at the row
found; a query that passes there goes on from the next row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.operators.series import BLOCK_ROWS
from tickforge.session import checkpointed

FANOUT = 64


def maxima(heights: np.ndarray) -> list[np.ndarray]:
    """Range maxima over 1, 2, 4, .. rows of heights (rows, columns)."""
    out = [heights]
    while 2 * (step := 1 << (len(out) - 1)) <= len(heights):
        out.append(np.maximum(out[-1][:-step], out[-1][step:]))
    return out


def first_break(tables: list[np.ndarray], at: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Per query the first row from `at` on with a height at or above its limit; the number of rows if none."""
    n, at = len(tables[0]), at.copy()
    for level in range(len(tables) - 1, -1, -1):
        step = 1 << level
        live = np.flatnonzero(at + step <= n)
        passed = (tables[level][at[live]] < limits[live]).all(1)
        at[live[passed]] += step
    return at


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def _answer(block: pd.DataFrame, queries: pd.DataFrame, width: int, exact: Callable | None) -> np.ndarray:
    """Row numbers of the first rows of `block` (sorted) that break each query's limits after its `_from`; -1 if none.

    A row counts only from the query's `_free` order value on.
    """
    at0, order = block["_at"].to_numpy(np.int64), block["_order"].to_numpy(np.int64)
    tables, limits = maxima(_matrix(block["_h"], width)), _matrix(queries["_l"], width)
    at = np.maximum(np.searchsorted(at0, queries["_from"].to_numpy(np.int64)), np.searchsorted(order, queries["_free"].to_numpy(np.int64)))
    todo, out = np.arange(len(queries)), np.full(len(queries), -1, np.int64)
    while len(todo):
        at[todo] = first_break(tables, at[todo], limits[todo])
        todo = todo[at[todo] < len(at0)]
        sure = np.ones(len(todo), bool) if exact is None or not len(todo) else exact(block.iloc[at[todo]], queries.iloc[todo])
        out[todo[sure]] = at0[at[todo[sure]]]
        todo = todo[~sure]
        at[todo] += 1
    return out


def first_ahead(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    heights: Sequence[Column],
    limits: Sequence[Column],
    order: Column | None = None,
    free: Column | None = None,
    carry: Sequence[str] = (),
    exact: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None,
    block_rows: int = BLOCK_ROWS,
    name: str = "ahead",
) -> DataFrame:
    """Rows (keys, at, name): for every row the first later row number of its series that breaks its limits, null if none.

    at numbers the rows of a series densely or not, without repeats. Null heights break nothing; a row with a
    null limit asks nothing. With order (a long that never falls along the series) and free, rows of an
    order value below a query's `free` let it pass. carry columns are there for `exact(rows, queries)`.
    """
    keys, width = list(keys), len(heights)
    low = F.lit(float("-inf"))
    base = rows.select(
        *keys, F.col(at).cast("long").alias("_at"), F.floor(F.col(at) / block_rows).cast("long").alias("_block"),
        F.array(*[F.coalesce(h.cast("double"), low) for h in heights]).alias("_h"),
        F.when(F.lit(True) if not limits else ~F.array_contains(F.array(*[l.isNull() for l in limits]), True), F.array(*[l.cast("double") for l in limits])).alias("_l"),
        (F.lit(0) if order is None else order).cast("long").alias("_order"), (F.lit(0) if free is None else free).cast("long").alias("_free"), *carry)
    base = checkpointed(base)
    kf = [base.schema[k] for k in keys]
    found_schema = T.StructType([*kf, T.StructField("_at", T.LongType()), T.StructField("_ahead", T.LongType())])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        asks = pdf[pdf["_l"].notna()].assign(_from=lambda q: q["_at"] + 1)
        if not len(asks):
            return pd.DataFrame(columns=found_schema.names)
        return asks[[*keys, "_at"]].assign(_ahead=_answer(pdf, asks, width, exact))

    inside = checkpointed(base.groupBy(*keys, "_block").applyInPandas(within, found_schema))
    found = inside.where("_ahead >= 0")
    waiting = base.drop("_h").join(inside.where("_ahead < 0").select(*keys, "_at"), [*keys, "_at"])
    peaks = base.groupBy(*keys, "_block").agg(F.array(*[F.max(F.col("_h")[i]) for i in range(width)]).alias("_h"))
    levels = [checkpointed(peaks.withColumnRenamed("_block", "_node"))]
    while levels[-1].agg(F.max("_node")).first()[0] not in (None, 0):
        up = levels[-1].groupBy(*keys, F.floor(F.col("_node") / FANOUT).cast("long").alias("_node"))
        levels.append(checkpointed(up.agg(F.array(*[F.max(F.col("_h")[i]) for i in range(width)]).alias("_h"))))
    test_schema = T.StructType([*kf, T.StructField("_at", T.LongType()), T.StructField("_ahead", T.LongType()), T.StructField("_tried", T.LongType())])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf[~pdf["_asks"]].sort_values("_at")
        asks = pdf[pdf["_asks"]].assign(_from=-1)
        out = asks[[*keys, "_at"]].assign(_ahead=_answer(block, asks, width, exact) if len(asks) else [], _tried=asks["_block"])
        return out[test_schema.names]

    while not (waiting := checkpointed(waiting)).isEmpty():
        # waiting: queries and the block they last passed
        goal = _next_block(waiting, levels, keys)
        if goal is None:
            break
        goal = checkpointed(goal)
        load = goal.groupBy(*keys, "_goal").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_parts"))
        part = F.pmod(F.xxhash64("_at"), F.col("_parts")).cast("int").alias("_part")
        asks = goal.join(load, [*keys, "_goal"]).select(*[F.col("_goal").alias("_block") if c == "_block" else F.col(c) for c in base.columns if c != "_h"],
                                                        F.array().cast("array<double>").alias("_h"), part, F.lit(True).alias("_asks"))
        tested = base.join(load.withColumnRenamed("_goal", "_block"), [*keys, "_block"]).select(
            *base.columns, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(False).alias("_asks"))
        seen = checkpointed(tested.unionByName(asks).groupBy(*keys, "_block", "_part").applyInPandas(test, test_schema))
        found = found.unionByName(seen.where("_ahead >= 0").select(*found_schema.names))
        again = seen.where("_ahead < 0").select(*keys, "_at", "_tried")
        waiting = waiting.join(again, [*keys, "_at"]).withColumn("_block", F.col("_tried")).drop("_tried")
    return rows.select(*keys, at).join(found.select(*keys, F.col("_at").alias(at), F.col("_ahead").alias(name)), [*keys, at], "left")


def _next_block(waiting: DataFrame, levels: list[DataFrame], keys: list[str]) -> DataFrame | None:
    """Adds `_goal`, the first block after `_block` whose maxima break the query's limits; queries without one are dropped."""
    def breaks(h: Column) -> Column:
        return F.exists(F.zip_with(h, "_l", lambda x, l: x >= l), lambda b: b)

    def children(level: int) -> DataFrame:
        node = F.struct(F.col("_node").alias("n"), F.col("_h").alias("h"))
        return levels[level].groupBy(*keys, F.floor(F.col("_node") / FANOUT).cast("long").alias("_parent")).agg(F.sort_array(F.collect_list(node)).alias("_kids"))

    def pick(asks: DataFrame, level: int, parent: Column, after: Column) -> DataFrame:
        hit = F.filter("_kids", lambda k: (k["n"] > after) & breaks(k["h"]))
        return asks.withColumn("_parent", parent.cast("long")).join(children(level), [*keys, "_parent"], "left").withColumn(
            "_hit", F.get(F.transform(hit, lambda k: k["n"]), 0)).drop("_parent", "_kids")

    out, asks = None, waiting
    for level in range(len(levels) - 1):
        here = F.floor(F.col("_block") / FANOUT ** level)
        asks = checkpointed(pick(asks, level, F.floor(here / FANOUT), here))
        hit = asks.where("_hit IS NOT NULL")
        for down in range(level - 1, -1, -1):  # the first child of the node that breaks
            hit = pick(hit.withColumn("_node", F.col("_hit")).drop("_hit"), down, F.col("_node"), F.lit(-1)).drop("_node")
        hit = hit.withColumnRenamed("_hit", "_goal")
        out = hit if out is None else out.unionByName(hit)
        asks = asks.where("_hit IS NULL").drop("_hit")
    return out


def follow(steps: DataFrame, keys: Sequence[str], at: str, to: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (keys, at) met when each series is followed from its first row, every row naming a later one in `to` (null ends).

    Blocks shorten their chains to one step from each row where one can be entered; the steps between
    blocks are followed by doubling, so rounds grow with the logarithm of the number of blocks; then
    every block follows its own chain from the row where it is entered.
    """
    keys = list(keys)
    rows = checkpointed(steps.select(*keys, F.col(at).cast("long").alias("_at"), F.col(to).cast("long").alias("_to")))
    block = lambda c: F.floor(F.col(c) / block_rows).cast("long")
    first = rows.groupBy(*keys).agg(F.min("_at").alias("_at"))
    entries = rows.where((block("_to") != block("_at"))).select(*keys, F.col("_to").alias("_at")).union(first).distinct().withColumn("_in", F.lit(True))
    marked = checkpointed(rows.join(entries, [*keys, "_at"], "left").withColumn("_block", block("_at")))
    kf = [rows.schema[k] for k in keys]
    jump_schema = T.StructType([*kf, T.StructField("_at", T.LongType()), T.StructField("_to", T.LongType())])

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        a, to = pdf["_at"].to_numpy(np.int64), pdf["_to"].fillna(-1).to_numpy(np.int64)
        out, where = to.copy(), np.searchsorted(a, to)
        for i in range(len(a) - 1, -1, -1):
            if 0 <= to[i] <= a[-1]:
                out[i] = out[where[i]]
        keep = pdf["_in"].notna().to_numpy() & (out >= 0)
        return pdf.loc[keep, [*keys, "_at"]].assign(_to=out[keep])

    jumps = checkpointed(marked.groupBy(*keys, "_block").applyInPandas(leave, jump_schema))
    reached = first
    while not jumps.isEmpty():
        step = reached.join(jumps, [*keys, "_at"]).select(*keys, F.col("_to").alias("_at"))
        reached = checkpointed(reached.union(step).distinct())
        after = jumps.select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        jumps = checkpointed(jumps.join(after, [*keys, "_to"]).select(*keys, "_at", F.col("_next").alias("_to")))
    # a chain enters a block once, so the least row reached is the entry
    entered = reached.groupBy(*keys, block("_at").alias("_block")).agg(F.min("_at").alias("_entry"))
    out_schema = T.StructType([*kf, T.StructField("_at", T.LongType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        a, to = pdf["_at"].to_numpy(np.int64), pdf["_to"].fillna(-1).to_numpy(np.int64)
        i, met = int(np.searchsorted(a, pdf["_entry"].iloc[0])), []
        while i < len(a):
            met.append(i)
            if to[i] < 0:
                break
            i = int(np.searchsorted(a, to[i]))
        return pdf.iloc[met][[*keys, "_at"]]

    met = marked.join(entered, [*keys, "_block"]).select(*keys, "_block", "_at", "_to", "_entry").groupBy(*keys, "_block").applyInPandas(walk, out_schema)
    return met.withColumnRenamed("_at", at)
