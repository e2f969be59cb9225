"""Long series without long tasks.

One series (or one contiguous period of it) may hold a large share of all rows,
so no window here is partitioned by the series alone. A series is cut into
blocks; a block is one task. What a block needs from others comes in two ways:

* a summary of the earlier blocks, one row per block (`segment`, `running`,
  `asof_join`, `exact_quantiles`), joined back on the block key; or
* a halo: copies of the last or next few rows of the neighbour (`blocks`), for
  operators that look back or forward a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time))


def segment(
    bars: DataFrame,
    gap_secs: float = 6 * 3600,
    min_bars: int = 0,
    keys: Sequence[str] = ("sym",),
    time: str = "time",
    bucket_secs: int = 14 * 86400,
    streak_of: str | None = None,
) -> DataFrame:
    """Contiguous periods: a gap longer than gap_secs starts a new one.

    Adds period_id (from 0 per series), rn (row index in the period) and
    period_rows; periods shorter than min_bars are dropped. With streak_of, adds
    ret_streak, the signed run length of rises and falls of that column.
    Rows are placed by time bucket; one row per (bucket, piece between gaps)
    crosses buckets.
    """
    keys = list(keys)
    us, gap = _micros(time), int(gap_secs * 1_000_000)
    wb = W.partitionBy(*keys, "_b").orderBy(time)
    upto = wb.rowsBetween(W.unboundedPreceding, 0)
    rows = bars.withColumn("_b", F.floor(us / (bucket_secs * 1_000_000)))
    prev = F.lag(us).over(wb)
    rows = rows.withColumns({"_gap": F.coalesce(us - prev > gap, F.lit(False)), "_i": F.row_number().over(wb)})
    if streak_of:
        rows = rows.withColumn("_prev", F.lag(streak_of).over(wb))
    rows = rows.withColumn("_seg", F.sum(F.col("_gap").cast("int")).over(upto))
    per_piece = {
        "_first": F.min(us), "_last": F.max(us), "_n": F.count(F.lit(1)), "_i0": F.min("_i"),
    }
    if streak_of:
        rows = rows.withColumn("_s", F.when(~F.col("_gap"), F.signum(F.col(streak_of) - F.col("_prev"))))
        turned = F.col("_s") != F.lag("_s").over(wb)
        rows = rows.withColumn("_turn", F.max(F.when(turned, F.col("_i"))).over(upto))
        per_piece |= {
            "_v0": F.min_by(streak_of, us), "_v1": F.max_by(streak_of, us),
            "_s1": F.min_by("_s", F.when(F.col("_s").isNotNull(), us)), "_s9": F.max_by("_s", us),
            "_last_turn": F.max("_turn"),
        }
    pieces = rows.groupBy(*keys, "_b", "_seg").agg(*[c.alias(n) for n, c in per_piece.items()])

    wp = W.partitionBy(*keys).orderBy("_b", "_seg")
    starts = F.coalesce(F.col("_first") - F.lag("_last").over(wp) > gap, F.lit(True))
    pieces = pieces.withColumn("_new", starts.cast("int"))
    pieces = pieces.withColumn("period_id", F.sum("_new").over(wp.rowsBetween(W.unboundedPreceding, 0)) - 1)
    wper = W.partitionBy(*keys, "period_id")
    word = wper.orderBy("_b", "_seg")
    before = word.rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumns({
        "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "period_rows": F.sum("_n").over(word.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    keep = [*keys, "_b", "_seg", "_i0", "_off", "period_id", "period_rows"]
    if streak_of:
        # sign of the first row of a piece, seen from the piece before it
        pieces = pieces.withColumn("_s0", F.signum(F.col("_v0") - F.lag("_v1").over(word)))
        pieces = pieces.withColumn("_s_before", F.lag(F.coalesce("_s9", "_s0")).over(word))
        turn0 = F.col("_s0").isNotNull() & F.coalesce(F.col("_s0") != F.col("_s_before"), F.lit(True))
        turn1 = F.col("_s1").isNotNull() & F.coalesce(F.col("_s1") != F.col("_s0"), F.lit(True))
        pieces = pieces.withColumns({
            "_t0": F.when(turn0, F.col("_off")), "_t1": F.when(turn1, F.col("_off") + 1),
        })
        inner = F.when(F.col("_last_turn") > F.col("_i0"), F.col("_last_turn") - F.col("_i0") + F.col("_off"))
        pieces = pieces.withColumn("_turn_before", F.max(F.greatest(inner, "_t0", "_t1")).over(before))
        keep += ["_s0", "_t0", "_t1", "_turn_before"]
    if min_bars:
        pieces = pieces.filter(F.col("period_rows") >= min_bars)

    out = rows.join(pieces.select(*keep), [*keys, "_b", "_seg"])
    out = out.withColumn("rn", F.col("_i") - F.col("_i0") + F.col("_off"))
    extra = ["period_id", "rn", "period_rows"]
    if streak_of:
        sign = F.coalesce(F.col("_s"), F.when(F.col("_i") == F.col("_i0"), F.col("_s0")))
        inner = F.when(F.col("_turn") > F.col("_i0"), F.col("_turn") - F.col("_i0") + F.col("_off"))
        begun = F.greatest(inner, "_turn_before", F.col("_t0"), F.when(F.col("rn") > F.col("_off"), F.col("_t1")))
        out = out.withColumn(
            "ret_streak", F.coalesce(sign * (F.col("rn") - begun + 1), F.lit(0.0)))
        extra.append("ret_streak")
    return out.select(*bars.columns, *extra)


def blocks(df: DataFrame, back: int = 0, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut periods into blocks of `rows` rows and copy halo rows to neighbours.

    Adds block and core; windows go over block_window(), results are kept with
    core_rows(). A period of at most `rows` rows has no copies.
    """
    if max(back, ahead) > rows:
        raise ValueError("a halo may not exceed one block")
    k, pos = F.floor(F.col("rn") / rows).cast("int"), F.col("rn") % rows
    homes = F.array_compact(F.array(
        k,
        F.when((pos >= rows - back) & ((k + 1) * rows < F.col("period_rows")), k + 1),
        F.when((pos < ahead) & (k > 0), k - 1),
    ))
    return df.withColumn("block", F.explode(homes)).withColumn("core", F.col("block") == k)


def block_window(*order: str, keys: Sequence[str] = ("sym", "period_id")):
    return W.partitionBy(*keys, "block").orderBy(*(order or ("rn",)))


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("core").drop("block", "core")


_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: dict[str, tuple[str, str]],
) -> DataFrame:
    """Running aggregates {new: (sum|max|min, column)} over whole series.

    bucket must not decrease along `order`. Each bucket is aggregated by itself
    and shifted by the totals of the buckets before it.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_bk", bucket)
    wl = W.partitionBy(*keys, "_bk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_bk").agg(
        *[_RUNNING[how](col).alias(f"_c_{name}") for name, (how, col) in columns.items()])
    before = W.partitionBy(*keys).orderBy("_bk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumns(
        {f"_c_{name}": _RUNNING[how](f"_c_{name}").over(before) for name, (how, _) in columns.items()})
    out = rows.withColumns({name: _RUNNING[how](col).over(wl) for name, (how, col) in columns.items()})
    out = out.join(carry, [*keys, "_bk"])
    for name, (how, _) in columns.items():
        c = F.col(f"_c_{name}")
        mix = {
            "sum": F.coalesce(F.col(name), F.lit(0)) + F.coalesce(c, F.lit(0)),
            "max": F.greatest(name, c), "min": F.least(name, c),
        }
        out = out.withColumn(name, mix[how])
    return out.drop("_bk", *[f"_c_{name}" for name in columns])


def previous(df: DataFrame, keys: Sequence[str], order: str, bucket: str, column: str, name: str) -> DataFrame:
    """df with `name`: column of the row before in `order` (distinct in a key), also from earlier buckets.

    The column bucket must not decrease along order; one row a bucket crosses buckets.
    """
    keys = list(keys)
    edge = df.groupBy(*keys, bucket).agg(F.max_by(F.struct(column), order)[column].alias("_edge"))
    edge = edge.withColumn("_edge", F.lag("_edge").over(W.partitionBy(*keys).orderBy(bucket)))
    w = W.partitionBy(*keys, bucket).orderBy(order)
    first = F.row_number().over(w) == 1
    own = F.lag(column).over(w)
    rows = df.withColumn(name, own).withColumn("_first", first).join(edge, [*keys, bucket])
    return rows.withColumn(name, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col(name))).drop("_first", "_edge")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    bucket_secs: int,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Last row of right at or before (forward: first at or after) left_time.

    strict leaves out equal times. Both sides meet in time buckets; a row whose
    bucket holds no match takes the nearest non-empty bucket's edge row.
    """
    keys, columns = list(keys), list(columns)
    size = bucket_secs * 1_000_000
    lb, rb = F.floor(_micros(left_time) / size), F.floor(_micros(right_time) / size)
    hit = F.struct(F.col(right_time).alias("_rt"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    probe = left.select(*keys, lb.alias("_b"), F.col(left_time).alias("_t"), F.lit(None).alias("_hit"),
                        F.struct(*left.columns).alias("_row"))
    series = right.select(*keys, rb.alias("_b"), F.col(right_time).alias("_t"), hit.alias("_hit"))
    both = probe.withColumn("_hit", F.lit(None).cast(series.schema["_hit"].dataType)).unionByName(
        series, allowMissingColumns=True)
    # among equal times a matching right row must come first in scan direction, else last
    right_first = F.col("_hit").isNull().cast("int")
    tie = right_first.desc() if strict else right_first.asc()
    t = F.col("_t").desc() if forward else F.col("_t").asc()
    scan = W.partitionBy(*keys, "_b").orderBy(t, tie).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_hit", ignorenulls=True).over(scan))
    edge = (F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_t"))) if forward
            else F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_t"))))
    b = F.col("_b").desc() if forward else F.col("_b").asc()
    over = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    edges = both.groupBy(*keys, "_b").agg(edge.alias("_edge"))
    edges = edges.withColumn("_edge", F.last("_edge", ignorenulls=True).over(over))
    out = found.filter(F.col("_row").isNotNull()).join(edges, [*keys, "_b"])
    got = F.coalesce("_found", "_edge")
    return out.select("_row.*", *[got[f"_r_{c}"].alias(c) for c in columns])


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str, width: float, extra: dict[str, Column] | None = None,
                  bucket_rows: int = 8192) -> DataFrame:
    """Distinct values with n, below (rows with a smaller value) and total.

    Equal values are merged first, so a hot value is one row; the rest is ordered
    inside buckets and between bucket totals. A bucket of `width` that holds more
    than bucket_rows distinct values is cut evenly into as many parts as that takes.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in (extra or {}).items()])
    counts = counts.withColumn("_bk", F.floor(F.col(value) / width))
    parts = counts.groupBy(*keys, "_bk").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_parts"))
    part = F.floor((F.col(value) / width - F.col("_bk")) * F.col("_parts"))
    counts = counts.join(parts, [*keys, "_bk"]).withColumn("_pt", F.least(F.greatest(part, F.lit(0)), F.col("_parts") - 1)).drop("_parts")
    at = ["_bk", "_pt"]
    totals = counts.groupBy(*keys, *at).agg(F.sum("n").alias("_bn"))
    wk = W.partitionBy(*keys).orderBy(*at)
    totals = totals.select(
        *keys, *at,
        F.coalesce(F.sum("_bn").over(wk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bn").over(wk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    wl = W.partitionBy(*keys, *at).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = counts.withColumn("_lo", F.coalesce(F.sum("n").over(wl), F.lit(0)))
    return local.join(totals, [*keys, *at]).withColumn("below", F.col("_lo") + F.col("_off")).drop(*at, "_lo", "_off")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], width: float, name: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation, one array per key.

    Unlike percentile(), which holds all values of a key in one task, ranks are
    found by ranked_counts.
    """
    keys = list(keys)
    ranked = ranked_counts(df, keys, value, width)
    last = F.col("total") - 1
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (last * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)])
    lo, hi = F.col("below"), F.col("below") + F.col("n") - 1
    near = F.filter(wanted, lambda w: (F.floor(w["h"]) <= hi) & (F.ceil(w["h"]) >= lo))
    picks = ranked.select(*keys, F.col(value).alias("v"), lo.alias("lo"), hi.alias("hi"), F.explode(near).alias("w"))
    f, c = F.floor("w.h"), F.ceil("w.h")
    per = picks.groupBy(*keys, F.col("w.i").alias("i")).agg(
        F.max(F.when((F.col("lo") <= f) & (f <= F.col("hi")), F.col("v"))).alias("a"),
        F.max(F.when((F.col("lo") <= c) & (c <= F.col("hi")), F.col("v"))).alias("b"),
        F.max(F.col("w.h") - f).alias("t"))
    point = F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("v"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["v"]).alias(name))
