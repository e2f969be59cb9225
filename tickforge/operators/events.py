"""Scheduled-event calendar and the time to and from its events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.constants import FOMC_DAYS
from tickforge.functions.windows import flag


@dataclass(frozen=True)
class DayEvents:
    """Sorted event times (epoch seconds) of a calendar of known, small size."""

    epochs: tuple[int, ...]


def event_calendar(years: DataFrame) -> DataFrame:
    """(ts, kind) for each `year` row: decision days, first Fridays, 12ths.

    Decision days are known only for the years of the fixed list.
    """
    spark = years.sparkSession
    years = years.select("year").distinct()
    months = years.select(F.explode(F.expr(
        "sequence(make_date(year, 1, 1), make_date(year, 12, 1), interval 1 month)")).alias("m"))
    half_two = F.expr("INTERVAL 13 HOURS 30 MINUTES")
    nfp = months.select((F.next_day(F.date_sub("m", 1), "FRI").cast("timestamp") + half_two).alias("ts"), F.lit("nfp").alias("kind"))
    cpi = months.select((F.date_add("m", 11).cast("timestamp") + half_two).alias("ts"), F.lit("cpi").alias("kind"))
    known = spark.createDataFrame(
        [(y, m, d) for y, days in FOMC_DAYS.items() for m, d in days], "year int, m int, d int")
    fomc = known.join(years, "year", "left_semi").select(
        (F.make_date("year", "m", "d").cast("timestamp") + F.expr("INTERVAL 19 HOURS")).alias("ts"), F.lit("fomc").alias("kind"))
    return fomc.unionByName(nfp).unionByName(cpi)


def calendar_of(spark: SparkSession, years: Sequence[int]) -> DayEvents:
    """The calendar of given years as plan constants (32 events a year at most)."""
    rows = event_calendar(spark.createDataFrame([(int(y),) for y in years], "year int"))
    return DayEvents(tuple(sorted(r[0] for r in rows.select(F.unix_seconds("ts")).collect())))


def event_proximity(time: Column, events: DayEvents, legacy: bool = False) -> dict[str, Column]:
    """Minutes to the next and since the previous event.

    Outside the calendar the values are null; legacy clips to the outermost
    events instead, which turns the minutes negative there.
    """
    at = F.unix_seconds(time)
    known = F.array(*[F.lit(e).cast("bigint") for e in events.epochs])
    nxt = F.array_min(F.filter(known, lambda e: e >= at))
    prev = F.array_max(F.filter(known, lambda e: e < at))
    if legacy:
        nxt = F.coalesce(nxt, F.lit(events.epochs[-1]))
        after_all = at > F.lit(events.epochs[-1])
        prev = F.when(after_all, F.lit(events.epochs[-2])).otherwise(F.coalesce(prev, F.lit(events.epochs[0])))
    to, since = (nxt - at) / 60.0, (at - prev) / 60.0
    pre, post = flag(to <= 30), flag(since <= 60)
    return {"min_to_event": to, "min_since_event": since, "pre_event": pre, "post_event": post}


def event_asof(bars: DataFrame, events: DataFrame, bucket_secs: int = 86400) -> DataFrame:
    """Next and previous event of each bar by as-of joins, for calendars of any size.

    The events are copied to each series they serve, so the joins stay keyed.
    """
    from tickforge.operators.series import asof_join

    syms = bars.select("sym").distinct()
    per_sym = events.select(F.col("ts").alias("ev_ts"), F.unix_seconds("ts").alias("ev")).crossJoin(F.broadcast(syms))
    out = asof_join(bars, per_sym.withColumnRenamed("ev", "next_ev"), ["sym"], "time", "ev_ts", ["next_ev"], bucket_secs, forward=True)
    out = asof_join(out, per_sym.withColumnRenamed("ev", "prev_ev"), ["sym"], "time", "ev_ts", ["prev_ev"], bucket_secs, strict=True)
    at = F.unix_seconds("time")
    return out.withColumns({
        "min_to_event": (F.col("next_ev") - at) / 60.0, "min_since_event": (at - F.col("prev_ev")) / 60.0,
    })
