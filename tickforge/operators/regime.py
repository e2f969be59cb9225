"""Rule-based market regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# value of a regime input when a row has none
DEFAULTS = {"trend_ema": 0.0, "trend_slope": 0.0, "bb_pctile": 0.5, "atr_pctile": 0.5,
            "vol_spike": 0.0, "news_candle": 0.0, "rsi_14": 50.0, "spread_z": 0.0}
# the inputs, without their defaults, for schema checks
REGIME_INPUTS = ["trend_ema", "trend_slope", "bb_pctile", "atr_pctile", "vol_spike", "news_candle", "rsi_14"]


def _inputs(source: str | None = None) -> dict[str, Column]:
    """Regime inputs of a row, or of a map column named `source`."""
    pick = (lambda n: F.col(source)[n]) if source else F.col
    return {n: F.coalesce(pick(n), F.lit(d)) for n, d in DEFAULTS.items()}


def regime_bin(source: str | None = None) -> Column:
    """Trend first, then volatility, then range width and momentum in a range."""
    x = _inputs(source)
    te, aligned = x["trend_ema"], x["trend_ema"] * x["trend_slope"] > 0
    busy = x["vol_spike"] > 1.2
    return (
        F.when((te > 1.2) & aligned, "STRONG_UP").when(te > 0.4, "UP")
        .when((te < -1.2) & aligned, "STRONG_DOWN").when(te < -0.4, "DOWN")
        .when((x["vol_spike"] > 2.0) | (x["news_candle"] > 0.4) | (x["atr_pctile"] > 0.85), "HIGH_VOL")
        .when((x["atr_pctile"] < 0.15) & (x["news_candle"] < 0.2), "QUIET_LOW_VOL")
        .when(x["bb_pctile"] < 0.35, "RANGE_TIGHT")
        .when((x["rsi_14"] > 60) & busy, "UP").when((x["rsi_14"] < 40) & busy, "DOWN")
        .otherwise("RANGE_WIDE"))


def with_regime(df: DataFrame) -> DataFrame:
    return df.withColumn("regime", regime_bin())


def regime_coverage(df: DataFrame) -> DataFrame:
    """Rows and percent per regime."""
    per = df.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_total"))
    return per.crossJoin(F.broadcast(total)).select("regime", "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"))


def regime_label(source: str | None = None) -> Column:
    """Readable market state: trend part and volatility part."""
    x = _inputs(source)
    te, aligned = x["trend_ema"], x["trend_ema"] * x["trend_slope"] > 0
    trend = (F.when((te > 1.2) & aligned, "TRENDING UP").when((te < -1.2) & aligned, "TRENDING DOWN")
             .when(x["bb_pctile"] < 0.3, "RANGING").otherwise("MIXED"))
    mood = (F.when((x["news_candle"] > 0.4) | (x["vol_spike"] > 2.0), "NEWS-SPIKE")
            .when(x["atr_pctile"] < 0.3, "QUIET").when(x["atr_pctile"] > 0.7, "VOLATILE"))
    return F.concat_ws(" | ", trend, mood)


def coarse_regime(with_news: bool = True, aligned: bool = True) -> Column:
    """Backtest buckets: NEWS, TREND-UP, TREND-DOWN, RANGE, MIXED."""
    x = _inputs()
    te = x["trend_ema"]
    trending = (F.abs(te) > 1.2) & (te * x["trend_slope"] > 0 if aligned else F.lit(True))
    news = (x["news_candle"] > 0.4) | (x["vol_spike"] > 2.0) if with_news else F.lit(False)
    return (F.when(news, "NEWS").when(trending & (te > 0), "TREND-UP").when(trending, "TREND-DOWN")
            .when(x["bb_pctile"] < 0.3, "RANGE").otherwise("MIXED"))
