"""Readers and writers."""

from __future__ import annotations

import hashlib
import json
import lzma
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_DDL = ("sym string, time timestamp, open double, high double, low double, close double, "
           "tick_volume double, spread double, real_volume double, src string")
LIVE_DDL = "t bigint, o double, h double, l double, c double, spread int, v int"


def read_bars_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str = BAR_DDL) -> DataFrame:
    """Bars with a header, in any order of columns; only the wanted columns are parsed.

    Known columns take their type from schema, others are strings; a column the files
    lack is absent. Files whose header differs from the first one's raise.
    """
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    header = spark.read.option("header", True).csv(path).columns
    found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = spark.read.schema(found).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def read_live_bars(spark: SparkSession, path: str, sym: str) -> DataFrame:
    """JSON lines {t, o, h, l, c, spread, v}; malformed lines are skipped."""
    raw = spark.read.schema(LIVE_DDL).json(path, mode="DROPMALFORMED").filter(F.col("t").isNotNull())
    return raw.select(
        F.lit(sym).alias("sym"), F.timestamp_seconds("t").alias("time"), F.col("o").alias("open"), F.col("h").alias("high"),
        F.col("l").alias("low"), F.col("c").alias("close"), F.coalesce("v", F.lit(0)).cast("double").alias("tick_volume"),
        F.coalesce("spread", F.lit(20)).cast("double").alias("spread"), F.lit(0.0).alias("real_volume"), F.lit("live").alias("src"))


# Candle record, big-endian, 24 bytes; prices in thousandths
CANDLE = np.dtype([("sec", ">i4"), ("open", ">i4"), ("close", ">i4"), ("low", ">i4"), ("high", ">i4"), ("vol", ">f4")])
CANDLE_DDL = "path string, sec long, open double, high double, low double, close double, tick_volume double"


def decode_candles(files: DataFrame) -> DataFrame:
    """LZMA day files of fixed candle records, from a binaryFile scan. sec counts from the day's start."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    data = lzma.decompress(content)
                except lzma.LZMAError:
                    continue
                r = np.frombuffer(data[: len(data) // 24 * 24], dtype=CANDLE)
                yield pd.DataFrame({
                    "path": path, "sec": r["sec"].astype("int64"),
                    **{c: r[c].astype("float64") / 1000.0 for c in ("open", "high", "low", "close")},
                    "tick_volume": np.floor(r["vol"].astype("float64") * 1000.0)})

    return files.select("path", "content").mapInPandas(decode, CANDLE_DDL)


def candle_rejects(files: DataFrame) -> DataFrame:
    """Files that decode_candles leaves out or cuts: (path, reason, bytes), reason corrupt or partial."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rest = len(lzma.decompress(content)) % 24
                    if rest:
                        bad.append((path, "partial", rest))
                except lzma.LZMAError:
                    bad.append((path, "corrupt", len(content)))
            yield pd.DataFrame(bad, columns=["path", "reason", "bytes"]).astype({"bytes": "int64"})

    return files.select("path", "content").mapInPandas(judge, "path string, reason string, bytes long")


def live_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that read_live_bars leaves out: malformed JSON or without a time."""
    raw = spark.read.text(path).withColumn("r", F.from_json("value", LIVE_DDL))
    return raw.where(F.col("r").isNull() | F.col("r.t").isNull()).select(F.col("value").alias("line"))


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    return decode_candles(spark.read.format("binaryFile").load(path))


def schema_fingerprint(df: DataFrame) -> str:
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def check_schema(df: DataFrame, fingerprint: str) -> None:
    got = schema_fingerprint(df)
    if got != fingerprint:
        raise ValueError(f"schema changed: {got} instead of {fingerprint}; rebuild in full")


def write_time_ordered(df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    """Parquet in time ranges, sorted inside files: later time filters skip row groups."""
    ranged = df.repartitionByRange(partitions, "time") if partitions else df.repartitionByRange("time")
    ranged.sortWithinPartitions("time").write.mode(mode).parquet(path)
