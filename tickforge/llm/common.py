"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a private one only where a one-machine session has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not re.fullmatch(r"local(\[[^,\]]*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            root = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the frame once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_offsets(df: DataFrame, keys: list[str], order: Column, within: list[Column], rank: str,
                 n: int, total: tuple[str, str] | None = None, rows: int = 4096) -> DataFrame:
    """Exact rank (from 0) per key by (order bucket, within), without a task per key.

    `order` is a non-negative long below 2^62 that spreads the rows; its high bits
    form buckets of about `rows` rows of the whole table. Bucket counts are summed
    up per key, and only bounded buckets are sorted. `total=(column, name)` adds the
    running sum of a column before the row.
    """
    bits = max(1, (max(1, n) // rows).bit_length())
    inner = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 62 - bits))
    aggs = [F.count(F.lit(1)).alias("_n")] + ([F.sum(total[0]).alias("_t")] if total else [])
    bk = [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb")]
    counts = inner.groupBy(*bk).agg(*aggs)
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn("_t0", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    on = inner["_b"] == counts["_kb"]
    for i, k in enumerate(keys):
        on = on & inner[k].eqNullSafe(counts[f"_k{i}"])
    w = Window.partitionBy(*keys, "_b").orderBy("_o", *within)
    out = inner.join(counts, on).withColumn(rank, (F.row_number().over(w) - 1 + F.col("_n0")).cast("long"))
    if total:
        run = F.coalesce(F.sum(total[0]).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(total[1], (run + F.col("_t0")).cast("long"))
    return out.select(*df.columns, rank, *([total[1]] if total else []))


def spread(*cols) -> Column:
    """A long in [0, 2^62) that orders rows as if at random."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, root), nodes with links only.

    Each round every node moves to the neighbour (or itself) of least priority, a
    hash that changes with the round, and the links are contracted; chains shrink by
    a constant factor, so rounds grow with the logarithm of the longest chain. Hubs
    are reduced by map-side minima; joins are by key and can be split when skewed.
    """
    both = links.where("a <> b").select("a", "b")
    edges = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    member = materialize(edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    for r in range(most):
        if edges.isEmpty():
            return member
        prio = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("p"), c.alias("v"))
        step = edges.groupBy("a").agg(F.min(prio(F.col("b"))).alias("m"))
        step = materialize(step.select(F.col("a").alias("old"), F.least("m", prio(F.col("a")))["v"].alias("new")))
        member = materialize(member.join(step, member.root == step.old, "left").select(
            "node", F.coalesce("new", "root").alias("root")))
        left = edges.join(step, edges.a == step.old).select(F.col("new").alias("a"), "b")
        right = left.join(step, left.b == step.old).select("a", F.col("new").alias("b"))
        edges = materialize(right.where("a <> b").distinct())
    raise RuntimeError("components did not settle")
