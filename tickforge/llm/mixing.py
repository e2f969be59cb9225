"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in a seeded order. Its target is the first
so many words of the stream; where the target is above the source's size the stream is
drawn whole once and its first words a second time. So documents are drawn whole, but for
at most one that a target cuts. A draw's stream is divided into blocks of equally many
words, and a document belongs to the block where it starts. The exact block quotas of all
sources are divided among the output shards by a binary tree, each node drawing its left
half from the multivariate hypergeometric law, so that a shard holds what a fair shuffle
would give it, without shuffling. A shard's quota is a range of places in the draw's block
permutation (an affine bijection), so ranges are disjoint and a document knows its shard
and place by arithmetic on its offset. Blocks within a shard are ordered by a seeded key (a
draw's position), so the last shuffle is local to the shard; the mix is written in runs of
a shard's positions. `pieces` and `longest` set the length of blocks: a thousandth of the
source, at most 4096 words; blocks shorter than documents only make the shuffle finer.

Only one table is summed over buckets (offsets of documents within their source, exact
also where one source holds most rows). The driver holds one row per source, at most
`max_sources`, and the quotas.

Null texts have no words and size 0. A null source is a source of its own, the last.
Repeated rows, equal doc_ids and rows without doc_id are placed one by one, in order of
their texts' hash. Very long texts are counted whole. Empty tables give an empty mix. `draw`
reads doc_id, source and text; `mixed_documents` keeps all columns, in one struct, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm.common import materialize, query, spread, table, with_offsets, words

WEIGHTS = (3, 1, 2)
DRAWS = "array<struct<epoch: int, shard: int, place: bigint, start: bigint, stop: bigint>>"
DEALT = DRAWS.replace(">>", ", position: bigint>>")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words per source: `share` of all sizes by weight, none above `most` times its size, the excess reshared."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def split_tree(quotas: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas (leaves, sources) that add up to `quotas`, halved by multivariate hypergeometric draws."""
    if leaves == 1:
        return quotas[None, :]
    half = leaves // 2
    total = int(quotas.sum())
    left = rng.multivariate_hypergeometric(quotas, total * half // leaves, method="marginals") if total else quotas
    return np.concatenate([split_tree(left, half, rng), split_tree(quotas - left, leaves - half, rng)])


def plan(sizes: list[int], goal: list[float], shards: int, seed: int, pieces: int = 1000, longest: int = 4096) -> list[dict]:
    """Per source: block words, and for both draws the words, blocks, permutation and the ends of the shards' ranges."""
    rng = np.random.default_rng(seed)
    longest = max(longest, math.ceil(sum(sizes) / 4e8))  # keeps the tree's draws within the sampler's range
    block = [max(1, min(longest, s // pieces)) for s in sizes]
    drawn = [[min(s, round(g)) for s, g in zip(sizes, goal)], [min(s, max(0, round(g) - s)) for s, g in zip(sizes, goal)]]
    count = [[-(-w // b) for w, b in zip(ws, block)] for ws in drawn]
    leaves = [split_tree(np.array(q, np.int64), shards, rng).cumsum(0) for q in count]
    out = []
    for i, b in enumerate(block):
        step = []
        for e in range(2):
            n = max(1, count[e][i])
            k = int(rng.integers(1, max(2, n)))
            while math.gcd(k, n) != 1:
                k = k % n + 1
            step.append(k)
        out.append({"block": b, "words": [ws[i] for ws in drawn], "blocks": [c[i] for c in count], "step": step,
                    "shift": [int(rng.integers(0, max(1, c[i]))) for c in count], "ends": [[int(x) for x in lv[:, i]] for lv in leaves]})
    return out


def draw(docs: DataFrame, shards: int = 8, seed: int = 7, share: float = 1.5, most: float = 2.0,
         weights: tuple[float, ...] = WEIGHTS, max_sources: int = 100_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and draws (epoch, shard, place, words start to stop of the document, position in the shard).

    A column `_id` of docs is kept; it must name a row.
    """
    spark = docs.sparkSession
    name = ["_id"] if "_id" in docs.columns else []
    sized = materialize(docs.select("doc_id", "source", F.size(words(docs["text"])).cast("long").alias("size"), F.xxhash64("text").alias("_text"), *name))
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.n for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    schema = ("_source string, source_size bigint, target double, p struct<block: bigint, words: array<bigint>, blocks: array<bigint>, step: array<bigint>, "
              "shift: array<bigint>, ends: array<array<bigint>>>")
    plans = spark.createDataFrame([(r.source, r.n, t, p) for r, t, p in zip(found, goal, plan(sizes, goal, shards, seed))], schema)
    key = spread(F.lit(seed), "doc_id", "_text")
    placed = with_offsets(sized, ["source"], key, ["doc_id", "size", *name], "_rank", sized.count(), total=("size", "_from"))
    whole = placed.join(F.broadcast(plans), F.col("source").eqNullSafe(F.col("_source")))  # at most max_sources rows
    drawn = whole.withColumn("draws", F.when(F.col("size") > 0, _draws(F.col("_from"), F.col("size"))).otherwise(F.array().cast(DRAWS)))
    drawn = _with_positions(materialize(drawn.select("doc_id", "source", "_rank", "size", "source_size", "target", "draws", *name)), seed)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, d: acc + d["stop"] - d["start"])
    return drawn.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *name)


def _with_positions(drawn: DataFrame, seed: int) -> DataFrame:
    """Adds to every draw its rank in its shard, by a seeded key of its block; (source, _rank) names a row."""
    flat = materialize(drawn.select("source", "_rank", F.inline("draws")))
    order = spread(F.lit(seed + 1), "epoch", "place", F.coalesce("source", F.lit("")), F.col("source").isNull())
    ranked = with_offsets(flat, ["shard"], order, ["source", "epoch", "place", "_rank"], "position", flat.count())
    fields = F.struct("epoch", "shard", "place", "start", "stop", "position")
    dealt = ranked.groupBy(F.col("source").alias("_s"), F.col("_rank").alias("_r")).agg(F.sort_array(F.collect_list(fields)).alias("_dealt"))
    both = drawn.join(dealt, (F.col("_rank") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    return both.withColumn("draws", F.coalesce(F.col("_dealt").cast(DEALT), F.array().cast(DEALT)))


def _draws(start: Column, size: Column) -> Column:
    p = F.col("p")

    def one(epoch: int) -> Column:
        place = F.pmod(p["step"][epoch] * F.floor(start / p["block"]) + p["shift"][epoch], F.greatest(p["blocks"][epoch], F.lit(1).cast("bigint")))
        shard = F.size(F.filter(p["ends"][epoch], lambda end: end <= place))
        stop = F.least(size, p["words"][epoch] - start)
        return F.struct(F.lit(epoch + 1).alias("epoch"), shard.alias("shard"), place.alias("place"), F.lit(0).cast("bigint").alias("start"), stop.alias("stop"))

    return F.filter(F.array(one(0), one(1)), lambda d: d["stop"] > 0).cast(DRAWS)


def mixed_documents(docs: DataFrame, rows_per_task: int = 4096, **options) -> DataFrame:
    """The mix as rows with the columns of documents: one row per draw of a document.

    Rows are laid out in runs of about `rows_per_task` positions of a shard, each in order.

    A document drawn whole keeps its text; of the one that its source's target cuts the drawn
    words stay, with the white space between them. n_chars follows the text.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = materialize(docs.select(row, F.monotonically_increasing_id().alias("_name")))
    named = rows.select(*[F.col("_row")[c].alias(c) for c in ("doc_id", "source", "text")], F.col("_name").alias("_id"))
    drawn = draw(named, **options).where("taken > 0").select("_id", "size", F.inline("draws"))
    both = rows.join(drawn, F.col("_name") == F.col("_id"))
    text = F.col("_row.text")
    cut = F.when(F.col("stop") == F.col("size"), text).otherwise(pandas_udf(cut_words, "string")(
        F.when(F.col("stop") < F.col("size"), text), F.array("start", "stop")))
    out = both.withColumn("_cut", cut)
    new = {"text": F.col("_cut"), "n_chars": F.length("_cut").cast("long")}
    laid = out.select(*[new.get(c, F.col("_row")[c]).alias(f"_c{i}") for i, c in enumerate(docs.columns)], "shard", "position")
    laid = laid.repartition("shard", F.floor(F.col("position") / rows_per_task)).sortWithinPartitions("shard", "position")
    return laid.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def cut_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Words [start, stop) of each text, white space between adjacent words kept, pieces joined by a line feed."""
    out = []
    for text, flat in zip(texts, spans):
        if text is None:
            out.append(None)
            continue
        ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        runs: list[list[int]] = []
        for lo, hi in sorted(zip(flat[0::2], flat[1::2])):
            if runs and runs[-1][1] == lo:
                runs[-1][1] = hi
            else:
                runs.append([lo, hi])
        out.append("\n".join(text[ends[lo][0]:ends[hi - 1][1]] for lo, hi in runs))
    return pd.Series(out)


@query("op8_split_tree_mix")
def op8_split_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")
