"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Method: a 64-bit SimHash is cut into three segments of 22, 21 and 21 bits. Of at most
two differing bits one segment has none (pigeonhole), and the segment after it has at
most two. A key is therefore an exact segment together with one of the codeword
indices near the next segment; two linked fingerprints always share a key. Candidates
meet by key, are verified bit by bit, and links feed connected components.

Size of groups: equal fingerprints are one row from the start. A key with more than
`group_rows` distinct fingerprints is split again: of six blocks in the other two
segments four are exact, so each of the 15 choices of four gives a group that can hold
2^15 fingerprints at most. A group returns links to the least fingerprint of each of
its local components, never pairs.

Null and empty texts and texts without a word have fingerprint zero and are linked
like any other. Repeated rows keep one row each; rows without doc_id are kept and do
not count for component_id (null if a component has no other rows). Other columns
are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm import golay
from tickforge.llm.common import components, materialize, query, table

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
CHOICES = list(combinations(range(6), 4))
CHUNK = 1 << 16


def _simhash(raw: bytes, n: int) -> int:
    w = raw.lower().split()
    if not w:
        return 0
    text = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(w) - n + 1)
    last = ends[n - 1:] if len(w) >= n else ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, k, CHUNK):
        h = np.array([digest(text[a:b], SEED) for a, b in zip(starts[at:min(k, at + CHUNK)].tolist(), last[at:at + CHUNK].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > k, bitorder="little")
    return int(bits.view(np.int64)[0])


def simhash(text, shingle: int = 3):
    """Column: the 64-bit SimHash of a text's word shingles, as a signed long."""
    @pandas_udf("long")
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([_simhash(r or b"", shingle) for r in raw], dtype="int64")
    return run(F.coalesce(text, F.lit("")).cast("binary"))


def golay_keys(fp: pd.Series) -> pd.Series:
    """Per fingerprint its keys: number of the exact segment, its bits, codeword index near the next one."""
    x = fp.to_numpy(np.int64).view(np.uint64)
    parts = [((x >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    keys = []
    for i in range(3):
        near = golay.indices(parts[(i + 1) % 3])
        keys.append(np.where(near < 0, -1, (i << 40) | (parts[i][:, None] << 12) | near))
    rows = np.concatenate(keys, axis=1)
    return pd.Series([r[r >= 0] for r in rows])


def split_keys(fp: pd.Series, key: pd.Series) -> pd.Series:
    """The 15 second keys of fingerprints in a large group: exact bits outside two of six blocks."""
    x, seg = fp.to_numpy(np.int64).view(np.uint64), (key.to_numpy(np.int64) >> 40)
    out = np.zeros((len(x), len(CHOICES)), np.int64)
    for i in range(3):
        masks = []
        for j in ((i + 1) % 3, (i + 2) % 3):
            shift, bits = SEGMENTS[j]
            cut = [0, bits // 3, 2 * bits // 3, bits]
            masks += [((1 << (hi - lo)) - 1) << (shift + lo) for lo, hi in zip(cut, cut[1:])]
        at = seg == i
        for c, choice in enumerate(CHOICES):
            mask = np.uint64(sum(masks[b] for b in choice))
            # the 43 masked bits and the number of the choice fit side by side
            out[at, c] = _packed(x[at] & mask, i) * 16 + c
    return pd.Series(list(out))


def _packed(x: np.ndarray, i: int) -> np.ndarray:
    """The two segments other than i side by side (at most 43 bits)."""
    a, b = (SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3])
    pa = (x >> np.uint64(a[0])) & np.uint64((1 << a[1]) - 1)
    pb = (x >> np.uint64(b[0])) & np.uint64((1 << b[1]) - 1)
    return ((pa << np.uint64(b[1])) | pb).astype(np.int64)


def local_roots(x: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints, the position of the first member of each one's component."""
    n = len(x)
    root = np.full(n, -1, np.int64)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start] = start
        todo = [start]
        free = np.flatnonzero(root < 0)
        while todo and len(free):
            near = np.bitwise_count(x[free] ^ x[todo.pop()]) <= radius
            hit = free[near]
            root[hit] = start
            todo += hit.tolist()
            free = free[~near]
    return root


def _linker(radius: int):
    @pandas_udf("array<struct<a: bigint, b: bigint>>")
    def run(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            x = np.unique(np.asarray(g, np.int64))
            root = local_roots(x.view(np.uint64), radius)
            at = np.flatnonzero(root != np.arange(len(x)))
            out.append([{"a": int(x[i]), "b": int(x[root[i]])} for i in at])
        return pd.Series(out)
    return run


def links(fps: DataFrame, radius: int = 2, group_rows: int = 2048) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` exactly as all pairs within `radius` would.

    A radius above two would need other segments and is refused.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the keys find at most two differing bits")
    keyed = fps.select("fp", F.explode(pandas_udf(golay_keys, "array<long>")("fp")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k")
    shared = keyed.join(sizes, keyed.key == sizes.k).select("fp", "key", "n")
    small = shared.where(F.col("n") <= group_rows).select("fp", "key", F.lit(-1).cast("long").alias("sub"))
    large = shared.where(F.col("n") > group_rows).select("fp", "key", F.explode(pandas_udf(split_keys, "array<long>")("fp", "key")).alias("sub"))
    groups = small.union(large).groupBy(F.xxhash64("key", "sub").alias("place"), "key", "sub").agg(F.collect_list("fp").alias("g"))
    found = groups.where(F.size("g") > 1).select(F.explode(_linker(radius)("g")).alias("l"))
    return found.select("l.a", "l.b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, group_rows: int = 2048) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of docs."""
    rows = materialize(docs.select("doc_id", simhash(F.col("text"), shingle).alias("fp")))
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps, radius, group_rows))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "comp").select(F.col("fp").alias("_f"), "component_id")
    return rows.join(named, rows.fp == named["_f"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id (rows without doc_id stay)."""
    found = near_duplicates(docs, **options)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")


@query("op10_golay_simhash")
def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
