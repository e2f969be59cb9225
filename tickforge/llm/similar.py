"""Near copies of a corpus: documents whose sets of five-word shingles have Jaccard 0.8 or more.

Method: equal shingle sets are one node from the start. As in op10, candidates meet by Golay keys of
SimHash words beside an exact segment. A node has `TABLES` words of 23 SimHash bits of its shingle set; its keys in a table
are the up to six codeword indices near its word, each together with the `ROWS` MinHash values of the table as the
exact segment. Texts at 0.8 differ in 15 % of the bits, and words that do share an index with probability 0.60 (two bits
always, three and four in 0.59), so with two MinHash values a table finds the pair with 0.385 and all with 0.9999;
an exact segment of SimHash bits would take a hundred tables. Nodes with an equal key are candidates. Links are
sought in steps, and a step makes no pair within a component of the steps before, as it would link nothing more.
First a node is paired with the hub of its key: in a key of up to `small` nodes the least node; in a larger one, the
largest of each table, the node most of whose keys are large, as the original of edited copies is. Then small keys give all
other pairs. The rest, nodes with a large key that are not in the component of the hub of each after the first step,
are searched exactly (two of them without a link only so): their pairs with all nodes of
large keys that share a shingle among the rarest of both. At 0.8 the smaller set (n
shingles) shares one of its n/9 + 1 rarest with the n/5 + 1 rarest of the larger, and the
places of the shared one bound how many can follow. So texts of one template are told
apart by what is rare in them, and the template's own shingles pair nobody. Every
candidate pair is verified on the shingle sets themselves, so nothing below 0.8 is
linked, and links feed connected components. Nothing is dropped at any size of a key's group.

Rarity is the count of a shingle among the nodes of large keys, in a table of `SLOTS`
hashed counters; a collision changes the order, not what is found.

Words are as in SimHash: lower case (ASCII), cut at ASCII white space. A text of fewer
than five words is one shingle; texts without a word (null, empty, blank) are equal, and very
long texts are whole sets in one row. Shingles and sets are compared by 64-bit hashes. Rows without
doc_id come after all others, rows alike in all columns are one. Empty tables stay empty.
All columns are carried in one struct, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm import golay
from tickforge.llm.common import components, materialize

SHINGLE, TABLES, ROWS, BITS = 5, 20, 2, 23
SEED = 42
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, TABLES * (ROWS + 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 12
SLOTS = 1 << 18


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    text = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[SHINGLE - 1:] if len(w) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers, every bit of which depends on all of theirs."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a shingle set per table a hash of ROWS MinHash values, and BITS SimHash bits as a word."""
    rows, words = FACTORS[:TABLES * ROWS], FACTORS[TABLES * ROWS:][:-(-TABLES * BITS // 64)]
    low, ones = np.full(len(rows), np.iinfo(np.uint64).max, np.uint64), np.zeros(64 * len(words), np.int64)
    for at in range(0, len(s), CHUNK):
        part = s[at:at + CHUNK, None]
        low = np.minimum(low, (part * rows).min(0))
        ones += np.unpackbits(mixed(part * words).astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    exact = np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(low.reshape(TABLES, ROWS))], np.uint64)
    bits = (2 * ones > len(s))[:TABLES * BITS].reshape(TABLES, BITS)
    return exact.view(np.int64), (bits @ (1 << np.arange(BITS))).astype(np.int32)


def _sketch(raw: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(r or b"") for r in raw]
    none = np.zeros(0, np.int64), np.zeros(0, np.int32)
    found = [fingerprint(s) if len(s) else none for s in sets]  # texts without a word are one node and have no keys
    return pd.DataFrame({"node": pd.Series([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype="uint64").astype("int64"),
                         "exact": [f[0] for f in found], "words": [f[1] for f in found]})


def _golay_keys(exact: pd.Series, words: pd.Series) -> pd.Series:
    """Keys of nodes: exact segment and codeword index near the SimHash word, the table in the lowest five bits."""
    full = np.flatnonzero(exact.map(len).to_numpy() > 0)
    out = [np.zeros(0, np.int64)] * len(exact)
    if len(full):
        seg, word = (np.stack([np.asarray(x.iloc[i], np.int64) for i in full]) for x in (exact, words))
        near = golay.indices(word.reshape(-1)).reshape(len(full), TABLES, -1)
        keys = mixed(seg.view(np.uint64)[:, :, None] + near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(31) | np.arange(TABLES, dtype=np.uint64)[None, :, None]
        for i, k, n in zip(full.tolist(), keys.view(np.int64), near):
            out[i] = k[n >= 0]
    return pd.Series(out)


def _hashes(raw: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(r or b"").view(np.int64) for r in raw])


def sketch(text) -> Column:
    """Column: node (hash of the shingle set) and fingerprint (exact segments, words) of a text."""
    return pandas_udf(_sketch, "struct<node: bigint, exact: array<bigint>, words: array<int>>")(F.coalesce(text, F.lit("")).cast("binary"))


def golay_keys(nodes: DataFrame) -> DataFrame:
    """Rows (node, key), up to six keys a table, from rows (node, exact, words)."""
    return nodes.select("node", F.explode(pandas_udf(_golay_keys, "array<bigint>")("exact", "words")).alias("key"))


def hashes(text) -> Column:
    """Column: the shingle set of a text."""
    return pandas_udf(_hashes, "array<bigint>")(F.coalesce(text, F.lit("")).cast("binary"))


def candidates(keyed: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """First pairs (a < b), of a node and the hub of its key, and rows (node, key, n, big, hub) of the keys that nodes share.

    big: the node has a key of more than `small` nodes. The hub of such a key is the node most of whose keys are large, of others
    the least node.
    """
    sizes = materialize(keyed.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = materialize(keyed.join(sizes, F.col("key") == F.col("_key")).select("node", "key", "n"))
    weight = met.where(F.col("n") > small).groupBy(F.col("node").alias("_n")).agg(F.count(F.lit(1)).alias("w"))
    weighed = met.join(weight, F.col("node") == F.col("_n"), "left").withColumn("w", F.coalesce("w", F.lit(0)))
    hubs = weighed.groupBy(F.col("key").alias("_key")).agg(
        F.when(F.max("n") > small, F.max(F.struct("w", "node"))["node"]).otherwise(F.min("node")).alias("hub"))
    shared = materialize(weighed.join(hubs, F.col("key") == F.col("_key")).select("node", "key", "n", (F.col("w") > 0).alias("big"), "hub"))
    few = shared.where(F.col("n") <= small).select("node", "hub")
    # a node's keys of one table hold much the same nodes, so the largest of them gives the pair
    star = shared.where(F.col("n") > small).groupBy("node", F.col("key").bitwiseAND(31)).agg(F.max(F.struct("n", "key", "hub"))["hub"].alias("hub")).select("node", "hub")
    pairs = few.union(star).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return pairs.distinct(), shared


def rooted(rows: DataFrame, roots: DataFrame, *names: str) -> DataFrame:
    """Rows with columns r_<name> (the root of the named node, or itself) and l_<name> (it has a link)."""
    for c in names:
        rows = rows.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(c) == F.col("_node"), "left").withColumns(
            {f"r_{c}": F.coalesce("_root", c), f"l_{c}": F.col("_root").isNotNull()}).drop("_node", "_root")
    return rows


def other_pairs(shared: DataFrame, roots: DataFrame, rest: DataFrame, small: int) -> DataFrame:
    """Pairs (a < b) of small keys that the first ones have left in two components. Where neither node has a link
    yet and one is in the rest, `rare_pairs` searches for all of theirs."""
    few = rooted(shared.where((F.col("n") <= small) & (F.col("n") > 2)).select("node", "key", "big", "hub"), roots, "node")
    split = few.groupBy(F.col("key").alias("_key")).agg(F.min("r_node").alias("lo"), F.max("r_node").alias("hi")).where("lo < hi").select("_key")
    few = few.join(split, F.col("key") == F.col("_key")).drop("_key").join(rest.select(F.col("node").alias("_rest")), F.col("node") == F.col("_rest"), "left")
    few = materialize(few.select("node", "key", "big", "hub", "r_node", "l_node", F.col("_rest").isNotNull().alias("rest")))
    x, y = (few.select(*[F.col(c).alias(f"{c}_{i}") for c in few.columns]) for i in "xy")
    sought = F.col("big_x") & F.col("big_y") & (F.col("rest_x") | F.col("rest_y")) & ~F.col("l_node_x") & ~F.col("l_node_y")
    new = (F.col("node_x") != F.col("hub_x")) & ~sought
    met = x.join(y, (F.col("key_x") == F.col("key_y")) & (F.col("node_x") < F.col("node_y")) & (F.col("r_node_x") != F.col("r_node_y")) & new)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def rare_keys(sets: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows (node, n, rest, g, at): the n/5 + 1 rarest shingles of a node that others have, and their places.

    sets: rows (node, s) of all nodes to search; rest: rows node of those whose pairs are sought.
    """
    slot = F.pmod("g", F.lit(SLOTS)).cast("int")
    counted = sets.select(F.explode("s").alias("g")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").toArrow()  # at most SLOTS rows
    table = np.ones(SLOTS, np.int64)
    table[counted["slot"].to_numpy()] = counted["c"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def prefix(raw: pd.Series) -> pd.Series:
        out = []
        for s in raw:
            s = np.asarray(s, np.int64)
            c = shared.value[s % SLOTS]
            at = np.lexsort((s, c))[:len(s) // 5 + 1]
            out.append([{"g": int(s[i]), "at": k} for k, i in enumerate(at.tolist()) if c[i] > 1])
        return pd.Series(out, dtype="object")

    marked = sets.join(rest.select(F.col("node").alias("_rest")), F.col("node") == F.col("_rest"), "left").select(
        "node", F.size("s").alias("n"), F.col("_rest").isNotNull().alias("rest"), pandas_udf(prefix, "array<struct<g: bigint, at: int>>")("s").alias("p"))
    return marked.select("node", "n", "rest", F.explode("p").alias("p")).select("node", "n", "rest", "p.g", "p.at")


def rare_pairs(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a < b) of two components that Jaccard 0.8 allows by their rarest shingles, one of each at least in the rest.

    keys: rows of `rare_keys`. A pair of sizes n <= m needs 4/9 (n + m) common shingles.
    """
    keys = materialize(rooted(keys, roots, "node"))
    x = keys.where("9 * at <= n").select(*[F.col(c).alias(f"{c}_x") for c in keys.columns])
    y = keys.select(*[F.col(c).alias(f"{c}_y") for c in keys.columns])
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") != F.col("node_y")))
    fits = once & (5 * F.col("n_x") >= 4 * F.col("n_y")) & (F.col("r_node_x") != F.col("r_node_y"))
    enough = 9 * F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= 4 * (F.col("n_x") + F.col("n_y"))
    met = x.join(y, (F.col("g_x") == F.col("g_y")) & fits & enough & (F.col("rest_x") | F.col("rest_y")))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose shingle sets have Jaccard 0.8 or more; texts has the set of every node."""
    left, right = (texts.select(F.col("node").alias(f"_{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    common = F.size(F.array_intersect("sa", "sb"))
    # common / (|a| + |b| - common) >= 4 / 5
    return both.where(common * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")


def similar_components(docs: DataFrame, rows: DataFrame, small: int = 12) -> DataFrame:
    """Rows (node, root) of linked nodes. docs: text, r1 and r2 (hashes of the row); rows: node, exact, words, r1 and r2."""
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("r"), F.first(F.struct("exact", "words")).alias("k")).select("node", "r", "k.*"))
    pairs, shared = candidates(golay_keys(nodes.select("node", "exact", "words")), small)
    met = shared.select(F.col("node").alias("n")).distinct()
    rep = nodes.join(met, F.col("node") == F.col("n")).select("node", F.col("r.r1").alias("_r1"), F.col("r.r2").alias("_r2"))
    texts = docs.join(rep, (F.col("r1") == F.col("_r1")) & (F.col("r2") == F.col("_r2"))).select("node", hashes(F.col("text")).alias("s"))
    # equal rows of docs have the same r1 and r2
    sets = materialize(texts.groupBy("node").agg(F.first("s").alias("s")))
    found = materialize(verified(pairs, sets))
    roots = components(found)
    large = shared.where(F.col("n") > small)
    rest = materialize(rooted(large.select("node", "hub").distinct(), roots, "node", "hub").where("r_node <> r_hub").select("node").distinct())
    more = materialize(verified(other_pairs(shared, roots, rest, small), sets))
    if not more.isEmpty():
        found = found.union(more)
        roots = components(found)
    if rest.isEmpty():
        return roots
    search = sets.join(large.select(F.col("node").alias("_n")).distinct(), F.col("node") == F.col("_n")).select("node", "s")
    more = materialize(verified(materialize(rare_pairs(rare_keys(search, rest), roots)), sets))
    return roots if more.isEmpty() else components(found.union(more))


def keep_distinct(docs: DataFrame, small: int = 12) -> DataFrame:
    """One row of each group of near copies stays: the one of least doc_id (rows without doc_id last), then of least row hash."""
    names = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.xxhash64(*names).alias("r1"), F.xxhash64(F.lit("row"), *names).alias("r2"))
    doc_id, text = F.col("row.doc_id"), F.col("row.text")
    seen = whole.select(doc_id.alias("doc_id"), "r1", "r2", sketch(text).alias("k"))
    rows = materialize(seen.select("doc_id", "r1", "r2", "k.node", "k.exact", "k.words"))
    roots = similar_components(whole.select(text.alias("text"), "r1", "r2"), rows, small).withColumnRenamed("node", "_node")
    placed = rows.join(roots, F.col("node") == F.col("_node"), "left").select(
        F.coalesce("root", "node").alias("comp"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2").alias("row"))
    kept = placed.groupBy("comp").agg(F.min("row").alias("row")).select(F.col("row.r1").alias("_r1"), F.col("row.r2").alias("_r2"))
    stay = whole.join(kept, (F.col("r1") == F.col("_r1")) & (F.col("r2") == F.col("_r2")), "left_semi")
    return stay.dropDuplicates(["r1", "r2"]).select("row.*")
