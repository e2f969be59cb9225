"""Hierarchical Pitman-Yor language model, sampled by Gibbs, and document scores.

Model: every token is drawn in the restaurant of its context, the previous token; every
word has one, and the start of a text shares that of the end token. All context
restaurants share one parent, the unigram restaurant, whose parent is uniform over the V
known tokens and one unknown token. Tables of a context restaurant are customers of the
parent.

Gibbs sampling: a sweep re-seats, for every (context, word), its customers given all
other seats: the number of tables of up to `EXACT` customers is drawn from its exact
conditional (generalised Stirling numbers times the parent's probability of a table
each), further customers are seated after them in batches of a sixteenth. A single customer
always has one table, so only pairs that occur twice or more are re-seated. Table totals
of restaurants come from the sweep before, summed over all data. After the burn-in the
predictive probabilities of the samples are averaged; the score is the sum of their
log10, from which perplexity follows.

Distribution: documents are grouped into blocks by hash of doc_id, words and contexts,
named by 64-bit hashes, into buckets by that hash. A block sends each bucket one compressed
list of its distinct (word, context) pairs with training counts, sorted by the word's hash;
buckets add up counts, keep the seats of their words and the table totals of their words'
restaurants, and answer with numbers in the order of the request. After a sweep each bucket sends
the tables of its contexts to the buckets that own these, which add them up and send the
totals back: lists in a fixed order, no names. So no table of contexts is held anywhere. Every pair of a word is
in one bucket. The driver sees sums only. Blocks are about `block_bytes` of text; there are at most
100,000 blocks and 20,000 buckets, beyond which they grow.

Null texts count as empty (one end token). Rows without doc_id are scored but not learned
from, and count as not held out. Repeated rows are learned from and scored one by one.
Without training rows every probability is 1. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import materialize, query, table

EXACT = 32
END = b""
#: Rows that blocks and buckets send each other: to, what, from, packed arrays; numbers for the driver.
MAIL = "place int, kind string, sender int, parts array<binary>, nums array<bigint>"
NUMS = ("n", "v", "tables", "guests", "n1", "n2", "m1", "m2")


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype).copy()


def tokens(raw: bytes | None) -> list[bytes]:
    words = (raw or b"").lower().split()
    words.append(END)
    return words


def letter(place: int, kind: str, sender: int, *arrays: np.ndarray, nums: list[int] | None = None) -> tuple:
    return int(place), kind, int(sender), [pack(a) for a in arrays], nums


def mail(letters: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(letters, columns=["place", "kind", "sender", "parts", "nums"])


def sorted_mail(rows: pd.DataFrame) -> dict[str, list]:
    """Rows of each kind, by sender."""
    out: dict[str, list] = {}
    for r in rows.sort_values("sender").itertuples():
        out.setdefault(r.kind, []).append(r)
    return out


def steps(at: np.ndarray) -> np.ndarray:
    """Ascending positions as differences, which pack well."""
    return np.diff(at, prepend=0).astype(np.uint32)


def positions(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint32), dtype=np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(places: np.ndarray):
    """(place, slice) of every place that occurs, places ascending."""
    at, first = np.unique(places, return_index=True)
    return [(int(b), slice(lo, hi)) for b, lo, hi in zip(at, first, np.append(first[1:], len(places)))]


# ── blocks ──────────────────────────────────────────────────────────────────

class Block:
    """Tokens of a block as positions in its sorted list of distinct (word, context) pairs."""

    def __init__(self, raws):
        number: dict[bytes, int] = {}
        put = number.setdefault
        parts = [np.array([put(w, len(number)) for w in tokens(raw)], np.int64) for raw in raws]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        ids = np.concatenate(parts)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.ids = hashes[order], rank[ids]
        before = np.concatenate((rank[[number[END]]], self.ids[:-1]))  # the end of a text starts the next
        del parts, ids, number
        key, self.pair = np.unique(self.ids << 32 | before, return_inverse=True)
        self.word, self.ctx = key >> 32, key & 0xFFFFFFFF

    def spans(self, buckets: int):
        """(bucket, word slice, pair slice) of every bucket that occurs."""
        for bucket, w in runs(bucket_of(self.hashes, buckets)):
            yield bucket, w, slice(*np.searchsorted(self.word, (w.start, w.stop)))


def _requests(buckets: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b = Block(rows["raw"])
        learn = np.repeat(rows["train"].to_numpy(bool), b.lengths)
        n = np.bincount(b.pair[learn], minlength=len(b.word)).astype(np.uint32)
        out = []
        for bucket, w, p in b.spans(buckets):
            per_word = np.bincount(b.word[p] - w.start, minlength=w.stop - w.start).astype(np.uint32)
            out.append(letter(bucket, "ask", key[0], b.hashes[w], per_word, b.hashes[b.ctx[p]], n[p]))
        return mail(out)
    return run


# ── buckets: restaurants and their seats ────────────────────────────────────

def _open(buckets: int):
    """Adds up the counts of all blocks; one table for each (context, word) to begin with."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = key[0]
        asked = sorted_mail(rows)["ask"]
        names = [unpack(r.parts[0], np.uint64) for r in asked]
        w = np.concatenate([np.repeat(x, unpack(r.parts[1], np.uint32)) for x, r in zip(names, asked)])
        u = np.concatenate([unpack(r.parts[2], np.uint64) for r in asked])
        n = np.concatenate([unpack(r.parts[3], np.uint32) for r in asked])
        order = np.lexsort((u, w))
        marks = np.cumsum([0] + [int(unpack(r.parts[1], np.uint32).sum()) for r in asked])
        w, u = w[order], u[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
        at = np.flatnonzero(new)
        c = np.add.reduceat(n[order].astype(np.int64), at)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        w, u = w[at], u[at]
        words, word = np.unique(w, return_inverse=True)
        out = [letter(own, "pos", r.sender, steps(np.searchsorted(words, x)), steps(place[lo:hi])) for r, x, lo, hi in zip(asked, names, marks, marks[1:])]
        many = np.flatnonzero(c > 1)
        count = lambda i: np.bincount(i, minlength=len(words))
        total, kinds, ones = np.bincount(word, c, len(words)).astype(np.int64), count(word[c > 0]), count(word[c == 1]).astype(np.uint32)
        ctx, at = np.unique(u[c > 0], return_inverse=True)
        single, more = (np.bincount(at[x], minlength=len(ctx)).astype(np.uint32) for x in (c[c > 0] == 1, c[c > 0] > 1))
        moving = ctx[more > 0]
        root_t, none = (total > 0).astype(np.uint32), np.zeros(len(many), np.uint32)
        owners = runs(bucket_of(moving, buckets))
        out += [
            letter(own, "count", own, c, total), letter(own, "own", own, words),
            letter(own, "many", own, steps(word[many]), np.searchsorted(moving, u[many]).astype(np.uint32), c[many], ones,
                   np.array([b for b, _ in owners], np.int64), np.array([s.stop for _, s in owners], np.int64)),
            letter(own, "seats", own, none + np.uint32(1), root_t, none, np.zeros(0, np.uint32)),
            letter(own, "nums", own, nums=[int(x) for x in (c.sum(), (total > 0).sum(), root_t.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum(), (kinds == 1).sum(), (kinds == 2).sum())])]
        out += [letter(b, "enter", own, ctx[s], single[s], more[s]) for b, s in runs(bucket_of(ctx, buckets))]
        return mail(out)
    return run


def _enter(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Places of every bucket's contexts in the list of their owner, and the first table totals."""
    own, got = key[0], sorted_mail(rows)
    words = unpack(got["own"][0].parts[0], np.uint64)
    base, t, seen = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), []
    for r in got.get("enter", ()):
        at, more = np.searchsorted(words, unpack(r.parts[0], np.uint64)), unpack(r.parts[2], np.uint32)
        base[at] += unpack(r.parts[1], np.uint32)
        t[at] += more
        seen.append((r.sender, at[more > 0]))
    t += base
    out = [letter(own, "base", own, base)]
    for sender, at in seen:
        if len(at):
            out += [letter(own, "seen", sender, steps(at)), letter(sender, "totals", own, t[at])]
    return mail(out)


def _add_up(sample: int):
    """Table totals of a bucket's contexts, kept for a sample (-1: none), sent to the buckets that seat customers there."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, got = key[0], sorted_mail(rows)
        t = unpack(got["base"][0].parts[0], np.int64)
        at = [(r.sender, positions(r.parts[0])) for r in got.get("seen", ())]
        for (_, a), r in zip(at, got.get("sums", ())):
            t[a] += unpack(r.parts[0], np.int64)
        out = [letter(sender, "totals", own, t[a]) for sender, a in at]
        return mail(out + ([letter(own, "kept", sample, t)] if sample >= 0 else []))
    return run


def stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c and t up to EXACT."""
    s = np.zeros((EXACT + 1, EXACT + 1))
    s[0, 0] = 1.0
    scale = np.zeros(EXACT + 1)
    for c in range(EXACT):
        s[c + 1, 1:] = s[c, :-1]
        s[c + 1] += np.maximum(0.0, c - discount * np.arange(EXACT + 1)) * s[c]
        scale[c + 1] = scale[c] + np.log(s[c + 1].max())
        s[c + 1] /= s[c + 1].max()
    with np.errstate(divide="ignore"):
        return np.log(s) + scale[:, None]


def seat(c, others, parent, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of c customers of a dish, given the restaurant's other tables and the parent's probability."""
    t = np.ones(len(c), np.int64)
    logs = stirling(discount)
    head = np.minimum(c, EXACT)
    steps = np.arange(EXACT)
    for size in np.unique(head[head > 1]):
        for at in np.array_split(np.flatnonzero(head == size), max(1, (head == size).sum() // 50_000)):
            a = strength + discount * (others[at, None] + steps[None, :size])
            lp = logs[size, 1:size + 1] + np.cumsum(np.log(a * parent[at, None]), 1)
            p = np.exp(lp - lp.max(1, keepdims=True)).cumsum(1)
            t[at] = 1 + (rng.random(len(at))[:, None] * p[:, -1:] > p[:, :-1]).sum(1)
    more = np.flatnonzero(c > EXACT)
    n = np.full(len(more), EXACT, np.int64)
    while len(more):
        step = np.minimum(c[more] - n, np.maximum(1, n // 16))
        new = (strength + discount * (others[more] + t[more])) * parent[more]
        t[more] += rng.binomial(step, np.clip(new / (n - discount * t[more] + new), 0.0, 1.0))
        n += step
        left = n < c[more]
        more, n = more[left], n[left]
    return t


def _sweep(shared, seed: int, keep: bool):
    """Re-seats the customers of a bucket's words; shared: totals of the sweep before."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v, own, got = shared.value, key[0], sorted_mail(rows)
        rng = np.random.default_rng([seed, own])
        many, seats = got["many"][0].parts, got["seats"][0].parts
        word, ctx, c = positions(many[0]), unpack(many[1], np.uint32), unpack(many[2], np.int64)
        ones, owners, stops = unpack(many[3], np.uint32).astype(np.int64), unpack(many[4], np.int64), unpack(many[5], np.int64)
        t, root_t, tsum = unpack(seats[0], np.uint32).astype(np.int64), unpack(seats[1], np.uint32).astype(np.int64), unpack(seats[2], np.uint32)
        guests = lambda: ones + np.bincount(word, t, len(ones)).astype(np.int64)
        parent = root_probability(guests(), root_t, v)
        if len(c):
            others = np.concatenate([unpack(r.parts[0], np.int64) for r in got["totals"]])[ctx] - t
            t = seat(c, others, parent[word], v["d"], v["theta"], rng)
        held = guests()
        some = np.flatnonzero(held)
        base = np.full(len(some), 1.0 / (v["v"] + 1))
        root_t[some] = seat(held[some], np.maximum(0, v["tables"] - root_t[some]), base, v["d0"], v["theta"], rng)
        past = unpack(seats[3], np.uint32)
        if keep:
            tsum, past = tsum + t.astype(np.uint32), np.concatenate((past, held.astype(np.uint32), root_t.astype(np.uint32)))
        sums = np.bincount(ctx, t, stops[-1] if len(stops) else 0).astype(np.int64)
        out = [letter(own, "seats", own, t.astype(np.uint32), root_t.astype(np.uint32), tsum, past),
               letter(own, "nums", own, nums=[0, 0, int(root_t.sum()), int(held.sum()), 0, 0, 0, 0])]
        return mail(out + [letter(b, "sums", own, sums[lo:hi]) for b, lo, hi in zip(owners, np.append(0, stops[:-1]), stops)])
    return run


def root_probability(guests, root_t, v: dict):
    return (guests - v["d0"] * root_t) / (v["theta"] + v["guests"]) + root_back_off(v)


def root_back_off(v: dict) -> float:
    """Probability of a token without a table in the unigram restaurant."""
    return (v["theta"] + v["d0"] * v["tables"]) / (v["theta"] + v["guests"]) / (v["v"] + 1)


def totals(state: DataFrame) -> dict[str, int]:
    sums = state.where("kind = 'nums'").agg(*[F.coalesce(F.sum(F.col("nums")[i]), F.lit(0)).alias(c) for i, c in enumerate(NUMS)])
    return sums.first().asDict()


# ── answers and scores ──────────────────────────────────────────────────────

def _answers(samples: int):
    """Per block: of its words the count and, a sample each, guests, tables and tables of their own restaurant; of its pairs the customers and summed tables."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = sorted_mail(rows)
        c, total = (unpack(x, np.int64) for x in got["count"][0].parts)
        _, _, tsum, past = (unpack(x, np.uint32) for x in got["seats"][0].parts)
        per_word = np.stack([*past.reshape(2 * samples, -1).astype(np.int64), *[unpack(r.parts[0], np.int64) for r in got["kept"]]])
        tables = np.where(c == 1, samples, 0).astype(np.uint32)
        tables[c > 1] = tsum
        out = []
        for r in got["pos"]:
            w, p = map(positions, r.parts)
            out.append(letter(r.sender, "answer", key[0], total[w], per_word[:, w], c[p], tables[p]))
        return mail(out)
    return run


def _score(shared):
    """Scores of a block's documents; shared: totals of every sample."""
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        g, b = shared.value, Block(rows["raw"])
        got = [r.parts for r in sorted_mail(answers)["answer"]]
        counts, c = (np.concatenate([unpack(x[i], np.int64) for x in got]) for i in (0, 2))
        per_word = np.concatenate([unpack(x[1], np.int64).reshape(3 * len(g), -1) for x in got], 1)
        tables = np.concatenate([unpack(x[3], np.uint32) for x in got])
        v = g[-1]
        p = (c - v["d"] * tables / len(g)) / (v["theta"] + counts[b.ctx])  # a word's restaurant has as many customers as the word occurs
        for i, s in enumerate(g):
            guests, root_t, own_t = per_word[2 * i], per_word[2 * i + 1], per_word[2 * len(g) + i]
            back = (s["theta"] + s["d"] * own_t) / (s["theta"] + counts)
            p += back[b.ctx] * root_probability(guests, root_t, s)[b.word] / len(g)
        logs = np.log10(np.minimum(p, 1.0))
        base = np.log10((counts + 0.1) / (v["n"] + 0.1 * (v["v"] + 1)))
        doc = np.repeat(np.arange(len(rows)), b.lengths)
        sums = lambda x: np.bincount(doc, x, len(rows))
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": b.lengths, "n_known": sums(counts[b.ids] > 0).astype(np.int64),
            "train_tokens": v["n"], "base_score": sums(base[b.ids]), "score": sums(logs[b.pair])})
    return run


def score_documents(docs: DataFrame, min_rate: float = 0.0, burn_in: int = 3, samples: int = 3, theta: float = 1.0, seed: int = 11,
                    block_bytes: int = 1 << 23) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one per row of docs.

    min_rate is accepted as before and has no effect: the rarest word is a context too.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
                       F.coalesce(fold != 0, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.length("raw") + 64), F.lit(0))).first()[0]
    blocks = int(min(100_000, max(1, -(-size // block_bytes))))
    buckets = min(20_000, blocks)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("raw"))), F.lit(blocks)).cast("int"))

    def deliver(run, *letters: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
        post = reduce(DataFrame.union, [df.where(F.col("kind").isin(*kinds)) for df, kinds in letters])
        return materialize(post.groupBy("place").applyInPandas(run, MAIL))

    asked = rows.groupBy("block").applyInPandas(_requests(buckets), MAIL)
    opened = deliver(_open(buckets), (asked, ("ask",)))
    entered = deliver(_enter, (opened, ("own", "enter")))
    now = totals(opened) | {"theta": theta}
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    now |= {"d": share(now["n1"], now["n2"]), "d0": share(now["m1"], now["m2"])}
    state, sums, kept, held = opened, entered, [], []
    for s in range(burn_in + samples):
        keep = s >= burn_in
        state = deliver(_sweep(spark.sparkContext.broadcast(now), seed + s, keep), (opened, ("many",)), (state, ("seats",)), (sums, ("totals",)))
        sums = deliver(_add_up(s - burn_in if keep else -1), (entered, ("base", "seen")), (state, ("sums",)))
        now = now | {k: x for k, x in totals(state).items() if k in ("tables", "guests")}
        if keep:
            kept.append(now)
            held.append((sums, ("kept",)))
    answers = reduce(DataFrame.union, [df.where(F.col("kind").isin(*kinds)) for df, kinds in [(opened, ("pos", "count")), (state, ("seats",)), *held]])
    answers = answers.groupBy("place").applyInPandas(_answers(samples), MAIL)
    scored = rows.groupBy("block").cogroup(answers.groupBy("place")).applyInPandas(
        _score(spark.sparkContext.broadcast(kept)),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


@query("op1_hpyp_gibbs")
def op1_hpyp_gibbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
