"""Byte-level BPE encoding and decoding by higher-order functions.

Texts are cut into pieces by the tokenizer's pattern. A piece is encoded by a fold over its ranked
merges: the spans of its bytes that are tokens, least rank first, leftmost first. What is folded is the piece's
set of cuts, the bits of one long; a span whose ends are cuts with exactly one cut between them is two adjacent
parts, and joining them takes that cut away. One pass is exact: as long as both ends of a token's span are cuts, what happens
between them is what happens to the token alone, and merges of lower rank bring it down to two parts before its turn (`odd_ranks`
checks this of every token when the rank file is read; a piece with one that breaks it goes to the heap). Ids are the ranks of the parts left, and decoding looks up the bytes of
every id and concatenates them, once per piece.

A partition is read once, in runs of about `chunk_chars` characters. A run holds its documents as numbers
of pieces and the pieces that are new to the partition, with their merges; these are folded in
place, and the same task puts the documents together from what it was told of each number. So a
piece is folded once a partition, nothing is exchanged or written between, and rows stay small. Runs and numbers
follow each other in one stage, whose rows keep their order. After `MOST_PIECES` pieces the numbers start
anew, on both sides, so neither side's memory grows with the partition.

The fold is quadratic in the length of a piece and a long has 64 bits, so pieces over `LONG` bytes (runs without
white space) are merged by the same rule with a heap, in n log n.

Null texts count as empty and have no ids. Repeated rows are encoded one by one. A very long text is
a run of its own. An empty table gives an empty result. Only doc_id and text are read, so other
columns may have any name; the rank file is a parameter and is read by the driver.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import query, table

RANK_FILE = "byte_bpe_50k.tiktoken"
LONG = 62  # a piece's cuts are the bits of a long, its end included
MOST_DOCS = 1 << 16
#: Units end where PATTERN always cuts: after a letter that no letter, digit or underscore follows, or before a space after a sign.
UNIT = re.compile(r"\s*[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+(?!\w)|[^\w\s]+(?=[ \n\t]|\Z)|.+?(?:(?<=[^\W\d_\xb2\xb3\xb9\xbc-\xbe])(?=\W)|(?<=\S)(?= )|\Z)", re.S)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MOST_PIECES = 1 << 18
RUN_TYPE = "ids array<bigint>, sizes array<int>, at binary, anew boolean, raw binary, lengths array<int>, merges array<array<bigint>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def extend(keys: np.ndarray, more: np.ndarray, n: int) -> np.ndarray:
    """Keys of strings of n bytes from those of n - 1 and the last bytes: up to 8 bytes the bytes themselves."""
    return keys * (np.uint64(256) if n <= 8 else FACTOR) + more


def by_length(ranks: dict[bytes, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys of the tokens of each length and their ranks."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs an id")
    out = {}
    for n in {len(x) for x in ranks if 2 <= len(x) <= LONG}:
        mine = [x for x in ranks if len(x) == n]
        data = np.frombuffer(b"".join(mine), np.uint8).reshape(-1, n).astype(np.uint64)
        keys = data[:, 0]
        for i in range(1, n):
            keys = extend(keys, data[:, i], i + 1)
        order = np.argsort(keys)
        out[n] = keys[order], np.array([ranks[x] for x in mine], np.int64)[order]
    return out


def ranked_merges(pieces: list[bytes], shared) -> pa.Array:
    """array<array<bigint>>: of each piece the spans that are tokens, as the bits from begin to end, least rank first.

    Null for pieces over LONG bytes and those with a token that lower merges don't lead to.
    """
    ranks, tokens, odd = shared
    size = np.fromiter((len(x) if len(x) <= LONG else 0 for x in pieces), np.int64, len(pieces))
    raw = b"".join([x for x in pieces if len(x) <= LONG])
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(pieces)), size)
    start = np.concatenate(([0], np.cumsum(size)))
    left = start[owner + 1] - np.arange(len(data))
    at, keys, found = np.arange(len(data)), data, []
    for n in range(2, LONG + 1):
        more = left[at] >= n
        at = at[more]
        if not len(at):
            break
        keys = extend(keys[more], data[at + n - 1], n)
        if n in tokens:
            known, rank = tokens[n]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero(known[place] == keys)
            if n > 8:  # keys are hashes
                hit = np.array([h for h in hit.tolist() if ranks.get(raw[at[h]:at[h] + n]) == rank[place[h]]], np.int64)
            found.append((at[hit], n, rank[place[hit]]))
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    begin, rank, size = join([f[0] for f in found]), join([f[2] for f in found]), join([np.full(len(f[0]), f[1]) for f in found])
    mine = owner[begin]
    null = np.array([len(x) > LONG for x in pieces], bool)
    null[mine[np.isin(rank, odd)]] = True
    order = np.lexsort((begin, rank, mine))
    b = (begin - start[mine])[order].astype(np.uint64)
    spans = (np.uint64(1) << (b + size[order].astype(np.uint64))) - (np.uint64(1) << b)
    first = np.concatenate(([0], np.cumsum(np.bincount(mine, minlength=len(pieces)))))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(spans.astype(np.int64)), mask=pa.array(null))


def odd_ranks(ranks: dict[bytes, int], tokens: dict) -> np.ndarray:
    """Ranks of the tokens that the merges of lower ranks don't bring down to two parts; none in a trained vocabulary."""
    out: list[int] = []
    none = np.zeros(0, np.int64)
    order = [x for x in sorted(ranks, key=ranks.get) if 2 <= len(x) <= LONG]
    for token, spans in zip(order, ranked_merges(order, (ranks, tokens, none))):
        cuts = -1
        for span in spans.values.to_numpy().tolist():
            low = span & -span
            between = cuts & (span ^ low)
            if between.bit_count() == 1 and cuts & (span + 2 * low) == span + 2 * low:
                cuts ^= between
            if span == (1 << len(token)) - 1:
                break
        if cuts & ((1 << len(token)) - 1) != 1:
            out.append(ranks[token])
    return np.array(out, np.int64)


def encode_piece(merges: Column) -> Column:
    """bigint: the cuts left of one piece by a fold of its ranked merges; bits past its end stay set. Null without merges."""
    def step(cuts: Column, span: Column) -> Column:
        low = span.bitwiseAND(-span)
        ends, between = span + low * 2, cuts.bitwiseAND(span.bitwiseXOR(low))
        two_parts = (F.bit_count(between) == 1) & (cuts.bitwiseAND(ends) == ends)
        return F.when(two_parts, cuts.bitwiseXOR(between)).otherwise(cuts)

    return F.aggregate(merges, F.lit(-1).cast("bigint"), step)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long piece: the same merges from a heap of (rank, place), with linked neighbours."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i:end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


class Units(dict):
    """Numbers of the pieces of every unit met; `fresh` has the pieces not told yet."""

    def __init__(self, find):
        super().__init__()
        self.find, self.odd, self.fresh, self.count = find, {}, [], 0

    def numbered(self, piece: str) -> tuple[int]:
        self.fresh.append(piece)
        self.count += 1
        return (self.count - 1,)

    def piece(self, piece: str) -> tuple[int, ...]:
        if self.find(piece) == [piece]:
            return self[piece]
        if piece not in self.odd:  # it would be cut if it stood alone
            self.odd[piece] = self.numbered(piece)
        return self.odd[piece]

    def __missing__(self, unit: str) -> tuple[int, ...]:
        pieces = self.find(unit)
        self[unit] = at = self.numbered(unit) if pieces == [unit] else tuple(chain.from_iterable(map(self.piece, pieces)))
        return at


def _runs(shared, pattern: str, chunk_chars: int, most: int):
    """Runs of documents: their ids, numbers of pieces, and the pieces not met before, numbered on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        known = pattern == public_tokenizers.PATTERN
        ids: list[int | None] = []
        at: list[np.ndarray] = []
        units, held, anew = Units(find), 0, True

        def row() -> pa.RecordBatch:
            raw = [p.encode() for p in units.fresh]
            units.fresh = []
            merges = ranked_merges(raw, shared.value)
            values = [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in at]], pa.list_(pa.int32())), pa.array([np.concatenate(at).astype("<u4").tobytes()], pa.binary()), pa.array([anew]),
                      pa.array([b"".join(raw)], pa.binary()), pa.array([[len(p) for p in raw]], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), merges)]
            return pa.RecordBatch.from_arrays(values, ["ids", "sizes", "at", "anew", "raw", "lengths", "merges"])

        for batch in batches:
            for k in range(batch.num_rows):  # one text at a time, so that a batch is not held twice
                doc_id, text = batch["doc_id"][k].as_py(), batch["text"][k].as_py() or ""
                split = UNIT.findall(text) if known else [text]
                at.append(np.fromiter(chain.from_iterable(map(units.__getitem__, split)), np.int32))
                ids.append(doc_id)
                held += len(text)
                if held >= chunk_chars or len(ids) >= MOST_DOCS or len(units.fresh) >= most:
                    yield row()
                    ids, at, held, anew = [], [], 0, units.count >= most
                    if anew:
                        units = Units(find)
        if ids:
            yield row()

    return run


def parts_of(raw: bytes, lengths: np.ndarray, cuts: pa.Array, ranks: dict[bytes, int]) -> Iterator[list[bytes]]:
    """The parts of every piece, by its cuts or, where they are null, by the heap."""
    start = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    bits = np.unpackbits(cuts.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    piece, byte = np.nonzero(bits & (np.arange(64) < lengths[:, None]))
    begin = start[piece] + byte
    end = np.where(np.append(piece[1:] == piece[:-1], False)[:len(piece)], np.append(begin[1:], 0)[:len(piece)], start[piece + 1])
    parts = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist())]
    at, null = 0, cuts.is_null().to_pylist()
    token = {rank: raw for raw, rank in ranks.items()} if any(null) else {}
    for i, n in enumerate(np.bincount(piece, minlength=len(lengths)).tolist()):
        yield [token[r] for r in merge_long(raw[start[i]:start[i + 1]], ranks)] if null[i] else parts[at:at + n]
        at += n


def _assemble(shared, keep_ids: bool):
    """Documents of runs from their pieces' ids: the ids in order, and the bytes of every id one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value[0]
        name, token = {}, {}
        for raw, rank in ranks.items():
            name[raw] = str(rank)
            token[name[raw]] = raw
        text: list[str] = []
        raws: list[bytes] = []
        count = np.zeros(0, np.int32)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes = batch["ids"][k].as_py(), batch["sizes"][k].values.to_numpy()
                at = np.frombuffer(batch["at"][k].as_py(), "<u4")
                if batch["anew"][k].as_py():
                    text, raws, count = [], [], count[:0]
                told = len(text)
                for parts in parts_of(batch["raw"][k].as_py(), batch["lengths"][k].values.to_numpy(), batch["cuts"][k].values, ranks):
                    mine = [name[x] for x in parts]
                    text.append(" ".join(mine))
                    raws.append(b"".join([token[x] for x in mine]))
                count = np.concatenate((count, np.fromiter((x.count(" ") + 1 for x in islice(text, told, None)), np.int32)))
                out, start = [], 0
                for doc_id, n in zip(ids, sizes.tolist()):
                    mine = at[start:start + n]
                    start += n
                    tokens, mine = int(count[mine].sum()), mine.tolist()
                    joined = " ".join([text[i] for i in mine])
                    out.append((doc_id, tokens, hashlib.sha256(joined.encode()).hexdigest(),
                                hashlib.sha256(b"".join([raws[i] for i in mine])).hexdigest(), *([list(map(int, joined.split()))] if keep_ids else [])))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names[:len(cols)])
    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     chunk_chars: int = 1 << 20, keep_ids: bool = False, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), with keep_ids also `ids`, one per row of docs."""
    ranks = read_ranks(path or public_tokenizers.path(RANK_FILE))
    tokens = by_length(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, tokens, odd_ranks(ranks, tokens)))  # the vocabulary's size bounds it
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = rows.mapInArrow(_runs(shared, pattern, chunk_chars, most_pieces), RUN_TYPE)
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return runs.select("ids", "sizes", "at", "anew", "raw", "lengths", F.transform("merges", encode_piece).alias("cuts")).mapInArrow(_assemble(shared, keep_ids), kind)


@query("op9_bpe_fold")
def op9_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
