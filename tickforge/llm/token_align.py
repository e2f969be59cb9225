"""Alignment of two tokenizers by inverted pair bitmaps.

Texts are encoded by a byte-level BPE (A, over space + text) and a piece BPE (B, which
puts the space itself). Byte offsets where tokens of both end cut a text into groups, and
the two tokens that end there are a link. Both tokenizers cut after a letter where no
letter, digit or underscore follows, and before a space after anything else, so a text is a list of units (a
word with the white space before it, or signs), and each distinct unit is encoded and aligned
once in a task. B's vocabulary is checked for pieces across such cuts.

A chunk is a run of documents of one partition (about `chunk_chars` characters, at most
65,536 documents); a document's place in it is its bit. For each pair of ids a chunk holds
compressed bitmaps: `planes`, where plane j marks the documents whose number of such links
has bit j set, and `docs`, the OR of the planes (kept only where there is more than one).
A bitmap is a list of 16-bit places or, where shorter, a plain one. Chunks share no
document, so a pair's bitmap over the corpus is that of its chunks side by side, and
popcounts add up: documents of a pair are the popcounts of `docs`, links the popcounts of
the planes, each times 2^j. Counts are joined to the postings by pair, and every posting
carries its scores back to its chunk, where the documents in its bitmaps add them up.

Sizes: a pair has at most one posting a chunk, so no pair is a large share of the postings;
only the best count of each B id (at most B's vocabulary) is joined as a small table. A
chunk is written once and read by all later steps, so that lost executors repeat the same chunks.

Null and empty texts, and texts whose tokens do not give back space + text (a literal
U+2581), have no tokens: zeros and an empty digest. Repeated rows and rows without doc_id
count one by one. A very long text is a chunk of its own. Empty tables give an empty
result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import materialize, query, table

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHIFT = 1 << 20  # of A's id in a pair
SUMS = ("n_best", "count_sum", "doc_count_sum")
MOST_DOCS, MOST_UNITS = 1 << 16, 1 << 19
#: A unit: white space and letters before something else, signs before a blank, or whatever leads to such a place.
UNIT = re.compile(r"\s*[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+(?!\w)|[^\w\s]+(?=[ \n\t]|\Z)|.+?(?:(?<=[^\W\d_\xb2\xb3\xb9\xbc-\xbe])(?=\W)|(?<=[^\w\s])(?=[ \n\t])|(?<=[\d_\xb2\xb3\xb9\xbc-\xbe])(?=[ \n\t])|\Z)", re.S)
#: What no piece of B may hold for these to be cuts of B: a letter and then another sign, a space or blank after anything.
NO_CUT = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe](?!\w)[^▁]|[^▁]▁|.[\n\t]", re.S)
CHUNK_TYPE = pa.schema([
    ("chunk", pa.int64()),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                                 ("groups_sha256", pa.string())]))),
    ("postings", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64()), ("whole", pa.bool_()), ("bitmap", pa.binary())])))])


def byte_alphabet() -> dict[str, int]:
    """The character of every byte in the entries of a byte-level vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_encoder(path: str):
    """(encode, bytes of every id) of a byte-level BPE file; its merges must be in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_alphabet()
    special = {t for t in model["vocab"] if any(c not in of for c in t)} | {"<|endoftext|>"}
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [ranks[bytes(of[c] for c in a + b)] for a, b in pairs] != list(range(256, 256 + len(pairs))):
        raise ValueError("ids of the byte-level vocabulary are not in the order of its merges")
    own = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own.encode_ordinary, {i: t for t, i in ranks.items()}


def piece_encoder(path: str):
    """(encode, bytes of every id) of a piece BPE model."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    if any(NO_CUT.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))):
        raise ValueError("the piece vocabulary has pieces across the cuts of units")

    def raw(i: int) -> bytes:
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()
    return sp.encode, {i: raw(i) for i in range(sp.get_piece_size())}


def units_of(text: str) -> list[str]:
    """Units of space + text, none of which begins with a letter."""
    return UNIT.findall(" " + text)


class Aligner:
    """Encodes and aligns units, keeping those met before (up to MOST_UNITS)."""

    def __init__(self, byte_path: str, piece_path: str):
        (self.a, bytes_a), (self.b, self.bytes_b) = byte_encoder(byte_path), piece_encoder(piece_path)
        self.width_a, self.width_b = {i: len(x) for i, x in bytes_a.items()}, {i: len(x) for i, x in self.bytes_b.items()}
        self.lead = self.b("a")
        if len(self.lead) != 1:
            raise ValueError("the piece vocabulary has no piece for a first letter a")
        self.name = [str(i) for i in range(max(*bytes_a, *self.bytes_b) + 1)]
        self.pairs: dict[int, int] = {}
        self.known: dict[str, tuple | None] = {}

    def align(self, unit: str, b: list[int]) -> tuple | None:
        """(A tokens, B tokens, digest of groups, links as pairs); None if B's tokens do not give back the unit, as A's always do."""
        if b"".join(map(self.bytes_b.__getitem__, b)) != unit.encode():
            return None
        a, name, same = self.a(unit), self.name.__getitem__, self.pairs.setdefault
        if len(a) == 1 or len(b) == 1:
            pair = a[-1] * SHIFT + b[-1]
            return len(a), len(b), ",".join(map(name, a)) + "|" + ",".join(map(name, b)), (same(pair, pair),)
        ends_a = dict(zip(accumulate(map(self.width_a.__getitem__, a)), range(1, len(a) + 1)))
        groups, links, from_a, from_b = [], [], 0, 0
        for to_b, end in enumerate(accumulate(map(self.width_b.__getitem__, b)), 1):
            to_a = ends_a.get(end)
            if to_a is not None:
                groups.append(",".join(map(name, a[from_a:to_a])) + "|" + ",".join(map(name, b[from_b:to_b])))
                pair = a[to_a - 1] * SHIFT + b[to_b - 1]
                links.append(same(pair, pair))
                from_a, from_b = to_a, to_b
        return len(a), len(b), ";".join(groups), tuple(links)

    def learn(self, units) -> None:
        if len(self.known) > MOST_UNITS:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        # a unit follows a letter as it follows anything else
        for u, b in zip(new, self.b(["a" + u for u in new], num_threads=1) if new else ()):
            self.known[u] = self.align(u, b[1:])


class Numbers(dict):
    """Numbers of units, in the order of their first look-up."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def bitmaps(pair: np.ndarray, place: np.ndarray, times: np.ndarray, docs: int) -> pa.Array:
    """Postings of one chunk from rows (pair, place, times), sorted by pair and place.

    Plane j has `times` 2^j. The OR of a pair's planes, kept where it has more than plane 0, has `times` 0. `whole` marks
    the bitmap of all the pair's documents.
    """
    keys, starts = [], []
    planes = int(times.max()).bit_length() if len(times) else 0
    several = np.zeros(len(pair), bool)
    if planes > 1:
        other = np.flatnonzero(times > 1)
        several = np.isin(pair, pair[other])
    for j in range(-1, planes):
        at = np.flatnonzero(several) if j < 0 else np.flatnonzero(times >> j & 1)
        keys.append(np.full(len(at), j, np.int32))
        starts.append(at)
    plane, at = np.concatenate([*keys, np.zeros(0, np.int32)]), np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
    order = np.lexsort((place[at], plane, pair[at]))
    plane, at = plane[order], at[order]
    p, q = pair[at], place[at].astype(np.uint16)
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (plane[1:] != plane[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    out, width = [], (docs + 7) // 8
    dense = count * 2 > width
    raw = q.astype("<u2").tobytes()
    for f, c, d in zip(first.tolist(), count.tolist(), dense.tolist()):
        if d:
            bits = np.zeros(width * 8, np.uint8)
            bits[q[f:f + c]] = 1
            out.append(b"\x01" + np.packbits(bits, bitorder="little").tobytes())
        else:
            out.append(b"\x00" + raw[2 * f:2 * (f + c)])
    whole = (plane[first] < 0) | ~several[at[first]]
    return pa.StructArray.from_arrays([pa.array(p[first], pa.int64()), pa.array(np.where(plane[first] < 0, 0, 1 << np.maximum(plane[first], 0).astype(np.int64))), pa.array(whole), pa.array(out, pa.binary())],
                                      ["pair", "times", "whole", "bitmap"])


def places(bitmap: bytes) -> np.ndarray:
    """Places marked in a bitmap."""
    if bitmap[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)


def _chunker(byte_path: str, piece_path: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, made = Aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0

        def row(held: list) -> pa.RecordBatch:
            number = Numbers()
            at = [list(map(number.__getitem__, units_of(t))) if t else [] for _, t in held]
            aligner.learn(number)
            found = [aligner.known[u] for u in number]
            bad = np.array([f is None for f in found], bool)
            found = [f or (0, 0, "", ()) for f in found]
            digest = [f[2] for f in found].__getitem__
            unit = np.array([u for us in at for u in us], np.int64)
            doc = np.repeat(np.arange(len(at)), [len(us) for us in at])
            good = np.ones(len(at), bool)
            good[doc[bad[unit]]] = False
            unit, doc = unit[good[doc]], doc[good[doc]]
            total = lambda k: np.bincount(doc, np.array([k(f) for f in found], np.float64)[unit], len(at)).astype(np.int64)
            sha = [hashlib.sha256(";".join(map(digest, us)).encode()).hexdigest() if us and ok else "" for us, ok in zip(at, good.tolist())]
            docs = pa.StructArray.from_arrays([
                pa.array([d for d, _ in held], pa.int64()), pa.array(np.arange(len(at)), pa.int32()), *[pa.array(total(k), pa.int64()) for k in (
                    lambda f: f[0], lambda f: f[1], lambda f: len(f[3]))], pa.array(sha, pa.string())], [f.name for f in CHUNK_TYPE.field("docs").type.value_type])
            # units of documents -> links of documents -> times of each (pair, document)
            size = np.array([len(f[3]) for f in found], np.int64)
            names, code = np.unique(np.array([x for f in found for x in f[3]], np.int64), return_inverse=True)
            n, rank = size[unit], (np.cumsum(size) - size)[unit]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key, times = np.unique(code[np.repeat(rank, n) + inside] * MOST_DOCS + np.repeat(doc, n), return_counts=True)
            post = bitmaps(names[key // MOST_DOCS], key % MOST_DOCS, times, len(held))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), one(docs), one(post)], schema=CHUNK_TYPE)

        held, chars = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                held.append((doc_id, text or ""))
                chars += len(text or "")
                if chars >= chunk_chars or len(held) == MOST_DOCS:
                    yield row(held)
                    held, chars, made = [], 0, made + 1
        if held:
            yield row(held)
    return run


def popcount(bitmap) -> F.Column:
    """Marked places of a bitmap of either kind."""
    plain = F.bitmap_count(F.substring(bitmap, 2, 1 << 30))
    return F.when(F.substring(bitmap, 1, 1) == F.lit(b"\x01"), plain).otherwise(((F.octet_length(bitmap) - 1) / 2).cast("bigint"))


def index(docs: DataFrame, byte_path: str, piece_path: str, chunk_chars: int) -> DataFrame:
    """Rows (chunk, docs, postings), written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = ("chunk long, docs array<struct<doc_id: bigint, place: int, n_a: bigint, n_b: bigint, n_groups: bigint, groups_sha256: string>>, "
            "postings array<struct<pair: bigint, times: bigint, whole: boolean, bitmap: binary>>")
    return materialize(rows.mapInArrow(_chunker(byte_path, piece_path, chunk_chars), kind))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Rows (pair, links, docs, best): link and document counts over the corpus, best if no pair of the B id has more links."""
    flat = chunks.select(F.explode("postings").alias("p")).select("p.pair", "p.times", "p.whole", popcount(F.col("p.bitmap")).alias("n"))
    counts = materialize(flat.groupBy("pair").agg(
        F.sum(F.col("n") * F.col("times")).alias("links"), F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("docs")))
    top = counts.groupBy((F.col("pair") % SHIFT).alias("_b")).agg(F.max("links").alias("top"))
    return counts.join(top, F.col("pair") % SHIFT == F.col("_b")).select("pair", "links", "docs", (F.col("links") == F.col("top")).alias("best"))


def _scorer(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
    """Sums of one chunk's documents from the scored postings of all its pairs."""
    weight, *scores = (frame[c].to_numpy().astype(np.int64) for c in ("times", "best", "links", "docs"))
    found = [places(x.as_py()) for x in frame["bitmap"].combine_chunks()]
    n = np.array([len(x) for x in found], np.int64)
    at, times = np.concatenate(found).astype(np.int64), np.repeat(weight, n)
    sums = []
    for s in scores:
        total = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(total, at, times * np.repeat(s, n))
        sums.append(pa.array([total.tolist()], pa.list_(pa.int64())))
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *sums], ["chunk", *SUMS])


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, chunk_chars: int = 1 << 22) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, doc_count_sum, groups_sha256), one per row of docs."""
    chunks = index(docs, byte_path or public_tokenizers.path(BYTE_FILE), piece_path or public_tokenizers.path(PIECE_FILE), chunk_chars)
    counts = pair_counts(chunks).withColumnRenamed("pair", "_pair")
    postings = chunks.select("chunk", F.explode("postings").alias("p")).select("chunk", "p.*").where("times > 0")
    scored = postings.join(counts, F.col("pair") == F.col("_pair")).select("chunk", "times", "bitmap", "links", "docs", "best")
    kind = ", ".join(f"{c} array<bigint>" for c in SUMS)
    sums = scored.groupBy("chunk").applyInArrow(_scorer, f"chunk long, {kind}").withColumnRenamed("chunk", "_chunk")
    rows = chunks.select("chunk", F.explode("docs").alias("d")).select("chunk", "d.*")
    of = lambda c: F.coalesce(F.get(c, F.col("place")), F.lit(0)).cast("bigint").alias(c)
    return rows.join(sums, F.col("chunk") == F.col("_chunk"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *[of(c) for c in SUMS], "groups_sha256")


@query("op12_pair_bitmaps")
def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
