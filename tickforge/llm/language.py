"""Language identification by language-bitmask n-gram filters.

Training counts the letter n-grams of each language over all training rows. A language
contains an n-gram when its rate there is at least `min_rate` (so a language contains
at most 1 / min_rate of them, which bounds the filter whatever the corpus) and at least
`ratio` of the highest rate in any language. The filter is bit-sliced: one Bloom filter
for each language, stored slot by slot, so a slot is a mask with one bit per language
and one look-up (the AND of k slots) returns all languages containing an n-gram.

Prediction sums the bits per language over all n-grams of the text, corrects each sum
for the false positives expected from that language's fill, and takes the highest;
ties go to the language with more training rows, then to the lesser name. The score is
the share of the winner in all corrected sums.

Null texts and texts without a letter are `und` with score 0; a text none of whose
n-grams is known gets the language with most training rows and score 0. Without
training rows every text is `und`. Languages and sources are never read in prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickforge.llm.common import query, table

SIZES = (2, 3, 4)
CHUNK = 1 << 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of non-letters as one blank, a blank at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, place = np.unique(codes, return_inverse=True) if len(codes) > 4096 or len(codes) == 0 else (codes, slice(None))
    letters = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[place]
    codes = np.where(letters, codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    blank = codes == 32
    return codes[~(blank & np.concatenate(([False], blank[:-1])))]


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams, in bounded pieces; 21 bits a code point, four are mixed into 64."""
    for size in SIZES:
        for at in range(0, max(0, len(codes) - size + 1), CHUNK):
            part = codes[at:at + CHUNK + size - 1]
            n = len(part) - size + 1
            if n <= 0:
                continue
            key = np.full(n, size, np.uint64)
            for k in range(size):
                key = (key ^ part[k:k + n]) * np.uint64(MULTIPLIERS[0])
                key ^= key >> np.uint64(29)
            yield key


def slots(key: np.ndarray, i: int, size: int) -> np.ndarray:
    h = key * np.uint64(MULTIPLIERS[i + 1])
    return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts (lang, gram, n), merged until about a million distinct n-grams are held."""
    held: dict[str, tuple[list, list]] = {}
    waiting = 0

    def flush():
        for lang, (keys, counts) in held.items():
            all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": all_keys.view(np.int64), "n": n})
        held.clear()

    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            parts: list[np.ndarray] = []
            for text in rows["text"]:
                parts += grams(letter_codes(text or ""))
                if sum(map(len, parts)) > 4 * CHUNK:
                    _hold(held, lang, parts)
                    parts = []
            _hold(held, lang, parts)
        waiting = sum(len(k) for keys, _ in held.values() for k in keys)
        if waiting > 1_000_000:
            yield from flush()
    yield from flush()


def _hold(held: dict, lang: str, parts: list[np.ndarray]) -> None:
    if parts:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        keys, counts = held.setdefault(lang, ([], []))
        keys.append(key)
        counts.append(n)


class LanguageFilter:
    """A trained filter: languages (most training rows first), slots of masks and the fill of each language."""

    def __init__(self, langs: list[str], table: np.ndarray, hashes: int):
        self.langs, self.table, self.hashes = langs, table, hashes
        ones = [(table >> np.uint64(i) & np.uint64(1)).mean() if len(table) else 0.0 for i in range(len(langs))]
        self.false = np.array(ones) ** hashes

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share of all languages' corrected sums, and the share of the text's n-grams that it contains."""
        codes = letter_codes(text or "")
        if not self.langs or not (codes != 32).any():
            return "und", 0.0, 0.0
        hits, total = np.zeros(len(self.langs), np.int64), 0
        for key in grams(codes):
            mask = self.table[slots(key, 0, len(self.table))]
            for i in range(1, self.hashes):
                mask = mask & self.table[slots(key, i, len(self.table))]
            total += len(key)
            for i in range(len(self.langs)):
                hits[i] += int(np.count_nonzero(mask & np.uint64(1 << i)))
        true = np.maximum(0.0, (hits - total * self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0, float(min(1.0, true[best] / max(1, total)))


def train(rows: DataFrame, min_rate: float = 2e-6, ratio: float = 0.25, bits_per_key: int = 10, hashes: int = 2, max_slots: int = 1 << 22) -> LanguageFilter:
    """Fits the filter on rows (text, lang); null languages are left out. At most 64 languages."""
    rows = rows.select("text", "lang").where("lang IS NOT NULL")
    langs = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(65).collect()]
    if len(langs) > 64:
        raise ValueError("more than 64 languages")
    names = [x for x, _ in sorted(langs, key=lambda t: (-t[1], t[0]))]
    if not names:
        return LanguageFilter([], np.zeros(0, np.uint64), hashes)
    parts = rows.mapInPandas(_count_batches, "lang string, gram bigint, n bigint")
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))  # at most 64 entries
    totals = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rates = F.array(*[F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(0)) / F.lit(float(totals.get(x) or 1)) for x in names])
    rated = by_gram.select("gram", rates.alias("r")).select("gram", "r", F.array_max("r").alias("top")).where(F.col("top") >= min_rate)
    bit = lambda i: F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")
    mask = F.lit(0).cast("long")
    for i in range(len(names)):
        r = F.get("r", F.lit(i))
        mask = mask.bitwiseOR(F.when((r >= min_rate) & (r >= F.col("top") * ratio), bit(i)).otherwise(F.lit(0)).cast("long"))
    kept = rated.select("gram", mask.alias("mask")).toPandas()  # at most 64 / min_rate rows
    size = int(min(max_slots, max(1024, bits_per_key * len(kept))))
    slot_masks = np.zeros(size, np.uint64)
    key, masks = kept["gram"].to_numpy(np.int64).view(np.uint64), kept["mask"].to_numpy(np.int64).view(np.uint64)
    for i in range(hashes):
        np.bitwise_or.at(slot_masks, slots(key, i, size), masks)
    return LanguageFilter(names, slot_masks, hashes)


def predictor(model: LanguageFilter, spark: SparkSession):
    """Column function: text to struct (lang_pred, score, known). The filter is broadcast; max_slots bounds it."""
    shared = spark.sparkContext.broadcast((model.langs, model.table, model.hashes))

    @pandas_udf("struct<lang_pred: string, score: double, known: double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LanguageFilter(*shared.value)
        for texts in parts:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "known"])

    return run


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: a crc32 of doc_id that leaves no remainder 1 by 3 (rows without doc_id are left out)."""
    return docs.where(fold(F.col("doc_id"), 3) != 1)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), learned from the rows of the other two folds."""
    model = train(train_rows(docs), **options)
    pred = predictor(model, docs.sparkSession)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), pred(docs["text"]).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """Documents with a language: rejects texts without a letter, and those of whose n-grams the winner contains less than `least`.

    That share does not depend on how many languages there are, or how alike. Where no row has a
    language nothing can be judged, and texts with a letter stay.
    """
    model = train(train_rows(docs), **options)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    if not model.langs:
        return docs.select(row).where(F.coalesce(F.regexp_like(F.col("_row.text"), F.lit(r"\p{L}")), F.lit(False))).select("_row.*")
    judged = docs.select(row, predictor(model, docs.sparkSession)(docs["text"]).alias("_p"))
    kept = F.when((F.col("_p.lang_pred") != "und") & (F.col("_p.known") >= least), F.array("_row"))
    return judged.select(F.explode(kept).alias("_row")).select("_row.*")


@query("op2_language_bitmask")
def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
