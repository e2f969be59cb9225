"""Document fingerprints by one-permutation MinHash, with built-in functions only.

Every five-word shingle is hashed once; the high bits of a hash are its bin, the least
hash of a bin is its value. An empty bin borrows from a random filled one (optimal
densification): it tries bins in an order hashed from its own number, the same for every
document, and after `PROBES` misses takes the filled bin of least hash with its number,
so that the choice stays uniform and agrees between documents that fill the same bins. A
borrowed value is hashed with the bin's number, or its low bits would agree in all bins at once.
The low `BITS` bits of every bin are packed sixteen bins a long and written as hex. The
likeness of two fingerprints is the share c of equal bins, freed of chance agreement:
(c - 2^-BITS) / (1 - 2^-BITS), at least 0.

A text of fewer than five words is one shingle; texts without a word (null, empty,
blank) have the fingerprint of no shingle, all zeros, likeness 1 to each other and 0 to
all others. Repeated rows and equal doc_ids follow one another in order of their texts'
hash; rows without doc_id come last. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.common import query, table, words

BINS, BITS, SHINGLE, PROBES = 256, 4, 5, 16
WORDS = BINS * BITS // 64
PER = 64 // BITS


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(w: Column) -> Column:
    many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(w) >= SHINGLE, many).otherwise(few)


def _bin(x: Column) -> Column:
    """Bins 0.. in the signed order of the hashes."""
    return F.shiftright(x, 64 - (BINS.bit_length() - 1)).cast("int") + BINS // 2


def _bins(s: Column) -> Column:
    """Array of BINS values from the least hashes of the filled bins in order; null where a bin is empty."""
    empty = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    upto = F.transform(s, lambda x, k: F.concat(
        empty(_bin(x) - F.when(k > 0, _bin(F.get(s, k - 1))).otherwise(F.lit(-1)) - 1), F.array(x)))
    return F.concat(F.flatten(upto), empty(F.lit(BINS - 1) - _bin(F.element_at(s, -1))))


def _filled(s: Column, bins: Column) -> Column:
    def borrow(x: Column, i: Column) -> Column:
        probe = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), F.lit(None).cast("bigint"), lambda acc, a: F.coalesce(
            acc, F.get(bins, F.pmod(F.xxhash64(i, a), F.lit(BINS)).cast("int"))))
        least = F.array_min(F.transform(s, lambda y: F.struct(F.xxhash64(i, _bin(y)).alias("p"), y.alias("y"))))["y"]
        return F.coalesce(x, F.xxhash64(i, F.coalesce(probe, least)))

    return F.when(F.size(s) == BINS, bins).otherwise(F.transform(bins, borrow))


def _packed(values: Column) -> Column:
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.aggregate(
        F.slice(values, k * PER + 1, F.lit(PER)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(low(x))))


def fingerprint(text: Column) -> Column:
    """array<bigint> of packed bins; empty for a text without a word."""
    def first_of_bins(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, F.greatest(i - 1, F.lit(0))))))

    def of_bins(s: Column) -> Column:
        full = let(_bins(s), lambda bins: let(_filled(s, bins), _packed))
        return F.when(F.size(s) > 0, full).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), lambda w: let(F.sort_array(shingle_hashes(w)), lambda h: let(first_of_bins(h), of_bins)))


def as_hex(fp: Column) -> Column:
    full = F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.lower(F.when(F.size(fp) > 0, full).otherwise(F.lit("0" * (BINS * BITS // 4))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed fingerprints, from the number of equal bins."""
    ones = F.lit(int("1" * PER, 16) if BITS == 4 else 0)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0 ** -BITS
    value = F.greatest(F.lit(0.0), ((BINS - apart) / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(value)


def with_next(rows: DataFrame, fields: list[str], key: str, tie: str, per_bucket: int = 2000, most: int = 1000) -> DataFrame:
    """Adds next_<field> of the row after each row by descending key (after the last: the first).

    Rows are cut into ranges of the key at its quantiles; only a range is sorted in a
    task. The first row of every range also enters the range before it, so the rows
    themselves move once. Rows without a key form the last range.
    """
    k = F.col(key)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, [i / most for i in range(1, most)], 20 * most).alias("q")).first()
    if not stats.n:
        return rows.select("*", *[F.col(f).alias(f"next_{f}") for f in fields])
    ranges = max(1, min(most, stats.n // per_bucket))
    q = stats.q or []
    cuts = sorted({q[min(len(q) - 1, i * most // ranges)] for i in range(1, ranges)}) if q and ranges > 1 else []
    # range 0 holds the greatest keys
    place = F.when(k.isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c >= k)) if cuts else F.lit(0))
    ranked = rows.withColumn("_range", place.cast("int"))
    heads = {r["_range"]: (r["k"], r["t"]) for r in ranked.select("_range", key, tie).groupBy("_range").agg(
        F.max(key).alias("k"), F.min_by(tie, F.struct((-k).alias("k"), F.col(tie).alias("t"))).alias("t")).collect()}  # one row a range
    used = sorted(heads)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # the first range's head follows the last range
    is_head = F.lit(False)
    to = F.create_map(*[x for r in used for x in (F.lit(r), F.lit(before[r]))])
    head = F.create_map(*[x for r in used for x in (F.lit(r), F.struct(F.lit(heads[r][0]).cast("bigint").alias("k"), F.lit(heads[r][1]).cast("bigint").alias("t")))])
    mine = F.try_element_at(head, F.col("_range"))
    is_head = k.eqNullSafe(mine["k"]) & F.col(tie).eqNullSafe(mine["t"])
    at = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")))
    ghost = F.array(F.struct(F.try_element_at(to, F.col("_range")).alias("r"), F.lit(True).alias("ghost")))
    spread_rows = ranked.withColumn("_at", F.explode(F.when(is_head, F.concat(at, ghost)).otherwise(at)))
    w = Window.partitionBy("_at.r").orderBy(F.col("_at.ghost"), k.desc_nulls_last(), F.col(tie))
    out = spread_rows.select("*", *[F.lead(f).over(w).alias(f"next_{f}") for f in fields])
    return out.where(~F.col("_at.ghost")).drop("_at", "_range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("tie"))
    moved = with_next(base.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"], "doc_id", "tie")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    out = moved.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    out = out.withColumn("efp", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


@query("op3_oneperm_minhash")
def op3_oneperm_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
