"""Resampling of documents towards a target text: hashed word features, gains per bucket, and a drawn share of the best scores.

Features (runs of ASCII-lowered words) fall into `buckets` by CRC-32. A bucket's gain is
the floored, scaled log ratio of its smoothed shares in target and source; the gains are
one array of `buckets` longs, the only thing that reaches the driver or a plan literal, and
a document's weight is the sum of the gains at its features. A hashed Gumbel term of the
doc_id is added, so that the documents of highest score are a draw without replacement.

The cut is found without sorting the corpus. A quantile sketch gives a bracket of scores
around it; one exact count of the rows above and inside validates the bracket, or widens
it until it holds the cut; only the bracket is then sorted and ranked. The drawn rows are
numbered by a range partitioning of the whole sort key (score, doc_id, row): equal scores
and repeated ids are cut like any others, and what is added up is one count a partition.

Null texts and texts without a word have no feature and weight 0. A null doc_id is hashed
as an empty string and comes last among equal scores; repeated rows score alike and rank one
by one. Very long texts are one array of words in one row. Empty tables: an empty result, and
gains from the smoothing alone if the target is empty. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.common import lower_ascii, materialize, query, table

#: All ASCII characters but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_BUCKETS = 1 << 20
#: Relative error of the quantile sketch, and the first half-width of the bracket in shares of the rows.
ACCURACY, MARGIN = 10_000, 2e-4


def feature_list(text: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, joined by a space, repeats included."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), "")
    if longest == 1:
        return words

    def runs(w: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<string>"))

    def of_words(w: Column) -> Column:
        return F.concat(w, *[runs(w, n) for n in range(2, longest + 1)])
    return F.get(F.transform(F.array(words), of_words), 0)


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Rows (b, n): occurrences of features of `text` per bucket."""
    words = texts.select(F.explode(feature_list(F.col("text"), longest)).alias("w"))
    return words.groupBy(bucket(F.col("w"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> list[int]:
    """Gain of every bucket, at most MOST_BUCKETS of them."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    empty = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    source = bucket_counts(docs, longest, buckets).select("b", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, longest, buckets).select("b", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = empty.union(source).union(wanted).groupBy("b").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = both.crossJoin(total).select("b", F.floor(1000 * F.log(ratio)).alias("g")).collect()
    out = [0] * buckets
    for r in rows:
        out[r.b] = int(r.g)
    return out


def scored(docs: DataFrame, gain: list[int], longest: int = 1, seed: int = 2024) -> DataFrame:
    """Rows (doc_id, n_features, n_words, weight, score)."""
    values = F.from_json(F.lit("[" + ",".join(map(str, gain)) + "]"), "array<bigint>")
    zero = F.lit(0).cast("bigint")
    words = feature_list(F.col("text"), longest)
    single = words if longest == 1 else feature_list(F.col("text"), 1)
    rows = docs.select("doc_id", F.size(words).cast("long").alias("n_features"), F.size(single).cast("long").alias("n_words"), F.aggregate(
        words, zero, lambda acc, w: acc + F.get(values, bucket(w, len(gain)))).alias("weight"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the rank from 1 in a total order: one range partitioning, places within partitions, and the partitions' counts added up."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(spread.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, part == before["_p"]).select(*rows.columns, (place + F.col("_before") + 1).cast("long").alias(name))


def bracket(rows: DataFrame, n: int, k: int, margin: float = MARGIN) -> tuple[int | None, int | None, int]:
    """(low, high, rows above high): scores that enclose the k-th highest of n; None is an open end."""
    while True:
        at = [max(0.0, 1 - k / n - margin), min(1.0, 1 - k / n + margin)]
        low, high = rows.agg(F.percentile_approx("score", at, ACCURACY)).first()[0]
        low, high = (None if at[0] == 0.0 else low), (None if at[1] == 1.0 else high)
        over = F.lit(False) if high is None else F.col("score") > high
        under = F.lit(False) if low is None else F.col("score") < low
        above, inside = rows.agg(F.count_if(over), F.count_if(~over & ~under)).first()
        if above < k <= above + inside:
            return low, high, above
        margin *= 8


def drawn(rows: DataFrame, k: int, margin: float = MARGIN) -> DataFrame:
    """The k rows of highest score, ties to the smaller doc_id, with their rank. Rows must have a distinct `_row`."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    if k <= 0:
        return rows.where("false").withColumn("rank", F.lit(0).cast("long"))
    low, high, above = bracket(rows, rows.count(), k, margin)
    # only the bracket is sorted to find the last row drawn
    inside = rows.where(F.lit(True) if low is None else F.col("score") >= low).where(F.lit(True) if high is None else F.col("score") <= high)
    last = numbered(inside, order, "_place").where(F.col("_place") == k - above).first()
    same = F.col("score") == last["score"]
    if last["doc_id"] is None:
        upto = F.col("doc_id").isNotNull() | (F.col("_row") <= last["_row"])
    else:
        upto = (F.col("doc_id") < last["doc_id"]) | ((F.col("doc_id") == last["doc_id"]) & (F.col("_row") <= last["_row"]))
    return numbered(rows.where((F.col("score") > last["score"]) | (same & upto)), order, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1,
             buckets: int = 10_000, seed: int = 2024, margin: float = MARGIN) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one per row of docs; rank is null for rows not drawn."""
    gain = gains(docs, target, longest, buckets)
    rows = materialize(scored(docs, gain, longest, seed).withColumn("_row", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    picked = drawn(able, k, margin).select(F.col("_row").alias("_picked"), "rank")
    return rows.join(picked, F.col("_row") == F.col("_picked"), "left").select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), qw AS (SELECT unnest(ws) AS w FROM q),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
f AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2),
      lambda p: (16 * (instr('0123456789ABCDEF', h[p]) - 1) + instr('0123456789ABCDEF', h[p + 1]) - 1)::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS k FROM v, tab),
s AS (SELECT k, count(*) AS n FROM dw JOIN f USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM qw JOIN f USING (w) GROUP BY k),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS alls, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS allt),
g AS (SELECT i AS k, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (alls + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (allt + 10000))))::BIGINT AS gain
  FROM range(10000) x(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i, al),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN f USING (w) JOIN g USING (k) GROUP BY r),
z AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN w ON w.r = d.r),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM z LEFT JOIN p USING (r)
"""


@query("op11_importance_bracket", SQL)
def op11_importance_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
