"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the measurements and one
long of failure bits. Everything after that works on the bits: a policy is a version
name with a mask of the rules it enforces, a document is kept when none of the masked
bits is set, and ablations (what a policy would let pass without one of its rules)
are bitwise aggregates over the distinct bit patterns, of which there are at most
2^rules.

Null texts count as empty: no words, rejected by the first rule. Repeated rows are
judged one by one. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import SPACE_CHARS, query, table, words

SYMBOLS = "#*$%&|<>"

#: Rules by bit. Each is true where a document fails.
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("upper_case", "10 * n_upper > 3 * word_chars"),
    ("exclamation", "10 * n_exclaim > 3 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("stutter", "20 * n_same_next > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that each version enforces.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "upper_case"],
    "v2": [name for name, _ in RULES],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_same_next"]


def mask(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def _repeat_words(w: str, n: int = 3) -> list[tuple[str, Column]]:
    """Columns, in order, that end in n_repeat_words: words in n-word windows found twice or more.

    Windows are hashed and sorted as one long each, hash in the high bits and position in
    as many low bits as the text needs; equal neighbours are confirmed by the full hash.
    """
    get = lambda a, i: F.get(F.col(a), i)
    m = F.size(w) - (n - 1)
    h = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.xxhash64(*[get(w, i + k) for k in range(n)]))).otherwise(
        F.array().cast("array<bigint>"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("_h").cast("long")))) - 1
    packed = F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long"))))
    at = F.transform("_s", lambda x: x.bitwiseAND(F.col("_low")).cast("int"))
    same = lambda i, j: F.coalesce(get("_h", get("_at", i)) == F.when(j >= 0, get("_h", get("_at", j))), F.lit(False))
    twice = F.sort_array(F.filter("_at", lambda p, i: same(i, i - 1) | same(i, i + 1)))
    gaps = F.transform("_p", lambda x, i: F.coalesce(F.least(F.lit(n), get("_p", i + 1) - x), F.lit(n)))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return [("_h", h), ("_low", low), ("_s", packed), ("_at", at), ("_p", twice), ("n_repeat_words", total)]


def _measured(docs: DataFrame, carry: Column) -> DataFrame:
    """Measurements and fail_bits beside the carried column `_row`."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    df = docs.select(carry.alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    df = df.select("_row", "_text", words(text).alias("_w"), lines.alias("_lines"))
    df = df.select(
        "_row", "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclaim"),
        F.size(F.filter("_w", lambda x, i: x == F.when(i > 0, F.get("_w", i - 1)))).cast("long").alias("n_same_next"))
    for name, col in _repeat_words("_w"):
        df = df.withColumn(name, col)
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        failed = F.expr(rule) if isinstance(rule, str) else rule
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long"))
    # a generator keeps later filters on the results above the measurements; pushed below them,
    # they would take along every expression they rest on, many times over
    return df.select(F.explode(F.array(F.struct("_row", *MEASURES, bits.alias("fail_bits")))).alias("_one")).select("_one.*")


def ledger(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, measurements..., fail_bits), one per row of docs."""
    return _measured(docs, F.col("doc_id")).withColumnRenamed("_row", "doc_id")


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds `policy` and `kept` to ledger rows, from the bits alone."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that stay without it."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    one = lambda name: F.lit(1 << BIT[name])
    out = patterns.select("n", bits.alias("b"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), one(name).cast("long").alias("bit")) for name in POLICIES[policy]])).alias("r"))
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    return out.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(F.col("b").bitwiseAND(F.bitwise_not("r.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"))


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """Rows of docs that the policy keeps, with all their columns whatever their names."""
    rows = _measured(docs, F.struct(*[docs[c] for c in docs.columns]))
    return rows.where(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0).select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
two AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM two) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines, len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_same_next
  FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_upper > 3 * word_chars THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_exclaim > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
  + CASE WHEN 20 * n_same_next > n_words THEN 64 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT *, 'v2' AS policy, fail_bits = 0 AS kept, fail_bits & 3 <> 0 AS base_failed FROM b
"""


@query("op4_rule_ledger", SQL)
def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), "v2")
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0)
