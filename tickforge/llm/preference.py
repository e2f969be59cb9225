"""Preference formatting: common prompt and paired masked completions.

For a pair of conversations the longest common prefix of turns (equal role and text,
nulls equal to nulls) is rendered once as the prompt; the remaining turns of either side
are its completion. A mask names the character ranges, counted from the start of prompt
and completion together, that bear loss: texts and end marks of assistant turns after
the prompt.

Turns are gathered by conversation (a conversation is one record), pairs move by their
two keys, and no group of conversations is compared all against all.

Rows without conv_id belong to no conversation and are left out. Turns are ordered by
turn (nulls first), then role and text, so repeated rows are repeated turns. A null role
renders as `unknown`, a null text as nothing. Equal sides share all turns and have empty
completions. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import query, table
from tickforge.llm.fingerprint import let

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turns array<struct<role, text>>)."""
    one = F.struct("turn", "role", "text")
    got = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return got.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render_turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit(SHUT), F.coalesce(t["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, F.lit(1), n), lambda t, i: t.eqNullSafe(F.get(b, i)))
    return let(F.array_position(same, F.lit(False)), lambda p: F.when(p == 0, n.cast("bigint")).otherwise(p - 1)).cast("int")


def loss_spans(turns: Column, start: Column) -> Column:
    """Ranges of assistant texts with their end marks in the rendered turns, moved by start."""
    ends = F.aggregate(turns, F.array(start), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(render_turn(t)))))
    spans = let(ends, lambda e: F.transform(turns, lambda t, i: F.struct(
        t["role"].alias("role"), (F.get(e, i + 1) - F.length(F.coalesce(t["text"], F.lit(""))) - len(END)).alias("start"), F.get(e, i + 1).alias("stop"))))
    return F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds n_common, prompt, chosen, rejected, chosen_mask and rejected_mask to rows with arrays of turns `_chosen`, `_rejected`."""
    cut = pairs.withColumn("n_common", common_turns(F.col("_chosen"), F.col("_rejected")))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    out = cut.withColumn("prompt", render(F.slice("_chosen", F.lit(1), F.col("n_common"))))
    out = out.withColumn("_a", rest(F.col("_chosen"))).withColumn("_b", rest(F.col("_rejected")))
    start = F.length("prompt")
    return out.select(
        *[c for c in pairs.columns if c not in ("_chosen", "_rejected")], "n_common", "prompt", render(F.col("_a")).alias("chosen"),
        render(F.col("_b")).alias("rejected"), loss_spans(F.col("_a"), start).alias("chosen_mask"), loss_spans(F.col("_b"), start).alias("rejected_mask"))


def format_preferences(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Formats pairs (pair_id, chosen_id, rejected_id) of conversations; a side that does not exist has no turns."""
    got = conversations(rows)
    none = F.array().cast(got.schema["turns"].dataType)
    a = got.select(F.col("conv_id").alias("_ca"), F.col("turns").alias("_ta"))
    b = got.select(F.col("conv_id").alias("_cb"), F.col("turns").alias("_tb"))
    both = pairs.join(a, F.col("chosen_id") == F.col("_ca"), "left").join(b, F.col("rejected_id") == F.col("_cb"), "left")
    return format_pairs(both.select(
        "pair_id", "chosen_id", "rejected_id", F.coalesce("_ta", none).alias("_chosen"), F.coalesce("_tb", none).alias("_rejected")))


def reply_pairs(rows: DataFrame) -> DataFrame:
    """A pair for every conversation: its turns to the last reply, and the same with the last reply of its partner.

    The partner of conversation c is c + 1 for even and c - 1 for odd c; without one, or
    where it has no reply, the rejected reply is empty. A conversation without a reply is
    on both sides.
    """
    got = conversations(rows)
    last = F.coalesce(F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1))), F.lit(0))
    got = got.select("conv_id", "turns", last.alias("_last"))
    partner = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1)
    replies = got.where("_last > 0").select(partner.alias("_to"), F.get("turns", F.col("_last") - 1)["text"].alias("_reply"))
    both = got.join(replies, F.col("conv_id") == F.col("_to"), "left")
    chosen = F.when(F.col("_last") > 0, F.slice("turns", F.lit(1), F.col("_last"))).otherwise(F.col("turns"))
    other = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("_reply", F.lit("")).alias("text")))
    rejected = F.when(F.col("_last") > 0, F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("_last") - 1, F.lit(0))), other)).otherwise(F.col("turns"))
    return both.select("conv_id", F.size("turns").alias("n_turns"), chosen.alias("_chosen"), rejected.alias("_rejected"))


SQL = r"""
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, ts, coalesce(list_max(list_filter(range(1, len(ts) + 1), lambda i: ts[i].role = 'assistant')), 0) AS k FROM c),
p AS (SELECT l.*, r.ts[r.k].text AS reply FROM l LEFT JOIN l r ON r.k > 0 AND r.conv_id = CASE WHEN l.conv_id % 2 = 0 THEN l.conv_id + 1 ELSE l.conv_id - 1 END),
s AS (SELECT conv_id, len(ts) AS n_turns, CASE WHEN k > 0 THEN ts[1:k] ELSE ts END AS a,
  CASE WHEN k > 0 THEN list_concat(CASE WHEN k > 1 THEN ts[1:k-1] ELSE [] END, [{'role': 'assistant', 'text': coalesce(reply, '')}]) ELSE ts END AS b FROM p),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS m FROM s),
x AS (SELECT conv_id, n_turns, m, list_transform(a, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS ra,
  list_transform(b, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)) AS rb, a, b FROM n),
y AS (SELECT conv_id, n_turns, m, coalesce(array_to_string(list_filter(ra, lambda t, i: i <= m), ''), '') AS prompt,
  coalesce(array_to_string(list_filter(ra, lambda t, i: i > m), ''), '') AS chosen, coalesce(array_to_string(list_filter(rb, lambda t, i: i > m), ''), '') AS rejected,
  coalesce(list_sum(list_transform(list_filter(a, lambda t, i: i > m AND t.role = 'assistant'), lambda t: length(coalesce(t.text, '')) + 8)), 0) AS ca,
  coalesce(list_sum(list_transform(list_filter(b, lambda t, i: i > m AND t.role = 'assistant'), lambda t: length(coalesce(t.text, '')) + 8)), 0) AS cb FROM x)
SELECT conv_id, n_turns::INTEGER AS n_turns, m::INTEGER AS n_common, prompt, chosen, rejected, ca::BIGINT AS chosen_loss_chars, cb::BIGINT AS rejected_loss_chars FROM y
"""


@query("op5_preference_format", SQL)
def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(reply_pairs(table(spark, sf_dir, "conversations")))
    chars = lambda m: F.aggregate(m, F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select("conv_id", "n_turns", "n_common", "prompt", "chosen", "rejected",
                      chars("chosen_mask").alias("chosen_loss_chars"), chars("rejected_mask").alias("rejected_loss_chars"))
