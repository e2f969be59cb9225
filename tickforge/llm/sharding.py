"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Law kept: `rows` (shard counts at most one apart). Documents start spread evenly, by
rank. Each round joins every linked document with the shards of its neighbours (the
documents of its hub), takes the shard most of them are in as its wish, and lets pairs
of shards exchange equally many documents: the best movers of one side against the
best movers of the other, filled up with unlinked documents and then with linked ones
whose cut is less than what the movers gain, so counts never change.

Hot hubs: neighbours are counted per (hub, shard) before anything is joined, ranks are
taken in buckets (`with_offsets`), and quotas are 8 x 8 numbers. Every other round no
shard that a single group fills is wished for, so that a group larger than a shard goes
on to fill a second one when its first is full.

Null texts have size 1, checksum 0 and are equal to empty texts. Rows with equal or
missing doc_id are placed one by one. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import materialize, query, spread, table, with_offsets


def _exchanged(there: list[tuple[int, int]], back: list[tuple[int, int]]) -> int:
    """Number of pairs, the best of both sides first, that keep more links than they cut; sides are (gain class, rows)."""
    sides, n = [sorted(there, reverse=True), sorted(back, reverse=True)], 0
    while sides[0] and sides[1]:
        (g, x), (h, y) = sides[0][0], sides[1][0]
        # a class is the least gain or the most loss of its rows
        if sum((1 << k) - 1 if k >= 0 else 1 - (1 << -k) for k in (g, h)) <= 0:
            break
        m = min(x, y)
        n += m
        for side, k, left in ((sides[0], g, x - m), (sides[1], h, y - m)):
            side[:1] = [(k, left)] if left else []
    return n


def propagate(rows: DataFrame, n: int, shards: int = 8, rounds: int = 12) -> DataFrame:
    """Adds `shard` to rows (v: 0..n-1 without gaps, hub: null for unlinked rows; other columns are kept)."""
    names = rows.columns
    state = materialize(rows.withColumn("shard", (F.col("v") % shards).cast("int")))
    still = 0
    for r in range(rounds):
        held = state.where("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("c"))
        most = {x["shard"]: x["c"] for x in held.groupBy("shard").agg(F.max("c").alias("c")).collect()}  # at most shards rows
        full = [s for s, c in most.items() if c == (n - s + shards - 1) // shards]
        open_to = ~F.col("shard").isin(full) if r % 2 and full else F.lit(True)
        wish = held.groupBy("hub").agg(
            F.max(F.struct(open_to.alias("open"), "c", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("best"),
            F.map_from_entries(F.collect_list(F.struct("shard", "c"))).alias("by"))  # one entry for each shard
        wish = wish.where(F.size("by") > 1).select(F.col("hub").alias("_hub"), F.col("best.shard").alias("home"), F.col("best.c").alias("most"), "by")
        linked = state.where("hub IS NOT NULL").join(wish, F.col("hub") == F.col("_hub"))
        movers = linked.where((F.col("home") != F.col("shard")) & (F.element_at("by", F.col("shard")) <= F.col("most"))).select(
            *names, "shard", F.col("home").alias("to"), F.least(F.lit(62), F.log2((F.col("most") - F.element_at("by", F.col("shard")) + 2).cast("double")).cast("int")).alias("gain"))
        partner = (F.col("shard") + 1 + F.pmod(F.xxhash64(F.lit(r), "v"), F.lit(shards - 1)).cast("int")) % shards
        # rows without a wish may give way: unlinked ones at no loss, linked ones at the links they would cut
        by = held.groupBy(F.col("hub").alias("_hub")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "c"))).alias("by"))
        stay = state.join(movers.select(F.col("v").alias("_v")), F.col("v") == F.col("_v"), "left_anti").withColumn("to", partner).join(by, F.col("hub") == F.col("_hub"), "left")
        loss = F.coalesce(F.try_element_at("by", F.col("shard")) - 1 - F.coalesce(F.try_element_at("by", F.col("to")), F.lit(0)), F.lit(0))
        fill = stay.select("v", "shard", "to", F.when(loss > 0, -1 - F.log2(loss.cast("double")).cast("int")).otherwise(0).alias("gain"))
        moves = materialize(movers.select("v", "shard", "to", "gain").union(fill))
        cells: dict[tuple[int, int], list] = {}
        for x in moves.groupBy("shard", "to", "gain").agg(F.count(F.lit(1)).alias("n")).collect():  # shards^2 rows for each of some 60 gains
            cells.setdefault((x["shard"], x["to"]), []).append((x["gain"], x["n"]))
        quota = [0] * (shards * shards)
        for (a, b), there in cells.items():
            quota[a * shards + b] = _exchanged(there, cells.get((b, a), []))
        still = 0 if any(quota) else still + 1
        if still == 2:
            break
        if still:
            continue
        # movers of high gain first, then unlinked rows, then linked ones by loss; within a gain at random
        order = (F.lit(62) - F.col("gain")).cast("long") * F.lit(1 << 55) + F.shiftright(spread(F.lit(r), "v"), 7)
        ranked = with_offsets(moves, ["shard", "to"], F.shiftright(order, 0), ["v"], "rank", n * 8)
        go = ranked.where(F.col("rank") < F.get(F.lit(quota), F.col("shard") * shards + F.col("to"))).select(F.col("v").alias("_v"), "to")
        state = materialize(state.join(go, F.col("v") == F.col("_v"), "left").select(
            *names, F.coalesce("to", "shard").alias("shard")))
    return state


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 12) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per row of docs."""
    text: Column = F.coalesce(docs["text"], F.lit(""))
    base = materialize(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("group"), text).alias("g2")))
    n = base.count()
    ranked = with_offsets(base, [], spread("doc_id", "g1"), ["doc_id", "size"], "v", n) if n else base.withColumn("v", F.lit(0).cast("long"))
    ranked = materialize(ranked)
    hubs = ranked.groupBy("g1", "g2", "size").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select(
        F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), F.col("size").alias("_size"), "hub")
    linked = ranked.join(hubs, (F.col("g1") == F.col("_g1")) & (F.col("g2") == F.col("_g2")) & (F.col("size") == F.col("_size")), "left")
    placed = propagate(linked.select("doc_id", "size", "text_crc32", "v", "hub"), n, shards, rounds)
    slots = with_offsets(placed, ["shard"], spread("hub", "v"), ["v"], "slot", n) if n else placed.withColumn("slot", F.lit(0).cast("long"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_label_shards")
def op7_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
