"""First breaks and chains across blocks against row-by-row rules."""

import random

import pytest
from pyspark.sql import functions as F

from tickforge.operators import backtest as BT
from tickforge.operators import decision as D
from tickforge.operators.ahead import first_ahead, follow


def kept_by_rule(rows, gap=30.0, move=0.5, band=1.0):
    last, out = None, []
    for r in rows:
        ok = last is None or not (r[1] - last[1] < gap or (r[2:4] == last[2:4] and abs(r[4] - last[4]) < move * r[5] and abs(r[6] - last[6]) <= band))
        out.append(ok)
        last = r if ok else last
    return out


@pytest.mark.parametrize("calm, block_rows", [(True, 16), (False, 16), (False, 4096)])
def test_same_idea_follows_the_rule_across_blocks(spark, calm, block_rows):
    """calm: one state and hardly a move for a whole series, so a signal is compared with one hundreds of blocks before."""
    rnd = random.Random(3)
    rows, t, px = [], 0, 100.0
    for i in range(1500):
        t += rnd.choice([5, 20, 60, 3600])
        px += rnd.gauss(0, 0.002 if calm else 0.3)
        rows.append(("a", t, 1.0 if calm else float(rnd.random() < 0.9), "UP" if calm else rnd.choice(["UP", "UP", "DOWN"]), px, 1.0, 2.0 + rnd.random()))
    rows.append(("b", 5, 1.0, "UP", 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "sym string, s long, direction double, regime string, px double, atr double, tp_dist double")
    got = D.same_idea(df.withColumn("time", F.timestamp_seconds("s")), block_rows=block_rows).orderBy("sym", "s").collect()
    want = kept_by_rule(rows[:1500]) + [True]
    assert [r.kept for r in got] == want and (sum(want) < 40) == calm


def test_breaks_and_chains_over_several_levels(spark):
    """Blocks of two rows make a pyramid of three levels; a third of the queries wait for the last row."""
    rnd = random.Random(7)
    h = [rnd.random() for _ in range(4500)] + [5.0]
    rows = [("a", i, x, (2.0 if i % 3 == 0 else x + 0.0005) if i % 5 else None) for i, x in enumerate(h)] + [("b", 0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "sym string, n long, h double, lim double")
    out = first_ahead(df, ["sym"], "n", [F.col("h")], [F.col("lim")], block_rows=2)
    got = {(r.sym, r.n): r.ahead for r in out.collect()}
    assert len(got) == len(rows) and got["b", 0] is None
    ahead, stack = {}, []
    for i in range(len(h) - 1, -1, -1):  # nearest later row of at least the limit, from a falling stack
        while stack and h[stack[-1]] <= h[i]:
            stack.pop()
        stack.append(i)
    for _, i, x, lim in rows[:-1]:
        if lim is not None and (i < 60 or i % 97 == 0):
            ahead[i] = next((j for j in range(i + 1, len(h)) if h[j] >= lim), None)
    assert all(got["a", i] == j for i, j in ahead.items()) and all(got["a", i] is None for i in range(0, 4500, 5))
    steps = df.select("sym", "n", F.when(F.col("n") % 7 == 3, F.col("n") + 1000).when(F.col("sym") == "a", F.col("n") + 1).alias("to"))
    met = {r.n for r in follow(steps, ["sym"], "n", "to", block_rows=4).where("sym = 'a'").collect()}
    want, i = set(), 0
    while i <= 4500:
        want.add(i)
        i += 1000 if i % 7 == 3 else 1
    assert met == want


def test_exit_ahead_and_one_position(spark):
    rnd = random.Random(5)
    px, rows = 100.0, []
    for i in range(2000):
        px += rnd.gauss(0, 0.2)
        rows.append(("a", 0, i, px, px + abs(rnd.gauss(0, 0.2)), px - abs(rnd.gauss(0, 0.2)), None if i % 4 == 3 else float(i % 2)))
    df = spark.createDataFrame(rows, "sym string, period_id long, rn long, close double, high double, low double, side double")
    sell = F.col("side") < 0.5
    wide = F.when(F.col("rn") % 10 == 0, 8.0).otherwise(1.0)
    levels = {"direction": F.col("side"), "entry": F.col("close"), "sl": F.col("close") + F.when(sell, wide).otherwise(-wide),
              "tp": F.col("close") + F.when(sell, -wide).otherwise(wide)}
    for tie in ("SL", "TP"):
        trades = BT.exit_ahead(df, levels, tie, block_rows=32)
        got = {r.rn: (r.kind, r.exit_rn) for r in trades.collect()}
        want = {}
        for _, _, i, c, _, _, side in rows:
            if side is None:
                continue
            w = 8.0 if i % 10 == 0 else 1.0
            sl, tp = (c + w, c - w) if side < 0.5 else (c - w, c + w)
            want[i] = ("OPEN", None)
            for _, _, j, _, hi, lo, _ in rows[i + 1:]:
                a, b = (hi >= sl, lo <= tp) if side < 0.5 else (lo <= sl, hi >= tp)
                if a or b:
                    want[i] = (("SL" if a and (tie == "SL" or not b) else "TP"), j)
                    break
        assert got == want and len({k for k, _ in got.values()}) == 3
    run, i = [], 0
    while i < 2000:
        if i in want:
            run.append(i)
            if want[i][1] is None:
                break
            i = want[i][1] + 1
        else:
            i += 1
    assert sorted(r.rn for r in BT.one_position(df, trades, block_rows=32).collect()) == run
