"""Importance resampling against a brute-force version: nulls, ties, repeated rows, any bracket."""

import hashlib
import math
import re
import zlib

import pytest

from tickforge.llm import importance

SCHEMA = "doc_id long, text string, score int, rank string, b int"
BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    w = [x for x in BREAK.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return w, [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, percent, least, longest=1, buckets=10_000):
    slot = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for g in grams(text, longest)[1]:
            s[slot(g)] += 1
    for text in target:
        for g in grams(text, longest)[1]:
            t[slot(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        w, g = grams(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[slot(x)] for x in g)
        out.append((doc_id, len(g), len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return out, [(i + 1, r[0], r[4]) for i, r in enumerate(drawn)]


ROWS = [(i % 40 if i % 9 else None, " ".join(f"w{(i * j) % 23}" for j in range(i % 30))) for i in range(300)] + \
    [(7, "Same TEXT again, same text again")] * 120 + [(None, "no id at all here")] * 60 + [(900, None), (901, ""), (902, "\x00 \n"), (903, "Größe ﬁ 日本 x-y_z")]
TARGET = ["w1 w2 w3 same text", "w5 w7", None, ""]


@pytest.mark.parametrize("percent, longest, margin", [(10, 1, 2e-4), (50, 1, 1e-9), (100, 2, 2e-4), (37, 2, 0.4), (0, 1, 2e-4)])
def test_draw(spark, percent, longest, margin):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(df, target, percent, 3, longest, margin=margin).collect()
    scored, drawn = brute(ROWS, TARGET, percent, 3, longest)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(((r[0], r[1], r[3], r[4]) for r in scored), key=key)
    assert sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None) == drawn


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(none, target).count() == 0
    some = spark.createDataFrame([(i, "word " * 25, 0, "", 0) for i in range(30)], SCHEMA)
    got = importance.resample(some, target.where("false")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 30
