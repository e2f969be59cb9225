"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.check import compare, oracle
from tests.conftest import SF
from tickforge.llm import (bpe, catalog, fingerprint, golay, language, lm_score, mixing, near_dedup, preference, quality,
                           sharding, similar, url_filter)
from tickforge.llm.common import components, materialize, with_offsets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", None, 3), (5, "one", "en", "b", 3),
    (5, "one", "en", "b", 3), (None, "no id here", "de", "b", 10), (6, LONG, "en", "a", len(LONG)), (7, LONG, None, "b", len(LONG)),
    (8, "Größe и мир 日本 🙂 " * 30, "xx", "é", None), (9, "a b c d e f g", "en", "a", 13), (10, "12 34 !!! 56", None, "z", 12)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).withColumns({"shard": F.lit(1), "fp": F.lit("x"), "size": F.lit(2), "component_id": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF).toPandas(), oracle(SF, catalog.ORACLE[name])) == ""


def test_golay_indices_meet():
    x = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    near = golay.indices(x)
    for i in range(23):
        for j in range(i, 23):
            other = golay.indices(x ^ ((1 << i) | (1 << j)))
            assert ((near[:, :, None] == other[:, None, :]) & (near[:, :, None] >= 0)).any((1, 2)).all()


def brute_simhash(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                if a != b:
                    root = {k: (min(a, b) if v in (a, b) else v) for k, v in root.items()}
    return root


def test_near_duplicates_match_brute_force(spark, docs):
    got = near_dedup.near_duplicates(docs).toPandas()
    want = {i: brute_simhash(t) for i, t in texts(docs).items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got.itertuples()} == want
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(want)


@pytest.mark.parametrize("group_rows", [2048, 3])
def test_links_keep_every_connection(spark, group_rows):
    rnd = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(15):
            fps.add(x)
            x ^= 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(near_dedup.links(df, 2, group_rows)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for x in signed:
        groups[roots.get(x, x)].add(x)
    for x, r in brute_components({x: x & (1 << 64) - 1 for x in signed}).items():
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    got = components(spark.range(300).selectExpr("id a", "id + 1 b")).toPandas()
    assert len(got) == 301 and got.root.nunique() == 1
    assert components(spark.range(0).selectExpr("id a", "id b")).count() == 0


def test_offsets_are_exact(spark):
    df = spark.range(5000).selectExpr("id % 3 k", "id v", "cast(id % 7 as long) size")
    got = with_offsets(df, ["k"], (F.col("v") * 7919 % 5003) * (1 << 49), ["v"], "r", 5000, ("size", "s"), rows=64).toPandas()
    got["o"] = got.v * 7919 % 5003
    for _, g in got.groupby("k"):
        g = g.sort_values("o")
        assert list(g.r) == list(range(len(g))) and list(g.s) == [0, *g["size"].cumsum()[:-1]]


def test_near_duplicate_edges(spark, edge, empty):
    got = near_dedup.near_duplicates(edge).toPandas()
    assert len(got) == len(EDGE)
    zero = got[got.fingerprint == "0" * 16]
    assert set(zero.doc_id) == {1, 2, 3} and set(zero.component_id) == {1}
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_first(edge)
    assert kept.columns == edge.columns
    assert kept.where("doc_id in (2, 3, 5, 7)").count() == 0 and kept.where("doc_id is null").count() == 1


def tokenizer():
    ranks = bpe.read_ranks(P.path(bpe.RANK_FILE))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", None, " ", "  a", "a  b\n\n c\t", "don't I'll we've X'S", "\x1c\x1d a\x85b\u00a0c\u2003d\u3000", "日本語テキスト " * 20, "a" * 300, "ab" * 3000,
        "é" * 100, "🙂🙂‍👩🏽‍🚀 ok", "١٢٣ ½ Ⅷ x²", "<|endoftext|> #$%&", "x" * 63 + " " + "y" * 64 + " " + "z" * 65]


def test_bpe_matches_tiktoken(spark):
    rnd = random.Random(3)
    hard = HARD + ["".join(rnd.choice("ab \n'éß日1$ \u0301") for _ in range(rnd.randint(0, 120))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    enc = tokenizer()
    for r in bpe.encode_documents(df, chunk_chars=3000, keep_ids=True).collect():
        text = hard[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_numbers_start_anew(spark):
    """Few pieces held at a time, a run a text or several: equal to tiktoken, and nothing is exchanged or written between."""
    rnd = random.Random(4)
    texts_ = [" ".join(rnd.choice(["the", "anon", "x" * 70, "zé日", "q7"]) + str(rnd.randrange(40)) for _ in range(30)) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").coalesce(2)
    enc = tokenizer()
    for chars, most in ((1, 1), (500, 20), (1 << 20, 1 << 19)):
        out = bpe.encode_documents(df, chunk_chars=chars, keep_ids=True, most_pieces=most)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts_)}


def test_bpe_folds_cuts_of_pieces_in_rank_order(spark):
    """The fold over cuts equals the heap, also with a token that lower merges don't lead to, whose pieces go to the heap."""
    rnd = random.Random(8)
    own = bpe.read_ranks(P.path(bpe.RANK_FILE))
    odd = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"dd": 259, b"abcdd": 260}
    for ranks, n_odd in ((own, 0), (odd, 2)):
        tokens = bpe.by_length(ranks)
        marked = bpe.odd_ranks(ranks, tokens)
        assert len(marked) == n_odd
        pieces = [b"".join(rnd.choice(list(ranks)[-400:] + [b"abc", b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(1, 8))) for _ in range(400)]
        merges = bpe.ranked_merges(pieces, (ranks, tokens, marked))
        df = spark.createDataFrame(list(enumerate(merges.to_pylist())), "i int, merges array<bigint>")
        cuts = [r.cuts for r in df.select("i", bpe.encode_piece(F.col("merges")).alias("cuts")).orderBy("i").collect()]
        assert [c is None for c in cuts] == [len(p) > bpe.LONG or (n_odd and b"abc" in p) for p in pieces]
        for p, c in zip(pieces, cuts):
            if c is not None:
                at = [i for i in range(len(p)) if c >> i & 1] + [len(p)]
                assert [ranks[p[a:b]] for a, b in zip(at, at[1:])] == bpe.merge_long(p, ranks)


def test_bpe_edges(edge, empty):
    assert bpe.encode_documents(edge).count() == len(EDGE) and bpe.encode_documents(empty).count() == 0


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_estimate_similarity(spark, docs):
    got = fingerprint.fingerprints(docs).toPandas().set_index("doc_id")
    t = texts(docs)
    ids = sorted(t, reverse=True)
    off = []
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        half = len(t[i]) // 2
        edited = t[i][:len(t[i]) - half] + t[nxt][:half]
        r = got.loc[i]
        assert r.n_chars == len(t[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, est in ((t[i], edited, r.near_edited), (t[i], t[nxt], r.near_next)):
            a, b = shingles(a), shingles(b)
            off.append(est - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.sqrt(np.mean(np.square(off))) < 0.05 and abs(np.mean(off)) < 0.01
    same = defaultdict(set)
    for i in ids:
        same[t[i]].add(got.loc[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprint_edges(spark, edge, empty):
    got = fingerprint.fingerprints(edge).toPandas()
    assert len(got) == len(EDGE) and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert fingerprint.fingerprints(empty).count() == 0
    # ranges of two rows each give the same neighbours as one range
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(40)], "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, ["text"], "doc_id", "tie", per_bucket=2).collect()}
    assert got == {i * i: f"t{(i - 1) % 40}" for i in range(40)}


def brute_repeats(text):
    w = WORD.findall(text)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    return len({j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)})


def test_quality_ledger(spark, edge, empty):
    rnd = random.Random(2)
    rows = [(100 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60))), "en", "s", 0) for i in range(60)]
    df = edge.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).union(spark.createDataFrame(rows, DOCS))
    got = quality.ledger(df).toPandas()
    t = texts(df)
    for r in got.dropna(subset=["doc_id"]).itertuples():
        assert r.n_repeat_words == brute_repeats(t[r.doc_id]) and r.n_words == len(WORD.findall(t[r.doc_id]))
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(edge).columns == edge.columns
    table = {r.rule: r for r in quality.ablations(quality.ledger(df), "base").collect()}
    bits = got.fail_bits & quality.mask("base")
    assert table["few_words"].failed == (bits & 1 > 0).sum() and table["few_words"].kept_without == (bits & ~1 == 0).sum()
    assert table["repeated_words"].only_this == (bits == 2).sum()


def test_quality_keeps_labelled_documents(spark):
    sf = SF.replace("0.001", "0.01")
    kept = quality.apply_policy(quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")), "v2")
    both = kept.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50").toPandas()
    assert both[both.quality == 1].kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.1


def test_language_held_out_accuracy(spark, docs, edge, empty):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    out = {r.doc_id: r for r in language.identify(edge).collect()}
    assert {out[i].lang_pred for i in (1, 2, 3, 10)} == {"und"} and len(out) == len({e[0] for e in EDGE})
    assert language.identify(empty).count() == 0
    assert language.keep_identified(edge).columns == edge.columns


def test_language_rule_does_not_depend_on_the_number_of_languages(spark, docs):
    """Sixteen languages, four alike each, and none at all: texts stay; other scripts and noise go."""
    many = docs.withColumn("lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 4).cast("string")))
    odd = spark.createDataFrame([(-1, "zxq kjw vvpq xzzk qqwj " * 9, None, "a", 1), (-2, "привет мир как дела", None, "a", 1), (-3, "12 34", None, "a", 1)], DOCS)
    kept = language.keep_identified(many.union(odd))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())
    none = docs.withColumn("lang", F.lit(None).cast("string")).union(odd)
    assert language.keep_identified(none).count() == docs.count() + 2


def test_language_counts_correct_false_positives():
    model = language.LanguageFilter(["a", "b"], np.array([1, 3] * 512, np.uint64), 1)
    assert model.false[0] == 1.0 and model.false[1] == 0.5
    assert model.predict(None) == ("und", 0.0) and model.predict("12 34") == ("und", 0.0)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) key")
    listed = universe.where("substr(key, -1) = '7'")
    levels = url_filter.cascade(listed, universe, first=(3, 2), later=(2, 1))
    got = universe.select("key", url_filter.member(levels, F.col("key")).alias("m"))
    assert len(levels) > 2 and got.where("m <> (substr(key, -1) = '7')").count() == 0
    assert url_filter.cascade(listed.limit(0), universe) == []


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/en/1", "https://x.example.com/en/77?q#f", "http://example.com/en/6", "http://net/de/", "http://xnet/de/1",
            "http://a.example.net/de/8#x", "http://b.org?/es/", "http://org/es/1", "http://org/es/1", "ftp://a://com/en/2", "http://line\nbreak.com/en/\nx"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == [
        None, None, None, None, "com/en/", "example.com/en/7", "com/en/", "net/de/", None, "example.net/de/8", None, "org/es/", "org/es/", None, "com/en/"]
    assert (got[0].host, got[0].path, got[4].host, got[5].path) == ("", "", "a.com", "/en/77") and got[7].verdict == "allow" and got[8].verdict == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0 and url_filter.judge_urls(df, []).where("verdict <> 'allow'").count() == 0


def test_shards(spark, docs, edge, empty):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i // 4}" if i % 2 else f"s{i}", None, None, None) for i in range(1200)]
    hot = spark.createDataFrame(rows, DOCS)
    for df, n in ((docs, docs.count()), (edge, len(EDGE)), (hot, 1200)):
        got = sharding.shard_documents(df).toPandas()
        sizes = got.shard.value_counts().reindex(range(8), fill_value=0)
        assert len(got) == n and sizes.max() - sizes.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    spread_of = got.merge(pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]), on="doc_id").groupby("text").shard.nunique()
    assert spread_of.drop("hot").max() <= 2 and (spread_of.drop("hot") > 1).mean() < 0.1 and spread_of["hot"] <= 6
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("groups", [2, 400])
def test_shards_without_unlinked_rows(spark, groups):
    """A group larger than a shard fills a second one, also where every document has copies."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i * groups // 2400 if groups > 2 else i % 2}", None, None, None) for i in range(2400)]
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.shard_documents(df).join(df.select("doc_id", "text"), "doc_id").toPandas()
    assert (got.shard.value_counts() == 300).all()
    assert list(got[got.text == "hot"].shard.value_counts().iloc[:2]) == [300, 300]


def test_mixing(spark, docs, edge, empty):
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    got = mixing.draw(docs).drop("draws").toPandas()
    again = mixing.draw(docs.repartition(5)).drop("draws").toPandas()
    assert compare(got, again) == ""
    assert (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by.taken - by.target) <= 1 + by.target * 0.01).all()
    assert len(mixing.draw(edge).toPandas()) == len(EDGE) and mixing.draw(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    words = sum(len(WORD.findall(r.text)) for r in rows)
    assert words == got.taken.sum() and mixing.mixed_documents(edge).columns == edge.columns
    whole = texts(docs)
    assert sum(r.text != whole[r.doc_id] for r in rows) <= len(by)  # one cut per target at most


def test_mix_takes_what_draw_takes(spark):
    """Rows without doc_id, or with one, of equal sizes: words of the mix are those of draw; short documents stay whole."""
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(50)), "en", "a", 1) for i in range(60)] + [(7, f"x{i} y z", "en", "b", 1) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    drawn = mixing.draw(df).toPandas()
    out = mixing.mixed_documents(df).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == drawn.taken.sum() and len(drawn) == 260
    assert sum(r.text not in {x[1] for x in rows} for r in out) <= 2 and len(out) <= 2 * 260


def test_mixing_places_are_disjoint(spark, docs):
    rows = mixing.draw(docs, shards=5).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").toPandas()
    assert set(rows.shard) <= set(range(5)) and (rows.stop > rows.start).all()
    for _, g in rows.groupby(["doc_id", "epoch"]):
        g = g.sort_values("start")
        assert (g.start.to_numpy()[1:] >= g.stop.to_numpy()[:-1]).all()
    quotas = np.array([40, 7, 0, 13])
    tree = mixing.split_tree(quotas, 6, np.random.default_rng(0))
    assert tree.shape == (6, 4) and (tree.sum(0) == quotas).all() and (tree >= 0).all() and tree.sum(1).max() - tree.sum(1).min() <= 1


def test_preferences(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, None, "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 1, 1), (9, 3, 4)], "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in preference.format_preferences(df, pairs).collect()}
    a = got[7]
    assert (a.n_common, a.prompt, a.chosen) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\nyes<|end|>\n")
    assert a.rejected == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n"
    full = a.prompt + a.chosen
    assert [full[s.start:s.stop] for s in a.chosen_mask] == ["yes<|end|>\n"]
    full = a.prompt + a.rejected
    assert [full[s.start:s.stop] for s in a.rejected_mask] == ["no<|end|>\n"]
    assert (got[8].n_common, got[8].chosen, got[8].rejected) == (2, "", "") and got[9].rejected == "" and got[9].chosen == "<|unknown|>\nx<|end|>\n"
    assert preference.format_preferences(df.limit(0), pairs).count() == 3 and preference.format_pairs(preference.reply_pairs(df.limit(0))).count() == 0


def brute_tables(c, others, parent, d, theta):
    """Exact law of the number of tables, by adding up all seatings one customer at a time."""
    state = {(1,): 1.0}
    for n in range(1, c):
        nxt = defaultdict(float)
        for sizes, p in state.items():
            for i, s in enumerate(sizes):
                nxt[tuple(sorted(sizes[:i] + (s + 1,) + sizes[i + 1:]))] += p * (s - d)
            nxt[tuple(sorted(sizes + (1,)))] += p * (theta + d * (others + len(sizes))) * parent
        state = nxt
    law = defaultdict(float)
    for sizes, p in state.items():
        law[len(sizes)] += p
    total = sum(law.values())
    return {k: v / total for k, v in law.items()}


def test_seats_follow_their_conditional():
    rng = np.random.default_rng(4)
    n = 40_000
    got = lm_score.seat(np.full(n, 6), np.full(n, 9), np.full(n, 0.2), 0.6, 1.0, rng)
    for t, p in brute_tables(6, 9, 0.2, 0.6, 1.0).items():
        assert abs((got == t).mean() - p) < 0.01
    big = lm_score.seat(np.array([10, 100, 10**6, 10**9]), np.full(4, 50), np.full(4, 0.01), 0.5, 1.0, rng)
    assert (big >= 1).all() and (np.diff(big) >= 0).all()


def test_language_model(spark, docs, edge, empty):
    got = lm_score.score_documents(docs, block_bytes=1 << 17).toPandas().set_index("doc_id")
    t = {i: (x.encode().lower().split() + [b""]) for i, x in texts(docs).items()}
    c = Counter(w for i, ws in t.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in t.items():
        r = got.loc[i]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n) and abs(r.base_score - base) < 1e-6 * abs(base)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score <= 0).all()
    out = lm_score.score_documents(edge).toPandas()
    assert len(out) == len(EDGE) and np.isfinite(out.score).all() and lm_score.score_documents(empty).count() == 0


def test_language_model_is_a_distribution(spark):
    """Probabilities of all known words and the unknown one add up to 1 after a context."""
    words = ["a", "b", "c", "d"]
    train = [(i, " ".join(random.Random(i).choice(words) for _ in range(30)), zlib.crc32(str(i).encode()) % 10) for i in range(200)]
    learn = [(i, t) for i, t, f in train if f]
    free = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    probes = list(zip(free, ["a", "a a", "a b", "a c", "a d", "a zzz"]))
    df = spark.createDataFrame(learn + probes, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score_documents(df, min_rate=0.01).where("held_out").collect()}
    s = [got[i] for i in free]
    # P(text) = P(a) P(w | a) P(end | w); the end after w comes from a probe each
    ends = dict(zip(words, [None] * 4))
    single = {r.text: r.score for r in lm_score.score_documents(spark.createDataFrame(
        learn + list(zip(free, ["a", "b", "c", "d", "zzz", "b b"])), "doc_id long, text string"), min_rate=0.01).join(
        spark.createDataFrame(list(zip(free, ["a", "b", "c", "d", "zzz", "b b"])), "id long, text string"), F.col("doc_id") == F.col("id")).collect()}
    assert ends.keys() <= single.keys() and all(x < 0 for x in s) and 10 ** single["a"] + 10 ** single["b"] + 10 ** single["c"] + 10 ** single["d"] < 1


@pytest.mark.parametrize("block_bytes", [1 << 24, 1 << 15])
def test_language_model_gives_rare_words_a_context(spark, block_bytes):
    """In a corpus whose words are all rarer than one in 10,000, a pair that was seen is likelier than one that was not."""
    train = [i for i in range(30_000) if zlib.crc32(str(i).encode()) % 10][:24_000]
    free = [i for i in range(30_000) if not zlib.crc32(str(i).encode()) % 10][:200]
    n = 8000
    data = [(i, f"a{k % n} b{k % n} c{k % n}") for k, i in enumerate(train)]
    data += [(i, f"a{k // 2} b{k // 2 + k % 2} c{k // 2 + k % 2}") for k, i in enumerate(free)]
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark.createDataFrame(data, "doc_id long, text string"), block_bytes=block_bytes).where("held_out").collect()}
    assert len(got) == 200 and all(got[a] - got[b] > 2 for a, b in zip(free[::2], free[1::2]))


def test_pipeline_against_brute_force(spark, docs):
    """Stages by stage: kept ids, mix sizes and token counts."""
    sf = SF
    a = materialize(corpus_pipeline.quality_rules(spark, docs, sf))
    led = quality.apply_policy(quality.ledger(docs), "v2").where("kept").toPandas()
    assert sorted(r.doc_id for r in a.collect()) == sorted(led.doc_id) and a.columns == docs.columns
    b = materialize(corpus_pipeline.language_id(spark, a, sf))
    assert b.count() == a.count()
    c = materialize(corpus_pipeline.near_duplicates(spark, b, sf))
    assert sorted(r.doc_id for r in c.collect()) == brute_kept(texts(b))
    d = materialize(corpus_pipeline.mix_sources(spark, c, sf))
    assert d.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.draw(c).collect()}
    mixed = Counter()
    for r in d.collect():
        mixed[r.doc_id] += len(WORD.findall(r.text))
    assert mixed == Counter({k: v for k, v in taken.items() if v})
    enc = tokenizer()
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in d.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_of_empty_and_odd_tables(spark, edge, empty):
    for df in (empty, edge):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            df = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.tokens(spark, df, SF).count() == df.count()


def brute_kept(found):
    """Least doc_id of each component of five-word Jaccard 0.8 or more, over all pairs that share a shingle."""
    sets = {i: shingles(t.lower()) for i, t in found.items()}
    having = defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            having[g].append(i)
    common = Counter((a, b) for ids in having.values() for n, a in enumerate(ids) for b in ids[n + 1:])
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])
    for (a, b), n in common.items():
        if 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in sets})


def test_similar_pairs_meet_by_golay_keys(spark):
    """Pairs of Jaccard 0.8 share a key of a codeword index near their SimHash words, though few words are equal; others don't."""
    rnd, data = random.Random(11), []
    for k in range(300):
        n = rnd.choice([40, 104, 204])
        a = [f"w{k}x{j}" for j in range(n)]  # n - 4 shingles, of which the pair shares 8 of 9
        keep = (n - 4) * 8 // 9 + 5
        data += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:keep] + [f"v{k}x{j}" for j in range(n - keep - 1)]))]
    rows = spark.createDataFrame(data, "doc_id long, text string").select("doc_id", similar.sketch(F.col("text")).alias("k")).select("doc_id", "k.*")
    node = {r.doc_id: r for r in rows.collect()}
    keys = defaultdict(set)
    for r in similar.golay_keys(rows).collect():
        keys[r.node].add(r.key)
    assert all(len(k) <= 6 * similar.TABLES for k in keys.values())
    words = [(x, y) for k in range(300) for x, y in zip(node[2 * k].words, node[2 * k + 1].words)]
    assert sum(x == y for x, y in words) < 0.1 * len(words) and 0.12 < np.mean([(x ^ y).bit_count() for x, y in words]) / similar.BITS < 0.18
    assert all(keys[node[2 * k].node] & keys[node[2 * k + 1].node] for k in range(300))
    assert not any(keys[node[2 * k].node] & keys[node[2 * k + 3].node] for k in range(299))
    pairs, _ = similar.candidates(similar.golay_keys(rows), 12)
    assert {(r.a, r.b) for r in pairs.collect()} == {tuple(sorted((node[2 * k].node, node[2 * k + 1].node))) for k in range(300)}
    word = node[0].words[3]
    near = {int(i) for i in golay.indices(np.array([word])).ravel() if i >= 0}
    assert len(near) == sum(k & 31 == 3 for k in keys[node[0].node])


def test_similar_finds_pairs_of_brute_force(spark):
    """Every pair of five-word Jaccard 0.8 or more is linked, and nothing else; also if all bands count as large."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    want = brute_kept(texts(docs))
    assert len(want) < docs.select("text").distinct().count()
    for small in (12, 1):
        assert sorted(r.doc_id for r in similar.keep_distinct(docs, small).select("doc_id").collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()) == want


@pytest.mark.parametrize("own, apart, below", [(4, 4, True), (2, 1, False)])
def test_similar_tells_pairs_of_one_template_apart(spark, own, apart, below):
    """Pairs (own edits) of one template among hundreds of texts just under the threshold, and a group above it."""
    base, data = [f"t{i}" for i in range(120)], []
    for k in range(300):
        first = list(base)
        first[10:10 + own] = [f"p{k}x{j}" for j in range(own)]
        for v in range(2):
            text = list(first)
            text[60:60 + apart] = [f"q{k}v{v}x{j}" for j in range(apart)]
            data.append((2 * k + v, " ".join(text)))
    want = brute_kept(dict(data))
    assert len(want) == (300 if below else 1)
    df = spark.createDataFrame([(*d, "x", 1, 2, None) for d in data], "doc_id long, text string, r1 string, node int, r2 int, k string")
    out = similar.keep_distinct(df, small=12)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.where("r1 = 'x' and node = 1").collect()) == want


def test_similar_keeps_a_group_around_its_original(spark):
    """Edited copies unlike each other are linked through the original, wherever its hash falls."""
    rnd, base, data = random.Random(5), [f"t{i}" for i in range(200)], []
    data.append((77, " ".join(base)))
    for k in range(200):
        text = list(base)
        for j in range(3):
            text[rnd.randrange(200)] = f"e{k}x{j}"
        data.append((100 + k, " ".join(text)))
    want = brute_kept(dict(data))
    assert len(want) < 60
    got = similar.keep_distinct(spark.createDataFrame(data, "doc_id long, text string"), small=4)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_similar_verifies_no_pairs_within_a_component(spark, monkeypatch):
    """In a large group of near copies the pairs that are compared stay a few a text: linked texts are not compared again."""
    rnd, base, seen = random.Random(3), [f"t{i}" for i in range(200)], []
    data = [(0, " ".join(base))]
    for k in range(1, 401):
        text = list(base)
        text[rnd.randrange(200)] = f"e{k}"
        data.append((k, " ".join(text)))
    verified = similar.verified

    def counted(pairs, texts):
        seen.append(pairs.count())
        return verified(pairs, texts)
    monkeypatch.setattr(similar, "verified", counted)
    got = similar.keep_distinct(spark.createDataFrame(data, "doc_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [0] == brute_kept(dict(data))
    assert sum(seen) < 15 * len(data), seen


def test_similar_keeps_one_row_of_each_text(spark, edge, empty):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "en", "s", 1), (2, a + " more", "en", "s", 1), (2, b, "en", "s", 1), (None, b, "en", "s", 1), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1), (None, "y", None, None, None)]
    got = [(r.doc_id, r.text) for r in similar.keep_distinct(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, "x"), (None, "y")], key=str)
    kept = similar.keep_distinct(edge)
    assert kept.columns == edge.columns and kept.where("doc_id in (2, 3, 5, 7)").count() == 0 and similar.keep_distinct(empty).count() == 0


def test_mix_is_dealt_to_shards_in_order(spark, docs):
    """Draws of a shard have the positions 0, 1, .. in an order unlike the input's; the mix is written in it."""
    got = catalog.QUERIES["op8_split_tree_mix"](spark, SF).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").toPandas()
    for _, g in got.groupby("shard"):
        g = g.sort_values("position")
        assert list(g.position) == list(range(len(g))) and abs(np.corrcoef(g.doc_id, g.position)[0, 1]) < 0.3
    least = got.groupby(["doc_id", "epoch", "shard"]).position.min().reset_index().sort_values(["shard", "position"])
    out = mixing.mixed_documents(docs).coalesce(1).collect()
    assert len(out) == len(least)
    one = mixing.mixed_documents(docs, rows_per_task=1 << 40)
    parts = one.withColumn("p", F.spark_partition_id()).toPandas()
    for _, g in parts.groupby("p"):
        shards = [list(x.doc_id) for _, x in least.groupby("shard")]
        assert any(list(g.doc_id) == [i for k in picks for i in shards[k]] for picks in subsets(len(shards)))


def subsets(n):
    return [[k for k in range(n) if m >> k & 1] for m in range(1, 1 << n)]
