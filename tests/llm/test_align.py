"""Token alignment against a brute-force version on whole texts."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF
from tickforge.llm import token_align


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    of = token_align.byte_alphabet()
    names = {i: bytes(of[c] for c in t) for t, i in a.get_vocab().items() if all(c in of for c in t)}

    def one(text):
        if not text:
            return None
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        ba = [names[i] for i in ia]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            return None

        def ends(parts):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            return out
        ea, eb = ends(ba), ends(bb)
        both = sorted(set(ea) & set(eb))
        groups, links, lo = [], [], 0
        for e in both:
            ga = [i for i, x in zip(ia, ea) if lo < x <= e]
            gb = [i for i, x in zip(ib, eb) if lo < x <= e]
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            links.append((ga[-1], gb[-1]))
            lo = e
        return len(ia), len(ib), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
    return one


def brute(texts, one):
    found = [one(t) for t in texts]
    links = Counter(x for f in found if f for x in f[2])
    docs = Counter(x for f in found if f for x in set(f[2]))
    top = {}
    for (_, b), n in links.items():
        top[b] = max(top.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], len(f[2]), len(f[2]), sum(links[x] == top[x[1]] for x in f[2]), sum(links[x] for x in f[2]), sum(docs[x] for x in f[2]), f[3]) for f in found]


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.doc_count_sum, r.groups_sha256) for r in df.collect())


ODD = [None, "", " ", "  ", "\n", "a", "a ", "a  ", " a", "  a  b ", "a\nb", "a \n b", "a\n\n  b\t c", "x ▁y", "▁", "日本 🙂 🙂", "it's  we'll 12 34!!", "<|endoftext|> <s> </s>",
       "a b 　 c", "a\x1c b", "a \x1cb", "é ﬁ", "one two two two two two", "same text", "same text", "same text", "z" * 3000, "w " * 3000, "\r\n x;\r y",
       "a b", "tab\tend\t", "\x00 nul"]


@pytest.mark.parametrize("chunk_chars", [1, 300, 1 << 22])
def test_odd_texts(spark, tokenizers, chunk_chars):
    data = [(i if i % 7 else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in data], "doc_id long, text string, pair int, chunk int, place int").repartition(3, "text")
    want = sorted((d[0] if d[0] is not None else -1, *w) for d, w in zip(data, brute(ODD, tokenizers)))
    assert rows(token_align.align_documents(df, chunk_chars=chunk_chars)) == want


def test_documents(spark, tokenizers):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    data = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted((d, *w) for (d, _), w in zip(data, brute([t for _, t in data], tokenizers)))
    assert rows(token_align.align_documents(df, chunk_chars=100_000)) == want
    assert sum(w[5] for w in want) > 0


def test_empty_table(spark):
    assert rows(token_align.align_documents(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_bitmaps_of_both_kinds(spark):
    import numpy as np
    pair, place = np.array([7] * 100 + [9] * 2), np.array([*range(100), 3, 99])
    times = np.array([1 + (i % 5) for i in range(100)] + [1, 4])
    got = {(r["pair"], r["times"]): token_align.places(r["bitmap"]).tolist() for r in token_align.bitmaps(pair, place, times, 100).to_pylist()}
    for j in range(3):
        assert got[7, 1 << j] == [i for i in range(100) if times[i] >> j & 1]
    assert got[7, 0] == list(range(100)) and got[9, 0] == [3, 99] and got[9, 1] == [3] and got[9, 4] == [99]
