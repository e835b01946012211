import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import encode as E
from lexloom.llm import segment as G
from lexloom.llm.contamination import leaked_spans
from lexloom.llm.fmindex import FMIndex, suffix_array
from lexloom.llm.forms import bare
from lexloom.llm.repeats import covered, rolling, shared_spans
from lexloom.llm.segment import cut, oversized


# segments


@settings(max_examples=150, deadline=None)
@given(st.text("가나 .\n?a", max_size=600), st.integers(20, 120), st.integers(1, 15))
def test_pieces(text, limit, overlap):
    spans = cut(text, limit, overlap)
    assert (not text) == (not spans)
    end, start = 0, -1
    for i, (s, e) in enumerate(spans):
        assert e - s <= limit and s > start and e > end
        assert s == 0 if i == 0 else 0 < end - s <= overlap
        start, end = s, e
    assert end == len(text)


def test_natural_ends():
    t = "".join(f"문장 번호 {i}는 여기에 있습니다. " for i in range(200))
    assert all(t[e - 1] == "." for _, e in cut(t)[:-1])
    w = "낱말 " * 900
    assert all(w[e].isspace() for _, e in cut(w)[:-1])
    assert [e - s for s, e in cut("가" * 2500)] == [1000, 1000, 740]
    assert cut(None) == [] and cut("") == [] and cut("가" * 1000) == [(0, 1000)]


def test_deepest_valley():
    a = "임금 체불 지급 기한 임금 수당. " * 22
    b = "산업 안전 보건 교육 장비 점검. " * 40
    t = a + b
    assert abs(cut(t, 700, 60)[0][1] - len(a)) <= 2


def test_depths_dont_change_at_stretches(monkeypatch):
    r = random.Random(8)
    t = "".join(" ".join(r.choice("임금 안전 교육 휴가 해고 장비 수당".split()) for _ in range(r.randint(2, 6))) + ". " for _ in range(600))
    ends = [m.end() for m in G.BOUNDARY.finditer(t)]
    assert len(ends) > 512
    want = G.cohesion_depths(t, ends)
    for n in (7, 100, 10_000):
        monkeypatch.setattr(G, "STRETCH", n)
        assert np.allclose(G.cohesion_depths(t, ends), want, atol=1e-12)
    sim = G.cohesion(t, ends)
    for k in range(0, len(ends), 37):
        x = k
        while x and sim[x - 1] >= sim[x]:
            x -= 1
        y = k
        while y + 1 < len(sim) and sim[y + 1] >= sim[y]:
            y += 1
        assert abs(want[k] - (sim[x] + sim[y] - 2 * sim[k])) < 1e-12


def test_deepest_valley_of_the_first_half():
    a = "임금 체불 지급 기한 임금 수당. " * 14
    b = "산업 안전 보건 교육 장비 점검. " * 60
    assert abs(cut(a + b, 1000, 60)[0][1] - len(a)) <= 2


def test_oversized(spark):
    rows = [("a", "가나. " * 600, 1), ("a", "가나. " * 600, 2), ("b", None, 1), ("c", "", 1), ("d", "짧다", 1)]
    out = oversized(spark.createDataFrame(rows, "k string, text string, field int"), "f", "k", "text").collect()
    assert {r["row_key"] for r in out} == {"a"} and max(len(r["text"]) for r in out) <= 1000
    assert oversized(spark.createDataFrame([], "k string, text string"), "f", "k", "text").count() == 0


# encoding


@pytest.mark.skipif(not __import__("os").path.exists(E.TOKENIZERS + "/byte_bpe_50k.json"), reason="no vocabulary")
def test_encode_and_decode(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(3)
    pool = ["임금", "근로자의", " the", "  ", "\n\n", "'s", "123", "!?", "<|endoftext|>", "\t", "é", "😥", "가"]
    texts = ["".join(r.choice(pool) + r.choice(["", " "]) for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "가" * 5000, " "]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, ids string")
    enc = E.encode_corpus(df, "doc_id", "text", block_chars=500)
    got = enc.collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert row["ids"] == t.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
    assert all(x["text"] == (texts[x["doc_id"]] or "") for x in E.decode(enc).collect())
    assert {x["doc_id"]: x["text"] for x in E.decode(spark.createDataFrame([(1, None), (2, [224])], "doc_id long, ids array<int>")).collect()} == {1: "", 2: "\ufffd"}
    assert E.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_word_of_many_blocks(spark, monkeypatch):
    """A word of more blocks than a task may get is repeated; a rare one isn't."""
    texts = [f"the word{i} the" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x["doc_id"]: x["ids"] for x in E.encode_corpus(df, "doc_id", "text").collect()}
    monkeypatch.setattr("lexloom.runtime.fits", lambda d, limit=0: False)
    got = E.encode_corpus(df, "doc_id", "text", block_chars=5, hot=7)
    assert {x["doc_id"]: x["ids"] for x in got.collect()} == want and all(want.values())


# FM-index


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(2, 6), max_size=120))
def test_suffix_array(x):
    s = np.array([*x, 0])
    assert suffix_array(s, 7).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.text("가나다", min_size=1, max_size=200), st.lists(st.text("가나다라", min_size=3, max_size=3), min_size=1, max_size=8))
def test_backward_search(text, words):
    codes = np.array([ord(c) for c in text], np.uint32)
    idx = FMIndex(codes)
    live, lo, hi = idx.search(np.array([ord(c) for w in words for c in w], np.uint32), np.arange(len(words)) * 3, 3)
    found = {int(k): sorted(idx.locate(np.arange(a, b)).tolist()) for k, a, b in zip(live, lo, hi)}
    for k, w in enumerate(words):
        assert found.get(k, []) == [i for i in range(len(text) - 2) if text[i : i + 3] == w]


def test_leaks(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("가나다라마바사아자차카타파하 ,") for _ in range(n))
    items = [(i, word(r.randint(20, 120))) for i in range(15)] + [(90, None), (91, ""), (92, "가" * 39)]
    docs = [(i, word(r.randint(0, 300))) for i in range(80)]
    for i in range(0, 80, 4):
        it = r.choice(items[:15])[1]
        a = r.randrange(len(it))
        docs[i] = (i, docs[i][1] + it[a : a + r.randint(30, 110)] + "." + docs[i][1])
    docs += [(200, None), (201, ""), (202, docs[0][1]), (203, "가" * 60), (203, "가" * 60)]
    want = defaultdict(set)
    for i, t in items:
        b = bare(t)
        for k in range(len(b) - 39):
            want[b[k : k + 40]].add(i)
    pairs = {(d, i) for d, t in docs for k in range(len(bare(t)) - 39) for i in want.get(bare(t)[k : k + 40], ())}
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, start int")
    it = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leaked_spans(df, it).collect()))
    for chars, item_chars in ((1 << 20, 100), (500, 8 << 20), (90, 300)):
        got = leaked_spans(df, it, shard_chars=chars, item_chars=item_chars).collect()
        assert sorted(map(tuple, got)) == whole
        assert {(x["doc_id"], x["item_id"]) for x in got} == pairs and pairs
        text = {d: bare(t) for d, t in docs}
        assert all(text[x["doc_id"]][x["start"] : x["start"] + 40] in want for x in got)
    assert leaked_spans(df.limit(0), it).count() == 0 and leaked_spans(df, it.limit(0)).count() == 0


# shared spans


def brute_shared(docs, n):
    where = defaultdict(set)
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            where[t[k : k + n]].add(d)
    out = {}
    for d, t in docs:
        hit = np.zeros(len(t or ""), bool)
        for k in range(len(hit) - n + 1):
            if len(where[t[k : k + n]]) > 1:
                hit[k : k + n] = True
        if hit.any():
            out[d] = int(hit.sum())
    return out


@pytest.mark.parametrize("bits,narrow", [(1 << 29, False), (1 << 10, False), (1 << 10, True)])
def test_shared_spans(spark, bits, narrow, monkeypatch):
    """Also with several ranges, and with joins of which no side is small and every key hot."""
    if narrow:
        for m in ("lexloom.runtime", "lexloom.llm.repeats"):
            monkeypatch.setattr(f"{m}.fits", lambda d, limit=0: False)
        monkeypatch.setattr("lexloom.runtime.spread_join.__defaults__", (2,))
    r = random.Random(6)
    word = lambda n: "".join(r.choice("가나다라 .") for _ in range(n))
    parts = [word(r.randint(15, 60)) for _ in range(12)]
    docs = []
    for i in range(60):
        docs.append((i, word(r.randint(0, 40)) + "".join(r.choice(parts) for _ in range(r.randint(0, 2))) + word(r.randint(0, 40))))
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, "가" * 90), (104, "가" * 50), (105, docs[5][1]), (105, docs[5][1])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, cid int")
    got = {x["doc_id"]: x["shared_chars"] for x in shared_spans(df, 20, filter_bits=bits).collect()}
    assert got == brute_shared(docs, 20) and got
    assert shared_spans(df.limit(0), 20).count() == 0


def test_rolling_hash():
    c = np.array([1, 2, 3, 4, 1, 2, 3, 4, 5], np.uint32)
    for w in (1, 2, 3, 4, 7):
        h = rolling(c, w)
        assert len(h) == len(c) - w + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (c[i : i + w].tolist() == c[j : j + w].tolist())
    assert len(rolling(c, 20)) == 0
    assert [x.tolist() for x in covered(np.array([0, 1, 5, 30]), 5)] == [[0, 30], [10, 35]]
