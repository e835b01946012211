import random

import numpy as np
import pytest

from lexloom.llm import simjoin as J
from lexloom.llm.components import components
from lexloom.llm.forms import bare


def sets(t):
    b = bare(t)
    return {b[i : i + 3] for i in range(len(b) - 2)}


def make(n, seed, alphabet="가나다라마바사아자차", lo=0, hi=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if len(out) > 5 and r.random() < 0.6:
            s = list(r.choice(out)[1] or "가나다")
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(s) + 1)
                s[k : k + r.randint(0, 1)] = r.choice(alphabet + " ,")
        else:
            s = [r.choice(alphabet) for _ in range(r.randint(lo, hi))]
        out.append((f"k{i:04d}", "".join(s), r.choice([1, 2])))
    return out + [("n1", None, 1), ("n2", None, 2), ("e1", "", 1), ("e2", "가나", 2), ("e3", "가나", 1)]


def brute(rows, two):
    got = set()
    uniq = {}
    for k, t, s in rows:
        uniq.setdefault(k, (t, s))
    g = [(k, sets(t or ""), s) for k, (t, s) in uniq.items()]
    for i, (a, x, sa) in enumerate(g):
        for b, y, sb in g[i + 1 :]:
            if x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9 and (not two or sa != sb):
                got.add((min(a, b), max(a, b)))
    return got


@pytest.mark.parametrize("two,hot,seed", [(False, 50_000, 1), (True, 50_000, 2), (False, 20, 3), (True, 20, 4)])
def test_against_brute_force(spark, two, hot, seed, monkeypatch):
    if hot == 20:  # nothing is small, and every key is hot
        for m in ("lexloom.runtime", "lexloom.llm.simjoin"):
            monkeypatch.setattr(f"{m}.fits", lambda d, limit=0: False)
        monkeypatch.setattr("lexloom.runtime.spread_join.__defaults__", (2,))
    rows = make(300, seed)
    rows += rows[:20]  # delivered twice
    if not two:
        rows = [(k, t, 3) for k, t, _ in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, text string, side int, cid string")
    prep = J.prepare(df)
    classes = J.similar_classes(prep, 0.8, two, hot=hot, buckets=97 if seed % 2 else None)
    p = J.cross_pairs(prep, classes) if two else J.member_pairs(prep, classes)
    got = [tuple(sorted(r[:2])) for r in p.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, two)


def test_boundary_and_containment(spark):
    # 4 of 5 pieces are shared: exactly 0.8
    rows = [("a", "가나다라마바", 3), ("b", "가나다라마바사", 3)]
    prep = J.prepare(spark.createDataFrame(rows, "key string, text string, side int"))
    r = J.similar_classes(prep).collect()
    assert len(r) == 1 and abs(r[0]["similarity"] - 0.8) < 1e-12 and {r[0]["contained_a"], r[0]["contained_b"]} == {1.0, 0.8}


def test_names_that_collide(spark, monkeypatch):
    """Two texts whose names have the same first 64 bits keep their own pairs."""
    monkeypatch.setattr(J.xxhash, "xxh3_128_digest", lambda x: b"12345678" + __import__("hashlib").md5(x).digest()[:8])
    rows = [("a", "가나다라마바", 3), ("b", "가나다라마바사", 3), ("c", "하파타카차자아사바마", 3), ("d", "하파타카차자아사바마라", 3)]
    prep = J.materialize(spark.createDataFrame(next(iter([[(k, s, c, i, x) for b in J._prepare([J.pa.RecordBatch.from_pylist([{"key": k, "text": t, "side": s} for k, t, s in rows])]) for k, s, c, i, x in zip(*[b.column(j).to_pylist() for j in range(5)])]])), "key string, side int, cid binary, id bigint, bare string"), "test")
    p = J.member_pairs(prep, J.similar_classes(prep))
    assert {(r["key_a"], r["key_b"]) for r in p.collect()} == {("a", "b"), ("c", "d")}


def test_copies_of_one_side_are_no_work(spark):
    rows = [(f"t{i}", "같은 문장이 훈련 자료에만 아주 많이 있습니다", 2) for i in range(50)] + [("e", "이것은 다른 문장으로 평가에만 있는 것입니다", 1)]
    prep = J.prepare(spark.createDataFrame(rows, "key string, text string, side int"))
    assert J.cross_pairs(prep, J.similar_classes(prep, two_sided=True)).count() == 0


def test_places_meet_once_per_pair_of_blocks():
    """Any two postings of a long list share a place, and a place gets two blocks of it at most."""
    r = np.random.default_rng(1)
    ids = r.integers(0, 1 << 62, 500).astype(np.uint64)
    of, at = J.places_of(np.full(500, 9, np.uint32), np.full(500, 6_000_000_000), ids, 8, 1_000_000_000)
    where = [set(at[of == i].tolist()) for i in range(500)]
    assert all(where[i] & where[j] for i in range(0, 500, 7) for j in range(500)) and all(len(w) == 6 for w in where)
    assert max(np.bincount(np.unique(at, return_inverse=True)[1])) < 250


def test_empty(spark):
    prep = J.prepare(spark.createDataFrame([], "key string, text string, side int"))
    assert J.member_pairs(prep, J.similar_classes(prep)).count() == 0


def test_group_of_copies(spark):
    rows = [(f"c{i}", "같은 질문이 아주 많이 들어왔습니다" + "." * (i % 3), 3) for i in range(60)] + make(100, 9)[:100]
    prep = J.prepare(spark.createDataFrame([(k, t, 3) for k, t, *_ in rows], "key string, text string, side int"))
    got = {(r["key_a"], r["key_b"]) for r in J.member_pairs(prep, J.similar_classes(prep)).collect()}
    assert got == brute([(k, t, 3) for k, t, *_ in rows], False)


def test_long_list_goes_in_steps(monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 64)
    n = 200
    key = np.zeros(n, np.uint32)
    rec = np.arange(n)
    size = np.full(n, 10)
    same = J.Sketches(size, np.zeros(n, np.uint64), np.arange(n))
    a, b = J.merge_lists((key, key), rec, rec, size, same, 0.8, True)
    assert len(a) == n * (n - 1) // 2


def test_far_pieces_do_not_meet():
    """A first common piece that stands too far back in either record makes no pair, in steps and in tiles."""
    n, key = np.full(100, 100), np.zeros(100, np.uint32)
    rec, place = np.arange(100), np.arange(100) % 20  # of 100 pieces 89 are shared, so that up to 11 may come before
    sketches = J.Sketches(n, np.zeros(100, np.uint64), np.arange(100))
    for dense in (1, 1 << 60):
        J_dense, J.DENSE = J.DENSE, dense
        try:
            a, b = J.merge_lists((key, key), rec, rec, n, sketches, 0.8, True, (place, place))
        finally:
            J.DENSE = J_dense
        assert len(a) == 60 * 59 // 2 and place[a].max() == place[b].max() == 11


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("dense", [1, 1 << 60])
def test_lists_of_all_sizes(two, dense, monkeypatch):
    """Every similar pair is a candidate, whatever the width of its sketches, and few others are."""
    monkeypatch.setattr(J, "DENSE", dense)
    monkeypatch.setattr(J, "TILE", (4, 8))
    r = random.Random(5)
    alphabet = "".join(chr(0xAC00 + 7 * i) for i in range(40))
    texts = []
    for size in (8, 60, 105, 112, 215, 222, 430, 441, 900, 1500):
        for _ in range(3):
            base = [r.choice(alphabet) for _ in range(size)]
            texts.append("".join(base))
            for cut in (0.01, 0.03, 0.06, 0.1, 0.2):
                s = list(base)
                for _ in range(max(1, int(cut * size / 3))):
                    k = r.randrange(len(s))
                    s[k : k + r.randint(0, 2)] = r.choice(alphabet)
                texts += ["".join(s), "".join(base[: int(size * (1 - cut))])]
    texts = sorted({t for t in texts if len(t) >= 3})
    side = np.array([r.choice([1, 2, 3]) for _ in texts], np.int32)
    names = [J.xxhash.xxh3_128_digest(t) for t in texts]
    rows = J.pa.RecordBatch.from_arrays([J.pa.array(texts), J.pa.array(side), J.pa.array(names, J.pa.binary())], ["bare", "side", "cid"])
    counts = np.zeros(J.SLOTS, np.int64)
    for b in J._count_slots([rows]):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    got = set()
    for now in range(3):
        sig = J.pa.Table.from_batches(list(J._signatures(type("bc", (), {"value": counts}), 0.8, 5, 50_000, 3, now)([rows])))
        for k in set(sig["bucket"].to_pylist()):
            assert k % 3 == now
            tab = J._bucket_kernel(0.8, two)(sig.filter(J.pa.array([x == k for x in sig["bucket"].to_pylist()])))
            got |= set(zip(tab["id_a"].to_pylist(), tab["id_b"].to_pylist()))
    ids, pieces = [int.from_bytes(x[:8], "little", signed=True) for x in names], [sets(t) for t in texts]
    want = set()
    for i in range(len(texts)):
        for j in range(i):
            cross = side[i] & 1 and side[j] & 2 or side[i] & 2 and side[j] & 1
            if (cross or not two) and len(pieces[i] & pieces[j]) >= 0.8 * len(pieces[i] | pieces[j]) - 1e-9:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert len(want) > 100 and want <= got and len(got) < 3 * len(want)


def test_rounds(spark, monkeypatch):
    """Buckets that are filled in rounds give the same pairs, each once."""
    monkeypatch.setattr(J, "ROUND_BYTES", 1)
    rows = make(200, 11)
    prep = J.prepare(spark.createDataFrame(rows, "key string, text string, side int"))
    for rounds in (3, None):
        classes = J.similar_classes(prep, 0.8, True, buckets=97, rounds=rounds)
        got = [tuple(sorted(r[:2])) for r in J.cross_pairs(prep, classes).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, True)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, r.randint(100, 130)) for _ in range(20)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(v == 100 for k, v in got.items() if k >= 100)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
