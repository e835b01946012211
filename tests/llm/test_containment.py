import random

import pytest

from lexloom.llm import containment as C
from lexloom.llm import simjoin


def grams(t, n=5):
    w = C.WORD.findall(t or "")
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("narrow", [False, True])
def test_against_brute_force(spark, monkeypatch, narrow):
    """Also with no side small and every n-gram hot."""
    if narrow:
        for m in ("lexloom.runtime", "lexloom.llm.containment"):
            monkeypatch.setattr(f"{m}.fits", lambda d, limit=0: False)
        monkeypatch.setattr("lexloom.runtime.spread_join.__defaults__", (2,))
    r = random.Random(7)
    words = "임금 휴가 해고 장비 수당 교육 안전 점검".split()
    rows = []
    for i in range(80):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 14)))
        if i > 10 and r.random() < 0.6:
            base = r.choice(rows)[1] or ""
            t = r.choice([base, f"{t} {base} {t}", base + " 끝", base.replace(" ", ", ")])
        rows.append((f"k{i:02d}", t, r.choice([1, 2, 3])))
    rows += [("n", None, 1), ("e", "", 2), ("p", "?!", 1), rows[3], rows[4]]
    prep = C.prepare(spark.createDataFrame([(*x, "z") for x in rows], "key string, text string, side int, cid string"))
    links = C.contained_classes(prep)
    got = {(x["eval_key"], x["train_key"]): (round(x["containment"], 9), x["n_eval"], x["n_train"]) for x in simjoin.class_links(simjoin.sides(prep), links).collect()}
    cls = {}
    for k, t, s in rows:
        if grams(t):
            cls.setdefault(" ".join(C.WORD.findall(t)), set()).add((k, s))
    want = {}
    for a, ka in cls.items():
        for b, kb in cls.items():
            e, tr = sorted({k for k, s in ka if s & 1}), sorted({k for k, s in kb if s & 2})
            share = len(grams(a) & grams(b)) / len(grams(a))
            if e and tr and share >= 0.8 - 1e-9 and not (a == b and len(e) == len(tr) == 1 and e == tr):
                want[e[0], tr[0]] = (round(share, 9), len(e), len(tr))
    assert got == want and any(v[0] < 1 for v in want.values()) and any(v[1] > 1 for v in want.values())
    assert C.contained_classes(C.prepare(spark.createDataFrame([], "key string, text string, side int"))).count() == 0
