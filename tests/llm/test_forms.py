import random
import unicodedata

import numpy as np
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.forms import HYPHENS, LAW_DOT, LOOK_ALIKES, MIDDLE_DOTS, bare, bare_codes, clusters, consistent, tables, transducer

CASES = [
    (None, None), ("", ""), ("plain ascii", "plain ascii"), ("한글 그대로", "한글 그대로"),
    ("１２　ＡＢ～", "12 AB~"), ("한글", "한글"), ("café", "café"),
    ("Саfé", "Café"), ("РM배달종사자법", "PM배달종사자법"), ("mаіl로", "mail로"), ("е-mail", "e-mail"), ("e‐mail e‑mail", "e-mail e-mail"),
    ("договор", "договор"), ("α팀", "α팀"), ("① ½ ㎡", "① ½ ㎡"),
    ("준​다⁠고﻿", "준다고"), ("작͏업᠎", "작업"), ("a b c d", "a b c d"), ("金勞⼈", "金勞人"),
    ("ᄀ​ᅡ", "가"), ("S​NЅ", "SNS"), ("́", "́"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_consistent(text, want):
    assert consistent(text) == want
    assert consistent(want) == want


def test_dots_only_for_laws():
    for c in MIDDLE_DOTS:
        assert consistent(f"가{c}나", True) == f"가{LAW_DOT}나"
    assert consistent("가·나") == "가·나"


def test_tables_are_consistent():
    mapping, _ = tables()
    assert all(c not in mapping for v in mapping.values() for c in v)
    assert all(len(c) == 1 and v.isascii() for c, v in LOOK_ALIKES.items()) and len(set(HYPHENS)) == 4


def test_batch_and_single_agree_and_are_idempotent():
    r = random.Random(0)
    pool = "가각힣abzZ \n\t1аВο​ Ａ각́①‐豈ㅤ"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(500)] + [None, ""]
    many = transducer().many(texts)
    assert many == [consistent(t) for t in texts]
    for t in many:
        assert consistent(t) == t and (t is None or unicodedata.is_normalized("NFC", t))


def test_bare():
    assert bare("가-나 １①, B​Ć!") == "가나1①BC".replace("C", "Ć")
    codes, off = bare_codes(["가 나", None, "", "a"])
    assert off.tolist() == [0, 2, 2, 2, 3] and codes.tolist() == [ord(c) for c in "가나a"]


def test_very_long_text():
    t = "가 " * 200_000
    assert consistent(t) == "가 " * 200_000 and len(bare(t)) == 200_000 and isinstance(bare_codes([t])[0], np.ndarray)


def test_clusters_are_compiled_and_agree_with_the_rule():
    table = clusters()
    assert len(table) > 22_000
    for key, value in table.items():
        assert len(value) == 1 and unicodedata.normalize("NFC", key) == value and consistent(key) in (value, LOOK_ALIKES.get(value, value))
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0xAC01, 0xD7A3, 0x304C]):
        d = unicodedata.normalize("NFD", c)
        assert len(d) == 1 or table[d] == c
    assert consistent("ệ") == consistent("ệ") == consistent("ệ") == "ệ"  # marks in any order
    assert consistent("가́") == "가́"  # a mark that doesn't combine stays


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("가각aeoАое̣́̂​ Ａé·ᾴ"), max_size=12))
def test_form_is_composed_and_stable(text):
    got = consistent(text)
    assert unicodedata.is_normalized("NFC", got) and consistent(got) == got and "​" not in got
