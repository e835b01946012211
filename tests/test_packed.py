import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators.packed import OPEN, PackedFormat, _clean, _unwrapped, explode_packed, split_packed
from lexloom.plans.packed import CITATIONS

CASES = [
    (None, []),
    ("", []),
    (" ", []),
    ("-", []),
    ("null", []),
    ("[]", []),
    ("{}", []),
    ("없음, N/A", []),
    ("가법 제1조, 제2조", ["가법 제1조", "제2조"]),
    ("[1] 가법 제75조(현행 나법 제31조 참조), ; 같은 법 제75조의5 [2] 제48조\n[3] 제85조 제5항", ["가법 제75조(현행 나법 제31조 참조)", "같은 법 제75조의5", "제48조", "제85조 제5항"]),
    ("제96조[4]제86조/다법 제3조의5 / ", ["제96조", "제86조", "다법 제3조의5"]),
    ("가법 제8조 [별표 8]；제9조", ["가법 제8조 [별표 8]", "제9조"]),
    ("「가, 나 및 다법」 제3조、　제4조,\xa0제5조", ["「가, 나 및 다법」 제3조", "제4조", "제5조"]),
    ('"가, 나법 제85조", "law:001203:86" ', ["가, 나법 제85조", "law:001203:86"]),
    ("['law:1:43', '가, 나법 제9조(\"상시\" 부분)']", ["law:1:43", '가, 나법 제9조("상시" 부분)']),
    ('["제7조(\\"상시\\" 부분)","rule:001368:26"]', ['제7조("상시" 부분)', "rule:001368:26"]),
    ('"제97조(""상시"" 부분)" | 제79조', ['제97조("상시" 부분)', "제79조"]),
    ("{decree:1:2,,rule:3:4,}", ["decree:1:2", "rule:3:4"]),
    ('"제1조, 제2조', ['"제1조', "제2조"]),
    ("제1조(제2항; 제3조", ["제1조(제2항", "제3조"]),
    ("[1] 제1조 [별표 2]", ["제1조 [별표 2]"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_split(text, want):
    assert split_packed(text, CITATIONS) == want


def test_long_text_is_linear():
    one = "가법 제1조(2011. 5. 2. 개정), "
    assert len(split_packed(one * 20_000, CITATIONS)) == 20_000


def by_restarts(text, fmt):
    """The definition: a quote or bracket that doesn't close is taken literally, and the field read again."""
    if not text:
        return []
    s = _unwrapped(text)
    token, marker, value = fmt.compiled()
    literal: set[int] = set()
    while True:
        out, start, nest, quote, quote_at, inner, skip = [], 0, [], "", -1, 0, -1
        for m in token.finditer(s):
            i, t = m.start(), m.group()
            if i in literal or i < skip:
                continue
            c = t[0]
            if c == "\\" and len(t) == 2:
                if t[1] in fmt.delimiters and not quote and not nest:
                    out.append(s[start:i])
                    start = m.end()
                continue
            if quote:
                if c in "(（":
                    inner += 1
                elif c in ")）":
                    inner = max(0, inner - 1)
                elif c == quote:
                    if s.startswith(quote, i + 1):
                        skip = i + 2
                    elif not inner:
                        quote = ""
                continue
            if nest:
                if c == nest[-1][0]:
                    nest.pop()
                elif c in OPEN and c != "[":
                    nest.append((OPEN[c], i))
                continue
            if len(t) > 1 and marker.fullmatch(t):
                out.append(s[start:i])
                start = m.end()
            elif c in fmt.delimiters:
                out.append(s[start:i])
                start = i + 1
            elif c in fmt.quotes:
                if not s[start:i].strip():
                    quote, quote_at, inner = c, i, 0
            elif c in OPEN:
                nest.append((OPEN[c], i))
        if quote:
            literal.add(quote_at)
        elif nest:
            literal.add(nest[0][1])
        else:
            break
    out.append(s[start:])
    values = (_clean(x, fmt.quotes) for x in out)
    return [v for v in values if value.search(v)]


@settings(max_examples=1500, deadline=None)
@given(st.text("(（)）「」[]\"',; \\1a제조{}", max_size=24))
def test_one_pass_equals_restarts(text):
    assert split_packed(text, PackedFormat()) == by_restarts(text, PackedFormat())


@pytest.mark.parametrize("junk", ["(", "「", "[", '"', '"(', '" (', "'「", "(]", ', "', "[{("])
def test_unclosed_signs_are_linear(junk):
    begin = time.process_time()
    split_packed(junk * 100_000, CITATIONS)
    assert time.process_time() - begin < 3


def test_other_formats():
    fmt = PackedFormat(delimiters=";", marker=r"#\d+")
    assert split_packed("a, b; 'c;d' ;e", fmt) == ["a, b", "c;d", "e"]


def test_explode(spark):
    rows = [(1, "제1조;제2조", None, "x"), (1, "제1조;제2조", None, "x"), (2, None, "", "y"), (3, "없음", "law:1:2", None)]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string, item string")
    out = explode_packed(df, "doc_id", ["a", "b"], CITATIONS)
    assert out.columns == ["doc_id", "field", "pos", "item"]
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1, "제1조"), (1, "a", 1, "제1조"), (1, "a", 2, "제2조"), (1, "a", 2, "제2조"), (3, "b", 1, "law:1:2")]
    assert explode_packed(df.limit(0), "doc_id", ["a", "b"], CITATIONS).count() == 0
