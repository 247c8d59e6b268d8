"""Problem 3 against a character-by-character reading of its statement."""

import random
import re

import pyarrow as pa
import pytest

from genoframe.operators.packed_fields import ALLELES, ENTRIES, FORMATS, explode_packed, split_packed
from genoframe.plans.problems import p3_found
from genoframe.tables import read_table
from oracle import DATA

KINDS = {"vcf_alt": ALLELES, "vcf_info": ENTRIES, "vcf_format": FORMATS}
BLANK = " \t\n\r\x0b\x0c"


def slow_split(text, kind):
    if text is None:
        return []
    text = text.strip(BLANK)
    if len(text) >= 2 and text[0] == text[-1] == '"' and text.count('"') == 2:
        text = text[1:-1]
    if text == ".":
        return []
    seps = {"vcf_alt": ",;|/", "vcf_format": ":,;|", "vcf_info": ";|"}[kind] + BLANK
    pieces, now, quoted, angle = [], "", False, False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        if kind == "vcf_alt" and c == "<" and ">" in text[i:]:
            angle = True
        if c == ">":
            angle = False
        cut = c in seps or (kind == "vcf_info" and c == "," and re.match(r"[ \t\n\r\x0b\x0c]*[A-Z][A-Z0-9_]*=", text[i + 1 :]))
        if cut and not quoted and not angle:
            pieces.append(now)
            now = ""
        else:
            now += c
    pieces.append(now)
    out = []
    for p in pieces:
        m = re.fullmatch(r'(?s)([^="]*=)?"(.*)"', p)
        p = (m[1] or "") + m[2].replace('""', '"') if m else p
        if p:
            out.append(p)
    return out


CASES = [
    None, "", " ", ".", '"."', " . ", "A", "A,C", '"A","C"', '"A,C"', "<DUP:TANDEM,3>, *", "T]chr1:5],C", "A<,C", "<A,<B>,C", ",;A;;", '""', 'N="" ;B',
    'AC=1,2,AN=5', 'AC=1, AN=5', 'AC=1,an=5', 'AC=3,2|NOTE="a|b; ""c"" d" AN=1', '"AC=1;AN=2"', 'NOTE="open;AN=2', "é,ü", "GT : DP;PL", "a=b=c", "x" * 5000 + ",C", 'AC=1,=5', 'AC=1,A_1=5',
]


@pytest.mark.parametrize("kind", KINDS)
def test_cases(kind):
    got = split_packed(pa.array(CASES, pa.string()), KINDS[kind]).to_pylist()
    assert got == [slow_split(c, kind) for c in CASES]


@pytest.mark.parametrize("kind", KINDS)
def test_random_texts_and_slices(kind):
    rng = random.Random(5)
    texts = ["".join(rng.choice('AC=,;|/:" <>.B_1é\t') for _ in range(rng.randrange(0, 14))) for _ in range(20_000)]
    whole = pa.array(texts, pa.string())
    want = [slow_split(t, kind) for t in texts]
    assert split_packed(whole, KINDS[kind]).to_pylist() == want
    assert split_packed(whole.slice(7, 500), KINDS[kind]).to_pylist() == want[7:507]


def test_empty_arrays():
    assert split_packed(pa.array([], pa.string()), ALLELES).to_pylist() == []
    assert split_packed(pa.array([None, None], pa.string()), ALLELES).to_pylist() == [[], []]


def test_query_against_slow_split(spark):
    sf = f"{DATA}/sf0.001"
    want = set()
    for r in read_table(spark, sf, "vcf_calls").select("call_id", *KINDS).collect():
        for kind in KINDS:
            want |= {(r.call_id, kind, i + 1, x) for i, x in enumerate(slow_split(r[kind], kind))}
    got = [tuple(r) for r in p3_found(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "A,C", "k"), (1, "A,C", "k"), (1, "A", "k"), (None, "G", None), (2, None, "k")]
    df = spark.createDataFrame(rows, "id bigint, alt string, item string")
    got = sorted(explode_packed(df, "id", "bigint", {"alt": ALLELES}).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "alt", 1, "A"), (1, "alt", 2, "C"), (None, "alt", 1, "G")]
    assert explode_packed(df.limit(0), "id", "bigint", {"alt": ALLELES}).count() == 0
