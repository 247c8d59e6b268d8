"""Problems 1, 2 and 6: edge cases and brute force on small fixtures."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from genoframe.operators import heavy_keys, joins
from genoframe.operators.heavy_keys import key_summary
from genoframe.operators.joins import join_checked
from genoframe.operators.parse_failures import assemble_columns, parse_line, parse_variant_lines
from genoframe.operators.table_diff import Field, table_diff

SCHEMA = "k bigint, v bigint, a string, q double, extra string"


def _diff(spark, left, right, **options):
    fields = {"a": Field(F.upper("a")), "q": Field(F.col("q"), tolerance=0.01)}
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA.replace("extra", "field_name"))
    return sorted((tuple(r) for r in table_diff(a, b, "k", "v", fields, "no_left", "no_right", **options).collect()), key=str)


def test_diff_cases(spark):
    nan = float("nan")
    left = [(1, 1, "x", 1.0, ""), (1, 2, "y", 1.0, ""), (2, 1, "z", None, ""), (3, 1, None, nan, ""), (None, 1, "n", 5.0, ""), (5, None, "old", 1.0, ""), (5, 1, "new", 1.0, ""), (6, 1, "e", 0.1, ""), (6, 1, "e", 0.1, "")]
    right = [(1, 9, "Y", 1.01, ""), (2, 1, "z", 1.0, ""), (3, 1, "w", nan, ""), (4, 1, "r", 1.0, ""), (None, 1, "n", 6.0, ""), (5, 1, "NEW", 1.0, "")]
    want = [(2, "q"), (3, "a"), (4, "no_left"), (6, "no_right"), (None, "q")]
    for buckets in (1, 4, 4096):
        assert _diff(spark, left, right, buckets=buckets) == sorted(want, key=str)
    assert _diff(spark, left, left) == []
    assert _diff(spark, [], left[:1]) == [(1, "no_left")]
    assert _diff(spark, [], []) == []


def test_diff_reads_only_unequal_cells(spark):
    """Whatever differs within the buckets, the answer is that of a full comparison."""
    rng = random.Random(1)
    left = [(k, 1, rng.choice("abc"), float(rng.randrange(3)), "") for k in range(500)]
    right = [(k, v, rng.choice("abc") if rng.random() < 0.05 else a, q + (rng.random() < 0.05), e) for k, v, a, q, e in left if rng.random() > 0.02]
    other = {r[0]: r for r in right}
    want = []
    for k, _, a, q, _ in left:
        if k not in other:
            want.append((k, "no_right"))
            continue
        want += [(k, "a")] * (a != other[k][2]) + [(k, "q")] * (abs(q - other[k][3]) > 0.01)
    assert _diff(spark, left, right, buckets=37) == sorted(want, key=str)


GOOD = "chr1\t5\t.\tA\tC\t1e3\tPASS\tAC=1;AN=2"
LINES = {
    GOOD: None,
    GOOD + ";": None,
    GOOD + '\r': None,
    GOOD.replace("AC=1;AN=2", 'N="a;b\t""c""",d="x"'): None,
    GOOD.replace("AC=1;AN=2", 'N="a;b\t""c""";AN=2'): None,
    GOOD.replace("AC=1;AN=2", 'N="a","b";AC=1'): None,
    GOOD.replace("AC=1;AN=2", "."): None,
    GOOD.replace("AC=1;AN=2", 'N="a'): "quoting",
    GOOD.replace("AC=1;AN=2", 'N="a"x'): "quoting",
    GOOD.replace("AC=1;AN=2", 'N=x"a"'): "quoting",
    GOOD.replace("AC=1;AN=2", 'DB;"a"'): "quoting",
    GOOD.replace("\t.\t", '\t"i"\t', 1): "quoting",
    GOOD + "\tx": "columns",
    "chr1\t5": "columns",
    GOOD.replace("\t5\t", "\t0\t"): "pos",
    GOOD.replace("\t5\t", "\t4294967295\t"): None,
    GOOD.replace("\t5\t", "\t4294967296\t"): "pos",
    GOOD.replace("\t5\t", "\t٣\t"): "pos",
    GOOD.replace("\t5\t", "\t" + "9" * 5000 + "\t"): "pos",
    GOOD.replace("\tA\t", "\tAX\t"): "ref",
    GOOD.replace("\tA\t", "\t\t"): "ref",
    GOOD.replace("\tC\t", "\tC,<DEL:x_1->,*\t").replace("AC=1", "AC=0,1,1"): None,
    GOOD.replace("\tC\t", "\tC,\t"): "alt",
    GOOD.replace("\tC\t", "\t.\t"): None,
    GOOD.replace("\tC\t", "\tC,G\t"): "info",
    GOOD.replace("1e3", "-1"): "qual",
    GOOD.replace("1e3", "1e"): "qual",
    GOOD.replace("1e3", "."): None,
    GOOD.replace("AN=2", "AN=0"): "info",
    GOOD.replace("AN=2", "AN=-2"): "info",
    GOOD.replace("AN=2", "AN"): "info",
    GOOD.replace(";", ";;"): "info",
    GOOD.replace("AC=1;AN=2", ""): "info",
    GOOD.replace("AC=1;AN=2", ";"): "info",
    GOOD.replace("AC=1;AN=2", "9K=1"): "info",
    GOOD.replace("AC=1;AN=2", "_k.1=;DB"): None,
}


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    assert parse_line(line, 8)[0] == LINES[line]


def test_assembled_columns_are_the_lines_own():
    line = GOOD.replace("AC=1;AN=2", 'N="a\tb";AN=2') + "\tGT\t0/1"
    assert assemble_columns(line)[7:] == ['N="a\tb";AN=2', "GT", "0/1"]
    assert "\t".join(assemble_columns(line)) == line


def test_files_and_odd_lines(spark):
    head = "#CHROM\t" + "\t".join("abcdefg")
    rows = [
        (1, "f", 1, "##x"), (2, "f", 2, head), (3, "f", 3, GOOD), (4, "f", 4, None), (5, "f", 5, ""), (6, "f", 6, " \t "), (7, "f", 7, "\r"), (8, "f", 8, GOOD + "\tGT\t1"),
        (9, "g", 1, GOOD + "\tGT\t1"), (10, "g", 2, "chr1\t5"), (11, None, 1, head + "\tFORMAT\ts"), (12, None, 2, GOOD), (13, "f", 9, head + "\tFORMAT\ts"), (14, "f", 10, GOOD + " "),
    ]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no bigint, line_text string").withColumn("reason", F.lit("clash"))
    got = {r.line_id: r for r in parse_variant_lines(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {3: None, 8: "columns", 9: None, 10: "columns", 12: "columns", 14: "info"}
    assert (got[3].vcf_pos, got[3].vcf_qual, got[3].vcf_format, got[9].genotype) == (5, 1000.0, None, "1")
    assert parse_variant_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_join_checked_both_ways(spark, monkeypatch, limit, how):
    big = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c"), (3, "d")], "k bigint, x string")
    small = spark.createDataFrame([(1, 10), (None, 30), (4, 40)], "k bigint, y bigint")
    got = sorted((tuple(r) for r in join_checked(big, small, ["k"], how, limit=limit).collect()), key=str)
    plain = big.alias("b").join(small.alias("s"), F.col("b.k").eqNullSafe(F.col("s.k")), how)
    plain = plain.select("b.k", "x", *(["y"] if how in ("left", "inner") else []))
    assert got == sorted((tuple(r) for r in plain.collect()), key=str)
    assert joins.BROADCAST_BYTES > 0


@pytest.mark.parametrize("slices", [1, 8, 4096])
def test_key_summary_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(heavy_keys, "SLICES", slices)
    rng = random.Random(slices)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, 0, 7, 7, rng.randrange(1000)]), rng.randrange(3)) for _ in range(600)] + [("only", None, 1), ("two", 4, 1), ("two", 6, 1)]
    df = spark.createDataFrame(rows, "g string, key bigint, rows bigint")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = set()
    for g, part in groups.items():
        values = sorted(r[1] for r in part if r[1] is not None)
        middle = values[(len(values) + 1) // 2 - 1] if values else None
        want.add((g, len(part), len(set(part)), values[0] if values else None, values[-1] if values else None, middle))
    assert {tuple(r) for r in key_summary(df, F.col("g"), "key", 1000).collect()} == want
    assert key_summary(df.limit(0), F.col("g"), "key", 1000).count() == 0


def test_rows_once(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None)]
    df = spark.createDataFrame(rows, "k bigint, x string")
    assert sorted(map(tuple, joins.rows_once(df, "k").collect()), key=str) == sorted(set(rows), key=str)
    monkeypatch.setattr(joins, "fits_broadcast", lambda small: False)
    assert sorted(map(tuple, joins.rows_once(df, "k").collect()), key=str) == sorted(set(rows), key=str)
    assert joins.rows_once(df.limit(0), "k").count() == 0


def test_bytes_of_a_side(spark):
    df = spark.createDataFrame([("ab", [1, 2], [("x",)]), (None, None, None)], "s string, a array<bigint>, t array<struct<n:string>>")
    assert joins.fits_broadcast(df, 2 + 16 + 1 + 2 * joins.ROW_BYTES) and not joins.fits_broadcast(df, 2 + 16 + 2 * joins.ROW_BYTES)
    assert joins.fits_broadcast(df.limit(0), 0)


def test_a_cluster_must_name_its_checkpoint_folder():
    from types import SimpleNamespace

    from genoframe.tables import ensure_checkpoint_dir

    made = []
    session = lambda master, named: SimpleNamespace(conf={"spark.checkpoint.dir": named} if named else {}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append))
    assert ensure_checkpoint_dir(session("spark://x:7077", "/shared")) == "/shared" and made == ["/shared"]
    assert ensure_checkpoint_dir(session("local[4]", None)) == made[-1]
    for master in ("spark://x:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(session(master, None))
