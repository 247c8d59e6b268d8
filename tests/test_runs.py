"""Whole masking runs over both kinds of variants, undone in every mode."""

import pytest
from pyspark.sql import functions as F

from genoframe.operators import differences, reads, runs, variants
from genoframe.sources import text_formats
from oracle import DATA

SECRET = b"\x0f" * 16
READ = "ord bigint, qname string, flag int, reference_name string, pos bigint, cigar string, seq string, qual string, sample_id string, extra string"
# Two persons and one without a name over an SNV (index 5), an insertion (20) and a deletion (40); unmapped reads.
ROWS = [
    (2, "chr1", 1, "10M", "ACGTACGTAC", "s1"), (2, "chr1", 3, "10M", "GTACGTACGT", "s1"), (2, "CHR1", 2, "9M", "CGTAGGTAC", "s1"), (2, "chr1", 1, "10M", "ACGTATGTAC", "s2"), (2, "chr1", 1, "10M", "ACGTACGTAC", None),
    (2, "chr1", 18, "10M", "TTTAGTCCAG", "s1"), (2, "chr1", 18, "4M2I6M", "TTTACCGTCCAG", "s1"), (2, "chr1", 19, "3M2I5M", "TTACCGTCCA", "s2"), (2, "chr1", 18, "4M2I1D5M", "TTTACCTCCAG", "s2"),
    (2, "chr1", 38, "10M", "CCCGTTACGT", "s1"), (2, "chr1", 38, "4M2D4M", "CCCGACGT", "s2"), (2, "chr1", 38, "4M2D4M", "CCCGACGT", "s2"), (4, "*", 0, "*", "ACGTNACG", "s1"), (4, None, None, "*", "*", "s2"), (4, "*", 0, "*", "ACRG", None),
]
KINDS = "idx bigint, is_snv boolean, ref_allele string, alleles array<string>, counts array<bigint>"
KNOWN = [
    (5, True, "C", ["A", "T", "G", "C"], [5, 5, 0, 0]), (20, False, "A", ["A", "ACC"], [1, 0]), (40, False, "GTT", ["GTT", "G"], [0, 9]), (41, True, "T", ["A", "T", "G", "C"], [9, 0, 0, 0]),
]


@pytest.fixture(scope="module")
def two_contigs(spark):
    return spark.createDataFrame([(0, "chr1", 0, 1000), (1, "chr2", 1000, 1000)], "contig_id int, contig_name string, start_idx bigint, contig_length bigint")


def placed(spark, contigs, rows):
    full = [(i, f"q{i}", f, n, p, c, s, "*" if s == "*" else "#" * len(s), who, "x") for i, (f, n, p, c, s, who) in rows]
    return reads.place_reads(spark.createDataFrame([*full, *full[:2]], READ), contigs)


@pytest.fixture(scope="module")
def run(spark, two_contigs):
    kept = runs.kept_variants(spark.createDataFrame(KNOWN, KINDS), variants.random_snvs(spark, 0, 2000, 0, 1), two_contigs).checkpoint()
    whole = runs.mask_reads(placed(spark, two_contigs, list(enumerate(ROWS))), kept, 3, SECRET)
    written = [df.checkpoint() for df in (whole.reads, whole.records, whole.second, whole.changed)]
    return kept, runs.MaskedRun(*written)


def texts(df):
    return {r.ord: (r.seq, r.cigar) for r in df.collect()}


ORIGINAL = {i: (s, c) for i, (_, _, _, c, s, _) in enumerate(ROWS)}


def test_overlapping_variants_are_left_out(run):
    assert sorted(r.idx for r in run[0].collect()) == [5, 20, 40]


def test_both_kinds_and_unmapped_reads_change(run):
    masked = texts(run[1].reads)
    assert len(masked) == len(ROWS)
    changed = {i for i in masked if masked[i] != ORIGINAL[i]}
    assert {0, 4, 12} <= changed and changed & {5, 6, 7} and changed & {9, 10, 11}
    # What can't be ciphered stays, and so does the insertion that a deletion follows.
    assert not changed & {8, 13, 14}
    assert masked[12][0][4] == "N"
    assert {r.ord for r in run[1].changed.collect()} == changed - {12}


def test_each_person_is_masked_as_if_alone(spark, two_contigs, run):
    kept, whole = run
    masked = texts(whole.reads)
    for who in ("s1", "s2", None):
        own = [(i, r) for i, r in enumerate(ROWS) if r[5] == who]
        alone = runs.mask_reads(placed(spark, two_contigs, own), kept, 3, SECRET)
        assert texts(alone.reads) == {i: masked[i] for i, _ in own}
        key = lambda df: sorted(map(str, df.filter(F.col("sample_id").eqNullSafe(F.lit(who))).collect()))
        assert key(alone.records) == key(whole.records)


def test_every_mode_of_unmasking_restores(run):
    _, whole = run
    args = (whole.reads, whole.records, whole.second)
    mapped = {i for i, r in enumerate(ROWS) if r[0] == 2}
    assert texts(runs.unmask_reads(*args)) == {i: ORIGINAL[i] for i in mapped}
    near = {i for i in mapped if 17 <= ROWS[i][2] <= 20}
    assert texts(runs.unmask_reads(*args, start=18, end=30)) == {i: ORIGINAL[i] for i in near}
    rest = set(range(len(ROWS))) - mapped
    assert texts(runs.unmask_reads(*args, start=18, end=30, include_unmapped=True, secret=SECRET)) == {i: ORIGINAL[i] for i in near | rest}
    assert texts(runs.unmask_reads(*args, unmapped_only=True, secret=SECRET)) == {i: ORIGINAL[i] for i in rest}
    with pytest.raises(ValueError):
        runs.unmask_reads(*args, unmapped_only=True)


def test_records_as_text_and_back(spark, run, tmp_path):
    _, whole = run
    numbers = whole.reads.select("ord", F.col("ord").alias("number"))
    lines = [r.line for r in differences.as_text(whole.records, whole.second, numbers).orderBy("idx", "sample_id").collect()]
    n_snvs = whole.records.filter("is_snv").count()
    head = differences.text_head({"secret": SECRET.hex(), "_from_index": 0}, n_snvs, len(lines) - n_snvs, 40)
    assert head[:3] == ["{", '    "_from_index": 0,', f'    "secret": "{SECRET.hex()}"'] and head[-1] == "index_size\t0"
    (tmp_path / "d.txt").write_text("\n".join([*head, *lines]) + "\n")
    names = ("idx", "is_snv", "ref_id", "zygosity", "images_a", "images_b")
    again = text_formats.read_differences(spark, str(tmp_path / "d.txt")).select(*names)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.records.select(*names).collect()))
    with pytest.raises(Exception, match="no reference"):
        differences.as_text(whole.records.withColumn("ref_id", F.lit(9)), whole.second, numbers).collect()


def test_nothing_to_mask(spark, two_contigs, run):
    kept, _ = run
    some = placed(spark, two_contigs, list(enumerate(ROWS)))
    none = runs.mask_reads(some, kept.limit(0), 3, SECRET)
    assert none.records.count() == 0 and texts(none.reads.filter("mapped")) == {i: ORIGINAL[i] for i, r in enumerate(ROWS) if r[0] == 2}
    assert runs.mask_reads(some.limit(0), kept, 3, SECRET).reads.count() == 0


def test_runs_change_the_given_reads(spark):
    """On the tables, what the twins of unmasking compare did change before."""
    from genoframe.plans import reference

    run = reference._run(spark, f"{DATA}/sf0.01")
    kinds = {r.is_snv: r["count"] for r in run.records.groupBy("is_snv").count().collect()}
    assert kinds[True] > 50 and run.changed.count() > 50
    originals = reference._reads(spark, f"{DATA}/sf0.01").filter("not mapped").select("ord", F.col("seq").alias("was"))
    assert run.reads.join(originals, "ord").filter("seq <> was").count() > 100
