
import re

import pytest
from pyspark.sql import functions as F

from genoframe.functions.info import format_value
from genoframe.plans import reference
from genoframe.tables import read_table
from oracle import DATA
from test_packed_fields import slow_split

SF = f"{DATA}/sf0.001"
CALLS = "call_id bigint, sample_id string, vcf_kind string, vcf_chrom string, vcf_pos bigint, vcf_ref string, vcf_alt string, vcf_qual double, vcf_filter string, vcf_format string, genotype string"


def use_calls(monkeypatch, spark, calls):
    """Puts (vcf_alt, vcf_format, genotype) of sample s at chr1:7 in the place of vcf_calls."""
    chrom = read_table(spark, SF, "contigs").orderBy("contig_id").first().contig_name
    rows = [(i, "s", "personal", chrom, 7, "G", *c[:1], 50.0, "PASS", *c[1:]) for i, c in enumerate(calls)]
    given = spark.createDataFrame(rows, CALLS)
    monkeypatch.setattr(reference, "read_table", lambda s, sf, name: given if name == "vcf_calls" else read_table(s, sf, name))


def slow_dosages(calls, key):
    """(chromosome key, position, ref, alt, sample) -> dosage, by layouts that ``key`` splits."""
    want = {}
    for r in calls:
        keys = key(r.vcf_format)
        values = (r.genotype or "").split(":")
        if "GT" not in keys or keys.index("GT") >= len(values) or r.sample_id is None:
            continue
        parts = re.findall("[0-9]+", values[keys.index("GT")])
        for number, alt in enumerate(slow_split(r.vcf_alt, "vcf_alt"), 1):
            if re.fullmatch("[ATGC]", alt.upper()):
                at = (re.sub("^chr", "", r.vcf_chrom.strip().lower()), r.vcf_pos, r.vcf_ref, alt.upper(), r.sample_id)
                want[at] = max(want.get(at, 0), sum(int(p) == number for p in parts))
    return want


def test_dosages_of_multi_allelic_calls(spark, monkeypatch):
    use_calls(monkeypatch, spark, [(' "t";A|TT ', "GT", "1/2"), ("<DEL>, c", "GT", "2|2")])
    assert {(r.site_id.split(":")[-1], r.dosage) for r in reference.sample_dosages(spark, SF).collect()} == {("T", 1), ("A", 1), ("C", 2)}


def test_dosages_against_plain_reading(spark):
    want = slow_dosages(read_table(spark, SF, "vcf_calls").collect(), lambda layout: slow_split(layout, "vcf_format"))
    known = {re.sub("^chr", "", r.contig_name.strip().lower()) for r in read_table(spark, SF, "contigs").collect()}
    got = {}
    for r in reference.sample_dosages(spark, SF).collect():
        chrom, pos, ref, alt = r.site_id.rsplit(":", 3)
        got[(re.sub("^chr", "", chrom.strip().lower()), int(pos), ref, alt, r.sample_id)] = r.dosage
    assert got == {k: v for k, v in want.items() if k[0] in known}


@pytest.mark.parametrize("layout", ["GT:DP", "GT;DP", '"GT:DP"', "GT::DP", " GT | DP ", '"GT","DP"', "GT\tDP,", ";GT,:DP"])
def test_format_value_in_any_writing(spark, layout):
    value = lambda tag: format_value(F.lit(layout), F.lit("0/1:7"), tag)
    assert tuple(spark.range(1).select(value("GT"), value("DP"), value("VAF")).first()) == ("0/1", "7", None)


def test_format_value_of_missing_layouts(spark):
    df = spark.createDataFrame([(None,), ("",), (".",), ("GT",)], "layout string")
    assert [r[0] for r in df.select(format_value(F.col("layout"), F.lit("0/1"), "GT")).collect()] == [None, None, None, "0/1"]


def test_depth_and_frequency_against_plain_reading(spark):
    def number(r, key, kind):
        keys, values = slow_split(r.vcf_format, "vcf_format"), (r.genotype or "").split(":")
        try:
            return kind(values[keys.index(key)])
        except (ValueError, IndexError):
            return None

    calls = {(r.call_id, r.vcf_kind, number(r, "DP", int), number(r, "VAF", float)) for r in read_table(spark, SF, "vcf_calls").filter("vcf_filter = 'PASS' and vcf_qual > 30").collect()}
    known = {r.call_id for r in reference._calls(spark, SF).select("call_id").collect()}
    want = {c for c in calls if c[0] in known and c[2] is not None and c[2] > 30}
    assert {(r.call_id, r.vcf_kind, r.depth, r.freq) for r in reference.passing_calls(spark, SF).collect()} == want


def use_reads(monkeypatch, spark, given):
    """Puts (sample_id, pos, cigar, seq) on the first contig and sites (pos, ref, alt, info) there."""
    chrom = read_table(spark, SF, "contigs").orderBy("contig_id").first().contig_name
    reads = [(i, f"q{i}", 2, chrom, pos, cg, seq, "I" * len(seq), s) for i, (s, pos, cg, seq) in enumerate(given["reads"])]
    sites = [(i, chrom, pos, ref, alt, 50.0, "PASS", info, 1) for i, (pos, ref, alt, info) in enumerate(given["sites"])]
    tables = {
        "alignments": spark.createDataFrame(reads, "ord bigint, qname string, flag int, reference_name string, pos bigint, cigar string, seq string, qual string, sample_id string"),
        "vcf_sites": spark.createDataFrame(sites, "rec_id bigint, vcf_chrom string, vcf_pos bigint, vcf_ref string, vcf_alt string, vcf_qual double, vcf_filter string, vcf_info string, loaded_at int"),
    }
    monkeypatch.setattr(reference, "read_table", lambda s, sf, name: tables[name] if name in tables else read_table(s, sf, name))


PERSONS = {
    "sites": [(3, "A", "C", "AC=100;AN=100")],
    "reads": [("x", 1, "5M", "TTATT")] * 9 + [("y", 1, "5M", "TTCTT")] + [(None, 1, "5M", "TTGTT")] * 2 + [("x", 1, "5M", "TTATT"), ("z", 9, "3M", "AAA")],
}


def test_genotypes_are_each_persons_own(spark, monkeypatch):
    use_reads(monkeypatch, spark, PERSONS)
    calls = {(r.sample_id, r.idx, r.allele_a, r.allele_b) for r in reference.genotype_calls(spark, SF).collect()}
    assert calls == {("x", 2, "A", "A"), ("y", 2, "C", "C"), (None, 2, "G", "G")}
    assert {(r.sample_id, r.n_a, r.n_c, r.n_g) for r in reference.pileup_counts(spark, SF).collect()} == {("x", 10, 0, 0), ("y", 0, 1, 0), (None, 0, 0, 2)}


def test_masks_records_and_counters_are_each_persons_own(spark, monkeypatch):
    use_reads(monkeypatch, spark, PERSONS)
    # The population has C alone: y keeps it, the others take it, those of unknown person too.
    assert {r.seq for r in reference.masked_reads(spark, SF).filter("ord < 13").collect()} == {"TTCTT"}
    assert {(r.sample_id, r.idx, r.perm_a) for r in reference.difference_records(spark, SF).collect()} == {("x", 2, "CTGA"), (None, 2, "ATCG")}
    got = {r.sample_id: (r.n_reads, r.n_covering, r.n_variants, r.n_changed_cells, r.n_changed_reads, r.n_records) for r in reference.run_counters(spark, SF).collect()}
    assert got == {"x": (10, 10, 1, 10, 10, 1), "y": (1, 1, 1, 0, 0, 0), None: (2, 2, 1, 2, 2, 1), "z": (1, 0, 1, 0, 0, 0)}
    assert [r.seq for r in reference.unmasked_reads(spark, SF).orderBy("ord").collect()] == [seq for _, _, _, seq in PERSONS["reads"]]


def test_indel_masked_reads_has_every_read(spark):
    want = {r.ord for r in read_table(spark, SF, "alignments").select("ord").collect()}
    assert sorted(r.ord for r in reference.indel_masked_reads(spark, SF).select("ord").collect()) == sorted(want)


def test_packed_reads_has_every_read(spark, monkeypatch):
    use_reads(monkeypatch, spark, {"sites": [], "reads": [("x", 1, "4M", "ATGC"), ("x", 1, "4M", "ANGC")]})
    assert sorted(tuple(r) for r in reference.packed_reads(spark, SF).select("ord", "seq", F.col("packed").isNull()).collect()) == [(0, "ATGC", False), (1, "ANGC", True)]
