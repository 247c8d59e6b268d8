"""Scalar functions, reads, pile-ups, masking, sets, sources and streaming on small inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from genoframe.functions import bases, cigar
from genoframe.functions.draws import uniform, weighted_index
from genoframe.functions.info import alternative_frequency, format_value, info_counts, info_number, with_reference_count
from genoframe.functions.sealing import seal, seal_cbc, unseal, unseal_cbc
from genoframe.operators import contigs, differences, genotype_matrix, interval_join, masking, pileup, position_sets, reads, variants
from genoframe.sources import text_formats
from genoframe.streaming.coverage import windowed_coverage


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*values):
    return F.array(*[F.lit(v) for v in values])


# Functions


@pytest.mark.parametrize(
    ("seq", "key", "want"),
    [("ATGC", "00", "ATGC"), ("ATGC", "FF", "CGTA"), ("ATGC", "D8", "CAAC"), ("ATNC", "D8", "CANC"), ("ATGCATNC", "D8D8", "CAACCANC"), ("ATGCAT", "D8", "CAACCA"), ("", "D8", ""), (None, "D8", None)],
)
def test_stream_cipher(spark, seq, key, want):
    key = F.unhex(F.lit(key))
    once = bases.stream_cipher(F.lit(seq).cast("string"), key)
    assert one(spark, once, bases.stream_cipher(once, key)) == (want, seq)


def test_stream_cipher_refuses_other_letters(spark):
    with pytest.raises(Exception, match="not a base"):
        one(spark, bases.stream_cipher(F.col("id").cast("string"), F.unhex(F.lit("FF"))))


@pytest.mark.parametrize(("seq", "bits"), [("ATGC", "1B"), ("CGTA", "E4"), ("AT", "10"), ("GC", "B0"), ("ATGCGC", "1BB0"), ("", ""), ("AN", None)])
def test_packed_bases(spark, seq, bits):
    packed = bases.pack_bases(F.lit(seq))
    back = seq if bits is not None else None
    assert one(spark, F.hex(packed), bases.unpack_bases(packed, F.length(F.lit(seq)))) == (bits, back)


@pytest.mark.parametrize(("permutation", "code"), [("AAAA", 0), ("ATGC", 0b11100100), ("CGTA", 0b00011011)])
def test_permutation_codes(spark, permutation, code):
    assert one(spark, bases.permutation_code(F.lit(permutation)), bases.code_permutation(F.lit(code))) == (code, permutation)


def test_variant_classes(spark):
    cases = [(["A", "T"], True, False), (["A"], False, False), (["A", "N"], False, False), (["A", "AT"], False, True), (["A", ""], False, False), (["AT", ""], False, True), (["A", "*"], False, False), (["<X>", "A"], False, False)]
    for alleles, snv, indel in cases:
        assert one(spark, bases.is_snv(lits(*alleles)), bases.is_indel(lits(*alleles))) == (snv, indel)
    assert one(spark, bases.shares_first_base(lits("AT", "A", "AC")), bases.shares_first_base(lits("AT", "C"))) == (True, False)


def test_cigar_forms(spark):
    short, full = F.lit("2M3I1M1D2M"), F.lit("MMIIIMDMM")
    assert one(spark, cigar.expand(short), cigar.shrink(full), cigar.reference_length(short), cigar.read_length(short)) == ("MMIIIMDMM", "2M3I1M1D2M", 6, 8)
    assert one(spark, cigar.reference_length(F.lit("*")), cigar.expand(F.lit("*"))) == (0, "")
    assert one(spark, cigar.op_tuples(F.lit("2M3I1=")), cigar.expand_tuples(cigar.op_tuples(F.lit("2M3I1=")))) == ([(0, 2), (1, 3), (7, 1)], "MMIII=")
    for text, at, want in [("HM", 0, 1), ("M", 0, 0), ("HHM", 1, None), ("MM", 1, 1), ("SSMMM", 3, 3), ("M", 1, None), ("MIIMDMM", 4, 5)]:
        assert one(spark, cigar.unit_of_base(F.lit(text), F.lit(at))) == (want,)
    for allele, ref, want in [("", "", ""), ("G", "G", "M"), ("", "G", "D"), ("GGG", "G", "MII"), ("T", "GG", "MD"), ("C", "CTT", "MDD"), ("CG", "CG", "MM")]:
        assert one(spark, cigar.allele_cigar(F.lit(allele), F.lit(ref))) == (want,)


@pytest.mark.parametrize(
    ("seq", "units", "alleles", "ref", "at", "want"),
    [
        ("TTAAAC", "MMMMMM", ["A", "AAAC"], "A", 2, "A"), ("TTAAAC", "MMMIII", ["A", "AAAC"], "A", 2, "AAAC"), ("AA", "MI", ["A", "AA", "AC"], "A", 0, "AA"), ("AC", "MI", ["A", "AA", "AC"], "A", 0, "AC"),
        ("A", "MD", ["A", "AT"], "AT", 0, "A"), ("CA", "MM", ["C", "CAT"], "C", 0, "C"), ("C", "M", ["C", "CAT"], "C", 0, None), ("GAA", "MII", ["G", "GA"], "G", 0, None),
        ("TTC", "MMMD", ["TTC", "T"], "TTC", 0, None), ("ATA", "MII", ["A", "ATT"], "A", 0, None),
    ],
)
def test_matching_allele(spark, seq, units, alleles, ref, at, want):
    assert one(spark, cigar.matching_allele(F.lit(seq), F.lit(units), lits(*alleles), F.lit(ref), F.lit(at), F.lit(at))) == (want,)


def test_place_allele(spark):
    def put(old, new, qual):
        cell = F.struct(F.lit(1).alias("seq_pos"), F.lit(1).alias("unit"), F.lit(old).alias("old"), F.lit(new).alias("new"), F.lit("A").alias("ref_allele"))
        units = {"A": "MMM", "AC": "MMIM"}[old]
        return tuple(one(spark, cigar.place_allele(cell, F.lit("T" + old + "G"), F.lit(units), F.lit(qual)))[0])

    assert put("A", "ACC", "*") == ("TACCG", "MMIIM", "*")
    assert put("A", "AC", "!#$") == ("TACG", "MMIM", "!##$")
    assert put("AC", "A", "abcd") == ("TAG", "MMM", "abd")
    assert put("A", "C", "abc") == ("TCG", "MMM", "abc")


def test_info_and_formats(spark):
    info = F.lit("DP=3;AC=1,2;AN=9;AC=5")
    assert one(spark, info_counts(info), info_number(info), info_counts(F.lit("XAC=1")), info_counts(F.lit("AC=1,x")), info_number(F.lit(None).cast("string"))) == ([1, 2], 9, None, None, None)
    assert one(spark, with_reference_count(lits(1, 2), F.lit(9)), alternative_frequency(lits(3, 1), F.lit(0))) == ([6, 1, 2], 0.25)
    assert one(spark, format_value(F.lit("GT:DP"), F.lit("0/1:7"), "DP"), format_value(F.lit("GT:DP"), F.lit("0/1"), "DP"), format_value(F.lit("GT"), F.lit("0/1"), "DP")) == ("7", None, None)


def test_draws(spark):
    u = [r[0] for r in spark.range(2000).select(uniform(1, "x", F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.03
    for weights, draw, want in [((5.0,), 0.9, 0), ((1.0, 1.0), 0.49, 0), ((1.0, 1.0), 0.5, 1), ((0.0, 2.0, 0.0), 0.0, 1), ((0.0, 0.0), 0.7, 1)]:
        assert one(spark, weighted_index(lits(*weights), F.lit(draw))) == (want,)


# Contigs and reads


@pytest.fixture(scope="module")
def two_contigs(spark):
    return spark.createDataFrame([(0, "chr1", 0, 10_000), (1, "chr2", 10_000, 10_000)], "contig_id int, contig_name string, start_idx bigint, contig_length bigint")


def test_positions_and_back(spark, two_contigs):
    df = spark.createDataFrame([(1, "CHR2", 1), (2, "1", 10_000), (3, None, 5), (4, "x", 5)], "k bigint, name string, p bigint")
    placed = contigs.with_index(df, two_contigs, "name", "p")
    assert {(r.k, r.idx) for r in placed.collect()} == {(1, 10_000), (2, 9_999)}
    assert {(r.k, r.contig_name, r.ref_pos) for r in contigs.with_position(placed.select("k", "idx"), two_contigs).collect()} == {(1, "chr2", 1), (2, "chr1", 10_000)}
    assert contigs.with_index(df, two_contigs, "name", "p", "left").count() == 4
    assert contigs.with_position(spark.createDataFrame([(20_000,)], "idx bigint"), two_contigs).count() == 0


def test_ranges(two_contigs):
    assert contigs.parse_range("chr1") == ("chr1", None, None, None)
    assert contigs.parse_range("chr1:5") == ("chr1", 5, None, None)
    assert contigs.parse_range("chr1:5:9") == ("chr1", 5, "chr1", 9)
    assert contigs.parse_range("chr1:5:chr2:9") == ("chr1", 5, "chr2", 9)
    assert contigs.resolve_range(two_contigs, None, None, None, None) == (0, 19_999)
    assert contigs.resolve_range(two_contigs, "chr1", 5, "chr1", None) == (4, 9_999)
    assert (contigs.contig_id(two_contigs, "CHR2"), contigs.contig_name(two_contigs, 0)) == (1, "chr1")
    assert contigs.resolve_position(two_contigs, 10_000) == ("chr2", 1) and contigs.resolve_position(two_contigs, 9_999) == ("chr1", 10_000)
    for lookup, bad in ((contigs.contig_id, "chr9"), (contigs.contig_name, 7), (contigs.resolve_position, 20_000)):
        with pytest.raises(ValueError):
            lookup(two_contigs, bad)
    for bad in [("chr9", None, None, None), (None, 4, None, None), ("chr2", 5, "chr1", 5)]:
        with pytest.raises(ValueError):
            contigs.resolve_range(two_contigs, *bad)
    for bad in ("chr1:0", "a:1:b:2:3", ""):
        with pytest.raises(ValueError):
            contigs.parse_range(bad)


READ = "ord bigint, qname string, flag int, reference_name string, pos bigint, cigar string, seq string, qual string, sample_id string"


def make_reads(spark, two_contigs, rows):
    full = [(i, f"q{i}", flag, name, pos, cg, seq, "*", None) for i, (flag, name, pos, cg, seq) in enumerate(rows)]
    return reads.place_reads(spark.createDataFrame([*full, *full[:1]], READ), two_contigs)


def test_scans(spark, two_contigs):
    placed = make_reads(spark, two_contigs, [(2, "chr1", 1, "10M", "A" * 10), (2, "chr1", 100, "5M5D5M", "A" * 10), (4, "*", 0, "*", "ACG"), (2, None, 5, "3M", "ACG"), (4, "chr1", 7, "*", "ACG"), (2, "chr2", 1, "4S4M", "A" * 8)])
    ids = lambda **k: sorted(r.ord for r in reads.scan_reads(placed, **k).collect())
    assert placed.count() == 6 and ids() == [0, 1, 5]
    assert ids(unmapped_only=True, include_unmapped=True) == [2, 3, 4]
    assert ids(start=9, end=99) == [0] and ids(start=10, end=99) == [] and ids(start=10, end=99, end_inclusive=True) == [1]
    assert ids(start=113, end=10_001) == [1, 5] and ids(start=114, end=10_000) == []
    assert ids(start=0, end=1, include_unmapped=True) == [0, 2, 3, 4]
    with pytest.raises(ValueError):
        reads.scan_reads(placed, 5, 4)


def test_scans_of_a_table_push_ranges_down(spark, two_contigs, tmp_path, monkeypatch):
    """The same reads as a scan of placed ones, with names and positions in the scan's filters."""
    rng = random.Random(3)
    rows = [(i, f"q{i}", rng.choice([2, 2, 2, 4]), rng.choice(["chr1", "CHR1", "1", "chr2", "2", None, "*", "x"]), rng.choice([0, None, *range(1, 200)]), rng.choice(["10M", "5M5D5M", "4M90N4M"]), "A" * 10, "*", "s") for i in range(400)]
    spark.createDataFrame([*rows, *rows[:30]], READ).write.parquet(str(tmp_path / "reads"))
    table = spark.read.parquet(str(tmp_path / "reads"))
    placed = reads.place_reads(table, two_contigs)
    modes = [{}, {"start": 50, "end": 120}, {"start": 150, "end": 10_060, "end_inclusive": True}, {"end": 10_020}, {"start": 10_010}, {"start": 50, "end": 120, "include_unmapped": True}, {"unmapped_only": True}]
    for most in (1000, 0):
        monkeypatch.setattr(reads, "MAX_SPELLINGS", most)
        for mode in modes:
            got = sorted(r.ord for r in reads.scan_alignments(table, two_contigs, **mode).collect())
            assert got == sorted(r.ord for r in reads.scan_reads(placed, **mode).collect()), mode
    monkeypatch.setattr(reads, "MAX_SPELLINGS", 1000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = reads.scan_alignments(table, two_contigs, 50, 120)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(pos,121)" in plan and "In(reference_name, [1,CHR1,chr1])" in plan


@pytest.mark.parametrize("width", [1, 7, 256])
def test_interval_join_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(interval_join, "MAX_BINS", 5)
    rng = random.Random(width)
    spans = [(i, s, s + rng.choice([0, 3, 40, 900])) for i, s in enumerate(rng.randrange(2000) for _ in range(150))] + [(999, None, None)]
    points = [(p,) for p in range(0, 3000, 13)] + [(None,)]
    df, at = spark.createDataFrame(spans, "ord bigint, start_idx bigint, end_idx bigint"), spark.createDataFrame(points, "idx bigint")
    want = Counter((o, p) for o, s, e in spans if s is not None for (p,) in points if p is not None and s <= p <= e)
    assert Counter((r.ord, r.idx) for r in interval_join.covering_pairs(df, at, width).collect()) == want
    assert {r.ord for r in interval_join.covering_reads(df, at).collect()} == {o for o, _ in want}
    assert interval_join.covering_pairs(df.limit(0), at).count() == 0


def test_cells_of_gapped_reads(spark, two_contigs):
    placed = make_reads(spark, two_contigs, [(2, "chr1", 1, "2S3M2I2M2D3M", "TTACGTTGANAA")])
    at = spark.createDataFrame([(i,) for i in range(12)], "idx bigint")
    got = {r.idx: (r.seq_pos, r.unit, r.allele) for r in pileup.snv_cells(placed, at).collect()}
    assert got == {0: (2, 2, "A"), 1: (3, 3, "C"), 2: (4, 4, "G"), 3: (7, 7, "G"), 4: (8, 8, "A"), 5: (None, None, None), 6: (None, None, None), 7: (9, 11, None), 8: (10, 12, "A"), 9: (11, 13, "A")}


def test_genotype_calls(spark):
    rows = [(1, [10, 0, 0, 0]), (2, [8, 2, 0, 0]), (3, [81, 19, 0, 0]), (4, [4, 3, 3, 0]), (5, [0, 2, 0, 2])]
    df = spark.createDataFrame(rows, "idx bigint, counts array<bigint>")
    assert {r.idx: (r.allele_a, r.allele_b) for r in pileup.call_genotypes(df).collect()} == {1: ("A", "A"), 2: ("A", "T"), 3: ("A", "A"), 4: (None, None), 5: ("T", "C")}


# Allele-count tables

VCF = [
    ("chr1", 1111, "C", "T", "AC=20;AN=100"), ("chr2", 1031, "A", "G,T", "AC=10,5;AN=100"), ("chr2", 1042, "TCG", "TG,T,TCAG", "AC=5,10,15;AN=100"), ("chr2", 1090, "T", "*", "AC=5;AN=100"), ("chr2", 1100, "T", ".", "AC=5;AN=100"),
    ("chr2", 1120, "N", "T,C", "AC=1,1;AN=100"), ("chr2", 1160, "A", "<INS:ME>", "AC=1;AN=100"), ("chr2", 1182, "GCG", "G,GCGCG", "AC=10,5;AN=100"), ("chr2", 1031, "A", "C", "AC=1;AN=100"), ("chr2", 1300, "A", "C", "AC=0;AN=100"),
    ("chr2", 1300, "A", "G", "AC=7;AN=100"), ("chr2", 1400, "A", "C", "AC=9;AN=5"), ("chr2", 1500, "AT", "CT", "AC=1;AN=5"), ("chr2", 1600, "A", "C", "AN=5"), ("chr9", 5, "A", "C", "AC=1;AN=5"),
]


def test_allele_count_table_from_text(spark, two_contigs, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"] + ["\t".join([c, str(p), ".", r, a, "47", ".", i]) for c, p, r, a, i in VCF]
    (tmp_path / "in.vcf").write_text("\n".join(lines) + "\n")
    rows = contigs.with_index(text_formats.read_vcf(spark, str(tmp_path / "in.vcf")), two_contigs, "vcf_chrom", "vcf_pos")
    classified = variants.classify(rows)
    first = variants.first_per_index(classified, "ord")
    snv, indel = variants.snv_table(first), variants.indel_table(first)
    text = [r.line for r in text_formats.allele_count_lines(snv, indel).orderBy("block", "idx").collect()]
    assert text == ["3", "2", "1110\t3\t0,20,0,80", "11030\t0\t85,5,10,0", "11299\t0\t93,0,7,0", "11041\t70:TCG,5:TG,10:T,15:TCAG", "11181\t85:GCG,10:G,5:GCGCG"]
    counters = variants.table_counters(classified, first).first().asDict()
    assert counters == {"n_rows": 14, "n_incomplete": 1, "n_unknown": 3, "n_skipped": 0, "n_first_base": 1, "n_no_info": 1, "n_no_alternative": 1, "n_negative": 1, "n_snv": 3, "n_indel": 2, "n_same_index": 1}
    assert variants.first_per_index(variants.classify(rows, skip_indels=True), "ord").count() == 3
    (tmp_path / "table.txt").write_text("\n".join(text) + "\n")
    again = text_formats.read_allele_counts(spark, str(tmp_path / "table.txt"))
    assert sorted(map(str, again[0].collect())) == sorted(map(str, snv.collect())) and sorted(map(str, again[1].collect())) == sorted(map(str, indel.collect()))
    for wrong in ([*text[:2], text[-1], *text[2:-1]], ["2", *text[1:]]):
        (tmp_path / "wrong.txt").write_text("\n".join(wrong) + "\n")
        with pytest.raises(ValueError):
            text_formats.read_allele_counts(spark, str(tmp_path / "wrong.txt"))
    assert variants.same_index(variants.as_variants(snv, indel)).count() == 0


def slow_kept(rows):
    kept, free, group = [], -1, None
    for g, i, n in sorted(rows):
        if g != group or i >= free:
            kept.append((g, i, n))
            group, free = g, i + n
    return kept


@pytest.mark.parametrize("tile", [1, 16, 1 << 20])
def test_non_overlapping_against_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = list({(g, i): (g, i, rng.choice([1, 1, 2, 5, 9])) for g, i in ((rng.choice("ab"), rng.randrange(400)) for _ in range(250))}.values())
    df = spark.createDataFrame(rows, "group string, idx bigint, length bigint")
    assert sorted((r.group, r.idx, r.length) for r in variants.non_overlapping(df, tile).collect()) == slow_kept(rows)
    assert variants.non_overlapping(df.limit(0)).count() == 0


def test_merge_and_random_variants(spark):
    known = variants.random_snvs(spark, 0, 5000, 0.001, 1).select("idx", "is_snv", F.lit("C").alias("ref_allele"), "alleles", "counts").dropDuplicates(["idx"])
    random_ones = variants.random_snvs(spark, 0, 5000, 0.001, 1)
    assert random_ones.count() == 5 and random_ones.filter("idx between 0 and 4999").count() == 5
    assert {r.ref_allele for r in variants.merge_variants(known, random_ones).collect()} == {"C"}
    with pytest.raises(ValueError):
        variants.random_snvs(spark, 0, 10, 0.5, 1)


# Masking


def test_all_masks_are_their_own_inverse_and_turn_genotypes(spark):
    b = "ATGC"
    rows = [(i, *g) for i, g in enumerate((x, y, u, v) for x in b for y in b for u in b for v in b)] + [(999, None, None, "A", "A")]
    got = masking.masks(spark.createDataFrame(rows, "idx bigint, allele_a string, allele_b string, to_a string, to_b string")).collect()
    assert len(got) == 256
    for r in got:
        for perm in (r.perm_a, r.perm_b):
            m = dict(zip(b, perm))
            assert all(m[m[x]] == x for x in b)
        a, c = dict(zip(b, r.perm_a)), dict(zip(b, r.perm_b))
        if r.zygosity in (0, 1):
            assert a[r.allele_a] == r.to_a and c[r.allele_a] == r.to_b
        elif r.zygosity == 2:
            assert {a[r.allele_a], a[r.allele_b]} == {r.to_a, r.to_b}
        else:
            assert a[r.allele_a] == c[r.allele_b] == r.to_a


# Ten reads given by what they show at indices 3 to 14; they begin at three places.
SHOWN = ["GGGGGGGGGG", "ATATATATAT", "CCCCCCCCCC", "CCCCCCCCCC", "AAAAACCCCC", "ACACACACAC", "TTTTTTTTTT", "TTTTTCCCCC", "GGGGGGGGGG", "AGAGAGAGAG", "CCCCCCCCCC", "GGGGGTTTTT"]
SAM = [("".join(column[i] for column in SHOWN)[i % 3 :], 4 + i % 3) for i in range(10)]


def test_masked_reads_are_restored(spark, two_contigs):
    placed = make_reads(spark, two_contigs, [(2, "chr1", pos, f"{len(s)}M", s) for s, pos in SAM])
    counts = [[1, 0, 0, 0], [1, 0, 0, 0], [1, 0, 0, 1], [1, 0, 0, 1], [0, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 1], [1, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 1]]
    table = spark.createDataFrame([(5 + i, c) for i, c in enumerate(counts)], "idx bigint, public array<bigint>")
    cells = pileup.snv_cells(placed, table.select("idx"))
    calls = pileup.call_genotypes(pileup.base_counts(cells)).join(table, "idx")
    masks = masking.masks(masking.draw_public(calls, 3))
    masked = masking.mask_cells(cells, masks, 3)
    change = lambda df, new: df.filter("allele is not null").select("ord", "seq_pos", "unit", F.col("allele").alias("old"), F.col(new).alias("new"), F.col("allele").alias("ref_allele"))
    given = masking.rewrite_reads(placed, change(masked, "masked"))
    assert masked.filter("allele <> masked").count() > 0
    # Index 5 is called C and its population is all A: every C there turns to A.
    at_five = {r.masked for r in masked.filter("idx = 5 and allele = 'C'").collect()}
    assert at_five == {"A"}
    records = masking.difference_table(masked)
    again = pileup.snv_cells(given, records.select("idx"))
    back = masking.rewrite_reads(given, change(masking.unmask_cells(again, records, masking.second_mask_reads(masked)), "restored"))
    assert {r.ord: r.seq for r in back.collect()} == {i: s for i, (s, _) in enumerate(SAM)}
    counters = masking.run_counters(placed, interval_join.covering_reads(placed, table), table, masked).first()
    assert counters.n_reads == counters.n_covering == 10 and counters.n_records == records.count()
    bounds = differences.bounds(records, 7).first()
    assert bounds.first_idx == 5 and bounds.at_or_before <= 7 <= bounds.at_or_after
    assert differences.slice_range(records, 5, 6).count() == 2
    assert differences.range_within(records, 0, 6) == (5, 6)
    with pytest.raises(IndexError):
        differences.range_within(records, 0, 4)
    maps = differences.involution_maps(records).first()
    assert maps.map_a["C"] == maps.perm_a[3]


def test_indel_masks_are_bijections_and_undone(spark):
    drawn = masking.drawn_bijection(lits("A", "AC", "ACC"), lits(5, 1, 0), lits(1, 0, 0), lits(0.1, 0.2, 0.3, 0.5, 0.5, 0.5))
    # A goes to the only weighted one, then AC to the second of two without weights.
    assert one(spark, drawn) == ({"A": "A", "AC": "ACC", "ACC": "AC"},)
    table = spark.createDataFrame([(5, ["A", "AC", "ACC"], [1, 8, 1]), (9, ["GT", "G"], [0, 0])], "idx bigint, alleles array<string>, counts array<bigint>")
    cells = spark.createDataFrame([(5, "A"), (5, "AC"), (5, "A"), (5, None), (9, "G")], "idx bigint, allele string")
    got = masking.indel_masks(cells, table, 1).select("idx", "mask", masking.invert().alias("back"), differences.key_sorted_images().alias("images")).collect()
    assert {r.idx for r in got} == {5, 9}
    for r in got:
        assert sorted(r.mask) == sorted(r.mask.values()) and all(r.back[r.mask[k]] == k for k in r.mask)
        assert r.images == [r.mask[k] for k in sorted(r.mask)]


# Sets, matrices, sources, stream


def test_position_sets(spark):
    a, b, c = ({1, 2, 3, 4}, {3, 4, 5, 6}, {2, 4, 6, 7})
    frames = [spark.createDataFrame([(x,) for x in s] * 2 + [(None,)], "idx bigint") for s in (a, b, c)]
    got = {r.idx: r["class"] for r in position_sets.membership(*frames).collect()}
    assert got == {1: "not_found", 2: "introduced", 3: "masked", 4: "not_masked", 5: "hidden", 6: "not_covered", 7: "revealed"}
    sizes = {r.name: (r.n, round(r.percent, 2)) for r in position_sets.set_sizes(position_sets.membership(*frames)).collect()}
    assert sizes["union"] == (7, 100.0) and sizes["population_personal"] == (2, 28.57)
    empty = [f.limit(0) for f in frames]
    assert {r.n for r in position_sets.set_sizes(position_sets.membership(*empty)).collect()} == {0}


def test_histogram_edges(spark):
    values = [0.0, 0.1, 0.3, 0.7, 0.99, 1.0, 1.01, -0.1, None, float("nan")]
    df = spark.createDataFrame([("k", v) for v in values], "kind string, v double")
    assert {r.bin: r.n for r in position_sets.histogram(df, F.col("v"), ["kind"]).collect()} == {0: 1, 1: 1, 3: 1, 7: 1, 9: 2}


def test_cohort_fills_what_is_missing(spark):
    rows = [("x", "b", "0/1"), ("x", "b", "0/0"), ("y", "a", "1/1"), ("y", None, "1/1")]
    got = genotype_matrix.cohort(spark.createDataFrame(rows, "site_id string, sample_id string, gt string"))
    assert {r.site_id: r.genotypes for r in got.collect()} == {"x": ["0/0", "0/1"], "y": ["1/1", "0/0"]}


def test_read_keys_are_sha_512_of_secret_and_name(spark):
    import hashlib

    key = one(spark, bases.read_key(F.lit(b"\xff" * 16), F.lit("q1")))[0]
    assert bytes(key) == hashlib.sha512(b"\xff" * 16 + b"q1").digest() and len(key) == 64


def test_components_and_pairs(spark):
    rows = [(f"s{i}", name, (i * k) % 3) for i in range(12) for k, name in ((1, "a"), (2, "b"), (1, "a_masked"))]
    points = genotype_matrix.principal_components(spark.createDataFrame(rows, "site_id string, sample_id string, dosage int"), 2)
    assert points.count() == 6 and abs(points.filter("component = 1").first().explained) <= 1
    assert [(r.sample_id, r.component) for r in genotype_matrix.masked_pairs(points).orderBy("component").collect()] == [("a", 1), ("a", 2)]


def test_sam_round_trip(spark, tmp_path):
    text = "@HD\tVN:1\n@SQ\tSN:chr1\tLN:100\n@SQ\tSN:chr2\tLN:50\nq\t2\tchr1\t3\t0\t4M\t=\t1\t0\tACGT\t*\nr\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t!!\n"
    (tmp_path / "in.sam").write_text(text)
    rows = text_formats.read_sam(spark, str(tmp_path / "in.sam"))
    assert [r.line for r in text_formats.sam_lines(rows).orderBy("ord").collect()] == text.splitlines()[3:]
    known = contigs.cumulative_starts(text_formats.read_sam_contigs(spark, str(tmp_path / "in.sam")))
    assert text_formats.sam_header(known)[1:] == ["@SQ\tSN:chr1\tLN:100", "@SQ\tSN:chr2\tLN:50"]
    assert [(r.contig_name, r.start_idx) for r in known.orderBy("contig_id").collect()] == [("chr1", 0), ("chr2", 100)]


def test_difference_text(spark, tmp_path):
    good = "{\n}\nsnvs\t2\n11011\t1\t2\t0\tA,G,T,C\n11015\t1\t3\t1\tC,A,T,G\tC,A,G,T\t2,4,6\n11027\t0\t2\t0\tA,AGT,AG\n"
    (tmp_path / "d.txt").write_text(good)
    got = text_formats.read_differences(spark, str(tmp_path / "d.txt")).orderBy("idx").collect()
    assert [(r.idx, r.is_snv, r.images_b, r.beta) for r in got] == [(11011, True, ["A", "G", "T", "C"], None), (11015, True, ["C", "A", "G", "T"], [2, 4, 6]), (11027, False, ["A", "AGT", "AG"], None)]
    (tmp_path / "bad.txt").write_text("5\t1\t2\t1\tA,G,T,C\n")
    with pytest.raises(Exception, match="not a difference record"):
        text_formats.read_differences(spark, str(tmp_path / "bad.txt")).collect()


def test_coverage_of_a_stream(spark, tmp_path):
    rows = [("chr1", "ACGT", "2024-01-01 10:00:00"), ("CHR1", "AC", "2024-01-01 11:00:00"), ("chr2", "A", "2024-01-02 00:00:00"), (None, "A", None)]
    df = spark.createDataFrame(rows, "reference_name string, seq string, sequenced_at string").withColumn("sequenced_at", F.col("sequenced_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_coverage(stream).writeStream.outputMode("complete").format("memory").queryName("covered").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((str(r.window_start), r.contig_key, r.n_reads, r.n_bases) for r in spark.table("covered").collect())
    assert got == [("2024-01-01 00:00:00", "1", 2, 6), ("2024-01-02 00:00:00", "2", 1, 1)]
    assert windowed_coverage(df).count() == 2


def test_sealed_values(spark):
    key, other, plain = F.lit(b"k" * 16), F.lit(b"o" * 16), F.lit(b"some bytes")
    assert bytes(one(spark, unseal(seal(plain, key), key))[0]) == b"some bytes"
    assert bytes(one(spark, unseal_cbc(seal_cbc(plain, key), key))[0]) == b"some bytes"
    fixed = one(spark, seal_cbc(plain, key, F.lit(b"v" * 16)), seal(F.lit(None).cast("binary"), key))
    assert bytes(fixed[0])[:16] == b"v" * 16 and len(fixed[0]) == 32 and fixed[1] is None
    with pytest.raises(Exception, match="(?i)decrypt|aes|tag|crypto"):
        one(spark, unseal(seal(plain, key), other))


def test_headers_checksums_and_narrow_ranges(spark, tmp_path):
    marked = text_formats.mark_header(["@HD"], "a", "b")
    assert text_formats.unmark_header(marked) == ["@HD"] == text_formats.unmark_header(["@HD"])
    with pytest.raises(ValueError):
        text_formats.mark_header(marked, "a", "b")
    (tmp_path / "x").write_bytes(b"abc")
    assert text_formats.file_checksums(spark, str(tmp_path / "x")).first().md5 == "900150983cd24fb0d6963f7d28e17f72"
    assert contigs.narrow_range(None, (1, 9)) == (1, 9) and contigs.narrow_range((2, 9), (1, 9)) == (2, 9)
    with pytest.raises(ValueError):
        contigs.narrow_range((0, 3), (1, 9))
