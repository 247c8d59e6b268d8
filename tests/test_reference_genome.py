import random

from genoframe.operators import reference_genome as genome


def test_lookups_against_the_whole_text(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ATGC?") for _ in range(300))
    rows = [(i, b) for i, b in enumerate(text) if b != "?"]
    chunks = genome.in_chunks(spark.createDataFrame(rows, "idx bigint, base string"), 16).checkpoint()
    wanted = [(i, n) for i in range(0, 300, 7) for n in (1, 5, 40)] + [(None, 3), (5, 0), (900, 2)]
    got = {(r.idx, r.length): r.bases for r in genome.bases_at(spark.createDataFrame(wanted, "idx bigint, length int"), chunks, 16).collect()}
    assert got == {(i, n): (text + "?" * 1000)[i : i + n] for i, n in wanted if i is not None and n}
    at = next(i for i in range(100) if "?" not in text[i : i + 3])
    variants = [(at, ["N", text[at : at + 3], text[at]]), (at + 1, ["N", None]), (901, ["A"])]
    found = genome.reference_alleles(spark.createDataFrame(variants, "idx bigint, alleles array<string>"), chunks, 16)
    assert {r.idx: r.allele_no for r in found.collect()} == {at: 1, at + 1: None, 901: None}


def test_consensus_takes_the_most_frequent_base(spark):
    reads = [(0, "3M", "ATG", True), (0, "3M", "ACG", True), (1, "1M1D1M", "CT", True), (0, "3M", "TTT", False), (2, "2M", "NC", True)]
    df = spark.createDataFrame(reads, "start_idx bigint, cigar string, seq string, mapped boolean")
    assert {r.idx: r.base for r in genome.consensus_bases(df).collect()} == {0: "A", 1: "C", 2: "G", 3: "T"}
    assert genome.consensus_bases(df.limit(0)).count() == 0
