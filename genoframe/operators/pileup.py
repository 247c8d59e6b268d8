"""Pile-ups: the base that each read shows at a variant, counts, and genotype calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.functions.bases import BASES
from genoframe.functions.cigar import aligned_blocks, expand, matching_allele
from genoframe.operators.interval_join import covering_pairs
from genoframe.operators.joins import person_keys

#: Least share of a base in the pile-up to count as one of the person's.
MIN_SHARE = 0.2


def cells(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """(ord, idx, seq_pos, unit, ...): one row per read and variant it covers.

    seq_pos is the read's base at the variant and unit that base's letter in the expanded
    CIGAR; both are null within a deletion or skip. Other columns of ``variants`` stay, and
    so does the reads' ``sample_id``."""
    picked = reads.select("ord", "start_idx", "end_idx", "seq", "cigar", *[c for c in reads.columns if c == "sample_id"])
    pairs = covering_pairs(picked, variants).withColumn("_off", (F.col("idx") - F.col("start_idx")).cast("int"))
    hit = F.filter(aligned_blocks(F.col("cigar")), lambda b: (F.col("_off") >= b["ref"]) & (F.col("_off") < b["ref"] + b["len"]))
    # Most reads are one match from end to end, and need no walk along their CIGAR.
    zero = F.lit(0)
    whole = F.struct(zero.alias("ref"), zero.alias("seq"), zero.alias("units"), zero.alias("len"))
    block = F.when(F.col("cigar").rlike("^[0-9]+M$"), whole).otherwise(F.get(hit, zero))
    shift = F.col("_off") - F.col("_block.ref")
    return (
        pairs.withColumn("_block", block)
        .withColumn("seq_pos", F.col("_block.seq") + shift)
        .withColumn("unit", F.col("_block.units") + shift)
        .drop("_off", "_block", "start_idx", "end_idx")
    )


def snv_cells(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Cells with ``allele``, the base shown there; null if it is none of the four. Repeated
    rows of a read give its cell once."""
    base = F.call_function("substring", F.col("seq"), F.col("seq_pos") + 1, F.lit(1))
    return cells(reads, variants).withColumn("allele", F.when(base.isin(*BASES), base)).drop("seq", "cigar").distinct()


def indel_cells(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Cells with ``allele``, the one of ``alleles`` (the reference's first) that the read
    shows; null if undecided, or if no CIGAR letter follows it. Each cell comes once."""
    rows = cells(reads, variants).withColumn("_exp", expand(F.col("cigar"))).withColumn("ref_allele", F.element_at("alleles", 1))
    found = matching_allele(F.col("seq"), F.col("_exp"), F.col("alleles"), F.col("ref_allele"), F.col("seq_pos"), F.col("unit"))
    rows = rows.withColumn("allele", F.when(F.col("seq_pos").isNotNull(), found))
    used = F.greatest(F.length("allele"), F.length("ref_allele"))
    rows = rows.withColumn("allele", F.when(F.length("_exp") > F.col("unit") + used, F.col("allele")))
    return rows.drop("_exp", "seq", "cigar").distinct()


def variant_cells(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Cells of single bases and of insertions and deletions in one join. ``variants`` has
    (idx, is_snv, ref_allele, alleles).

    Only alleles that can be told apart again once another one stands in their place count:
    where an insertion or deletion follows right after, the place is undecided (null)."""
    rows = cells(reads, variants.select("idx", "is_snv", "ref_allele", "alleles"))
    base = F.call_function("substring", F.col("seq"), F.col("seq_pos") + 1, F.lit(1))
    units = expand(F.col("cigar"))
    found = matching_allele(F.col("seq"), F.col("_exp"), F.col("alleles"), F.col("ref_allele"), F.col("seq_pos"), F.col("unit"))
    rows = rows.withColumn("_exp", F.when(~F.col("is_snv") & F.col("seq_pos").isNotNull(), units))
    rows = rows.withColumn("allele", F.when(F.col("is_snv"), F.when(base.isin(*BASES), base)).when(F.col("_exp").isNotNull(), found))
    used = F.greatest(F.length("allele"), F.length("ref_allele"))
    after = F.call_function("substring", F.col("_exp"), F.col("unit") + used + 1, F.lit(1))
    told = F.col("is_snv") | ((after != "") & ~after.isin("I", "D"))
    return rows.withColumn("allele", F.when(told, F.col("allele"))).drop("_exp", "seq", "cigar", "alleles").distinct()


def base_counts(snv: DataFrame) -> DataFrame:
    """(sample_id, idx, counts): a person's known bases at each variant, in the order of
    ``BASES``. Variants that no read shows a base at are left out. Counts are added up before
    the shuffle."""
    sums = [F.count_if(F.col("allele") == b).alias(b) for b in BASES]
    return snv.filter("allele is not null").groupBy(*person_keys(snv)).agg(*sums).select(*person_keys(snv), F.array(*BASES).alias("counts"))


def call_genotypes(counts: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Adds allele_a and allele_b: one base with at least ``min_share`` is a homozygote, two
    a heterozygote in the order of ``BASES``; none or more are no call (null)."""
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    numbered = F.transform(F.array(*[F.lit(b) for b in BASES]), lambda b, i: F.struct(b.alias("base"), (F.get(F.col("counts"), i) / F.col("_total")).alias("share")))
    passing = F.transform(F.filter(numbered, lambda x: x["share"] >= min_share), lambda x: x["base"])
    called = counts.withColumn("_total", total).withColumn("_pass", passing)
    some = F.size("_pass").isin(1, 2)
    return called.select(*person_keys(counts), "counts", F.when(some, F.element_at("_pass", 1)).alias("allele_a"), F.when(some, F.element_at("_pass", -1)).alias("allele_b"))
