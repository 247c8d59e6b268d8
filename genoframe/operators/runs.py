"""A whole masking run over reads, known and random variants of both kinds, and its undoing.

``mask_reads`` merges known and random variants, leaves out those that overlap, calls each
person's pile-ups, draws masks, rewrites single bases, insertions and deletions in one go,
ciphers unmapped reads, and gives the records that undo it all. ``unmask_reads`` restores all
mapped reads, those of a range, a range and the unmapped ones, or the unmapped ones alone.

Cases:

* a null sample is a person of its own; repeated rows of a read count once.
* records stand only where a read was changed; indels keep zygosity 0 and one mask.
* quality text of inserted or deleted bases can't be restored; bases and CIGAR are.
* unmapped reads with other letters than the bases and N, or without bases, stay as they are.
* without variants or reads nothing changes and there are no records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.bases import BASES, base_code, read_key, stream_cipher
from genoframe.operators import contigs as dictionary
from genoframe.operators import masking, pileup, reads, variants
from genoframe.operators.differences import key_sorted_images, slice_range
from genoframe.operators.joins import join_null_safe, person_keys
from genoframe.tables import ensure_checkpoint_dir


@dataclass(frozen=True)
class MaskedRun:
    """Masked reads; records (sample_id, idx, is_snv, ref_allele, ref_id, zygosity, images_a,
    images_b); (sample_id, idx, ord) of second masks; changed cells (sample_id, ord, idx)."""

    reads: DataFrame
    records: DataFrame
    second: DataFrame
    changed: DataFrame


def kept_variants(known: DataFrame, random: DataFrame, contigs: DataFrame) -> DataFrame:
    """Known and random variants, one per index, none of which begins within the last kept
    one's reference allele."""
    merged = variants.merge_variants(known, random)
    placed = dictionary.with_position(merged, contigs).withColumn("length", F.length("ref_allele").cast("bigint"))
    kept = variants.non_overlapping(placed.select(F.col("contig_name").alias("group"), "idx", "length"))
    return merged.join(kept.select("idx"), "idx", "left_semi")


def _ciphered(secret: bytes) -> Column:
    letters = F.col("seq").rlike(f"^[{BASES}N]+$")
    turned = stream_cipher(F.col("seq"), read_key(F.lit(secret), F.col("qname")))
    return F.when(~F.col("mapped") & letters, turned).otherwise(F.col("seq"))


def _letters(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit("(.)"), F.lit(1))


def mask_reads(placed: DataFrame, kept: DataFrame, seed: int, secret: bytes) -> MaskedRun:
    """Masks placed reads (each once) at the kept variants (``kept_variants``)."""
    ensure_checkpoint_dir(placed.sparkSession)
    # Cells are counted, masked, recorded and put back; the interval join runs once.
    cells = pileup.variant_cells(placed, kept).checkpoint()
    snv, indel = cells.filter("is_snv"), cells.filter("not is_snv")
    public = kept.filter("is_snv").select("idx", base_code(F.col("ref_allele")).cast("int").alias("ref_id"), F.col("counts").alias("public"))
    calls = pileup.call_genotypes(pileup.base_counts(snv)).join(public, "idx")
    # Few rows, from which changes, records and second masks all come.
    masked = masking.mask_cells(snv, masking.masks(masking.draw_public(calls, seed)), seed).checkpoint()
    maps = masking.indel_masks(indel, kept.filter("not is_snv"), seed)
    keys = person_keys(cells)
    turned = join_null_safe(indel.filter("allele is not null"), maps, keys).withColumn("masked", F.element_at("mask", F.col("allele"))).checkpoint()
    put = ("ord", "seq_pos", "unit", F.col("allele").alias("old"), F.col("masked").alias("new"), "ref_allele")
    changes = masked.filter("allele is not null").select(*put).unionByName(turned.select(*put))
    rewritten = masking.rewrite_reads(placed, changes).withColumn("seq", _ciphered(secret))

    bases = F.array(*[F.lit(b) for b in BASES])
    of_snvs = masking.difference_table(masked).select(
        *keys, F.lit(True).alias("is_snv"), F.get(bases, F.col("ref_id")).alias("ref_allele"), "ref_id", "zygosity", _letters("perm_a").alias("images_a"), _letters("perm_b").alias("images_b")
    )
    changed = turned.groupBy(*keys, "ref_allele").agg(F.max(F.col("allele") != F.col("masked")).alias("_changed"), F.max(F.struct(key_sorted_images().alias("images"))).alias("_m"))
    images = F.col("_m.images")
    of_indels = changed.filter("_changed").select(
        *keys, F.lit(False).alias("is_snv"), "ref_allele", (F.array_position(images, F.col("ref_allele")) - 1).cast("int").alias("ref_id"), F.lit(0).alias("zygosity"), images.alias("images_a"), images.alias("images_b")
    )
    edited = masked.select(*keys, "ord", "allele", "masked").unionByName(turned.select(*keys, "ord", "allele", "masked")).filter("allele <> masked")
    return MaskedRun(rewritten, of_snvs.unionByName(of_indels), masking.second_mask_reads(masked), edited.drop("allele", "masked"))


def unmask_reads(
    masked: DataFrame,
    records: DataFrame,
    second: DataFrame,
    start: int | None = None,
    end: int | None = None,
    include_unmapped: bool = False,
    unmapped_only: bool = False,
    secret: bytes | None = None,
) -> DataFrame:
    """Restored reads of a scan of masked ones; both ends of the range are within it. Without
    a range all mapped reads are restored. Unmapped ones need the secret."""
    if (include_unmapped or unmapped_only) and secret is None:
        raise ValueError("unmapped reads can't be restored without the secret")
    scanned = reads.scan_reads(masked, start, end, unmapped_only, include_unmapped, end_inclusive=True)
    if secret is not None:
        scanned = scanned.withColumn("seq", _ciphered(secret))
    if unmapped_only:
        return scanned
    wanted = slice_range(records, start if start is not None else 0, end if end is not None else 2**62)
    # An indel's images are its alleles in another order, so each record names all of them.
    sites = wanted.select("idx", "is_snv", F.when(~F.col("is_snv"), F.col("ref_allele")).alias("ref_allele"), F.when(~F.col("is_snv"), F.array_sort("images_a")).alias("alleles")).distinct()
    cells = pileup.variant_cells(scanned, sites)
    keys = person_keys(wanted)
    own = join_null_safe(cells.filter("allele is not null"), wanted.drop("is_snv", "ref_allele"), keys)
    own = own.join(second.select("idx", "ord", F.lit(True).alias("_b")), ["idx", "ord"], "left")
    images = F.when(F.col("_b"), F.col("images_b")).otherwise(F.col("images_a"))
    bases = F.array(*[F.lit(b) for b in BASES])
    # Masks of single bases are their own inverse; an indel's goes from images to names in order.
    of_snv = F.get(images, (F.array_position(bases, F.col("allele")) - 1).cast("int"))
    of_indel = F.get(F.array_sort("images_a"), (F.array_position("images_a", F.col("allele")) - 1).cast("int"))
    new = F.when(F.col("is_snv"), of_snv).otherwise(of_indel)
    changes = own.select("ord", "seq_pos", "unit", F.col("allele").alias("old"), new.alias("new"), F.coalesce("ref_allele", "allele").alias("ref_allele"))
    return masking.rewrite_reads(scanned, changes)
