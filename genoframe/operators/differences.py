"""Tables of difference records: ranges, bounds, numbering and text form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.functions.bases import BASES
from genoframe.operators.joins import join_null_safe, person_keys
from genoframe.operators.variants import overlap_runs


def slice_range(records: DataFrame, first: int, last: int) -> DataFrame:
    """Records with first <= idx <= last and no others; sorted files prune by it."""
    return records.filter(F.col("idx").between(first, last))


def bounds(records: DataFrame, pivot: int) -> DataFrame:
    """First index, last index, least one >= pivot, greatest one <= pivot: one row, or one
    per person."""
    return records.groupBy(*person_keys(records)[:-1]).agg(
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.min(F.when(F.col("idx") >= pivot, F.col("idx"))).alias("at_or_after"),
        F.max(F.when(F.col("idx") <= pivot, F.col("idx"))).alias("at_or_before"),
    )


def range_within(records: DataFrame, first: int, last: int) -> tuple[int, int]:
    """First and last index of the records in first..last; none there raises."""
    row = slice_range(records, first, last).agg(F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    if row.a is None:
        raise IndexError(f"no record from {first} to {last}")
    return row.a, row.b


def key_sorted_images(mask: str = "mask"):
    """Images of a map in ascending order of their keys."""
    return F.transform(F.array_sort(F.map_keys(mask)), lambda k: F.element_at(mask, k))


def involution_maps(records: DataFrame) -> DataFrame:
    """Adds ``map_a`` and ``map_b``, base to base, to records with perm_a and perm_b."""
    bases = F.array(*[F.lit(b) for b in BASES])
    for side in ("a", "b"):
        images = F.regexp_extract_all(F.col(f"perm_{side}"), F.lit("(.)"), F.lit(1))
        records = records.withColumn(f"map_{side}", F.map_from_arrays(bases, images))
    return records


def overlap_clusters(variants: DataFrame) -> DataFrame:
    """(idx, length, cluster): variants whose reference spans touch share a cluster, named
    by its first index."""
    return overlap_runs(variants.select(F.lit(0).alias("group"), "idx", "length")).select("idx", "length", F.col("run").alias("cluster"))


def as_text(records: DataFrame, second: DataFrame, numbering: DataFrame) -> DataFrame:
    """(sample_id, idx, line): tab-separated lines of records: index, 1 for single bases and 0
    for indels, reference, zygosity, first mask and, where there are two, the second and the
    numbers of its reads.

    ``records`` are those of a masking run (images_a, images_b). ``numbering`` has (ord, number)
    of the reads as the file counts them. Lists of numbers are per variant, as long as its
    pile-up."""
    keys = person_keys(records)
    numbered = second.join(numbering, "ord").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("number")), ",").alias("_reads"))
    joined = join_null_safe(records, numbered, keys, "left")
    two = F.col("zygosity").isin(1, 3)
    fields = [F.col("idx").cast("string"), F.col("is_snv").cast("int").cast("string"), F.col("ref_id").cast("string"), F.col("zygosity").cast("string"), F.array_join("images_a", ",")]
    line = F.concat_ws("\t", *fields, F.when(two, F.array_join("images_b", ",")), F.when(two, F.coalesce("_reads", F.lit(""))))
    # A record must name its reference among its alleles.
    sound = F.col("ref_id").between(0, F.size("images_a") - 1)
    return joined.select(*keys, F.when(sound, line).otherwise(F.raise_error(F.concat(F.lit("no reference at "), F.col("idx").cast("string")))).alias("line"))


def text_head(header: dict, n_snvs: int, n_indels: int, last_index: int, index: list[tuple[int, int]] = (), resolution: int = 1000) -> list[str]:
    """Lines before the records: the header as sorted JSON, counts, and the sparse index."""
    counts = (("snvs", n_snvs), ("indels", n_indels), ("last_index", last_index), ("index_res", resolution), ("index_size", len(index)))
    return [*json.dumps(header, sort_keys=True, indent=4).split("\n"), *[f"{k}\t{v}" for k, v in counts], *[f"{i}\t{p}" for i, p in index]]
