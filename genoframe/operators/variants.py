"""Allele-count tables from variant rows, and ordered unions of variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genoframe.functions.bases import BASES, base_code, is_indel, is_snv, shares_first_base
from genoframe.functions.draws import uniform
from genoframe.functions.info import with_reference_count
from genoframe.operators.joins import side_by_side

# Fixed value: counts by which alleles of random variants are weighted.
RANDOM_COUNTS = (3, 3, 2, 2)


def classify(rows: DataFrame, skip_indels: bool = False) -> DataFrame:
    """Adds ``alleles``, ``counts`` and ``status`` to (idx, ref, alts, ac, an).

    status is the first that applies: incomplete (no alternative), unknown (an allele that
    isn't made of bases), skipped, first_base (an indel's alleles begin differently), no_info
    (AC or AN missing or not one count per alternative), no_alternative (all counts 0),
    negative (more alternatives than alleles), else snv or indel."""
    alleles = F.concat(F.array("ref"), F.filter("alts", lambda a: a != "."))
    rows = rows.withColumn("alleles", alleles)
    snv, indel = is_snv(F.col("alleles")), is_indel(F.col("alleles"))
    counts = with_reference_count(F.col("ac"), F.col("an"))
    status = (
        F.when(F.col("alleles").isNull() | (F.size("alleles") < 2), "incomplete")
        .when(~(snv | indel), "unknown")
        .when(~snv & F.lit(skip_indels), "skipped")
        .when(~snv & ~shares_first_base(F.col("alleles")), "first_base")
        .when(F.col("ac").isNull() | F.col("an").isNull() | (F.size("ac") != F.size("alleles") - 1), "no_info")
        .when(F.aggregate("ac", F.lit(0).cast("bigint"), lambda a, n: a + n) == 0, "no_alternative")
        .when(F.element_at(counts, 1) < 0, "negative")
        .when(snv, "snv")
        .otherwise("indel")
    )
    return rows.withColumn("status", F.coalesce(status, F.lit("unknown"))).withColumn("counts", F.when(F.col("status").isin("snv", "indel"), counts))


def first_per_index(classified: DataFrame, order: str) -> DataFrame:
    """The usable rows, of those with one index the first by ``order``.

    Rows that can't be used don't claim their index. Folded before the shuffle."""
    usable = classified.filter("status in ('snv', 'indel') and idx is not null")
    first = usable.groupBy("idx").agg(F.min(F.struct(order, "status", "alleles", "counts")).alias("_first"))
    return first.select("idx", "_first.status", "_first.alleles", "_first.counts")


def snv_table(first: DataFrame) -> DataFrame:
    """(idx, ref_id, counts): counts in the order of ``BASES``, 0 for alleles not listed; of
    an allele listed twice the last count stands."""
    def count_of(base: str):
        pairs = F.arrays_zip(F.col("alleles").alias("a"), F.col("counts").alias("n"))
        last = F.aggregate(pairs, F.lit(None).cast("bigint"), lambda acc, x: F.when(x["a"] == base, x["n"]).otherwise(acc))
        return F.coalesce(last, F.lit(0).cast("bigint"))

    by_base = [count_of(b) for b in BASES]
    return first.filter("status = 'snv'").select("idx", base_code(F.element_at("alleles", 1)).cast("int").alias("ref_id"), F.array(*by_base).alias("counts"))


def indel_table(first: DataFrame) -> DataFrame:
    """(idx, alleles array<struct<count, seq>>), the reference's first."""
    pairs = F.zip_with("counts", "alleles", lambda n, a: F.struct(n.alias("count"), a.alias("seq")))
    return first.filter("status = 'indel'").select("idx", pairs.alias("alleles"))


def table_counters(classified: DataFrame, first: DataFrame) -> DataFrame:
    """One row: rows read, written by kind, and left out by reason."""
    seen = classified.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("incomplete", "unknown", "skipped", "first_base", "no_info", "no_alternative", "negative")],
        F.count_if(F.col("status").isin("snv", "indel") & F.col("idx").isNotNull()).alias("_usable"),
    )
    kept = first.agg(F.count_if(F.col("status") == "snv").alias("n_snv"), F.count_if(F.col("status") == "indel").alias("n_indel"))
    return side_by_side(seen, kept).withColumn("n_same_index", F.col("_usable") - F.col("n_snv") - F.col("n_indel")).drop("_usable")


def as_variants(snv: DataFrame, indel: DataFrame) -> DataFrame:
    """(idx, is_snv, ref_allele, alleles, counts): both tables as one."""
    bases = F.array(*[F.lit(b) for b in BASES])
    a = snv.select("idx", F.lit(True).alias("is_snv"), F.get(bases, F.col("ref_id")).alias("ref_allele"), bases.alias("alleles"), "counts")
    b = indel.select("idx", F.lit(False).alias("is_snv"), F.element_at("alleles", 1)["seq"].alias("ref_allele"), F.col("alleles.seq").alias("alleles"), F.col("alleles.count").alias("counts"))
    return a.unionByName(b)


def same_index(variants: DataFrame) -> DataFrame:
    """Indices that more than one variant claims; a sound table has none."""
    return variants.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def random_snvs(spark: SparkSession, first: int, last: int, share: float, seed: int) -> DataFrame:
    """Random variants over [first, last): ``share`` of the indices, drawn independently, so
    one may come twice. Reference base A and fixed counts, as placeholders."""
    if not 0 <= share <= 0.001:
        raise ValueError("the share of random variants lies in 0 to 0.001")
    n = int(share * (last - first))
    at = F.floor(uniform(seed, "random", F.col("id")) * (last - first)).cast("bigint") + first
    bases = F.array(*[F.lit(b) for b in BASES])
    return spark.range(n).select(at.alias("idx"), F.lit(True).alias("is_snv"), F.lit("A").alias("ref_allele"), bases.alias("alleles"), F.array(*[F.lit(c).cast("bigint") for c in RANDOM_COUNTS]).alias("counts"))


def merge_variants(known: DataFrame, random: DataFrame) -> DataFrame:
    """Union with one variant per index: a known one where there is one."""
    both = known.withColumn("_turn", F.lit(0)).unionByName(random.withColumn("_turn", F.lit(1)))
    fields = ("is_snv", "ref_allele", "alleles", "counts")
    return both.groupBy("idx").agg(F.min(F.struct("_turn", *fields)).alias("_first")).select("idx", *[f"_first.{f}" for f in fields])


def overlap_runs(variants: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """Adds ``run`` to (group, idx, length, ...): the first index of the run of variants
    whose reference spans touch, one after another, within a group (a contig).

    Found in tiles of the index: only rows within the longest length before a tile can reach
    into it, so those are shown to it as well. Rows must have one index each per group."""
    longest = variants.agg(F.max("length")).first()[0] or 1
    tile = max(tile, longest)
    rows = variants.withColumn("_tile", F.expr(f"idx div {tile}")).withColumn("_own", F.lit(True))
    reach_out = rows.filter(f"(idx + {longest}) div {tile} > _tile").withColumn("_tile", F.col("_tile") + 1).withColumn("_own", F.lit(False))
    order = W.partitionBy("group", "_tile").orderBy("idx")
    reach = F.max(F.col("idx") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    shown = rows.unionByName(reach_out).withColumn("_begins", F.coalesce(F.col("idx") >= reach, F.lit(True)))
    own = shown.filter("_own").withColumn("_run", F.max(F.when(F.col("_begins"), F.col("idx"))).over(order))
    # Runs that come over from an earlier tile: one row per tile tells.
    tiles = own.groupBy("group", "_tile").agg(F.max("_run").alias("_last"))
    before = W.partitionBy("group").orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    carried = tiles.select("group", "_tile", F.max("_last").over(before).alias("_carried"))
    return own.join(carried, ["group", "_tile"]).select(*variants.columns, F.coalesce("_run", "_carried").alias("run"))


def _keep_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each run in order, less those that begin before the last kept one's end. A
    run's first row is kept as it is; only the rows after it are walked."""
    group, run, free = None, None, -1
    for batch in batches:
        keep = (batch["idx"] == batch["run"]).to_numpy().copy()
        ends = (batch["idx"] + batch["length"]).to_numpy()
        starts, groups, runs = batch["idx"].to_numpy(), batch["group"].to_numpy(), batch["run"].to_numpy()
        for i in np.flatnonzero(~keep):
            if i and keep[i - 1] and starts[i - 1] == runs[i - 1]:
                group, run, free = groups[i - 1], runs[i - 1], ends[i - 1]
            if (groups[i], runs[i]) != (group, run) or starts[i] >= free:
                keep[i], group, run, free = True, groups[i], runs[i], ends[i]
        if len(batch) and keep[-1]:
            group, run, free = groups[-1], runs[-1], ends[-1]
        yield batch[keep]


def non_overlapping(variants: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """Variants (group, idx, length, ...) kept in order: each that begins at or after the
    end of the last kept one, or first in its group.

    Runs of touching variants are sorted and read through as a stream that holds one end, so
    neither the number of runs nor the length of one needs memory."""
    runs = overlap_runs(variants, tile)
    sorted_runs = runs.repartition("group", "run").sortWithinPartitions("group", "run", "idx")
    return sorted_runs.mapInPandas(_keep_in_order, runs.schema).select(*variants.columns)
