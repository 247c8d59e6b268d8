"""Masking: exchange of a person's bases for ones drawn from the population, and back.

A mask exchanges pairs of bases, so applying it twice restores them. All draws depend on
seed, index, sample and read alone, and each person has masks of their own. Which reads took the second of two masks is kept as rows
(idx, ord), not as positions in a queue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.bases import BASES, permute_base, swap_permutation
from genoframe.functions.cigar import expand, place_allele, shrink
from genoframe.functions.draws import uniform, weighted_index
from genoframe.operators.joins import fits_broadcast, join_null_safe, person_keys, side_by_side
from genoframe.tables import ensure_checkpoint_dir

# What a mask does to the genotype.
HOMO_TO_HOMO, HOMO_TO_HETERO, HETERO_TO_HETERO, HETERO_TO_HOMO = range(4)


def draw_public(calls: DataFrame, seed: int) -> DataFrame:
    """Adds to_a and to_b: two independent draws of a base by the population's ``public``
    counts (order of ``BASES``)."""
    bases = F.array(*[F.lit(b) for b in BASES])
    weights = F.transform("public", lambda n: n.cast("double"))
    keys = [F.col(c) for c in reversed(person_keys(calls))]
    for which in ("a", "b"):
        calls = calls.withColumn(f"to_{which}", F.get(bases, weighted_index(weights, uniform(seed, which, *keys))))
    return calls


def masks(drawn: DataFrame) -> DataFrame:
    """(idx, ..., zygosity, perm_a, perm_b) from allele_a, allele_b, to_a, to_b; uncalled
    variants are left out.

    Between heterozygotes a shared base stays as it is and the others are exchanged; if none
    is shared, first with first and second with second. Where the number of different bases
    changes there are two masks, one for each of the differing bases."""
    a, b, x, y = (F.col(c) for c in ("allele_a", "allele_b", "to_a", "to_b"))
    homo, to_homo = a == b, x == y
    zygosity = F.when(homo & to_homo, HOMO_TO_HOMO).when(homo, HOMO_TO_HETERO).when(~to_homo, HETERO_TO_HETERO).otherwise(HETERO_TO_HOMO)
    between = (
        F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), F.lit(BASES))
        .when(a == x, swap_permutation((b, y)))
        .when(a == y, swap_permutation((b, x)))
        .when(b == x, swap_permutation((a, y)))
        .when(b == y, swap_permutation((a, x)))
        .otherwise(swap_permutation((a, x), (b, y)))
    )
    first = F.when(F.col("zygosity") == HETERO_TO_HETERO, between).otherwise(swap_permutation((a, x)))
    second = F.when(F.col("zygosity") == HOMO_TO_HETERO, swap_permutation((a, y))).when(F.col("zygosity") == HETERO_TO_HOMO, swap_permutation((b, x))).otherwise(F.col("perm_a"))
    return drawn.filter("allele_a is not null").withColumn("zygosity", zygosity).withColumn("perm_a", first).withColumn("perm_b", second)


def mask_cells(snv: DataFrame, masks: DataFrame, seed: int) -> DataFrame:
    """Cells of masked variants with ``use_b`` and ``masked``, the base to be put there.

    Homozygotes made heterozygous take either mask by a draw per read; heterozygotes made
    homozygous take the second where the read shows the second base."""
    keys = person_keys(masks)
    given = [c for c in ("ref_id",) if c in masks.columns]
    rows = join_null_safe(snv, masks.select(*keys, *given, "zygosity", "perm_a", "perm_b", F.col("allele_b").alias("_second")), keys)
    drawn = uniform(seed, "beta", F.col("idx"), F.col("ord")) >= 0.5
    use_b = F.when(F.col("zygosity") == HOMO_TO_HETERO, drawn).when(F.col("zygosity") == HETERO_TO_HOMO, F.coalesce(F.col("allele") == F.col("_second"), F.lit(False))).otherwise(False)
    rows = rows.withColumn("use_b", use_b).drop("_second")
    return rows.withColumn("masked", permute_base(F.col("allele"), F.when(F.col("use_b"), F.col("perm_b")).otherwise(F.col("perm_a"))))


def difference_table(masked: DataFrame) -> DataFrame:
    """(sample_id, idx, ref_id, zygosity, perm_a, perm_b) of a person's variants at which some
    read was changed; ``ref_id`` if the cells have it."""
    given = [c for c in ("ref_id",) if c in masked.columns]
    return masked.groupBy(*person_keys(masked), *given, "zygosity", "perm_a", "perm_b").agg(F.max(F.col("allele") != F.col("masked")).alias("_changed")).filter("_changed").drop("_changed")


def second_mask_reads(masked: DataFrame) -> DataFrame:
    """(sample_id, idx, ord) of the cells that took the second mask."""
    return masked.filter("use_b").select(*person_keys(masked), "ord")


def unmask_cells(snv: DataFrame, differences: DataFrame, second: DataFrame) -> DataFrame:
    """Cells of masked reads with ``restored``, the base that stood there before."""
    marked = join_null_safe(snv, differences, person_keys(differences))
    # A read is one person's, so its place in the file is enough here.
    marked = marked.join(second.select("idx", "ord", F.lit(True).alias("_b")), ["idx", "ord"], "left")
    perm = F.when(F.col("_b"), F.col("perm_b")).otherwise(F.col("perm_a"))
    return marked.withColumn("restored", permute_base(F.col("allele"), perm)).drop("_b")


def run_counters(reads: DataFrame, covering: DataFrame, variants: DataFrame, masked: DataFrame) -> DataFrame:
    """Reads, reads over a variant, variants, changed cells, changed reads, records: a row per
    person if all of reads, ``covering`` and ``masked`` have ``sample_id``, else one row."""
    changed = masked.filter("allele <> masked")
    if all("sample_id" in df.columns for df in (reads, covering, masked)):
        one = F.count(F.lit(1))
        per_person = [
            reads.groupBy("sample_id").agg(one.alias("n_reads")),
            covering.groupBy("sample_id").agg(one.alias("n_covering")),
            changed.groupBy("sample_id").agg(one.alias("n_changed_cells"), F.count_distinct("ord").alias("n_changed_reads"), F.count_distinct("idx").alias("n_records")),
        ]
        rows = reduce(lambda a, b: join_null_safe(a, b, ["sample_id"], "left"), per_person)
        rows = rows.withColumn("n_variants", F.lit(variants.count()))
        names = ("n_reads", "n_covering", "n_variants", "n_changed_cells", "n_changed_reads", "n_records")
        return rows.select("sample_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names])
    parts = [
        reads.agg(F.count(F.lit(1)).alias("n_reads")),
        covering.agg(F.count(F.lit(1)).alias("n_covering")),
        variants.agg(F.count(F.lit(1)).alias("n_variants")),
        changed.agg(F.count(F.lit(1)).alias("n_changed_cells"), F.count_distinct("ord").alias("n_changed_reads"), F.count_distinct("idx").alias("n_records")),
    ]
    return side_by_side(*parts)


def rewrite_reads(reads: DataFrame, changes: DataFrame) -> DataFrame:
    """All reads, as they are but with their changed alleles put into seq, cigar and qual.

    ``changes`` has (ord, seq_pos, unit, old, new, ref_allele); a read's are applied from
    its end, so that earlier places stay valid. A read covers few variants, and they don't
    overlap."""
    cell = F.struct("seq_pos", "unit", "old", "new", "ref_allele")
    ensure_checkpoint_dir(reads.sparkSession)
    listed = changes.filter("old <> new").groupBy("ord").agg(F.sort_array(F.collect_list(cell), asc=False).alias("_cells")).checkpoint()
    # Few reads cover a variant that changes them; where these are few, the others stay in place.
    joined = reads.join(F.broadcast(listed) if fits_broadcast(listed) else listed, "ord", "left")
    state = F.struct(F.col("seq"), expand(F.col("cigar")).alias("expanded"), F.col("qual"))
    done = F.aggregate("_cells", state, lambda acc, c: place_allele(c, acc["seq"], acc["expanded"], acc["qual"]))
    joined = joined.withColumn("_done", F.when(F.col("_cells").isNotNull(), done))
    put = {"seq": F.coalesce("_done.seq", "seq"), "cigar": F.coalesce(shrink(F.col("_done.expanded")), "cigar"), "qual": F.coalesce("_done.qual", "qual")}
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in reads.columns])


def drawn_bijection(alleles: Column, private: Column, public: Column, draws: Column) -> Column:
    """A bijection of alleles onto themselves, as map<string,string>: again and again the most
    frequent private allele left goes to one drawn by public weight from those left; the last
    pair remains.

    ``draws`` has a tie-breaker per allele (by name), then a draw per pair. Where no weight is
    left each allele is equally likely."""
    named = F.array_sort(F.arrays_zip(alleles.alias("allele"), private.alias("n"), public.alias("weight")))
    ranked = F.transform(named, lambda x, i: F.struct((-(x["n"] + F.get(draws, i))).alias("score"), x["allele"].alias("allele")))
    option = lambda x: F.struct(x["allele"].alias("allele"), x["weight"].cast("double").alias("weight"))
    kinds = "array<struct<from:string,to:string>>"
    state = F.struct(F.transform(named, option).alias("left"), F.array().cast(kinds).alias("pairs"))

    def pair(acc: Column, source: Column) -> Column:
        left, done = acc["left"], F.size(acc["pairs"])
        u = F.when(F.size(left) > 1, F.get(draws, F.size(alleles) + done)).otherwise(F.lit(0.0))
        at = F.coalesce(weighted_index(F.transform(left, lambda x: x["weight"]), u), F.size(left) - 1)
        put = F.struct(source["allele"].alias("from"), F.get(left, at)["allele"].alias("to"))
        return F.struct(F.filter(left, lambda x, i: i != at).alias("left"), F.concat(acc["pairs"], F.array(put)).alias("pairs"))

    return F.map_from_entries(F.aggregate(F.array_sort(ranked), state, pair, lambda acc: acc["pairs"]))


def indel_masks(cells: DataFrame, variants: DataFrame, seed: int) -> DataFrame:
    """(sample_id, idx, mask map<string,string>) of each indel with a known allele in a
    person's pile-up."""
    keys = person_keys(cells)
    seen = cells.filter("allele is not null").groupBy(*keys, "allele").agg(F.count(F.lit(1)).alias("n"))
    private = seen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("_private"))
    joined = variants.select("idx", "alleles", "counts").join(private, "idx")
    draws = F.transform(F.sequence(F.lit(1), F.size("alleles") * 2), lambda k: uniform(seed, "indel", F.col("idx"), k, *[F.col(c) for c in keys[:-1]]))
    n_private = F.transform("alleles", lambda a: F.coalesce(F.try_element_at("_private", a), F.lit(0).cast("bigint")))
    rows = joined.select(*keys, "alleles", "counts", n_private.alias("_n"), draws.alias("_draws"))
    return rows.select(*keys, drawn_bijection(F.col("alleles"), F.col("_n"), F.col("counts"), F.col("_draws")).alias("mask"))


def invert(mask: str = "mask"):
    """The map that undoes a bijection."""
    return F.map_from_arrays(F.map_values(mask), F.map_keys(mask))
