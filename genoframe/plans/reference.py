"""Queries of the domain's own operators over alignments, site lists and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genoframe.functions import bases, cigar
from genoframe.functions.info import format_value, info_counts, info_number
from genoframe.operators import contigs as dictionary
from genoframe.operators import differences, genotype_matrix, masking, pileup, position_sets, reads, reference_genome, runs, variants
from genoframe.operators.interval_join import covering_pairs
from genoframe.operators.joins import join_null_safe, person_keys
from genoframe.operators.packed_fields import ALLELES, packed_values
from genoframe.plans.reference_sql import ORACLE
from genoframe.plans.settings import NAMED_RANGE, RANDOM_SHARE, RANGE, RECORD_RANGE, SECRET, SEED, UNMASK_RANGE
from genoframe.sources import text_formats
from genoframe.tables import ensure_checkpoint_dir, read_table


def _contigs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "contigs")


def _reads(spark: SparkSession, sf: str, once: bool = True) -> DataFrame:
    return reads.place_reads(read_table(spark, sf, "alignments"), _contigs(spark, sf), once)


def _sites(spark: SparkSession, sf: str, table: str = "vcf_sites") -> DataFrame:
    """The standing row of each record, with its index, alleles and counts."""
    fields = ("vcf_chrom", "vcf_pos", "vcf_ref", "vcf_alt", "vcf_qual", "vcf_filter", "vcf_info")
    rows = read_table(spark, sf, table).groupBy("rec_id").agg(F.max(F.struct("loaded_at", *fields)).alias("_s")).select("rec_id", *[f"_s.{f}" for f in fields])
    rows = dictionary.with_index(rows, _contigs(spark, sf), "vcf_chrom", "vcf_pos")
    return rows.withColumn("ref", F.upper("vcf_ref")).withColumn("alts", F.split(F.upper("vcf_alt"), ",")).withColumn("ac", info_counts(F.col("vcf_info"))).withColumn("an", info_number(F.col("vcf_info")))


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    # The table is small beside the reads and is counted, joined and split again below.
    ensure_checkpoint_dir(spark)
    first = variants.first_per_index(variants.classify(_sites(spark, sf)), "rec_id").checkpoint()
    return variants.snv_table(first), variants.indel_table(first)


def contig_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of the contigs that hold listed sites, worked out again from the dictionary's
    lengths, and the indices that the sites get by them."""
    starts = dictionary.cumulative_starts(_contigs(spark, sf).select("contig_id", "contig_name", "contig_length"))
    sites = dictionary.with_index(_sites(spark, sf).select("rec_id", "vcf_chrom", "vcf_pos"), starts, "vcf_chrom", "vcf_pos")
    span = sites.groupBy("contig_name").agg(F.count(F.lit(1)).alias("n_sites"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return span.join(F.broadcast(starts.select("contig_name", "start_idx")), "contig_name").select("contig_name", "start_idx", "n_sites", "first_idx", "last_idx")


def site_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Named positions to absolute indices."""
    return _sites(spark, sf).select("rec_id", "contig_name", "vcf_pos", "idx")


def index_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute indices back to named positions."""
    return dictionary.with_position(_sites(spark, sf).select("rec_id", "idx"), _contigs(spark, sf))


_SCANNED = ("ord", "qname", "mapped", "contig_name", "start_idx", "end_idx")


def _scan(spark: SparkSession, sf: str, *bounds: int, **options: bool) -> DataFrame:
    return reads.scan_alignments(read_table(spark, sf, "alignments"), _contigs(spark, sf), *bounds, **options)


def _named(spark: SparkSession, sf: str, text: str) -> tuple[int, int]:
    return dictionary.resolve_range(_contigs(spark, sf), *dictionary.parse_range(text))


def scan_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """All mapped reads, placed."""
    return _scan(spark, sf).select(*_SCANNED)


def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped reads that overlap a range."""
    return _scan(spark, sf, *RANGE).select(*_SCANNED)


def scan_named_range(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped reads that overlap a range given by contig names, both ends within it."""
    return _scan(spark, sf, *_named(spark, sf, NAMED_RANGE), end_inclusive=True).select(*_SCANNED)


def scan_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Unmapped reads alone."""
    return _scan(spark, sf, *RANGE, unmapped_only=True).select(*_SCANNED)


def scan_range_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Reads that overlap a range, and all unmapped ones."""
    return _scan(spark, sf, *RANGE, include_unmapped=True, end_inclusive=True).select(*_SCANNED)


def covering_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many reads cover each listed site, deletions included."""
    # Repeated rows of a read collapse as pairs: there are far fewer of them than reads.
    pairs = covering_pairs(_reads(spark, sf, once=False).select("ord", "start_idx", "end_idx"), _sites(spark, sf).select("idx").distinct()).select("ord", "idx").distinct()
    return pairs.groupBy("idx").agg(F.count(F.lit(1)).alias("n_reads"))


def covering_read_count(spark: SparkSession, sf: str) -> DataFrame:
    """Reads per sample that cover a listed site at least."""
    placed = _reads(spark, sf, once=False).select("ord", "start_idx", "end_idx", "sample_id")
    hit = covering_pairs(placed, _sites(spark, sf).select("idx").distinct()).select("ord", "sample_id").distinct()
    return hit.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_covering"))


def _snv_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    snv, _ = _tables(spark, sf)
    return pileup.snv_cells(_reads(spark, sf, once=False), snv.select("idx")), snv


def pileup_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The base that each read shows at each single-base variant that it covers."""
    return _snv_cells(spark, sf)[0].select("ord", "idx", "seq_pos", "unit", "allele")


def pileup_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's base counts at each variant."""
    counts = pileup.base_counts(_snv_cells(spark, sf)[0])
    return counts.select("sample_id", "idx", *[F.get("counts", F.lit(i)).alias(f"n_{b.lower()}") for i, b in enumerate(bases.BASES)])


def genotype_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Genotypes called from each person's pile-ups."""
    return pileup.call_genotypes(pileup.base_counts(_snv_cells(spark, sf)[0])).select("sample_id", "idx", "allele_a", "allele_b")


def allele_count_snvs(spark: SparkSession, sf: str) -> DataFrame:
    """Population counts of single-base variants."""
    snv, _ = _tables(spark, sf)
    return snv.select("idx", "ref_id", *[F.get("counts", F.lit(i)).alias(f"n_{b.lower()}") for i, b in enumerate(bases.BASES)])


def allele_count_indels(spark: SparkSession, sf: str) -> DataFrame:
    """Population counts of insertions and deletions, one row per allele."""
    _, indel = _tables(spark, sf)
    return indel.select("idx", F.posexplode("alleles").alias("allele_no", "a")).select("idx", "allele_no", F.col("a.seq").alias("seq"), F.col("a.count").alias("n"))


def allele_count_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What became of the site list's rows on the way into the table."""
    classified = variants.classify(_sites(spark, sf))
    return variants.table_counters(classified, variants.first_per_index(classified, "rec_id"))


def allele_count_text(spark: SparkSession, sf: str) -> DataFrame:
    """The table's text form, line by line."""
    return text_formats.allele_count_lines(*_tables(spark, sf))


def reference_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Sites whose reference base isn't the one that the other copy of the list has there."""
    own = _sites(spark, sf).select("rec_id", "idx", F.left("ref", F.lit(1)).alias("base"))
    other = _sites(spark, sf, "vcf_sites_mirror").groupBy("idx").agg(F.collect_set(F.left("ref", F.lit(1))).alias("_bases"))
    return own.join(other, "idx").filter(~F.array_contains("_bases", F.col("base"))).select("rec_id", "idx", "base")


def reference_alleles(spark: SparkSession, sf: str) -> DataFrame:
    """For each variant of the table what the reads' consensus holds there, as a sequence in
    chunks, and the first allele that it begins with."""
    first = variants.first_per_index(variants.classify(_sites(spark, sf)), "rec_id")
    chunks = reference_genome.in_chunks(reference_genome.consensus_bases(_reads(spark, sf)))
    return reference_genome.reference_alleles(first.select("idx", "alleles"), chunks)


def merged_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Known variants and random ones over the dictionary; known ones first on ties."""
    first, last = dictionary.resolve_range(_contigs(spark, sf), None, None, None, None)
    random = variants.random_snvs(spark, first, last, RANDOM_SHARE, SEED)
    both = variants.merge_variants(variants.as_variants(*_tables(spark, sf)), random)
    return both.select("idx", "is_snv", "ref_allele", F.array_join("alleles", ",").alias("alleles"), F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


def kept_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants left when each must begin after the last kept one's end."""
    known = variants.as_variants(*_tables(spark, sf)).select("idx", F.length("ref_allele").cast("bigint").alias("length"))
    placed = dictionary.with_position(known, _contigs(spark, sf)).select(F.col("contig_name").alias("group"), "idx", "length")
    return variants.non_overlapping(placed).select(F.col("group").alias("contig_name"), "idx", "length")


def overlap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of listed sites whose reference spans touch."""
    spans = _sites(spark, sf).groupBy("idx").agg(F.max(F.length("ref")).cast("bigint").alias("length"))
    return differences.overlap_clusters(spans)


def _masks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Masks, the variants, and all their cells."""
    cells, snv = _snv_cells(spark, sf)
    # Cells are counted, masked and looked up again; the interval join runs once.
    ensure_checkpoint_dir(spark)
    cells = cells.checkpoint()
    # The planner takes the table for smaller than it is, and would gather it on the driver.
    public = snv.select("idx", "ref_id", F.col("counts").alias("public")).hint("merge")
    calls = pileup.call_genotypes(pileup.base_counts(cells)).join(public, "idx")
    return masking.masks(masking.draw_public(calls, SEED)), snv, cells


def _masked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of masked variants, the variants, and all their cells."""
    masks, snv, cells = _masks(spark, sf)
    # Records, second masks and changed reads all come from these few rows.
    return masking.mask_cells(cells, masks, SEED).checkpoint(), snv, cells


def genotype_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The mask drawn for each called variant of a person."""
    return _masks(spark, sf)[0].select("sample_id", "idx", "allele_a", "allele_b", "to_a", "to_b", "zygosity", "perm_a", "perm_b")


def zygosity_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How many of a person's masks change the genotype in which way."""
    return _masks(spark, sf)[0].groupBy("sample_id", "zygosity").agg(F.count(F.lit(1)).alias("n"))


def masked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """What masking makes of each base, and by which of two masks."""
    return _masked(spark, sf)[0].select("ord", "idx", "allele", "use_b", "masked")


def difference_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that undo the masking, for variants at which a read was changed."""
    return masking.difference_table(_masked(spark, sf)[0])


def mask_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Difference records with their masks as bytes, and read back from them."""
    rows = masking.difference_table(_masked(spark, sf)[0]).withColumn("code_a", bases.permutation_code(F.col("perm_a")))
    return rows.select("sample_id", "idx", "code_a", bases.code_permutation(F.col("code_a")).alias("perm_a"))


def difference_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Difference records of a range, given by names, alone."""
    return differences.slice_range(masking.difference_table(_masked(spark, sf)[0]), *_named(spark, sf, RECORD_RANGE))


def difference_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's first and last record, and the nearest ones to an index."""
    return differences.bounds(masking.difference_table(_masked(spark, sf)[0]), _named(spark, sf, RECORD_RANGE)[1])


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each person's masking run over single-base variants."""
    masked, snv, cells = _masked(spark, sf)
    # Every read over a variant has a cell there, shown base or not.
    return masking.run_counters(_reads(spark, sf), cells.select("ord", "sample_id").distinct(), snv, masked)


def _changes(cells: DataFrame, old: str, new: str) -> DataFrame:
    return cells.filter(f"{old} is not null").select("ord", "seq_pos", "unit", F.col(old).alias("old"), F.col(new).alias("new"), F.col(old).alias("ref_allele"))


_READ = ("ord", "seq", "cigar", "qual")


def masked_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with the masked bases put in."""
    return masking.rewrite_reads(_reads(spark, sf), _changes(_masked(spark, sf)[0], "allele", "masked")).select(*_READ)


def unmasked_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Masked reads restored from difference records and second-mask rows: the originals, and
    whether masking had changed the read."""
    placed, (cells, _, _) = _reads(spark, sf).withColumn("_original", F.col("seq")), _masked(spark, sf)
    given = masking.rewrite_reads(placed, _changes(cells, "allele", "masked"))
    # The masked reads and their records are written tables for whoever restores them.
    given = given.select(*_READ, "sample_id", "start_idx", "end_idx", (F.col("seq") != F.col("_original")).alias("was_masked")).checkpoint()
    records = masking.difference_table(cells).checkpoint()
    again = pileup.snv_cells(given, records.select("idx").distinct())
    restored = masking.unmask_cells(again, records, masking.second_mask_reads(cells))
    return masking.rewrite_reads(given, _changes(restored, "allele", "restored")).select(*_READ, "was_masked")


def indel_pileup(spark: SparkSession, sf: str) -> DataFrame:
    """Allele that each read shows at each insertion or deletion that it covers."""
    _, indel = _tables(spark, sf)
    picked = indel.select("idx", F.col("alleles.seq").alias("alleles"), F.col("alleles.count").alias("counts"))
    return pileup.indel_cells(_reads(spark, sf, once=False), picked).select("ord", "idx", "seq_pos", "unit", "allele")


def _indel_masks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    _, indel = _tables(spark, sf)
    picked = indel.select("idx", F.col("alleles.seq").alias("alleles"), F.col("alleles.count").alias("counts"))
    cells = pileup.indel_cells(_reads(spark, sf, once=False), picked)
    return cells, masking.indel_masks(cells, picked, SEED)


def indel_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The bijection drawn for each insertion or deletion of a person, one row per allele."""
    masks = _indel_masks(spark, sf)[1]
    return masks.select(*person_keys(masks), F.explode("mask").alias("allele", "image"))


def indel_masked_reads(spark: SparkSession, sf: str) -> DataFrame:
    """All reads, with insertions and deletions exchanged by a drawn bijection, CIGAR and all."""
    placed, (cells, masks) = _reads(spark, sf), _indel_masks(spark, sf)
    joined = join_null_safe(cells.filter("allele is not null"), masks, person_keys(masks))
    changes = joined.select("ord", "seq_pos", "unit", F.col("allele").alias("old"), F.element_at("mask", F.col("allele")).alias("new"), "ref_allele")
    return masking.rewrite_reads(placed, changes).select(*_READ)


def _run(spark: SparkSession, sf: str) -> runs.MaskedRun:
    first, last = dictionary.resolve_range(_contigs(spark, sf), None, None, None, None)
    random = variants.random_snvs(spark, first, last, RANDOM_SHARE, SEED)
    # Few rows beside the reads, and used for cells, counts and masks of both kinds.
    kept = runs.kept_variants(variants.as_variants(*_tables(spark, sf)), random, _contigs(spark, sf)).checkpoint()
    return runs.mask_reads(_reads(spark, sf), kept, SEED, SECRET)


def mask_run_reads(spark: SparkSession, sf: str) -> DataFrame:
    """All reads after a whole masking run, both kinds of variants and unmapped reads."""
    return _run(spark, sf).reads.select(*_READ)


def mask_run_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records that undo a whole masking run, as lines of text."""
    run = _run(spark, sf)
    return differences.as_text(run.records, run.second, run.reads.select("ord", F.col("ord").alias("number")))


def _restored(spark: SparkSession, sf: str, **how) -> DataFrame:
    run = _run(spark, sf)
    # Between the two runs masked reads and their records are written tables.
    written = [df.checkpoint() for df in (run.reads, run.records, run.second)]
    return runs.unmask_reads(*written, secret=SECRET, **how).select("ord", "seq", "cigar")


def unmask_all(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped reads restored after a whole masking run: bases and CIGAR of the originals."""
    return _restored(spark, sf)


def unmask_range(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of a range by name, restored. Records outside of the range aren't used."""
    first, last = _named(spark, sf, UNMASK_RANGE)
    return _restored(spark, sf, start=first, end=last)


def unmask_range_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of a range, and all unmapped ones, restored."""
    first, last = _named(spark, sf, UNMASK_RANGE)
    return _restored(spark, sf, start=first, end=last, include_unmapped=True)


def unmask_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Unmapped reads alone, restored."""
    return _restored(spark, sf, unmapped_only=True)


_PLAIN = "^[ATGCN]*$"


def ciphered_reads(spark: SparkSession, sf: str) -> DataFrame:
    """All unmapped reads under the stream cipher, each with a key of its own from its name;
    null where a read holds other letters than the bases and N."""
    key = F.unhex(F.md5(F.concat(F.lit("s:"), "qname")))
    return _scan(spark, sf, unmapped_only=True).select("ord", F.when(F.col("seq").rlike(_PLAIN), bases.stream_cipher(F.col("seq"), key)).alias("seq"))


def secret_ciphered_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The same with 64-byte keys, and whether deciphering gives the read again."""
    key = bases.read_key(F.unhex(F.lit("ff" * 16)), F.col("qname"))
    cipher = F.when(F.col("seq").rlike(_PLAIN), bases.stream_cipher(F.col("seq"), F.col("_key")))
    once = _scan(spark, sf, unmapped_only=True).withColumn("_key", key).withColumn("cipher", cipher)
    return once.select("ord", "cipher", (bases.stream_cipher(F.col("cipher"), F.col("_key")) == F.col("seq")).alias("restored"))


def secret_ciphers_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the cipher changed each unmapped read, and deciphering gave it again; null where
    a read holds other letters."""
    again = secret_ciphered_reads(spark, sf).join(_scan(spark, sf, unmapped_only=True).select("ord", "seq"), "ord")
    return again.select("ord", (F.col("cipher") != F.col("seq")).alias("changed"), "restored")


def packed_reads(spark: SparkSession, sf: str) -> DataFrame:
    """All reads as two bits a base, and unpacked again. Two bits can't hold an N or other
    letters: such reads have null ``packed`` and their letters as they are."""
    rows = _reads(spark, sf).withColumn("packed", bases.pack_bases(F.col("seq")))
    return rows.select("ord", F.hex("packed").alias("packed"), F.coalesce(bases.unpack_bases(F.col("packed"), F.length("seq")), "seq").alias("seq"))


def cigar_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Expanded CIGARs of all mapped reads, shrunk again, and the bases they use."""
    rows = _scan(spark, sf).select("ord", "cigar", cigar.expand(F.col("cigar")).alias("expanded"))
    return rows.select("ord", "expanded", cigar.shrink(F.col("expanded")).alias("shrunk"), cigar.reference_length(F.col("cigar")).alias("on_reference"), cigar.read_length(F.col("cigar")).alias("on_read"))


def sam_text(spark: SparkSession, sf: str) -> DataFrame:
    """All reads as lines, each row of the file once."""
    return text_formats.sam_lines(read_table(spark, sf, "alignments").dropDuplicates(["ord"]))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "vcf_calls").select("call_id", "sample_id", "vcf_kind", "vcf_chrom", "vcf_pos", "vcf_ref", "vcf_alt", "vcf_qual", "vcf_filter", "vcf_format", "genotype").dropDuplicates()
    rows = dictionary.with_index(rows, _contigs(spark, sf), "vcf_chrom", "vcf_pos")
    return rows.withColumn("depth", format_value(F.col("vcf_format"), F.col("genotype"), "DP").try_cast("int")).withColumn("freq", format_value(F.col("vcf_format"), F.col("genotype"), "VAF").try_cast("double"))


def passing_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that passed, deep and good enough, with depth and frequency from their keys."""
    return _calls(spark, sf).filter("vcf_filter = 'PASS' and depth > 30 and vcf_qual > 30").select("call_id", "idx", "vcf_kind", "depth", "freq")


def _kinds(spark: SparkSession, sf: str) -> list[DataFrame]:
    calls = _calls(spark, sf)
    return [calls.filter(F.col("vcf_kind") == kind) for kind in ("population", "personal", "masked")]


def position_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Where each called position occurs: population, personal, masked, and what that means."""
    return position_sets.membership(*_kinds(spark, sf))


def position_set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the sets, their intersections and differences, and their share of all."""
    return position_sets.set_sizes(position_sets.membership(*_kinds(spark, sf)))


def frequency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Frequencies of calls in ten bins, by kind."""
    return position_sets.histogram(_calls(spark, sf), F.col("freq"), ["vcf_kind"])


def masked_bin_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of masked calls in each frequency bin."""
    bins = position_sets.histogram(_calls(spark, sf), F.col("freq"), ["vcf_kind"])
    return position_sets.bin_shares(bins, "masked", ["masked", "personal"], "vcf_kind")


def altered_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Personal beside masked calls of one position: altered or not."""
    one = lambda df: df.groupBy("idx").agg(F.min(F.struct(F.col("vcf_alt").alias("alt"), "freq")).alias("_c")).select("idx", "_c.alt", "_c.freq")
    _, personal, masked = _kinds(spark, sf)
    return position_sets.altered(one(personal), one(masked))


def personal_population_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Personal calls at positions of the site list."""
    return _kinds(spark, sf)[1].join(_sites(spark, sf).select("idx"), "idx", "left_semi").select("call_id", "idx")


def _genotypes(cells: DataFrame, snv: DataFrame, base: str) -> DataFrame:
    """Genotypes called from one column of cells, with the share of bases unlike the reference."""
    calls = pileup.call_genotypes(pileup.base_counts(cells.withColumn("allele", F.col(base)))).filter("allele_a is not null")
    joined = calls.join(snv.select("idx", "ref_id").hint("merge"), "idx")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n)
    share = 1 - F.get(F.col("counts"), F.col("ref_id")) / total
    return joined.select("sample_id", "idx", F.concat_ws("/", "allele_a", "allele_b").alias("alt"), share.alias("freq"))


def _called_twice(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genotypes called before and after masking, and the variants."""
    cells, snv, _ = _masked(spark, sf)
    return _genotypes(cells, snv, "allele"), _genotypes(cells, snv, "masked"), snv


def altered_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's genotype beside the one called from the masked reads: altered or not."""
    personal, masked, _ = _called_twice(spark, sf)
    return position_sets.altered(personal, masked, ["sample_id", "idx"])


def altered_genotype_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many of each person's genotypes are altered, and their share."""
    return position_sets.altered_counts(altered_genotypes(spark, sf), ["sample_id"])


def genotype_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Where positions occur: in the allele-count table, with an allele unlike the reference
    among persons' genotypes, and among those called from masked reads."""
    personal, masked, snv = _called_twice(spark, sf)
    return position_sets.membership(snv, personal.filter("freq > 0"), masked.filter("freq > 0"))


def cohort_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Genotypes of all samples at each called site, the reference's where none is listed."""
    rows = _calls(spark, sf).withColumn("gt", format_value(F.col("vcf_format"), F.col("genotype"), "GT")).filter("gt is not null and gt <> ''")
    site = F.concat_ws(":", "contig_name", F.col("vcf_pos").cast("string"), "vcf_ref", "vcf_alt")
    return genotype_matrix.cohort(rows.select(site.alias("site_id"), "sample_id", "gt")).select("site_id", F.array_join("genotypes", " ").alias("genotypes"))


def split_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites by alternative, each once, single bases only."""
    split = genotype_matrix.split_alternatives(_sites(spark, sf).select("contig_name", "vcf_pos", "ref", "alts"))
    return split.filter("length(ref) = 1 and alt rlike '^[ATGC]$'").groupBy("site_id").agg(F.min("alt_no").alias("alt_no"))


def _dosages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _calls(spark, sf).withColumn("gt", format_value(F.col("vcf_format"), F.col("genotype"), "GT")).filter("gt is not null")
    # The whole list is split, so that alt_no is the number that the genotype uses.
    alts = F.transform(packed_values(F.col("vcf_alt"), ALLELES), F.upper)
    split = genotype_matrix.split_alternatives(rows.select("contig_name", "vcf_pos", F.col("vcf_ref").alias("ref"), alts.alias("alts"), "sample_id", "gt"))
    return genotype_matrix.dosages(split.filter("alt rlike '^[ATGC]$'"))


def sample_dosages(spark: SparkSession, sf: str) -> DataFrame:
    """How often each sample has each single-base alternative, multi-allelic calls included."""
    return _dosages(spark, sf)


def sample_components(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components of the samples' genotypes."""
    return genotype_matrix.principal_components(_dosages(spark, sf), 2)


def sample_components_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per component: its samples, whether its weights have length one, and whether it explains
    no more than those before it and a share between 0 and 1."""
    rows = sample_components(spark, sf)
    each = rows.groupBy("component").agg(F.count_distinct("sample_id").alias("n_samples"), F.sum(F.col("weight") * F.col("weight")).alias("_sum"), F.max("explained").alias("_share"))
    before = F.coalesce(F.min("_share").over(W.orderBy("component").rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))  # two rows
    return each.select("component", "n_samples", (F.abs(F.col("_sum") - 1) < 1e-9).alias("unit"), ((F.col("_share") <= before) & (F.col("_share") > 0)).alias("in_order"))


QUERIES = {
    f.__name__: f
    for f in (
        contig_starts, site_indices, index_positions, scan_mapped, scan_range, scan_unmapped, scan_range_unmapped, covering_counts, covering_read_count, pileup_cells, pileup_counts, scan_named_range, mask_run_reads, mask_run_records, unmask_all, unmask_range,
        unmask_range_unmapped, unmask_unmapped, indel_masks, secret_ciphers_checked, altered_genotypes, altered_genotype_counts, genotype_classes, cohort_genotypes,
        sample_components_checked, reference_alleles,
        genotype_calls, allele_count_snvs, allele_count_indels, allele_count_counters, allele_count_text, reference_mismatches, merged_variants, kept_variants, overlap_clusters,
        genotype_masks, zygosity_changes, masked_cells, difference_records, mask_codes, difference_slice, difference_bounds, run_counters, masked_reads, unmasked_reads, indel_pileup,
        indel_masked_reads, ciphered_reads, secret_ciphered_reads, packed_reads, cigar_lengths, sam_text, passing_calls, position_classes, position_set_sizes, frequency_histogram,
        masked_bin_shares, altered_calls, personal_population_calls, split_sites, sample_dosages, sample_components,
    )
}

__all__ = ["ORACLE", "QUERIES"]
