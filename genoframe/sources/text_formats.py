"""Reads, variants, allele counts and differences as text: readers and line builders.

Readers go through ``spark.read.text`` (compressed files too) and give each line's place,
which is ascending within a file. Builders make one line per row for ``write.text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.info import info_counts, info_number


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("ord"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven columns of each alignment line, header lines left out, and ``ord``."""
    names = ("qname", "flag", "reference_name", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    kinds = {"flag": "int", "mapq": "int", "pos": "bigint", "pnext": "bigint", "tlen": "bigint"}
    cut = _lines(spark, path).filter("line <> '' and not startswith(line, '@')").select("ord", F.split("line", "\t").alias("c"))
    return cut.select("ord", *[F.get("c", F.lit(i)).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)])


def read_sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, contig_name, contig_length) of the header's sequence lines, in their order."""
    heads = _lines(spark, path).filter("startswith(line, '@SQ')")
    named = heads.select("ord", F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("contig_name"), F.regexp_extract("line", r"\tLN:([0-9]+)", 1).cast("bigint").alias("contig_length"))
    from pyspark.sql import Window as W

    return named.select((F.row_number().over(W.orderBy("ord")) - 1).alias("contig_id"), "contig_name", "contig_length")  # the header: a short list


def read_vcf(spark: SparkSession, path: str, ac_tag: str = "AC", an_tag: str = "AN") -> DataFrame:
    """Typed columns of each variant line, with alts, ac and an."""
    names = ("vcf_chrom", "vcf_pos", "vcf_id", "ref", "vcf_alt", "vcf_qual", "vcf_filter", "vcf_info")
    cut = _lines(spark, path).filter("line <> '' and not startswith(line, '#')").select("ord", F.split("line", "\t").alias("c"))
    rows = cut.select("ord", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return (
        rows.withColumn("vcf_pos", F.col("vcf_pos").cast("bigint"))
        .withColumn("vcf_qual", F.when(F.col("vcf_qual") != ".", F.col("vcf_qual").cast("double")))
        .withColumn("alts", F.split("vcf_alt", ","))
        .withColumn("ac", info_counts(F.col("vcf_info"), ac_tag))
        .withColumn("an", info_number(F.col("vcf_info"), an_tag))
    )


def sam_lines(rows: DataFrame) -> DataFrame:
    """(ord, line) of reads, ready to be ordered and written."""
    names = ("qname", "flag", "reference_name", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    return rows.select("ord", F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("*" if n not in ("pos", "mapq", "pnext", "tlen", "flag") else "0")) for n in names]).alias("line"))


def sam_header(contigs: DataFrame) -> list[str]:
    """Header lines of reads on the contigs of a dictionary, which is a short list."""
    rows = contigs.select("contig_name", "contig_length").orderBy("contig_id").collect()
    return ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{r.contig_name}\tLN:{r.contig_length}" for r in rows]]


def allele_count_lines(snv: DataFrame, indel: DataFrame) -> DataFrame:
    """(block, idx, line): two lines of totals, then SNV rows, then INDEL rows, as the text form
    has them."""
    totals = [df.agg(F.count(F.lit(1)).cast("string").alias("line")).select(F.lit(0).alias("block"), F.lit(at).cast("bigint").alias("idx"), "line") for at, df in enumerate((snv, indel))]
    a = snv.select(F.lit(1).alias("block"), "idx", F.concat_ws("\t", F.col("idx").cast("string"), F.col("ref_id").cast("string"), F.array_join(F.transform("counts", lambda n: n.cast("string")), ",")).alias("line"))
    pairs = F.array_join(F.transform("alleles", lambda x: F.concat(x["count"].cast("string"), F.lit(":"), x["seq"])), ",")
    b = indel.select(F.lit(2).alias("block"), "idx", F.concat_ws("\t", F.col("idx").cast("string"), pairs).alias("line"))
    return totals[0].unionByName(totals[1]).unionByName(a).unionByName(b)


def read_allele_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of a text of ``allele_count_lines``. A file may be shorter than its totals
    say, but not longer, and no INDEL may stand among the SNVs."""
    cut = _lines(spark, path).select("ord", F.split("line", "\t").alias("c"))
    width = F.size("c")
    seen = cut.agg(
        F.max_by(F.col("c")[0], -F.col("ord")).alias("n_snv"),
        F.max(F.when(width == 3, F.col("ord"))).alias("last_snv"),
        F.min(F.when(width == 2, F.col("ord"))).alias("first_indel"),
        F.count_if(width == 3).alias("snvs"),
    ).first()
    if seen.first_indel is not None and seen.last_snv is not None and seen.first_indel < seen.last_snv:
        raise ValueError("an insertion or deletion stands among single bases")
    if seen.n_snv is not None and seen.snvs > int(seen.n_snv):
        raise ValueError("more single bases than the file's first line says")
    snv = cut.filter(width == 3).select(F.col("c")[0].cast("bigint").alias("idx"), F.col("c")[1].cast("int").alias("ref_id"), F.transform(F.split(F.col("c")[2], ","), lambda n: n.cast("bigint")).alias("counts"))
    pair = lambda x: F.struct(F.split(x, ":")[0].cast("bigint").alias("count"), F.split(x, ":")[1].alias("seq"))
    indel = cut.filter(width == 2).select(F.col("c")[0].cast("bigint").alias("idx"), F.transform(F.split(F.col("c")[1], ","), pair).alias("alleles"))
    return snv, indel


def read_differences(spark: SparkSession, path: str) -> DataFrame:
    """SNV and INDEL records of a difference text; header and index lines are left out.

    Lines of neither five columns nor, for changed zygosity, seven raise when read."""
    cut = _lines(spark, path).select(F.split("line", "\t").alias("c")).filter(F.get("c", F.lit(0)).rlike("^[0-9]+$") & (F.size("c") > 2))
    changed = F.get("c", F.lit(3)).isin("1", "3")
    sound = F.size("c") == F.when(changed, 7).otherwise(5)
    checked = cut.select(F.when(sound, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("not a difference record: "), F.concat_ws(" ", "c")))).alias("c"))
    images = lambda i: F.split(F.get("c", F.lit(i)), ",")
    return checked.select(
        F.col("c")[0].cast("bigint").alias("idx"),
        (F.col("c")[1] == "1").alias("is_snv"),
        F.col("c")[2].cast("int").alias("ref_id"),
        F.col("c")[3].cast("int").alias("zygosity"),
        images(4).alias("images_a"),
        F.coalesce(images(5), images(4)).alias("images_b"),
        F.transform(images(6), lambda n: n.cast("int")).alias("beta"),
    )


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of files that aren't empty; each is read by one task, so for files of
    moderate size."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"))


# Fixed value: how a masked file's header line begins.
MARK = "@mt"


def mark_header(lines: list[str], source_md5: str, table_md5: str) -> list[str]:
    """Header lines with the mark of a masked file; marked ones are refused."""
    if any(line.startswith(MARK) for line in lines):
        raise ValueError("the file is masked already")
    return [*lines, f"{MARK}\tbm:{source_md5}\tvc:{table_md5}"]


def unmark_header(lines: list[str]) -> list[str]:
    """Header lines without the mark, if it is the last of them; else as they are."""
    return lines[:-1] if lines and lines[-1].startswith(MARK) else lines
