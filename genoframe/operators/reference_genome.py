"""A reference sequence as a table of chunks, and lookups of its bases.

Chunks are rows (chunk, seq) of ``CHUNK`` bases each, so that a lookup is an equality of chunk
numbers whatever the genome's length; a stretch that runs over a chunk's end takes its pieces
from several. Unknown bases are ``?``.

Cases: stretches outside of all chunks are unknown; null indices give no row; alleles that are
null or longer than what is known don't match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.functions.bases import BASES
from genoframe.functions.cigar import aligned_blocks

#: Bases in a chunk.
CHUNK = 256
UNKNOWN = "?"


def consensus_bases(reads: DataFrame) -> DataFrame:
    """(idx, base) of every index that a mapped read (each once) shows a base at: the most
    frequent one, on ties the first in the order of ``BASES``. Counts fold before the shuffle."""
    block = reads.filter("mapped").select("start_idx", "seq", F.explode(aligned_blocks(F.col("cigar"))).alias("_b"))
    each = block.select("*", F.explode(F.sequence(F.lit(0), F.col("_b.len") - 1)).alias("_k")).select(
        (F.col("start_idx") + F.col("_b.ref") + F.col("_k")).alias("idx"), F.call_function("substring", F.col("seq"), F.col("_b.seq") + F.col("_k") + 1, F.lit(1)).alias("_base")
    )
    counts = each.groupBy("idx").agg(*[F.count_if(F.col("_base") == b).alias(b) for b in BASES])
    best = F.greatest(*BASES)
    base = F.coalesce(*[F.when((F.col(b) == best) & (best > 0), F.lit(b)) for b in BASES])
    return counts.select("idx", base.alias("base")).filter("base is not null")


def in_chunks(bases: DataFrame, width: int = CHUNK) -> DataFrame:
    """Chunks of (idx, base) rows, one for each index."""
    placed = bases.select(F.expr(f"idx div {width}").alias("chunk"), F.struct((F.col("idx") % width).cast("int").alias("at"), "base").alias("_x"))
    listed = placed.groupBy("chunk").agg(F.map_from_entries(F.collect_list("_x")).alias("_m"))
    seq = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(UNKNOWN)))
    return listed.select("chunk", F.array_join(seq, "").alias("seq"))


def bases_at(stretches: DataFrame, chunks: DataFrame, width: int = CHUNK) -> DataFrame:
    """(idx, length, bases) of each different stretch (idx, length) of a sequence in chunks."""
    wanted = stretches.select("idx", F.col("length").cast("int").alias("length")).filter("idx is not null and length > 0").distinct()
    spread = wanted.withColumn("chunk", F.explode(F.sequence(F.expr(f"idx div {width}"), F.expr(f"(idx + length - 1) div {width}"))))
    pieces = spread.join(chunks, "chunk", "left").select("idx", "length", F.struct("chunk", F.coalesce("seq", F.lit(UNKNOWN * width)).alias("seq")).alias("_p"))
    joined = pieces.groupBy("idx", "length").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["seq"]), "").alias("_all"))
    return joined.select("idx", "length", F.call_function("substring", F.col("_all"), (F.col("idx") % width).cast("int") + 1, F.col("length")).alias("bases"))


def reference_alleles(variants: DataFrame, chunks: DataFrame, width: int = CHUNK) -> DataFrame:
    """(idx, bases, allele_no) of variants (idx, alleles): what the sequence holds there, as far
    as the longest allele goes, and the first allele (from 0) that it begins with; null if none
    does. Nothing is exchanged: a mismatch is to be counted."""
    longest = variants.select("idx", "alleles", F.array_max(F.transform("alleles", lambda a: F.length(a))).alias("length"))
    found = longest.join(bases_at(longest, chunks, width), ["idx", "length"], "left")
    held = F.transform("alleles", lambda a: F.coalesce(F.call_function("left", F.col("bases"), F.length(a)) == a, F.lit(False)))
    return found.select("idx", "bases", (F.nullif(F.array_position(held, True), F.lit(0).cast("bigint")) - 1).cast("int").alias("allele_no"))
