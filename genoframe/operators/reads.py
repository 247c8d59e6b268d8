"""Aligned reads: placement on the absolute index, and scans by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.cigar import reference_length
from genoframe.functions.names import contig_key
from genoframe.operators.contigs import dictionary, with_index
from genoframe.operators.joins import rows_once

#: Spellings of contigs up to which a range is pushed down by name.
MAX_SPELLINGS = 1000


def place_reads(alignments: DataFrame, contigs: DataFrame, once: bool = True) -> DataFrame:
    """Each read with ``mapped`` and its first and last index (``start_idx``, ``end_idx``,
    null unless mapped).

    Repeated rows collapse on ``ord``, the place in the file, without a shuffle of the others;
    with ``once`` false they stay, for operators that collapse what they make of them. A read is
    mapped if its flag says so and its contig is known; unplaced and unknown ones are kept as
    unmapped."""
    rows = alignments.select("ord", "qname", "flag", "reference_name", "pos", "cigar", "seq", "qual", "sample_id")
    rows = rows_once(rows, "ord") if once else rows
    placed = with_index(rows, contigs, "reference_name", "pos", "left")
    mapped = (F.col("flag").bitwiseAND(4) == 0) & F.col("idx").isNotNull() & (F.col("pos") > 0)
    return (
        placed.withColumn("mapped", F.coalesce(mapped, F.lit(False)))
        .withColumn("start_idx", F.when(F.col("mapped"), F.col("idx")))
        .withColumn("end_idx", F.col("start_idx") + reference_length(F.col("cigar")) - 1)
        .drop("idx")
    )


def scan_reads(
    reads: DataFrame,
    start: int | None = None,
    end: int | None = None,
    unmapped_only: bool = False,
    include_unmapped: bool = False,
    end_inclusive: bool = False,
) -> DataFrame:
    """Reads that overlap a range of indices, or all mapped ones.

    ``unmapped_only`` overrides everything else; ``include_unmapped`` adds all unmapped reads.
    The end is exclusive unless said otherwise. Open ends are no bounds."""
    if unmapped_only:
        return reads.filter(~F.col("mapped"))
    if start is not None and end is not None and end < start:
        raise ValueError("the range ends before it begins")
    hit = F.col("mapped")
    if start is not None:
        hit &= F.col("end_idx") >= start
    if end is not None:
        hit &= (F.col("start_idx") <= end) if end_inclusive else (F.col("start_idx") < end)
    return reads.filter(hit | ~F.col("mapped")) if include_unmapped else reads.filter(hit)


def _range_of_names(alignments: DataFrame, contigs: DataFrame, start: int | None, end: int | None) -> Column:
    """What a read that overlaps [start, end] must fulfil, by its own columns alone: names
    and positions that a file's statistics are kept for. The dictionary is a short list; the
    spellings come from the names' column alone, and beyond ``MAX_SPELLINGS`` of them names
    aren't pushed down."""
    low, high = start if start is not None else 0, end if end is not None else 2**62
    hit = {r.contig_key: r for r in dictionary(contigs).collect() if r.start_idx <= high and r.start_idx + r.contig_length > low}
    # A read reaches right from its position, so only the end bounds positions.
    last = max((min(high, r.start_idx + r.contig_length - 1) - r.start_idx + 1 for r in hit.values()), default=0)
    in_contig = F.lit(False)
    for key, r in hit.items():
        if high < r.start_idx + r.contig_length - 1:
            in_contig |= (contig_key("reference_name") == key) & (F.col("pos") <= high - r.start_idx + 1)
    whole = [k for k, r in hit.items() if high >= r.start_idx + r.contig_length - 1]
    if whole:
        in_contig |= contig_key("reference_name").isin(whole)
    named = alignments.select("reference_name").filter(contig_key("reference_name").isin(list(hit))).distinct()
    spellings = [r[0] for r in named.limit(MAX_SPELLINGS + 1).collect()]
    bounds = F.col("reference_name").isin(spellings) if len(spellings) <= MAX_SPELLINGS else F.col("reference_name").isNotNull()
    # Reads may run past their contig's end, so no upper bound where all of it is wanted.
    return bounds & (F.col("pos") >= 1) & ((F.col("pos") <= last) if not whole else F.lit(True)) & in_contig


def scan_alignments(
    alignments: DataFrame,
    contigs: DataFrame,
    start: int | None = None,
    end: int | None = None,
    unmapped_only: bool = False,
    include_unmapped: bool = False,
    end_inclusive: bool = False,
) -> DataFrame:
    """Placed reads of a scan, each once, straight from the table: what the range excludes is
    left out by pushed filters and before any shuffle; only what is left drops its repeats.

    Options as in ``scan_reads``. Tables sorted by name and position prune row groups."""
    if (start is not None or end is not None) and not unmapped_only and not include_unmapped:
        alignments = alignments.filter(_range_of_names(alignments, contigs, start, end))
    placed = place_reads(alignments, contigs, once=False)
    return scan_reads(placed, start, end, unmapped_only, include_unmapped, end_inclusive).dropDuplicates(["ord"])
