"""Rows that fail to parse (problem 2).

Raw lines of tab-separated variant files become typed rows, or keep the first reason
for which they can't. Columns are assembled quote-aware: every separator becomes the
delimiter of Python's strict csv reader, so that each quoted value is a field of its
own and a quote that isn't closed, or is closed too early, is a structural exception.
Only then are the typed fields built, each by a constructor that raises its reason.

Cases:

* null, empty and blank lines and lines beginning with ``#`` are no records.
* one closing carriage return isn't part of a line.
* a file without a ``#CHROM`` line: its records need the eight fixed columns at least.
* a file with several: the first by line number counts.
* a null file name is a file of its own.
* repeated lines are judged each by itself; very long lines are read whole.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.operators.joins import join_checked

FIXED_COLUMNS = 8
_SEPARATORS = str.maketrans({"=": "\t", ",": "\t", ";": "\t", "\r": " ", "\n": " "})
_BREAKS = str.maketrans({"\r": " ", "\n": " "})
_DIGITS = re.compile(r"[0-9]+")
_BASES = re.compile(r"[ACGTNacgtn]+")
_ALLELE = re.compile(r"[ACGTNacgtn]+|\*|<[A-Za-z0-9:_-]+>")
_QUALITY = re.compile(r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_ENTRY = re.compile(r'((?:[^";]|"(?:[^"]|"")*")*)(;|$)')
_MAX_POS = 4_294_967_295

PARSED_SCHEMA = (
    "line_id bigint, file_name string, line_no bigint, reason string, vcf_chrom string, vcf_pos bigint, vcf_id string, vcf_ref string, "
    "vcf_alt string, vcf_qual double, vcf_filter string, vcf_info string, vcf_format string, genotype string"
)


class FieldError(ValueError):
    """A field that can't be built; the message is the reason."""


def _read(text: str) -> list[str]:
    """The values of one line by the strict reader. Raises csv.Error."""
    return next(csv.reader([text], delimiter="\t", quotechar='"', doublequote=True, strict=True), [])


def assemble_columns(line: str) -> list[str]:
    """The columns of a line; tabs in quoted values don't separate. Raises csv.Error."""
    csv.field_size_limit(sys.maxsize)
    columns, begin, at = [], 0, 0
    has_quote = '"' in line
    # Without quotes nothing but tabs can separate columns.
    for value in _read(line.translate(_SEPARATORS if has_quote else _BREAKS)):
        quoted = has_quote and line.startswith('"', at)
        end = at + len(value) + (2 + value.count('"') if quoted else 0)
        if quoted and (at == 0 or line[at - 1] not in "=," or line[end : end + 1] not in ("", ";", ",", "\t")):
            raise csv.Error("quoted text where no value stands")
        if not quoted and has_quote and '"' in value:
            raise csv.Error("quote within a plain value")
        if line[end : end + 1] in ("", "\t"):
            columns.append(line[begin:end])
            begin = end + 1
        at = end + 1
    return columns


def _position(text: str) -> int:
    digits = text.lstrip("0")
    if not _DIGITS.fullmatch(text) or not 1 <= len(digits) <= 10 or int(digits) > _MAX_POS:
        raise FieldError("pos")
    return int(digits)


def _reference(text: str) -> str:
    if not _BASES.fullmatch(text):
        raise FieldError("ref")
    return text


def _alternatives(text: str) -> list[str]:
    alleles = text.split(",")
    if text != "." and not all(_ALLELE.fullmatch(a) for a in alleles):
        raise FieldError("alt")
    return alleles


def _quality(text: str) -> float | None:
    if text == ".":
        return None
    if not _QUALITY.fullmatch(text):
        raise FieldError("qual")
    return float(text)


def _count(text: str | None) -> int:
    if text is None or not _DIGITS.fullmatch(text):
        raise FieldError("info")
    return int(text)


def _info(text: str, alleles: int) -> str:
    if text == ".":
        return text
    entries = text.split(";") if '"' not in text else [m[1] for m in _ENTRY.finditer(text) if m[0] or m.start() == 0 or text[m.start() - 1] == ";"]
    if len(entries) > 1 and not entries[-1]:
        entries.pop()
    known: dict[str, str | None] = {}
    for entry in entries:
        key, has_value, value = entry.partition("=")
        if not _KEY.fullmatch(key):
            raise FieldError("info")
        known.setdefault(key, value if has_value else None)
    total = _count(known["AN"]) if "AN" in known else None
    if "AC" in known:
        counts = [_count(x) for x in (known["AC"] or "").split(",")]
        if len(counts) != alleles or (total is not None and sum(counts) > total):
            raise FieldError("info")
    return text


def parse_line(line: str, n_columns: int | None) -> tuple:
    """(reason, typed fields...): the reason is null where all fields could be built."""
    failed = (None,) * 10
    line = line.removesuffix("\r")
    try:
        columns = assemble_columns(line)
    except csv.Error:
        return ("quoting", *failed)
    if len(columns) < FIXED_COLUMNS or (n_columns is not None and len(columns) != n_columns):
        return ("columns", *failed)
    chrom, pos, name, ref, alt, qual, passed, info = columns[:FIXED_COLUMNS]
    try:
        position, reference = _position(pos), _reference(ref)
        alleles = _alternatives(alt)
        typed = (position, name, reference, alt, _quality(qual), passed, _info(info, len(alleles)))
    except FieldError as e:
        return (str(e), *failed)
    return (None, chrom, *typed, columns[8] if len(columns) > 8 else None, "\t".join(columns[9:]) if len(columns) > 9 else None)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PARSED_SCHEMA.split(", ")]
    sys.set_int_max_str_digits(0)
    for batch in batches:
        widths = [None if pd.isna(n) else int(n) for n in batch["n_columns"]]
        parsed = [parse_line(t, n) for t, n in zip(batch["line_text"], widths)]
        typed = pd.DataFrame(parsed, columns=names[3:], dtype=object)
        keys = batch[["line_id", "file_name", "line_no"]].reset_index(drop=True)
        out = pd.concat([keys, typed], axis=1)
        yield out.astype({"vcf_pos": "Int64", "vcf_qual": "Float64"})


def parse_variant_lines(lines: DataFrame) -> DataFrame:
    """One row per record of ``lines`` (line_id, file_name, line_no, line_text) with its
    ``reason``, or null and the typed fields. Lines stay in the partitions in which they
    were read; only the files' column counts are gathered and joined."""
    lines = lines.select("line_id", "file_name", "line_no", "line_text")
    heads = (
        lines.filter(F.col("line_text").startswith("#CHROM"))
        .select("file_name", F.struct(F.size(F.split("line_text", "\t")).alias("n"), F.lit(0)).alias("_x"), F.struct("line_no", "line_id").alias("_at"))
        .groupBy("file_name")
        .agg(F.min_by("_x.n", "_at").alias("n_columns"))
    )
    records = lines.filter(~F.col("line_text").startswith("#") & (F.trim(F.regexp_replace("line_text", r"\s+", " ")) != ""))
    return join_checked(records, heads, ["file_name"]).mapInPandas(_parse_batches, PARSED_SCHEMA)
