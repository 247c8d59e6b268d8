"""Several values packed in one field (problem 3).

Works on the byte buffers of Arrow string columns: masks of quotes, brackets and
delimiters over the whole batch, running quote parity to tell protected text, piece
boundaries from mask edges, child offsets, a list array, and its flattened values
beside their parents' ordinals. No loop over rows or pieces.

Cases:

* null, empty, blank and ``.`` fields hold no value; empty pieces aren't counted.
* a quote that isn't closed protects the rest of its field; a ``<`` without ``>`` none.
* an empty table gives no rows; repeated rows give their values once.
* other columns are never read; very long fields need memory for one batch only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = b" \t\n\r\x0b\x0c"


def _mask(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


@dataclass(frozen=True)
class Packing:
    """How a field is packed: delimiter characters; whether ``<...>`` is protected;
    whether a comma separates if a capital ``KEY=`` follows."""

    delimiters: bytes
    brackets: bool = False
    comma_before_key: bool = False


ALLELES = Packing(b",;|/" + _BLANKS, brackets=True)
FORMATS = Packing(b":,;|" + _BLANKS)
ENTRIES = Packing(b";|" + _BLANKS, comma_before_key=True)


def _next_at(where: np.ndarray) -> np.ndarray:
    """For each place the first one from there on at which ``where`` holds, else the end."""
    n = len(where)
    at = np.where(where, np.arange(n), n)
    return np.append(np.minimum.accumulate(at[::-1])[::-1], n)


def _last_at(where: np.ndarray) -> np.ndarray:
    """For each place the last one up to there at which ``where`` holds, else -1."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1)) if len(where) else np.zeros(0, dtype=np.int64)


def split_packed(column: pa.Array, packing: Packing) -> pa.ListArray:
    """The values of each field of a string column, as lists of its rows' pieces."""
    n = len(column)
    column = column.cast(pa.large_string())
    if column.offset or column.null_count:
        column = pa.concat_arrays([pc.fill_null(column, "")])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    begin, end = offsets[:-1], offsets[1:]
    # Outer blanks, then one pair of quotes around everything.
    solid = ~_mask(_BLANKS)[data]
    begin = np.minimum(_next_at(solid)[begin], end)
    last = np.append(_last_at(solid), -1)
    end = np.maximum(begin, np.where(end > 0, last[np.maximum(end, 1) - 1] + 1, 0))
    quote = data == ord('"')
    quotes = np.append(0, np.cumsum(quote))
    padded = np.append(data, np.uint8(0))
    wrapped = (end - begin >= 2) & (padded[begin] == ord('"')) & (padded[np.maximum(end, 1) - 1] == ord('"')) & (quotes[end] - quotes[begin] == 2)
    begin, end = begin + wrapped, end - wrapped
    end = np.where((end - begin == 1) & (padded[begin] == ord(".")), begin, end)
    # Which bytes belong to the fields' content, and to which row.
    edges = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, end, -1)
    content = np.cumsum(edges)[:-1] > 0
    row = np.repeat(np.arange(n), np.diff(offsets))
    protected = (quotes[:-1] - quotes[begin][row]) % 2 == 1 if len(data) else np.zeros(0, dtype=bool)
    if packing.brackets:
        bracket = _last_at(((data == ord("<")) | (data == ord(">"))) & content)
        opened = (bracket >= begin[row]) & (padded[bracket] == ord("<"))
        protected |= opened & (_next_at((data == ord(">")) & content)[:-1] < end[row])
    delimiter = _mask(packing.delimiters)[data]
    if packing.comma_before_key:
        keyish = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")[data]
        after = _next_at(~keyish)
        capital = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")[data]
        starts_key = np.append(capital & (padded[after[:-1]] == ord("=")) & (after[:-1] < end[row]), False)
        follows = _next_at(solid)[1:]
        delimiter |= (data == ord(",")) & starts_key[follows] & (follows < end[row])
    piece = content & ~(delimiter & ~protected)
    # Edges of pieces; neighbouring rows may touch in the buffer.
    first_byte = np.zeros(len(data), dtype=bool)
    first_byte[begin[begin < end]] = True
    before = np.append(False, piece[:-1]) if len(data) else piece
    starts = np.flatnonzero(piece & (~before | first_byte))
    follow = np.append(piece[1:], False) if len(data) else piece
    next_first = np.append(first_byte[1:], True) if len(data) else piece
    ends = np.flatnonzero(piece & (~follow | next_first)) + 1
    sizes = ends - starts
    places = np.append(0, np.cumsum(sizes))
    source = np.repeat(starts - places[:-1], sizes) + np.arange(places[-1])
    values: pa.Array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(data[source].tobytes()))
    parents = row[starts]
    has_quote = quotes[ends] > quotes[starts]
    if has_quote.any():
        some = values.filter(pa.array(has_quote))
        around = pc.match_substring_regex(some, r'(?s)^([^="]*=)?".*"$')
        bare = pc.replace_substring(pc.replace_substring_regex(some, r'(?s)^([^="]*=)?"(.*)"$', r"\1\2"), '""', '"')
        values = pc.replace_with_mask(values, pa.array(has_quote), pc.if_else(around, bare, some))
        kept = pc.not_equal(values, "")
        values, parents = values.filter(kept), parents[kept.to_numpy(zero_copy_only=False)]
    counts = np.bincount(parents, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values.cast(pa.string()))


def packed_values(column: Column, packing: Packing) -> Column:
    """The values of a packed field as an array; empty if it has none."""

    def split(texts: pa.Array) -> pa.Array:
        return split_packed(texts, packing)

    # Arrow's types stand here, since hints of a nested function aren't resolved.
    split.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(split, "array<string>")(column)


def explode_packed(df: DataFrame, key: str, key_type: str, fields: dict[str, Packing]) -> DataFrame:
    """Distinct rows (key, field_name, item_no, item): one per value of each field."""
    schema = f"{key} {key_type}, field_name string, item_no int, item string"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packing in fields.items():
                lists = split_packed(batch.column(name), packing)
                parents = pc.list_parent_indices(lists)
                firsts = lists.offsets.to_numpy()[:-1]
                number = np.arange(len(parents)) - firsts[parents.to_numpy(zero_copy_only=False)] + 1
                keys = batch.column(key).take(parents)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([name] * len(parents), pa.string()), pa.array(number.astype(np.int32)), lists.flatten()],
                    names=[key, "field_name", "item_no", "item"],
                )

    # Repeats go before the values multiply; two versions of a key may still share some.
    rows = df.select(key, *fields).dropDuplicates()
    return rows.mapInArrow(explode, schema).dropDuplicates()


