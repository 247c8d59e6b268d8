"""Percentiles of very large numeric columns with bounded error (problem 5).

Each partition sorts its values by group and makes one summary of each: rank-interval
tuples, for a kept value v lower and upper bounds of the number of values <= v and < v.
Summaries merge by adding bounds, whatever the order; a tuple is dropped unless the count
crosses a multiple of the permitted step, so a group's summary has at most about 1 /
``STEP`` tuples however many values it stands for. While values are read in order all
bounds are exact, and only one of the four is kept; the others follow from it. Merging
runs in levels of ``FAN_IN`` partitions. The tuples' intervals carry the error along: each
answer comes with the largest number of ranks by which it can be off, at most ``STEP`` * n
for each level of summaries.

Cases:

* null, NaN and negative values are left out; a group without values gives no row.
* a null panel or day is a group of its own.
* each id counts once: repeats of a row collapse first; of an id's differing rows each
  distinct one counts.
* heavy ties are one tuple; a group of few distinct values has exact answers.
* an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.operators.joins import join_checked, join_null_safe
from genoframe.tables import ensure_checkpoint_dir

#: Share of a group's values by which one summary may blur ranks.
STEP = 0.001
#: Summaries of so many partitions merge in one task at a time.
FAN_IN = 64
_BOUNDS = ("le_lo", "le_hi", "lt_lo", "lt_hi")
_TUPLES = "n bigint, v array<double>, " + ", ".join(f"{b} array<bigint>" for b in _BOUNDS)


def _starts(columns: list[pa.Array | pa.ChunkedArray], n: int) -> np.ndarray:
    """Where a new combination of the (sorted) columns begins."""
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        codes = pc.fill_null(pc.index_in(c, value_set=pc.unique(c), skip_nulls=False), -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat, kind))


def _thin(group: np.ndarray, n: np.ndarray, v: np.ndarray, bounds: dict[str, np.ndarray], step: float) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Keeps first and last tuple of each group and those that cross a step."""
    width = np.maximum(1, np.floor(n[group] * step)).astype(np.int64)
    crossed = bounds["le_lo"] // width
    before = np.append(-1, crossed[:-1])
    first = np.append(True, group[1:] != group[:-1])
    last = np.append(group[1:] != group[:-1], True)
    keep = first | last | (crossed != before)
    return group[keep], v[keep], {k: b[keep] for k, b in bounds.items()}


def _within(group: np.ndarray, per_tuple: np.ndarray) -> np.ndarray:
    """Running sums that restart with each group."""
    total = np.cumsum(per_tuple)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    base = (total - per_tuple)[first]
    return total - np.repeat(base, np.diff(np.append(first, len(group))))


def _merge(summary: np.ndarray, group: np.ndarray, sizes: np.ndarray, v: np.ndarray, bounds: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Adds up the step functions of all summaries of a group at all their values.

    ``summary`` and ``group`` number the tuples' summary and group, ``sizes`` the values
    each summary stands for."""
    first = np.append(True, summary[1:] != summary[:-1])
    last = np.append(summary[1:] != summary[:-1], True)
    prev_le = np.where(first, 0, np.append(0, bounds["le_lo"][:-1]))
    next_lt = np.where(last, sizes[summary], np.append(bounds["lt_hi"][1:], 0))
    # What each bound gains from a tuple at its own value, and beyond it.
    at = {
        "le_lo": bounds["le_lo"] - prev_le,
        "le_hi": bounds["le_hi"] - bounds["lt_hi"],
        "lt_lo": bounds["lt_lo"] - prev_le,
        "lt_hi": np.zeros_like(prev_le),
    }
    beyond = {
        "le_lo": np.zeros_like(prev_le),
        "le_hi": next_lt - bounds["le_hi"],
        "lt_lo": bounds["le_lo"] - bounds["lt_lo"],
        "lt_hi": next_lt - bounds["lt_hi"],
    }
    order = np.lexsort((v, group))
    group, v = group[order], v[order]
    begins = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (v[1:] != v[:-1])))
    out_group, out_v, out = group[begins], v[begins], {}
    for b in _BOUNDS:
        here = np.add.reduceat(at[b][order], begins)
        past = np.add.reduceat(beyond[b][order], begins)
        out[b] = _within(out_group, here + past) - past
    return out_group, out_v, out


def _pack(keys: dict[str, pa.Array], n: np.ndarray, group: np.ndarray, v: np.ndarray, bounds: dict[str, np.ndarray]) -> pa.RecordBatch:
    sizes = np.bincount(group, minlength=len(n))
    # Where a group's bounds are exact, le_lo says it all: < v is what is <= the value before.
    le, first = bounds["le_lo"], np.append(True, group[1:] != group[:-1])[: len(group)]
    exact_tuple = (bounds["le_hi"] == le) & (bounds["lt_lo"] == bounds["lt_hi"]) & (bounds["lt_lo"] == np.where(first, 0, np.append(0, le[:-1])[: len(le)]))
    exact = np.bincount(group, weights=~exact_tuple, minlength=len(n)) == 0
    loose = ~exact[group]
    columns = [*keys.values(), pa.array(n, pa.int64()), _lists(v, sizes, pa.float64()), _lists(le, sizes, pa.int64())]
    columns += [_lists(bounds[b][loose], np.where(exact, 0, sizes), pa.int64()) for b in _BOUNDS[1:]]
    return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "v", *_BOUNDS])


def _flat(lists: pa.ListArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False)


def _unpack(columns: dict[str, pa.ListArray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Summary number, value and all four bounds of each tuple."""
    owner = pc.list_parent_indices(columns["v"]).to_numpy(zero_copy_only=False).astype(np.int64)
    le = _flat(columns["le_lo"])
    loose = (pc.list_value_length(columns["le_hi"]).to_numpy(zero_copy_only=False) > 0)[owner]
    first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
    bounds = {"le_lo": le, "le_hi": le.copy(), "lt_lo": np.where(first, 0, np.append(0, le[:-1])[: len(le)])}
    bounds["lt_hi"] = bounds["lt_lo"].copy()
    for b in _BOUNDS[1:]:
        bounds[b][loose] = _flat(columns[b])
    return owner, _flat(columns["v"]), bounds


def _summarise_sorted(keys: list[str], step: float):
    """Summaries of rows (keys, part, value) that are sorted by keys and value: those of a
    batch, of which the last may go on in the next one and is merged there."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = _starts([batch.column(k) for k in keys], batch.num_rows)
            n = np.diff(np.append(begins, batch.num_rows))
            group = np.repeat(np.arange(len(begins)), n)
            values = batch.column("value").to_numpy(zero_copy_only=False)
            new = np.append(True, (values[1:] != values[:-1]) | (group[1:] != group[:-1]))
            distinct = np.flatnonzero(new)
            base = begins[group[distinct]]
            le, lt = np.append(distinct[1:], len(values)) - base, distinct - base
            g, v, bounds = _thin(group[distinct], n, values[distinct], {"le_lo": le, "le_hi": le, "lt_lo": lt, "lt_hi": lt}, step)
            yield _pack({k: batch.column(k).take(pa.array(begins)) for k in keys}, n, g, v, bounds)

    merge = _merge_sorted(keys, step)
    return lambda batches: merge(exact(batches))


def _merge_sorted(keys: list[str], step: float):
    """Merges neighbouring summaries of equal keys; the last group of a batch waits."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            begins = _starts([columns[k] for k in keys], len(table))
            group_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(table))))
            sizes = columns["n"].to_numpy(zero_copy_only=False)
            summary, v, bounds = _unpack(columns)
            group, v, bounds = _merge(summary, group_of[summary], sizes, v, bounds)
            n = np.bincount(group_of, weights=sizes, minlength=len(begins)).astype(np.int64)
            group, v, bounds = _thin(group, n, v, bounds, step)
            return _pack({k: columns[k].take(pa.array(begins)) for k in keys}, n, group, v, bounds)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            begins = _starts([table.column(k) for k in keys], len(table))
            if begins[-1] > 0:
                yield merged(table.slice(0, begins[-1]))
            rest = table.slice(begins[-1]).combine_chunks()
            held = [merged_tail] if (merged_tail := _early(rest, merged, keys)) is not None else rest.to_batches()
        if held:
            yield merged(pa.Table.from_batches(held))

    return merge


def _early(rest: pa.Table, merged, keys: list[str]) -> pa.RecordBatch | None:
    """A waiting group of many summaries is merged before it grows further."""
    if len(rest) < FAN_IN:
        return None
    return merged(rest).select(rest.column_names)


def merge_summaries(summaries: DataFrame, keys: list[str], step: float = STEP) -> DataFrame:
    """One summary per combination of ``keys`` (say a panel's of any set of days)."""
    types = dict(summaries.dtypes)
    narrow = summaries.select(*keys, "n", "v", *_BOUNDS)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + _TUPLES
    return narrow.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_sorted(keys, step), schema)


def values_of(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows (keys, metric, value) of the values that count."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value")
    return rows.filter("value >= 0 and not isnan(value)")


def partition_summaries(df: DataFrame, keys: list[str], metrics: list[str], step: float = STEP) -> DataFrame:
    """One summary per combination of ``keys`` and metric of each partition (``part``)."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", metric string, part int, " + _TUPLES
    rows = values_of(df, keys, metrics).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys, "metric", "value")
    return rows.mapInArrow(_summarise_sorted([*keys, "metric", "part"], step), schema)


def summarise(df: DataFrame, keys: list[str], metrics: list[str], step: float = STEP, fan_in: int = FAN_IN) -> DataFrame:
    """One summary per combination of ``keys`` and metric, over all values of ``df``."""
    groups = [*keys, "metric", "part"]
    ensure_checkpoint_dir(df.sparkSession)
    # Written once: how many partitions there really were decides the levels of merging.
    parts = partition_summaries(df, keys, metrics, step).checkpoint()
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while count > fan_in:
        parts = merge_summaries(parts.withColumn("part", F.expr(f"part div {fan_in}").cast("int")), groups, step)
        count = -(-count // fan_in)
    return merge_summaries(parts, [*keys, "metric"], step)


def percentiles(summaries: DataFrame, keys: list[str], points: list[int]) -> DataFrame:
    """Rows (keys, pct, n_values, value, rank_error): the value of rank ceil(pct% * n), and
    by how many ranks it can be off."""
    types = dict(summaries.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", pct int, n_values bigint, value double, rank_error bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False)
            owner, v, flat = _unpack({c: batch.column(c) for c in ("v", *_BOUNDS)})
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            ends = np.append(begins[1:], len(owner))
            far = int(n.max()) + 2
            line = owner * far + flat["le_lo"]
            for p in points:
                rank = np.maximum(1, -(-n * p // 100))
                above = np.minimum(np.searchsorted(line, np.arange(len(n)) * far + rank), ends - 1)
                below = np.maximum(above - 1, begins)
                off = [np.maximum(0, np.maximum(flat["lt_hi"][i] + 1 - rank, rank - flat["le_lo"][i])) for i in (above, below)]
                best = np.where(off[0] <= off[1], above, below)
                columns = [batch.column(k) for k in keys] + [pa.array(np.full(len(n), p, dtype=np.int32)), pa.array(n), pa.array(v[best]), pa.array(np.minimum(*off))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "pct", "n_values", "value", "rank_error"])

    return summaries.mapInArrow(read, schema)


def checked_ranks(values: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pct, n_values, within): whether each answer's exact rank among ``values``
    (``values_of``) lies within its ``rank_error``. Each value is counted below, and up to, all
    answers of its group at once, before the shuffle."""
    listed = answers.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pct", F.col("value").alias("at"), "n_values", "rank_error"))).alias("_answers"))
    points = [r[0] for r in answers.select("pct").distinct().collect()]  # the percentiles asked for
    joined = join_checked(values, listed, keys, "inner")
    counts = [F.count_if(op).alias(f"_{name}{i}") for i in range(len(points)) for name, op in (("lt", F.col("value") < F.col("_answers")[i]["at"]), ("le", F.col("value") <= F.col("_answers")[i]["at"]))]
    counted = join_null_safe(joined.groupBy(*keys).agg(*counts), listed, keys)
    one = F.explode(F.array(*[F.struct(F.col("_answers")[i].alias("a"), F.col(f"_lt{i}").alias("lt"), F.col(f"_le{i}").alias("le")) for i in range(len(points))]))
    rows = counted.select(*keys, one.alias("_r")).select(*keys, "_r.*")
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("a.n_values") * F.col("a.pct") / 100).cast("bigint"))
    off = F.greatest(F.lit(0).cast("bigint"), F.col("lt") + 1 - rank, rank - F.col("le"))
    return rows.select(*keys, F.col("a.pct").alias("pct"), F.col("a.n_values").alias("n_values"), (off <= F.col("a.rank_error")).alias("within"))
