"""Duplicates hidden by formatting differences (problem 4).

Each record becomes canonical bytes. Records are then partitioned by radix: the counts
of all six-byte prefixes, rolled up to four and two bytes, show which prefixes hold more
than ``capacity`` records; those are split by further bytes (and, where six bytes don't
do, counted again six bytes deeper) until each bucket fits. Each bucket is counted in a
trie whose terminal nodes carry the number of copies and the smallest id.

A bucket whose records are all one record can't be split; its count and smallest id are
known from the prefix counts, so its rows get them by a join and never meet in a task.

Cases:

* null and empty fields alike hold nothing; records of nothing but such fields are one.
* ids may repeat: each row is one copy; a row with a null id is a copy with a null id.
* an empty table gives no rows; only id and canonical bytes are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.operators.joins import join_checked
from genoframe.tables import ensure_checkpoint_dir

#: Bytes by which a bucket is split, and how deep one counting pass looks.
STEP, DEPTH = 2, 6
#: Characters on one edge of a trie.
EDGE = 8
_RUN = r"[\p{L}\p{N}]+"


def bare(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def runs_as_set(text: Column) -> Column:
    """The runs of letters and digits as a sorted set, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_RUN})"), F.lit(1)))), ",")


def pairs_as_set(text: Column) -> Column:
    """``key=value`` pairs as a sorted set. A key is a run before ``=`` or ``:``; the runs
    up to the next key are its value, in order, dot-joined."""
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"({_RUN})[\"'\s]*[=:]", "\u0001$1=")
    parts = F.split(marked, "\u0001")

    def pair(part: Column) -> Column:
        runs = F.array_join(F.regexp_extract_all(F.regexp_replace(part, rf"^{_RUN}=", ""), F.lit(f"({_RUN})"), F.lit(1)), ".")
        return F.concat(F.regexp_extract(part, rf"^({_RUN}=)", 1), runs)

    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, pair), lambda p: p != ""))), ";")


def _identical() -> Column:
    return (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b"))


def _prefix_counts(rows: DataFrame, key: str, depth: int) -> DataFrame:
    a, b = F.xxhash64(F.lit("a"), "canon"), F.xxhash64(F.lit("b"), "canon")
    return rows.groupBy(F.substring("canon", 1, depth).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min(a).alias("lo_a"), F.max(a).alias("hi_a"), F.min(b).alias("lo_b"), F.max(b).alias("hi_b"), F.min(key).alias("rep")
    )


def _roll_up(counts: DataFrame, depth: int) -> DataFrame:
    return counts.groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(
        F.sum("n").alias("n"), F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"), F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b"), F.min("rep").alias("rep")
    )


def radix_buckets(rows: DataFrame, key: str, capacity: int) -> DataFrame:
    """``rows`` with ``bucket``, the shortest prefix that fits ``capacity`` or holds one
    record only; of the latter kind if oversized, ``rep`` and ``n`` are set.

    The lists of oversized prefixes have at most rows / capacity entries a level.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    out = rows.withColumn("bucket", F.lit(None).cast("string")).withColumn("rep", F.lit(None).cast(rows.schema[key].dataType)).withColumn("n", F.lit(None).cast("bigint"))
    pending, base = rows, 0
    while True:
        counts = _prefix_counts(pending, key, base + DEPTH).checkpoint()
        for depth in range(base + STEP, base + DEPTH + 1, STEP):
            level = counts if depth == base + DEPTH else _roll_up(counts, depth)
            over = level.filter(F.col("n") > capacity)
            hot = over.filter(_identical()).select(F.col("prefix").alias("_p"), F.col("rep").alias("_rep"), F.col("n").alias("_n"))
            split = over.filter(~_identical()).select(F.col("prefix").alias("_p"), F.lit(True).alias("_split"))
            marks = hot.withColumn("_split", F.lit(False)).unionByName(split, allowMissingColumns=True)
            if marks.isEmpty():
                return out.withColumn("bucket", F.coalesce("bucket", F.substring("canon", 1, depth)))
            at = F.when(F.col("bucket").isNull(), F.substring("canon", 1, depth))
            out = join_checked(out.withColumn("_p", at), marks, ["_p"])
            settled = F.when(F.col("bucket").isNull() & ~F.coalesce("_split", F.lit(False)), F.substring("canon", 1, depth))
            out = out.select(*rows.columns, F.coalesce("bucket", settled).alias("bucket"), F.coalesce("rep", "_rep").alias("rep"), F.coalesce("n", "_n").alias("n"))
        base += DEPTH
        pending = out.filter("bucket is null").select(*rows.columns)
        if pending.isEmpty():
            return out


class Trie:
    """Counts texts; edges carry ``EDGE`` characters, terminal nodes the counters."""

    def __init__(self) -> None:
        self.edges: dict[tuple[int, str], int] = {}
        self.copies: dict[int, int] = {}
        self.smallest: dict[int, object] = {}

    def add(self, text: str, key: object) -> int:
        node = 0
        for at in range(0, len(text), EDGE):
            node = self.edges.setdefault((node, text[at : at + EDGE]), len(self.edges) + 1)
        self.copies[node] = self.copies.get(node, 0) + 1
        known = self.smallest.get(node)
        if known is None or (key is not None and key < known):
            self.smallest[node] = key
        return node


def _count_in_tries(key: str):
    def flush(trie: Trie, keys: list, nodes: list) -> pd.DataFrame:
        out = pd.DataFrame({key: pd.array(keys, dtype="Int64"), "rep": pd.array([trie.smallest[x] for x in nodes], dtype="Int64"), "n": [trie.copies[x] for x in nodes]})
        return out.astype({"n": "int64"})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, trie, keys, nodes = None, Trie(), [], []
        for batch in batches:
            for k, canon, b in zip(batch[key].astype(object), batch["canon"], batch["bucket"]):
                if b != bucket:
                    if nodes:
                        yield flush(trie, keys, nodes)
                    bucket, trie, keys, nodes = b, Trie(), [], []
                k = None if pd.isna(k) else int(k)
                keys.append(k)
                nodes.append(trie.add(canon[len(b) :], k))
        if nodes:
            yield flush(trie, keys, nodes)

    return count


def count_copies(rows: DataFrame, key: str, capacity: int = 50_000) -> DataFrame:
    """For each row (``key`` bigint, ``canon`` string): ``rep``, the smallest key among
    the rows of the same canon, and ``n``, their number."""
    rows = rows.select(F.col(key).cast("bigint").alias(key), "canon")
    buckets = radix_buckets(rows, key, capacity)
    hot = buckets.filter("n is not null").select(key, "rep", "n")
    cold = buckets.filter("n is null").select(key, "canon", "bucket").repartition("bucket").sortWithinPartitions("bucket")
    return cold.mapInPandas(_count_in_tries(key), f"{key} bigint, rep bigint, n bigint").unionByName(hot)
