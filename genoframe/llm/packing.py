"""Filling fixed-capacity containers with texts (problem 7).

Sizes are tokens of a public tokenizer. For each capacity the texts are routed to tiers by
context size: the capacities below it, or its half and quarter where there is none. From
the longest tier down, each is packed by itself, best fit first; then the gaps of its
containers, the smallest first, are filled from the next shorter tier and those below, the
largest text that fits at a time. What a tier hasn't given away as filling is packed next.
Texts above the capacity are divided into full pieces and a rest; no other text is.

Work is spread by hash over shards of about ``SHARD_PIECES`` pieces, each packed by one
task; a shard can leave one container under half full at most, so shards cost next to
nothing in fill, and no task, group or driver ever holds all sizes. Step groups go across
shards: each shard deals its containers, by falling attention cost (the sum of squared
sizes), along an arc of the steps' circle that begins where its number says, so that every
step gets containers of many shards from evenly spread places of their order.

Cases:

* null and empty texts have size 0 and get a place like any other.
* rows with a null id, and repeats of a row, are each placed.
* an empty table, or no capacities, gives no rows; null or non-positive capacities are
  no containers; a capacity listed twice under two ids is packed twice.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.tables import ensure_checkpoint_dir

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that one task packs together, and containers of one step.
SHARD_PIECES, STEP_CONTAINERS = 20_000, 8
#: Capacities that one plan packs for; more of them make several plans.
SPECS_AT_ONCE = 100
# Fixed value: the pattern by which this vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, key: str, text: str, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have none. The vocabulary file goes
    to the executors with the session's files."""
    texts.sparkSession.sparkContext.addFile(tokenizer_file)
    name = os.path.basename(tokenizer_file)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) for t in batch[text].where(batch[text].notna(), "")]
            yield pd.DataFrame({key: batch[key].astype("Int64"), "n_tokens": pd.Series(sizes, dtype="int64")})

    return texts.select(F.col(key).cast("bigint").alias(key), text).mapInPandas(count, f"{key} bigint, n_tokens bigint")


def context_tiers(capacity: int, capacities: list[int]) -> list[int]:
    """Upper bounds of the tiers of a capacity, ascending, itself the last."""
    below = sorted({c for c in capacities if 0 < c < capacity}) or sorted({c for c in (capacity // 4, capacity // 2) if c > 0})
    return [*below, capacity]


class _Stock:
    """Texts not packed yet, by size; finds the largest size up to a bound that is left."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.of_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, n in enumerate(sizes):
            self.of_size[n].append(i)
        self.below = list(range(capacity + 1))

    def largest(self, bound: int, least: int) -> int | None:
        """The largest size left in least..bound."""
        at = bound
        while at >= least and not self.of_size[at]:
            # An emptied size points below itself, past others found empty, and never fills again.
            below = self.below[at] if self.below[at] < at else at - 1
            if below >= 0 and not self.of_size[below]:
                below = self.below[below] if self.below[below] < below else below - 1
            self.below[at] = below
            at = below
        return at if at >= least else None

    def take(self, size: int) -> int:
        return self.of_size[size].pop()

    def take_all(self, least: int, bound: int) -> list[int]:
        taken = [i for n in range(least, bound + 1) for i in self.of_size[n]]
        self.of_size[least : bound + 1] = [[] for _ in range(least, bound + 1)]
        return taken


def _pack_tier(texts: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of one tier's texts by themselves: the largest first, each to the tightest
    gap that holds it."""
    gaps: list[int] = []
    by_gap: dict[int, list[int]] = {}
    held: list[list[int]] = []
    for i in sorted(texts, key=lambda i: -sizes[i]):
        at = bisect_left(gaps, sizes[i])
        if at < len(gaps):
            gap = gaps[at]
            container = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[at]
        else:
            gap, container = capacity, len(held)
            held.append([])
        held[container].append(i)
        gap -= sizes[i]
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append(container)
    return held


def fill_containers(sizes: list[int], tiers: list[int]) -> tuple[list[int], list[int], list[int]]:
    """For each size (up to the last tier's bound) its container, and each container's load
    and attention cost."""
    capacity, bounds = tiers[-1], [-1, *tiers]
    stock = _Stock(sizes, capacity)
    containers: list[list[int]] = []
    for k in range(len(tiers), 0, -1):
        own = _pack_tier(stock.take_all(bounds[k - 1] + 1, bounds[k]), sizes, capacity)
        # Gaps from the smallest up, each filled from the next shorter tier, then from those below.
        for held in sorted(own, key=lambda held: -sum(sizes[i] for i in held)):
            gap = capacity - sum(sizes[i] for i in held)
            for t in range(k - 1, 0, -1):
                while (size := stock.largest(min(gap, bounds[t]), bounds[t - 1] + 1)) is not None:
                    held.append(stock.take(size))
                    gap -= size
        containers += own
    container_of = [0] * len(sizes)
    for c, held in enumerate(containers):
        for i in held:
            container_of[i] = c
    return container_of, [sum(sizes[i] for i in held) for held in containers], [sum(sizes[i] ** 2 for i in held) for held in containers]


def step_groups(costs: list[int], steps: int, shard: int, shards: int) -> list[int]:
    """A step for each container of a shard: by falling cost along the circle of all steps,
    from where the shard's arc begins, back and forth where it goes round more than once."""
    out = [0] * len(costs)
    begin = shard * steps // shards
    for turn, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        lap, at = divmod(turn, steps)
        out[i] = (begin + (at if lap % 2 == 0 else steps - 1 - at)) % steps
    return out


_PACKED = "spec_id int, capacity_tokens int, container_id string, place int, {key} bigint, piece_no int, first_token bigint, n_tokens bigint, tier int, step_group string"


def _pack_shards(key: str, capacities: list[int]):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", key, "piece_no"], ascending=[False, True, True], kind="stable", ignore_index=True)
        capacity, spec, number, shards = (int(shard[c][0]) for c in ("capacity_tokens", "spec_id", "shard", "shards"))
        tiers, sizes = context_tiers(capacity, capacities), shard["n_tokens"].tolist()
        container, _, costs = fill_containers(sizes, tiers)
        steps = step_groups(costs, int(shard["steps"][0]), number, shards)
        shard["tier"] = [sum(n > t for t in tiers) + 1 for n in sizes]
        shard["container_id"] = [f"{spec}-{number}-{w}" for w in container]
        shard["step_group"] = [f"{spec}-{steps[w]}" for w in container]
        shard["place"] = shard.groupby("container_id").cumcount() + 1
        return shard[[x.split()[0] for x in _PACKED.format(key=key).split(", ")]]

    return pack


def pack_texts(sizes: DataFrame, key: str, specs: DataFrame, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Container, place and step group of every piece of every text, for each capacity.

    ``sizes`` has (key bigint, n_tokens), ``specs`` (spec_id, capacity_tokens): settings, a
    short list. ``tier`` counts from the shortest."""
    ensure_checkpoint_dir(sizes.sparkSession)
    sizes = sizes.select(key, "n_tokens").checkpoint()
    rows = specs.select(F.col("spec_id").cast("int"), F.col("capacity_tokens").cast("int")).filter("capacity_tokens > 0 and spec_id is not null").distinct().collect()
    wanted = [(r.spec_id, r.capacity_tokens) for r in rows]
    capacities = sorted({c for _, c in wanted})
    parts = [_pack_for(sizes, key, wanted[k : k + SPECS_AT_ONCE], capacities, shard_pieces) for k in range(0, max(1, len(wanted)), SPECS_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def _pack_for(sizes: DataFrame, key: str, wanted: list[tuple[int, int]], capacities: list[int], shard_pieces: int) -> DataFrame:
    # Pieces and tokens of each capacity tell how many shards and steps it needs.
    counts = [F.coalesce(F.sum(x), F.lit(0)) for _, c in wanted for x in (F.expr(f"greatest(1, (n_tokens + {c - 1}) div {c})"), F.col("n_tokens"))]
    totals = list(sizes.agg(*counts).first()) if wanted else []
    plans = []
    for (spec, c), pieces, tokens in zip(wanted, totals[::2], totals[1::2]):
        steps = max(1, -(-tokens // (c * STEP_CONTAINERS)))
        values = {"spec_id": spec, "capacity_tokens": c, "shards": max(1, -(-pieces // shard_pieces)), "steps": steps}
        plans.append(F.struct(*[F.lit(v).cast("int").alias(n) for n, v in values.items()]))
    kind = "array<struct<spec_id:int,capacity_tokens:int,shards:int,steps:int>>"
    rows = sizes.withColumn("_plan", F.explode(F.array(*plans).cast(kind))).select(key, "n_tokens", "_plan.*")
    n_pieces = F.expr("greatest(1, (n_tokens + capacity_tokens - 1) div capacity_tokens)").cast("int")
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n_pieces)))
    rows = rows.select(
        "spec_id",
        "capacity_tokens",
        "shards",
        "steps",
        F.pmod(F.xxhash64(key, "piece_no", "n_tokens"), "shards").cast("int").alias("shard"),
        key,
        "piece_no",
        ((F.col("piece_no") - 1) * F.col("capacity_tokens").cast("bigint")).alias("first_token"),
        F.least(F.col("capacity_tokens").cast("bigint"), F.col("n_tokens") - (F.col("piece_no") - 1) * F.col("capacity_tokens").cast("bigint")).alias("n_tokens"),
    )
    return rows.groupBy("spec_id", "shard").applyInPandas(_pack_shards(key, capacities), _PACKED.format(key=key))
