"""Evaluation texts leaking into training text (problem 8).

Texts become words (runs of ASCII letters and digits in lower case), words hashes. Every
window of ``width`` words of an item and of a document goes through the CGK random walk:
a copy of three times the length in which each step repeats or advances, by a bit of the
word's hash, so that windows a few edits apart stay close in Hamming distance. Each of
``reps`` repetitions samples ``samples`` places of the walked text as its bucket key.
Windows that meet in a bucket are compared by their exact edit distance in words.

Items are a stated query set, taken in blocks of at most ``BLOCK_CHARS`` characters: only a
block's texts are sent to the executors, and each Python worker builds the block's keys
itself (some 26 bytes a character, so 80 MB at most). Every document is read whole, once
per block. Equal windows walk alike, so they
always meet. For windows up to ``edits`` edits apart recall depends on reps and samples
(measured in the tests).

A window can only be within ``edits`` edits of an item's if all but ``edits`` of its words
occur in items; other windows aren't walked. This loses nothing.

Cases:

* null, empty or short texts and passages (under ``width`` words) have no windows.
* items or documents may repeat; each pair is reported once.
* an empty side gives no rows; very long texts are walked in blocks of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, the edits that are looked for, and the LSH's settings.
WIDTH, EDITS, REPS, SAMPLES = 13, 2, 14, 8
#: Characters of passages in one block of items; a longer passage is a block of its own.
BLOCK_CHARS = 3_000_000
#: Bytes of text hashed, and windows walked, at a time.
_TEXT_BYTES, _WINDOWS = 4_000_000, 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit values."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    return (np.cumprod(np.append(np.uint64(1), np.full(n, b, dtype=np.uint64)), dtype=np.uint64) for b in (_BASE, inverse))  # type: ignore[return-value]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and each word's text number."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[: offsets[-1]] if raw is not None and len(texts) else np.zeros(0, dtype=np.uint8)
    table = np.zeros(256, dtype=np.uint8)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalnum():
            table[c] = ord(chr(c).lower())
    folded = table[data]
    inside = folded > 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(folded * power[: len(data)], dtype=np.uint64))
        hashes = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64), 1)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def window_starts(owner: np.ndarray, width: int) -> np.ndarray:
    """Where ``width`` words in a row belong to one text."""
    if len(owner) < width:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])


def walked_keys(words: np.ndarray, starts: np.ndarray, width: int, rep: int, samples: int) -> np.ndarray:
    """Bucket key of each window: sampled places of its CGK walk of 3 * width steps."""
    rng = np.random.default_rng(1000 + rep)
    places = set(rng.choice(3 * width, size=samples, replace=False).tolist())
    coins = _mix(words, 77 + rep)
    at = np.zeros(len(starts), dtype=np.int64)
    key = np.full(len(starts), rep + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for step in range(max(places) + 1):
            within = at < width
            index = np.minimum(starts + at, len(words) - 1)
            if step in places:
                key = _mix(key * np.uint64(31) + np.where(within, words[index], np.uint64(0)), 5)
            at += within & ((coins[index] >> np.uint64(step)) & np.uint64(1)).astype(bool)
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance in words of each pair of rows of two (pairs, width) arrays, exact up to
    ``most`` (a larger one comes out as more than ``most``). Only the
    diagonals that ``most`` edits can reach are filled."""
    n, width = a.shape
    far = np.int8(most + 1)
    before = np.full((width + 1, n), far, dtype=np.int8)
    for j in range(min(most, width) + 1):
        before[j] = j
    for i in range(1, width + 1):
        now = np.full_like(before, far)
        low, high = max(0, i - most), min(width, i + most)
        for j in range(low, high + 1):
            if j == 0:
                now[0] = i
                continue
            cost = before[j - 1] + (a[:, i - 1] != b[:, j - 1])
            if j > i - most:
                cost = np.minimum(cost, now[j - 1] + np.int8(1))
            if j < i + most:
                cost = np.minimum(cost, before[j] + np.int8(1))
            now[j] = np.minimum(cost, far)
        before = now
    return before[width].astype(np.int64)


@dataclass
class ItemIndex:
    """Words and bucket keys of a block of items."""

    item_ids: np.ndarray
    words: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    vocabulary: np.ndarray
    keys: list[np.ndarray]
    windows: list[np.ndarray]


@lru_cache(maxsize=1)
def _built(block: bytes, width: int, reps: int, samples: int) -> ItemIndex:
    """The index of a block of items, an Arrow stream; kept for the worker's next tasks."""
    return build_index(pa.ipc.open_stream(block).read_all(), width, reps, samples)


def build_index(items: pa.Table, width: int, reps: int, samples: int) -> ItemIndex:
    words, owner = word_hashes(items.column("passage").combine_chunks())
    starts = window_starts(owner, width)
    # Equal windows of one item are one window.
    seen = pd.DataFrame({"o": owner[starts], **{i: words[starts + i] for i in range(width)}}).drop_duplicates().index.to_numpy() if len(starts) else starts
    starts = starts[seen]
    keys, windows = [], []
    for rep in range(reps):
        key = walked_keys(words, starts, width, rep, samples)
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        windows.append(order)
    return ItemIndex(items.column("item_id").to_numpy(), words, owner, starts, np.unique(words), keys, windows)


def _known(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(words), dtype=bool)
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return vocabulary[at] == words


def near_windows(texts: pa.Array, index: ItemIndex, width: int, edits: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, window start, edits) of each pair of near windows."""
    words, owner = word_hashes(texts)
    known = np.append(0, np.cumsum(_known(words, index.vocabulary)))
    starts = window_starts(owner, width)
    starts = starts[known[starts + width] - known[starts] >= width - edits]
    found = []
    for k in range(0, len(starts), _WINDOWS):
        block, pairs = starts[k : k + _WINDOWS], []
        for rep, (keys, windows) in enumerate(zip(index.keys, index.windows)):
            key = walked_keys(words, block, width, rep, samples)
            first, last = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            many = last - first
            mine = np.repeat(np.arange(len(block)), many)
            theirs = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            pairs.append(mine * len(index.starts) + windows[theirs])
        pair = np.unique(np.concatenate(pairs))
        for p in range(0, len(pair), _WINDOWS):
            mine, theirs = np.divmod(pair[p : p + _WINDOWS], len(index.starts))
            span = np.arange(width)
            far = edit_distances(words[block[mine][:, None] + span], index.words[index.starts[theirs][:, None] + span], edits)
            near = far <= edits
            mine, theirs = mine[near], theirs[near]
            found.append((owner[block[mine]], index.owner[index.starts[theirs]], block[mine], far[near]))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts.cast(pa.large_string())], dtype=np.int64)
    block = (np.cumsum(sizes) - sizes) // _TEXT_BYTES
    for b in np.unique(block):
        rows = np.flatnonzero(block == b)
        yield int(rows[0]), texts.slice(int(rows[0]), len(rows))


def _search(block, width: int, edits: int, reps: int, samples: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(block.value, width, reps, samples)
        for batch in batches:
            for first, texts in _slices(batch.column("text")):
                doc, item, window, far = near_windows(texts, items, width, edits, samples)
                rows = pd.DataFrame({"d": doc + first, "i": items.item_ids[item], "w": window, "far": far.astype(np.int64)})
                best = rows.groupby(["d", "i"], as_index=False).agg(n_windows=("w", "nunique"), edits=("far", "min"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(best["d"].to_numpy())), pa.array(best["i"].to_numpy(), pa.int64()), pa.array(best["n_windows"].to_numpy(), pa.int64()), pa.array(best["edits"].to_numpy(), pa.int32())],
                    names=["doc_id", "item_id", "n_windows", "edits"],
                )

    return search


def leaked_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, edits: int = EDITS, reps: int = REPS, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, item_id, n_windows, edits): documents with windows near an item's, how many,
    and the fewest edits. ``docs`` has (doc_id, text), ``items`` (item_id, passage)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "passage").filter("item_id is not null and passage is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    out = None
    for b in range(blocks):
        # One block of the query set, of bounded size; the documents stay where they are.
        table = items.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        block = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        found = docs.mapInArrow(_search(block, width, edits, reps, samples), "doc_id bigint, item_id bigint, n_windows bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out
