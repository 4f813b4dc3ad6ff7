"""Benchmark items that turn up in documents, whole or slightly changed.

Windows of a document as long as an item are fingerprinted by SimHash. Item fingerprints are indexed by ten blocks of
bits: whatever lies within ``RADIUS`` bits agrees with an item on some block but for one bit, so probing each block and
its one-bit changes finds all of them. Candidates are then compared exactly by the weighted Jaccard similarity of their
shingles. Only windows that hold a shingle of the item can be similar, so windows are formed around such shingles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, range_keys, slices, text_bytes
from .simhash_dedup import simhash

#: Words of a shingle; an item with fewer is one shingle of all its words.
WIDTH = 5
#: Least weighted Jaccard similarity of a leak.
SIMILARITY = 0.8
#: Fingerprints within so many bits become candidates.
RADIUS = 19
#: Blocks of the index; RADIUS // BLOCKS bits may differ in one of them.
BLOCKS = 10
#: Items, and bytes of their texts, that one pass over the documents compares with; more are taken in several passes.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 32_000_000

class Items:
    """Benchmark items with the keys of their shingles and the block index of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], width: int = WIDTH):
        self.ids = [i for i, _ in rows]
        self.shingles: list[list[bytes]] = []
        self.widths = np.zeros(len(rows), np.int64)
        keys, owners = [], []
        for n, (_, text) in enumerate(rows):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            joined, starts, ends, _ = folded_words(raw, np.array([0, len(raw)]))
            w = min(width, len(starts))
            self.widths[n] = w
            count = len(starts) - w + 1 if w else 0
            s, e = starts[:count], ends[w - 1 :][:count] if w else ends[:0]
            self.shingles.append([joined[a:b] for a, b in zip(s.tolist(), e.tolist())])
            keys.append(range_keys(joined, s, e))
            owners.append(np.full(count, n))
        self.keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        self.owners = np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]
        self.sizes = np.array([len(s) for s in self.shingles], np.int64)
        self.counters = [Counter(s) for s in self.shingles]
        hashes = [xxhash.xxh64_intdigest(x, 42) for s in self.shingles for x in s]
        self.prints = simhash(np.array(hashes, np.uint64), self.sizes) if len(rows) else np.zeros(0, np.uint64)
        edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
        self.blocks = [(np.uint64(a), b - a) for a, b in zip(edges, edges[1:])]
        self.index = []
        for start, width_ in self.blocks:
            value = (self.prints >> start) & np.uint64((1 << width_) - 1)
            table: dict[int, list[int]] = {}
            for n, v in enumerate(value.tolist()):
                if self.sizes[n]:
                    table.setdefault(v, []).append(n)
            # Whatever item is within RADIUS // BLOCKS (one) bit of a block value.
            self.index.append([np.array(sorted({n for v in [x, *(x ^ (1 << b) for b in range(width_))] for n in table.get(v, ())}), np.int64) for x in range(1 << width_)])

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, item) of all item fingerprints within RADIUS of the given ones."""
        for (start, width), table in zip(self.blocks, self.index):
            value = ((prints >> start) & np.uint64((1 << width) - 1)).astype(np.int64)
            for v in np.unique(value).tolist():
                if len(table[v]):
                    at = np.flatnonzero(value == v)
                    near = np.bitwise_count(prints[at][:, None] ^ self.prints[table[v]][None, :]) <= RADIUS
                    i, j = np.nonzero(near)
                    yield from zip(at[i].tolist(), table[v][j].tolist())


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over sum of the larger counts."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / max(a.total() + b.total() - both, 1)


def _leaks(data: np.ndarray, offsets: np.ndarray, items: Items, similarity: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window of each item in each text."""
    joined, starts, ends, first_word = folded_words(data, offsets)
    words = np.diff(first_word)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for w in np.unique(items.widths[items.widths > 0]).tolist():
        count = np.maximum(words - w + 1, 0)
        base = np.cumsum(count) - count
        first = np.repeat(first_word[:-1], count) + np.arange(count.sum()) - np.repeat(base, count)
        s, e = starts[first], ends[first + w - 1]
        keys = range_keys(joined, s, e)
        at = np.searchsorted(items.keys, keys)
        at[at == len(items.keys)] = 0
        hits = np.flatnonzero(items.keys[at] == keys)
        if not len(hits):
            continue
        lo, hi = np.searchsorted(items.keys, keys[hits]), np.searchsorted(items.keys, keys[hits], side="right")
        place = np.repeat(hits, hi - lo)
        item = items.owners[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        fits = items.widths[item] == w
        place, item = place[fits], item[fits]
        text = np.searchsorted(base, place, side="right") - 1
        # Windows of the item's length that hold the shingle, within the text; a text shorter than that is one window.
        for size in np.unique(items.sizes[item]).tolist():
            own = items.sizes[item] == size
            t = text[own]
            low = np.maximum(place[own] - size + 1, base[t])
            high = np.minimum(place[own], np.maximum(base[t] + count[t] - size, base[t]))
            spread = np.maximum(high - low + 1, 0)
            window = np.unique(np.repeat(low, spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread))
            if not len(window):
                continue
            wt = np.searchsorted(base, window, side="right") - 1
            length = np.minimum(size, base[wt] + count[wt] - window)
            prints = _window_prints(joined, s, e, window, length)
            wanted = set(zip(t.tolist(), item[own].tolist()))
            seen = set()
            for i, n in items.within(prints):
                if items.sizes[n] != size or (i, n) in seen or (int(wt[i]), n) not in wanted:
                    continue
                seen.add((i, n))
                a = int(window[i])
                found = Counter(joined[x:y] for x, y in zip(s[a : a + int(length[i])].tolist(), e[a : a + int(length[i])].tolist()))
                score = weighted_jaccard(found, items.counters[n])
                place_in_text = a - int(base[wt[i]])
                if score >= similarity and (score, -place_in_text) > best.get((int(wt[i]), n), (0.0, 0)):
                    best[int(wt[i]), n] = (score, -place_in_text)
    for (t, n), (score, begin) in best.items():
        length = min(int(items.sizes[n] + items.widths[n] - 1), int(words[t]) + begin)
        yield t, n, score, -begin, length


def _window_prints(joined: bytes, s: np.ndarray, e: np.ndarray, window: np.ndarray, length: np.ndarray) -> np.ndarray:
    """SimHash of each window of shingles; bits are summed once per stretch and taken as differences."""
    reach = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(window.tolist(), length.tolist())]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], 42) for x, y in zip(s[reach].tolist(), e[reach].tolist())), np.uint64, len(reach))
    out = np.zeros(len(window), np.uint64)
    at = np.searchsorted(reach, window)
    for bit in range(64):
        ones = np.concatenate([[0], np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        out |= (2 * (ones[at + length] - ones[at]) > length).astype(np.uint64) << np.uint64(bit)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item found in each document, with its best window.

    Words are lower-cased (A-Z) runs without white space. Null or blank items and texts match nothing. An item of fewer
    than ``width`` words is one shingle of all its words. Repeated items and documents are each reported; empty tables
    give no rows; other columns are ignored. Items are compared in passes of bounded size, so a large benchmark takes
    several passes over the documents rather than more memory.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shipped in _passes(benchmark):
        part = picked.mapInArrow(_matcher(shipped, similarity, width), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def _passes(benchmark: DataFrame) -> Iterator:
    """The items as broadcast lists of bounded size, one for each pass over the documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    for turn in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def _matcher(shipped, similarity: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shipped.value, width)
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                rows = list(_leaks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], items, similarity))
                if rows:
                    t, n, score, first, length = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([a + x for x in t])), pa.array([items.ids[x] for x in n], pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(length, pa.int64())],
                        names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The documents that hold no benchmark item. Each row is judged by its own text, whatever its id; columns are unchanged."""
    for shipped in _passes(benchmark):
        docs = docs.mapInArrow(_keeper(shipped, docs.columns.index("text"), similarity, width), docs.schema)
    return docs


def _keeper(shipped, at: int, similarity: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shipped.value, width)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            data, offsets = text_bytes(batch.column(at))
            for a, b in slices(offsets):
                for t, *_ in _leaks(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], items, similarity):
                    keep[a + t] = False
            yield batch.filter(pa.array(keep))

    return run
