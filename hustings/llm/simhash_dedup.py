"""Near-duplicate groups from SimHash fingerprints, linked by a joint walk over a binary trie.

All pairs of fingerprints within ``radius`` differing bits are found by a self-join of the trie of fingerprints: pairs
of nodes are walked together, differing bits add up, and a pair of nodes is dropped as soon as the budget is exceeded.
To share the walk among tasks the 64 bits are cut into ``radius + 2`` blocks. Two fingerprints within the radius agree
on at least two blocks, so for each choice of two blocks a trie is built that has these bits first, and only its
subtries below equal first bits are walked. A subtrie is a row group of one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.session import cut_lineage

from .common import folded_words, shingles, slices, text_bytes
from .components import components

#: Subtries with more fingerprints are walked in parts, each pair of parts by a task of its own.
PART_ROWS = 20_000
#: Node pairs walked at once.
FRONTIER = 200_000
#: In a subtrie of more points, what lies near its middle is linked to one point and not compared among itself.
DENSE = 128
#: Sketch for near copies: 64-bit words, words compared, and the bits of these that may differ (39 are expected at 0.8).
SKETCH_WORDS = 10
COMPARED_WORDS = 4
SKETCH_BUDGET = 56
#: Bits of a key of the sketch, and keys of a sketch.
KEY_BITS = 14
KEYS = 45
#: Texts of one part when a group of candidates is compared exactly; two parts meet in a task.
PART_TEXTS = 500
LANES = np.uint64(0x0101010101010101)


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint per text from its shingle hashes: a bit is 1 if set in over half of them; no hash gives 0."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    n = counts[filled]
    parts = -(-n // 255)  # eight byte-wide counters in one word hold 255 rows
    first = np.cumsum(n) - n
    cuts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    groups = np.cumsum(parts) - parts
    result = np.zeros(len(filled), np.uint64)
    for shift in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, cuts)
        ones = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        set_bits = (2 * ones > n[:, None]).astype(np.uint64)
        for byte in range(8):
            result |= set_bits[:, byte] << np.uint64(8 * byte + shift)
    out[filled] = result
    return out


def text_fingerprints(column: pa.Array, width: int, words: int = 0) -> np.ndarray:
    """The SimHash of each text; with ``words``, that many from independent mixes of the shingle hashes, a row per text."""
    data, offsets = text_bytes(column)
    out = [np.zeros((0, words) if words else 0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for a, b in slices(offsets):
        joined, starts, ends, first_word = folded_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        s, e, counts = shingles(starts, ends, first_word, width)
        hashes = np.fromiter((digest(joined[x:y], 42) for x, y in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        out.append(np.stack([simhash(_mixed(hashes, w), counts) for w in range(words)], axis=1) if words else simhash(hashes, counts))
    return np.concatenate(out)


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    h = (hashes ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text over its ``width``-word shingles, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = text_fingerprints(batch.column(1), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def blocks(radius: int) -> list[tuple[int, int]]:
    """Start and width of ``radius + 2`` blocks of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    return label


def walk(rest: np.ndarray, pairs: list[np.ndarray], radius: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``rest`` within ``radius``, from the given pairs of trie nodes.

    ``rest`` holds the bits to compare, highest first, in rows of 64-bit words, sorted within each node. ``pairs`` are the
    arrays (from, to) of the one node, (from, to) of the other, and the bits that differ so far; a node paired with itself
    gives each pair once.
    """
    stack = [(*pairs, depth)]
    while stack:
        a0, a1, b0, b1, used, depth = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append((a0[:half], a1[:half], b0[:half], b1[:half], used[:half], depth))
            stack.append((a0[half:], a1[half:], b0[half:], b1[half:], used[half:], depth))
            continue
        product = (a1 - a0) * (b1 - b0)
        leaf = (product <= 16) | (depth == 0)
        if leaf.any():  # few pairs left below: compare the remaining bits at once
            size = product[leaf]
            for part in _parts(size):
                inner = np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                across = np.repeat((b1 - b0)[leaf][part], size[part])
                i = np.repeat(a0[leaf][part], size[part]) + inner // np.maximum(across, 1)
                j = np.repeat(b0[leaf][part], size[part]) + inner % np.maximum(across, 1)
                own = np.repeat((a0 == b0)[leaf][part], size[part])
                near = (np.bitwise_count(rest[i] ^ rest[j]).sum(axis=1, dtype=np.int64) <= radius) & ~(own & (i >= j))
                yield i[near], j[near]
            keep = ~leaf
            a0, a1, b0, b1, used = a0[keep], a1[keep], b0[keep], b1[keep], used[keep]
        if not len(a0):
            continue
        depth -= 1
        am, bm = _split(rest, a0, a1, depth), _split(rest, b0, b1, depth)
        own = a0 == b0
        nexts = [(a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1), (am, a1, b0, bm, used + 1)]
        nexts[3] = tuple(x[~own] for x in nexts[3])  # within one node, the other order is the same pair
        a0, a1, b0, b1, used = (np.concatenate(x) for x in zip(*nexts))
        keep = (used <= radius) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 < 2))
        stack.append((a0[keep], a1[keep], b0[keep], b1[keep], used[keep], depth))


def _parts(size: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    edges = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(size), np.arange(most, int(size.sum()) + most, most), side="right"), [len(size)]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield slice(a, b)


def _split(rest: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the given bit turns to 1 within each sorted range whose higher bits are equal."""
    lo, hi, one, word = lo.copy(), hi.copy(), np.uint64(1 << (bit % 64)), rest[:, rest.shape[1] - 1 - bit // 64]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        high = (word[mid] & one) != 0
        hi[open_[high]] = mid[high]
        lo[open_[~high]] = mid[~high] + 1


def _dense(rest: np.ndarray, lo: int, hi: int, radius: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Thin a crowded node: links of its middle point to all points near it, and the node pairs still to be walked.

    The point nearest to the bitwise majority is linked to everything within ``radius`` of it. Those points are connected,
    so they need not meet each other, only the rest of the node. Returns rows in place: ranges of an index array.
    """
    links, cross, left = [], [], np.arange(lo, hi)
    while len(left) > DENSE:
        bits = np.unpackbits(rest[left].view(np.uint8).reshape(len(left), -1), axis=1)
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(left)).view(np.uint64)
        point = left[np.bitwise_count(rest[left] ^ middle).sum(axis=1, dtype=np.int64).argmin()]
        near = np.bitwise_count(rest[left] ^ rest[point]).sum(axis=1, dtype=np.int64) <= radius
        if 4 * near.sum() < len(left):
            break
        ball, left = left[near], left[~near]
        links.append((np.full(len(ball) - 1, point), ball[ball != point]))
        cross.append((ball, left))
    return links, [*cross, (left, left)]


def _walk_groups(group: np.ndarray, side: np.ndarray, rest: np.ndarray, radius: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the smaller rows they are connected with by what the walk finds in each group.

    Rows are sorted by group, side and rest. A group with rows of both sides is a pair of nodes, others are one node.
    """
    label, held, size = None, [], 0
    for rows, nodes, links in _jobs(group, side, rest, radius):
        held += links
        if not nodes:
            continue
        for i, j in walk(rest if rows is None else rest[rows], [*nodes, np.zeros(len(nodes[0]), np.int64)], radius, depth):
            held.append((i, j) if rows is None else (rows[i], rows[j]))
            size += len(i)
            if size > 1_000_000:  # keep the connections, not the pairs
                label = _least_reachable(len(rest), *(np.concatenate(x) for x in zip(*held)), label)
                held, size = [], 0
    if held:
        label = _least_reachable(len(rest), *(np.concatenate(x) for x in zip(*held)), label)
    if label is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    moved = np.flatnonzero(label != np.arange(len(rest)))
    return moved, label[moved]


def _jobs(group: np.ndarray, side: np.ndarray, rest: np.ndarray, radius: int) -> Iterator[tuple]:
    """(rows, node pairs, links) to walk: all rows or an index array, nodes in it, and links made by thinning."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([starts[1:], [len(group)]])
    first, last = side[starts], side[ends - 1]
    middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
    alone, cross = (last == 0) & (ends - starts > 1), (first == 0) & (last == 1)
    crowded = alone & (ends - starts > DENSE)
    plain = alone & ~crowded
    yield None, [np.concatenate(x) for x in (
        (starts[plain], starts[cross]), (ends[plain], middle[cross]), (starts[plain], middle[cross]), (ends[plain], ends[cross]))], []
    for lo, hi in zip(starts[crowded].tolist(), ends[crowded].tolist()):
        links, pairs = _dense(rest, lo, hi, radius)
        yield None, [], links
        for a, b in pairs:
            own = a is b
            rows = a if own else np.concatenate([a, b])
            cut = [[0], [len(a)], [0], [len(a)]] if own else [[0], [len(a)], [len(a)], [len(rows)]]
            if len(a) and len(b):
                yield rows, [np.array(x) for x in cut], []


def _nearest_and_least(group: np.ndarray, side: np.ndarray, rest: np.ndarray, radius: int, depth: int) -> tuple[np.ndarray, ...]:
    """Rows with a partner within ``radius``: the row, the smallest row it is connected with, the nearest found and its bits.

    Input as for ``_walk_groups``. Where a crowded node is thinned, the nearest found is the point in its middle.
    """
    label, held, size = np.arange(len(rest)), [], 0
    best = np.full(len(rest), np.iinfo(np.int64).max)
    for rows, nodes, links in _jobs(group, side, rest, radius):
        found = walk(rest if rows is None else rest[rows], [*nodes, np.zeros(len(nodes[0]), np.int64)], radius, depth) if nodes else ()
        for i, j in (*links, *((i, j) if rows is None else (rows[i], rows[j]) for i, j in found)):
            bits = np.bitwise_count(rest[i] ^ rest[j]).sum(axis=1, dtype=np.int64) << 40
            np.minimum.at(best, i, bits | j)
            np.minimum.at(best, j, bits | i)
            held.append((i, j))
            size += len(i)
            if size > 1_000_000:
                label = _least_reachable(len(rest), *(np.concatenate(x) for x in zip(*held)), label)
                held, size = [], 0
    if held:
        label = _least_reachable(len(rest), *(np.concatenate(x) for x in zip(*held)), label)
    met = np.flatnonzero(best < np.iinfo(np.int64).max)
    return met, label[met], best[met] & ((1 << 40) - 1), best[met] >> 40


def trie_links(points: DataFrame, radius: int = 4, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``points`` (fp) exactly as all pairs within ``radius`` would.

    Of each walked subtrie only a spanning forest is returned, so the rows never exceed the points times the number of
    tries.
    """
    cut = blocks(radius)
    tries = []
    for t, (i, j) in enumerate(combinations(range(len(cut)), 2)):
        def bits(k: int):
            start, width = cut[k]
            return F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1))

        key, rest = F.lit(t).cast("long"), F.lit(0).cast("long")
        for k in (i, j):
            key = F.shiftleft(key, cut[k][1]).bitwiseOR(bits(k))
        for k in range(len(cut)):
            if k not in (i, j):
                rest = F.shiftleft(rest, cut[k][1]).bitwiseOR(bits(k))
        tries.append(F.struct(key.alias("key"), rest.alias("rest")))
    depth = 64 - min(cut[i][1] + cut[j][1] for i, j in combinations(range(len(cut)), 2))
    rows = points.select(F.col("fp").alias("name"), F.explode(F.array(*tries)).alias("t")).select("name", "t.key", F.array("t.rest").alias("rest"))
    return subtrie_links(rows, radius, depth, part_rows)


def subtrie_links(rows: DataFrame, radius: int, depth: int, part_rows: int = PART_ROWS, nearest: bool = False) -> DataFrame:
    """Links (u, v) of ``name`` values that connect the rows of each ``key`` whose ``rest`` differ in ``radius`` bits or less.

    ``rest`` is an array of longs whose last ``depth`` bits are compared. A subtrie of more than ``part_rows`` rows is cut
    into parts by hash; each pair of parts is one row group, so no key has to fit a task. With ``nearest`` every row that
    has a partner is returned once for a key, with the ``near`` row of fewest differing ``bits``; there v may be u itself.
    """
    large = rows.groupBy("key").count().where(F.col("count") > part_rows).select("key", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    placed = rows.join(large, "key", "left").withColumn("own", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("name"), "parts")).cast("int"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("other")
    units = placed.select("name", "key", "rest", "own", other).select(
        "name", "key", "rest",
        F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    units = units.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(cols: list[np.ndarray]):
            name, key, p, q, side, rest = cols
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            counts = np.bincount(group)
            keep = counts[group] > 1  # most rows are alone
            name, group, side, rest = name[keep], group[keep], side[keep], rest[keep].view(np.uint64)
            if not len(name):
                return None
            by = np.lexsort((*(rest[:, w] for w in range(rest.shape[1] - 1, -1, -1)), side, group))
            name = name[by]
            if nearest:
                a, b, near, apart = _nearest_and_least(group[by], side[by], rest[by], radius, depth)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (name[a], name[b], name[near], apart)], names=["u", "v", "near", "bits"])
            a, b = _walk_groups(group[by], side[by], rest[by], radius, depth)
            return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(c) for c in batch.columns[:-1]]
            cols.append(np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1))
            cols = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            _, key, p, q, _, _ = cols
            last = np.flatnonzero((key != key[-1]) | (p != p[-1]) | (q != q[-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            held = [c[cut_at:] for c in cols]
            if cut_at and (found := links([c[:cut_at] for c in cols])):
                yield found
        if held and (found := links(held)):
            yield found

    units = units.select("name", "key", "p", "q", "side", "rest")
    return units.mapInArrow(run, "u long, v long, near long, bits long") if nearest else units.mapInArrow(run, "u long, v long").distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable. A null or
    blank text has fingerprint 0 and is linked like any other. Equal fingerprints are folded to one point before the
    join, so copies are never paired. Rows that repeat a doc_id each get a row. A null doc_id never names a component
    (a component of null ids only has a null id). Other columns are ignored; an empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, width, id_col, text_col))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    return _named(prints, points, components(trie_links(points.select("fp"), radius)), "fp").select("doc_id", "fp", "component_id")


def _named(made: DataFrame, points: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Rows with the smallest doc_id of their component, by way of the distinct fingerprints ``points``."""
    rooted = points.join(roots, points[name] == roots["node"], "left").select(name, "least_id", F.coalesce("root", name).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return made.join(rooted.join(named, "root").select(name, "component_id"), name)


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def sketches(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, print, sketch, keys): a SimHash of ``SKETCH_WORDS`` * 64 bits of every whole text.

    ``print`` is a hash of all its bits, ``text_hash`` one of the text; ``sketch`` holds the words that are compared, ``keys`` the bits cut into keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = text_fingerprints(batch.column(1), width, SKETCH_WORDS)
            raw = [w.tobytes() for w in words]
            bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1)[:, : KEYS * KEY_BITS].reshape(len(words), KEYS, KEY_BITS)
            keys = (np.arange(KEYS, dtype=np.int64) << KEY_BITS) | (bits @ (1 << np.arange(KEY_BITS, dtype=np.int64)))
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()) for x in (words[:, :COMPARED_WORDS].copy().view(np.int64), keys)]
            digest = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(digest), *lists], names=["doc_id", "text_hash", "print", "sketch", "keys"])

    text = F.col(text_col).cast("string")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return picked.mapInArrow(run, "doc_id long, text_hash long, print long, sketch array<long>, keys array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(print, hashes): the distinct shingle hashes of the ``text`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            done = 0
            for a, b in slices(offsets):
                joined, starts, ends, first_word = folded_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                s, e, counts = shingles(starts, ends, first_word, width)
                hashes = np.fromiter((digest(joined[x:y], 42) for x, y in zip(s.tolist(), e.tolist())), np.uint64, len(s)).view(np.int64)
                sets = [np.unique(h) for h in np.split(hashes, np.cumsum(counts)[:-1])]
                at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, b - a), pa.ListArray.from_arrays(at, np.concatenate(sets))], names=["print", "hashes"])
                done += b - a

    return texts.select("print", "text").mapInArrow(run, "print long, hashes array<long>")


def hubs(links: DataFrame) -> DataFrame:
    """(print, part) of every end of the links (u, v): the neighbour of most links, or the point itself if it has more.

    Points of one part have a link to the same point, so they are connected; a part need not be all that is.
    """
    ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = ends.groupBy("u").agg(F.count("*").alias("n"))
    around = ends.join(degree.select(F.col("u").alias("v"), "n"), "v").groupBy("u").agg(F.max(F.struct("n", "v")).alias("best"))
    own = F.struct("n", F.col("u").alias("v"))
    return degree.join(around, "u").select(F.col("u").alias("print"), F.greatest(own, "best")["v"].alias("part"))


def among_parts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct links (u, v) of different parts that links of points make, by the (print, part) of ``labels``."""
    one, two = (labels.select(F.col("print").alias(end), F.col("part").alias(f"{end}_part")) for end in ("u", "v"))
    both = links.select("u", "v").where("u <> v").join(one, "u").join(two, "v").where("u_part <> v_part")
    return both.select(F.greatest("u_part", "v_part").alias("u"), F.least("u_part", "v_part").alias("v")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets of (print, hashes) have a Jaccard similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("print").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("print").alias("v"), F.col("hashes").alias("b")), "v")
    # common / (all - common) >= 4 / 5
    return both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def open_units(members: DataFrame, part_texts: int = PART_TEXTS) -> DataFrame:
    """Rows (print, gid, part) of the candidate groups that are not connected yet, dealt to units of two parts each.

    ``members``: (print, part, gid), a row per text; ``gid`` names its candidate group, ``part`` the texts it is known to
    be connected with. The largest such part of a group needs no comparing within: it only meets the others, which also
    meet among themselves. Both are cut by hash into stretches of ``part_texts``. A group of two texts has been compared.
    """
    sizes = members.groupBy("gid", "part").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("gid").agg(F.count("*").alias("parts"), F.sum("n").alias("texts"), F.max(F.struct("n", "part")).alias("most"))
    left = groups.where((F.col("parts") > 1) & (F.col("texts") > 2)).select(
        "gid", F.col("most.part").alias("largest"),
        F.ceil(F.col("most.n") / part_texts).cast("int").alias("held"), F.ceil((F.col("texts") - F.col("most.n")) / part_texts).cast("int").alias("asked"),
    )
    rows = members.join(left, "gid").withColumn("in_largest", F.col("part") == F.col("largest"))
    own = F.pmod(F.xxhash64("print"), F.when(F.col("in_largest"), F.col("held")).otherwise(F.col("asked"))).cast("int")

    def unit(kind: int, p, q, side):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"))

    to_asked = F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda a: unit(0, F.col("own"), a, F.lit(0)))
    to_held = F.transform(F.sequence(F.lit(0), F.col("held") - 1), lambda h: unit(0, h, F.col("own"), F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda a: unit(1, F.least("own", a), F.greatest("own", a), F.col("own") > a))
    dealt = rows.withColumn("own", own).withColumn("unit", F.explode(F.when(F.col("in_largest"), to_asked).otherwise(F.concat(to_held, among))))
    return dealt.select("print", "gid", "part", "unit.kind", "unit.p", "unit.q", "unit.side")


def _compare_unit(table: pa.Table) -> pa.Table:
    """Links (u, v) that connect the parts of a unit by pairs of 0.8 or more; pairs of connected parts are not compared."""
    names, parts, side = (np.asarray(table.column(c)) for c in ("print", "part", "side"))
    sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64).reshape(len(names), -1)
    by = np.lexsort((*(sketch[:, w] for w in range(sketch.shape[1] - 1, -1, -1)), side))
    names, parts, side, sketch = names[by], parts[by], side[by], sketch[by]
    hashes = [np.asarray(table.column("hashes")[int(k)].values) for k in by]
    middle, n = int((side == 0).sum()), len(names)
    across = 0 < middle < n
    alone = table.column("kind")[0].as_py() == 1 and not across  # a stretch of the smaller parts that meets itself
    nodes = [[0], [middle], [middle], [n]] if across else [[0], [n], [0], [n]]
    found = list(walk(sketch, [np.array(x) for x in (*nodes, [0])], SKETCH_BUDGET, 64 * sketch.shape[1])) if (across or alone) and n > 1 else []
    made = []
    if found:
        i, j = (np.concatenate(x) for x in zip(*found))
        open_ = parts[i] != parts[j]
        i, j = i[open_], j[open_]
        order = np.argsort(np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1), kind="stable")
        root = {int(c): int(c) for c in np.unique(parts)}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x, y in zip(i[order].tolist(), j[order].tolist()):
            a, b = find(int(parts[x])), find(int(parts[y]))
            few, many = sorted((len(hashes[x]), len(hashes[y])))
            if a != b and 5 * few >= 4 * many:
                common = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
                if 9 * common >= 4 * (few + many):
                    root[a] = b
                    made.append((names[x], names[y]))
    u, v = zip(*made) if made else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def near_copy_groups(docs: DataFrame, width: int = 5, part_texts: int = PART_TEXTS) -> DataFrame:
    """(doc_id, component_id): documents connected by pairs whose ``width``-word shingles have a similarity of 0.8 or more.

    Candidates come from long SimHash fingerprints: at 0.8 two bits differ with probability 0.15. ``KEYS`` keys of
    ``KEY_BITS`` bits choose the subtries, of which two documents at 0.8 share one with probability 0.99, and the walk has
    a budget of ``SKETCH_BUDGET`` of the compared ``COMPARED_WORDS`` * 64 bits. The walk gives each document's nearest
    candidate and a forest that connects all candidates, no more rows than went in. First each document is compared
    with its nearest candidate. Where a group of candidates is not connected by that, all its pairs within the budget
    that are not connected yet are compared, inside tasks that hold two stretches of the group. So every pair of candidates is linked
    as if all had been compared. A link is made where the exact similarity is 0.8 or more. A null or blank text is a group
    of its own kind: all such are alike. Equal fingerprints of all bits are folded before.
    """
    made = cut_lineage(sketches(docs, width))
    points = cut_lineage(made.groupBy("print").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")
    ))
    rows = points.select(F.col("print").alias("name"), F.explode("keys").alias("key"), F.col("sketch").alias("rest"))
    near = cut_lineage(subtrie_links(rows, SKETCH_BUDGET, 64 * COMPARED_WORDS, nearest=True))
    met = near.select(F.col("u").alias("print")).distinct()  # both ends of a candidate pair have a row
    sets = cut_lineage(shingle_sets(_texts(met, points, docs), width))
    nearest = near.groupBy("u").agg(F.min(F.struct("bits", "near")).alias("best")).select("u", F.col("best.near").alias("v"))
    first = cut_lineage(verified(nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets))
    labels = sets.select("print").join(hubs(first), "print", "left")
    labels = cut_lineage(labels.select("print", F.coalesce("part", "print").alias("part")))
    groups = components(among_parts(near, labels)).withColumnsRenamed({"node": "part", "root": "gid"})
    members = cut_lineage(labels.join(groups, "part", "left").select("print", "part", F.coalesce("gid", "part").alias("gid")))
    units = open_units(members, part_texts).join(sets, "print").join(points.select("print", "sketch"), "print")
    more = units.groupBy("gid", "kind", "p", "q").applyInArrow(_compare_unit, "u long, v long")
    roots = components(among_parts(first.unionByName(more), labels)).withColumnRenamed("node", "part")
    roots = labels.join(roots, "part", "left").select(F.col("print").alias("node"), F.coalesce("root", "part").alias("root"))
    return _named(made, points, roots, "print").select("doc_id", "component_id")


def _texts(prints: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """(print, text): one text of each of the ``prints``; only these texts are read again."""
    named = points.join(prints, "print").select("print", F.col("one.doc_id").alias("__id"), F.col("one.text_hash").alias("__hash"))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("__h"))
    return texts.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))).dropDuplicates(["print"])


def representatives(docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents that name their group of near copies; everything else leaves. Columns are unchanged.

    Rows that repeat a doc_id are one document and stay or leave together; rows with a null doc_id stay.
    """
    leaving = near_copy_groups(docs, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(leaving, "doc_id", "left_anti")
