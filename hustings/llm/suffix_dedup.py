"""Removal of byte strings that already occur in an earlier document, by classes of common prefixes in suffix arrays.

A text as a whole has too many suffixes for one task, so they are shared out such that equal strings of ``LENGTH`` bytes
always meet. A string's key is the least hash of its ``GRAM``-byte parts; neighbouring strings with one key make a segment.

1. Of documents with equal texts only the first takes part; the others go as a whole.
   Keys of the documents meet by hash; those found in more than one document are sent back.
2. Segments with such a key meet by key. The distinct contents of a key are put into a suffix array. Its common
   prefixes are derived from the Burrows-Wheeler transform by breadth-first backward extension: intervals of the strings
   w of length 0, 1, 2, ... are extended to the left by each character, and a boundary first met at length l has the
   common prefix l. At ``LENGTH`` the walk stops; what has no boundary between is a class of equal strings.
3. Each class knows its smallest document, which gives the removed stretches of all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_keys, slices, text_bytes

#: Bytes of a repeated string.
LENGTH = 50
#: Bytes of the parts whose least hash is the key.
GRAM = 20
#: Bytes of contents put into one suffix array, but for a key with more.
ARRAY_BYTES = 400_000
#: Documents are dealt into this many groups for each shuffle partition; keys into one.
GROUPS_PER_PARTITION = 4
LAST_ID = np.iinfo(np.int64).max
_KEY_BITS = np.uint64(48)
#: Where a segment stands: document id, row in its group, first byte.
PLACE = np.dtype([("id", "<i8"), ("row", "<i4"), ("start", "<i4")])
#: What a row sent to a group of documents holds.
COPIES, SHARED, REMOVALS = range(3)


def _ahead(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[: max(len(a) - k, 0)] = a[k:]
    return out


def string_keys(data: np.ndarray) -> np.ndarray:
    """Key of the ``LENGTH`` bytes from each position (48 bits); the last positions have no meaning."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        if width == 4:
            four = x
        x = x | (_ahead(x, width) << np.uint64(8 * width))
    h = x * np.uint64(0x9E3779B97F4A7C15)
    h ^= _ahead(x, 8) * np.uint64(0x9FB21C651E98DF25)
    h ^= _ahead(four, 16) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(64) - _KEY_BITS
    span, done = LENGTH - GRAM + 1, 1
    while done < span:
        step = min(done, span - done)
        most = max(len(h) - step, 0)
        np.minimum(h[:most], h[step:].copy(), out=h[:most])
        done += step
    return h


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of strings with one key: (key, text, first position, strings in the run)."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    valid = np.arange(len(data)) + LENGTH <= offsets[1:][text]
    keys = string_keys(data)
    start = valid.copy()
    start[1:] &= (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(start)
    upto = np.concatenate([[0], np.cumsum(valid)])
    count = upto[np.append(first[1:], len(data))] - upto[first]
    return keys[first], text[first], first, count


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions sorted by their next 64 symbols (bytes, 0 past the end), by prefix doubling from 8."""
    x = symbols.astype(np.uint64)
    for width in (1, 2, 4):
        x = (x << np.uint64(8 * width)) | _ahead(x, width)
    order = np.argsort(x)
    rank = _ranks(x, order)
    for width in (8, 16, 32):
        both = (rank << np.uint64(32)) | _ahead(rank, width)
        order = np.argsort(both)
        rank = _ranks(both, order)
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    sorted_ = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return rank


def equal_classes(symbols: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of ``order`` begin a new class of suffixes that share their first ``length`` symbols.

    Common prefixes are found by increasing value: intervals of ``order`` whose suffixes begin with w are extended to c w,
    where c precedes them in the transform. The end of an extended interval that is new at step l has the common prefix l
    with what follows, and only such intervals are extended further.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(order > 0, order - 1, n - 1)
    char, back = symbols[before].astype(np.int64), place[before]  # the transform, and where its suffix stands
    boundary = np.zeros(n + 1, bool)
    boundary[0] = boundary[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        single = hi - lo == 1
        new_lo = [back[lo[single]]]
        new_hi = [new_lo[0] + 1]
        size = (hi - lo)[~single]
        if len(size):
            at = np.repeat(lo[~single], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            group = (np.repeat(np.arange(len(size)), size) << 8) | char[at]
            by = np.argsort(group)
            cut = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) != 0]))
            new_lo.append(np.minimum.reduceat(back[at][by], cut))
            new_hi.append(np.maximum.reduceat(back[at][by], cut) + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~boundary[hi]  # intervals of one step are disjoint, so no end occurs twice
        lo, hi = lo[fresh], hi[fresh]
        boundary[hi] = True
        if not len(lo):
            break
    return boundary[:n]


def least_ids(contents: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each string of ``LENGTH`` bytes in each content, the least id of a content that holds it."""
    sizes = np.array([len(c) for c in contents])
    # UTF-8 has no byte above 0xF4, so one more fits a byte and 0 ends a content.
    symbols = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8) + np.uint8(1)
    order = suffix_order(symbols)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    start = np.cumsum(sizes + 1) - sizes - 1
    valid = np.arange(len(symbols)) - start[owner] + LENGTH <= sizes[owner]
    new = equal_classes(symbols, order)
    value = np.where(valid, ids[owner], LAST_ID)[order]
    first = np.flatnonzero(new)
    least = np.empty(len(symbols), np.int64)
    least[order] = np.minimum.reduceat(value, first)[np.cumsum(new) - 1]
    return [least[a : a + s - LENGTH + 1] for a, s in zip(start, sizes)]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, row numbers) of each group there is."""
    by = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]])) if len(by) else np.zeros(0, int)
    for a, b in zip(cut, np.append(cut[1:], len(by))):
        yield int(group[by[a]]), by[a:b]


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as integers; a null counts as the last."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.fill_null(int(LAST_ID)), np.int64)


def _copies(side: pa.Table) -> np.ndarray:
    """(id, mark) rows of the documents that repeat a whole earlier text."""
    found = [np.frombuffer(b, np.int64).reshape(2, -1) for b, kind in zip(side.column("data").to_pylist(), side.column("kind").to_pylist()) if kind == COPIES]
    return np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)


def _arranged(docs: pa.Table, side: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Ids, texts and whether a text is a copy, in an order that depends on nothing but the documents of the group."""
    ids, marks = _ids(docs.column("doc_id")), np.asarray(docs.column("mark").combine_chunks(), np.int64)
    by = np.lexsort((marks, ids))
    ids, marks = ids[by], marks[by]
    copies = {(i, m) for i, m in _copies(side).T.tolist()}
    is_copy = np.array([(i, m) in copies for i, m in zip(ids.tolist(), marks.tolist())], bool) if copies else np.zeros(len(ids), bool)
    return ids, docs.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(by)), is_copy


def _send_keys(buckets: int):
    """Keys of a group of documents: a row per key bucket with the keys and the documents they are from."""

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            home = docs.column("home")[0].as_py()
            ids, text, is_copy = _arranged(docs, side)
            length = np.diff(text_bytes(text)[1])
            keep = ~is_copy & (length >= LENGTH)
            ids, text = ids[keep], text.filter(pa.array(keep))
            data, offsets = text_bytes(text)
            keys, rows_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in slices(offsets):
                key, row, _, _ = segments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                both = np.unique((row.astype(np.uint64) << _KEY_BITS) | key)  # a slice has under 2 ** 16 texts of that length
                keys.append(both & np.uint64((1 << 48) - 1))
                rows_.append((both >> _KEY_BITS).astype(np.int64) + a)
            key, row = np.concatenate(keys), np.concatenate(rows_)
            for bucket, rows in _by_group((key % np.uint64(buckets)).astype(np.int64)):
                r, k = row[rows], key[rows]  # in the order of documents
                new = np.concatenate([[True], r[1:] != r[:-1]])
                at = np.cumsum(new) - 1
                out.append((bucket, home, _pack((k & np.uint64(0xFFFFFFFF)).astype(np.uint32), (k >> np.uint64(32)).astype(np.uint16)), _pack(at.astype(np.uint16 if at[-1] < 1 << 16 else np.uint32)), _pack(ids[r[new]])))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["bucket", "home", "keys", "at", "ids"])

    return run


def _share_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the keys that two documents or more have: a row per group of documents."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys, ids, homes = [], [], []
        for home, packed, at, own in rows:
            n = len(packed) // 6
            keys.append(np.frombuffer(packed, np.uint32, n).astype(np.uint64) | (np.frombuffer(packed, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)))
            ids.append(np.frombuffer(own, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)])
            homes.append(np.full(n, home, np.int32))
        key, id_, home = np.concatenate(keys), np.concatenate(ids), np.concatenate(homes)
        by = np.argsort(key)
        key, id_, home = key[by], id_[by], home[by]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.minimum.reduceat(id_, cut) < np.maximum.reduceat(id_, cut)
        keep = np.repeat(shared, np.diff(np.append(cut, len(key))))
        key, id_, home = key[keep], id_[keep], home[keep]
        return _side([(g, SHARED, _pack(key[r], id_[r])) for g, r in _by_group(home)])

    held, current = [], None
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != current and held:
                yield flush(held)
                held = []
            current = bucket
            held.append(row)
    if held:
        yield flush(held)


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _pairs(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a row and a key; a chance meeting only adds a segment to look at."""
    h = key * np.uint64(0x9E3779B97F4A7C15) ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def _send_segments(docs: pa.Table, side: pa.Table) -> pa.Table:
    """Segments of a group of documents whose key is shared: a row per content, with its ids and places."""
    parts: list[tuple[np.ndarray, ...]] = []
    pairs = [np.frombuffer(b, np.uint64).reshape(2, -1) for b, kind in zip(side.column("data").to_pylist(), side.column("kind").to_pylist()) if kind == SHARED]
    data = np.zeros(0, np.uint8)
    if docs.num_rows and pairs:
        ids, text, is_copy = _arranged(docs, side)
        data, offsets = text_bytes(text)
        key, owner = np.concatenate(pairs, axis=1)
        known = np.unique(_pairs(np.searchsorted(ids, owner.view(np.int64)), key))
        first_of = np.searchsorted(ids, ids)
        for a, b in slices(offsets):
            part = data[offsets[a] : offsets[b]]
            k, t, begin, count = segments(part, offsets[a : b + 1] - offsets[a])
            t = t + a
            probe = _pairs(first_of[t], k)
            at = np.searchsorted(known, probe)
            at[at == len(known)] = 0
            hit = (known[at] == probe) & ~is_copy[t] if len(known) else np.zeros(len(probe), bool)
            k, t, begin, size = k[hit], t[hit], begin[hit], count[hit] + LENGTH - 1
            parts.append((k, range_keys(part.tobytes(), begin, begin + size), t, begin + offsets[a], size))
    if not parts or not sum(len(p[0]) for p in parts):
        return pa.table({"key": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "content": pa.array([], pa.binary()), "home": pa.array([], pa.int32()), "places": pa.array([], pa.binary())})
    key, digest, row, begin, size = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((row, digest, key))
    key, digest, row, begin, size = key[by], digest[by], row[by], begin[by], size[by]
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]))
    places = np.zeros(len(key), PLACE)
    places["id"], places["row"], places["start"] = ids[row], row, begin - offsets[row]
    length = size[cut]
    upto = np.concatenate([[0], np.cumsum(length)])
    taken = data[np.repeat(begin[cut] - upto[:-1], length) + np.arange(upto[-1])]
    return pa.table({
        "key": pa.array(key[cut].astype(np.int64)),
        "least": pa.array(np.minimum.reduceat(ids[row], cut)),
        "content": _binary(upto, taken),
        "home": pa.array(np.full(len(cut), docs.column("home")[0].as_py(), np.int32)),
        "places": _binary(np.append(cut, len(key)) * PLACE.itemsize, places.view(np.uint8)),
    })


def _find_removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed stretches (row, begin, end) by group of documents; rows come sorted by key and least id.

    As ids rise within a key, what is known of its contents so far fixes the least id of each of their strings. So a key
    with many rows is worked off in steps that keep its distinct contents only.
    """
    known: tuple[int, dict[bytes, int]] = (-1, {})

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        nonlocal known
        groups: dict[int, dict[bytes, int]] = {known[0]: known[1]}
        for key, least, content, _, _ in rows:
            groups.setdefault(key, {}).setdefault(content, least)
        many = [(k, c, v) for k, g in groups.items() if len(g) > 1 for c, v in g.items()]
        runs = {}
        if many:
            limits = least_ids([c for _, c, _ in many], np.array([v for _, _, v in many], np.int64))
            sizes = np.array([len(lim) for lim in limits])
            flat, at = np.concatenate(limits), np.cumsum(sizes) - sizes
            lowest, highest = np.minimum.reduceat(flat, at).tolist(), np.maximum.reduceat(flat, at).tolist()
            for (k, c, _), lim, x, y in zip(many, limits, lowest, highest):
                if x == y:
                    groups[k][c] = x  # one limit throughout
                else:
                    cut = np.flatnonzero(np.concatenate([[True], lim[1:] != lim[:-1]]))
                    runs[k, c] = lim[cut], cut, np.diff(np.append(cut, len(lim)))
        places = np.frombuffer(b"".join(r[4] for r in rows), PLACE)
        count = np.array([len(r[4]) for r in rows]) // PLACE.itemsize
        row = np.repeat(np.arange(len(rows)), count)
        # A content with one limit throughout goes or stays as a whole.
        limit, several = np.full(len(rows), LAST_ID), []
        for i, (key, _, content, _, _) in enumerate(rows):
            run = runs.get((key, content))
            if run is None:
                limit[i] = groups[key][content]
            else:
                several.append(i)
        size = np.array([len(r[2]) for r in rows])
        home = np.array([r[3] for r in rows])
        late = places["id"] > limit[row]
        found = [(home[row[late]], places["row"][late], places["start"][late], places["start"][late] + size[row[late]])]
        first = np.cumsum(count) - count
        for i in several:
            lim, at, length = runs[rows[i][0], rows[i][2]]
            own = places[first[i] : first[i] + count[i]]
            x, y = np.nonzero(lim[None, :] < own["id"][:, None])
            begin = own["start"][x] + at[y]
            found.append((np.full(len(x), home[i]), own["row"][x], begin, begin + length[y] + LENGTH - 1))
        last = rows[-1][0]
        known = last, groups[last]
        to, *stretch = (np.concatenate(x) for x in zip(*found))
        packed = np.stack(stretch).astype(np.int32)
        return _side([(g, REMOVALS, _pack(packed[:, r])) for g, r in _by_group(to)])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > ARRAY_BYTES:
                yield flush(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2]) + len(row[4])
    if rows:
        yield flush(rows)


def _side(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["home", "kind", "data"])


def _send_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks = _ids(batch.column(1)), np.asarray(batch.column(2))
        yield _side([(g, COPIES, _pack(ids[r], marks[r])) for g, r in _by_group(np.asarray(batch.column(0)))])


def _kept(docs: pa.Table, side: pa.Table):
    """Per document of a group: id, bytes, and its merged removed stretches."""
    ids, text, is_copy = _arranged(docs, side)
    data, offsets = text_bytes(text)
    found = [np.frombuffer(b, np.int32).reshape(3, -1) for b, kind in zip(side.column("data").to_pylist(), side.column("kind").to_pylist()) if kind == REMOVALS]
    all_ = np.concatenate([np.zeros((3, 0), np.int32), *found], axis=1).astype(np.int64)
    all_ = all_[:, np.lexsort((all_[1], all_[0]))]
    cut = np.searchsorted(all_[0], np.arange(len(ids) + 1))
    for i in range(len(ids)):
        begin, end = all_[1, cut[i] : cut[i + 1]], all_[2, cut[i] : cut[i + 1]]
        if is_copy[i]:
            begin, end = np.array([0]), offsets[i + 1 : i + 2] - offsets[i]
        elif len(begin):
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
            begin, end = begin[new], reach[np.append(new[1:], len(reach)) - 1]
        yield ids[i], data[offsets[i] : offsets[i + 1]], begin, end


def _digests(docs: pa.Table, removals: pa.Table) -> pa.Table:
    out = []
    if docs.num_rows:
        for id_, raw, begin, end in _kept(docs, removals):
            edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(raw)]
            digest = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2]):
                digest.update(raw[a:b].tobytes())
            out.append((None if id_ == LAST_ID else int(id_), len(raw), int((end - begin).sum()), len(begin), digest.hexdigest()))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: pa.Table, removals: pa.Table) -> pa.Table:
    out = []
    if docs.num_rows:
        for id_, raw, begin, end in _kept(docs, removals):
            edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(raw)]
            out.append((None if id_ == LAST_ID else int(id_), b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])), [{"begin": int(a), "end": int(b)} for a, b in zip(begin, end)]))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), span))], names=["doc_id", "kept", "spans"])


def _deduplicated(docs: DataFrame, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = GROUPS_PER_PARTITION * buckets
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("home"), "text", F.xxhash64("text").alias("mark"))
    side = "home int, kind int, data binary"
    # Copies of whole texts go as a whole: only the first of equal texts takes part in what follows.
    prints = rows.select("doc_id", "home", "mark", F.xxhash64("text", F.lit(1)).alias("more"), F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH)
    last = F.lit(int(LAST_ID)).cast("long")
    firsts = prints.groupBy("mark", "more", "size").agg(F.min(F.coalesce("doc_id", last)).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = prints.join(firsts, ["mark", "more", "size"]).where(F.coalesce("doc_id", last) > F.col("first"))
    copies = copies.select("home", "doc_id", "mark").mapInArrow(_send_copies, side)
    dealt = rows.groupBy("home")
    sent = dealt.cogroup(copies.groupBy("home")).applyInArrow(_send_keys(buckets), "bucket int, home int, keys binary, at binary, ids binary")
    shared = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_share_keys, side)
    held = dealt.cogroup(shared.unionByName(copies).groupBy("home")).applyInArrow(_send_segments, "key long, least long, content binary, home int, places binary")
    removals = held.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_find_removals, side)
    return dealt.cogroup(removals.unionByName(copies).groupBy("home")).applyInArrow(finish, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, spans): the bytes of each text that stay, and the removed stretches in the text's bytes.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id, judged on the
    texts as given. Matches never cross documents. A null text is empty. Rows that share a doc_id are one document to
    each other (nothing is removed between them) and each get a row; a null doc_id comes after all others. Texts under 50
    bytes stay whole. Other columns are ignored; an empty table gives no rows. Whole texts are used at any length.
    """
    return _deduplicated(docs, _texts, "doc_id long, kept binary, spans array<struct<begin: long, end: long>>")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of the same removal; digests in place of the bytes."""
    return _deduplicated(docs, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
