"""Helpers shared by the operators: words, slices of Arrow text columns, running sums without one-task windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of bytes outside this class (fixed values of the contract).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that separate words.
SPACES = [0x20, *range(0x09, 0x0E)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
#: Lower-cases A-Z and turns every separator into a blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[SPACES] = 0x20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 buffer and ``n + 1`` offsets of a text column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each, so that work arrays stay small; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of each text joined by single blanks: buffer, word starts, word ends, first word of each text.

    The last array has one entry more than there are texts.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    wide = np.full(len(data) + n, 0x20, np.uint8)  # a blank after each text
    wide[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = FOLD[data]
    ends_of_text = offsets[1:] + np.arange(1, n + 1)
    blank = wide == 0x20
    before = np.empty_like(blank)
    before[:1], before[1:] = True, blank[:-1]
    keep = ~(blank & before)
    position = np.cumsum(keep) - keep
    starts = position[~blank & before]
    ends = position[blank & ~before]
    first_word = np.concatenate([[0], np.cumsum(~blank & before)[ends_of_text - 1]]) if n else np.zeros(1, np.int64)
    return wide[keep].tobytes(), starts, ends, first_word


def shingles(starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all ``width``-word shingles and how many each text has; a shorter text is one shingle, an empty one none."""
    words = np.diff(first_word)
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    base = np.cumsum(counts) - counts
    within = np.arange(counts.sum()) - np.repeat(base, counts)
    first = np.repeat(first_word[:-1], counts) + within
    last = first + np.repeat(np.minimum(words, width), counts) - 1
    return starts[first], ends[last], counts


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 22)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", int(_BASE)), ("down", inverse)):
            powers = np.ones(size, np.uint64)
            powers[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["up"], _powers["down"]


def range_keys(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each byte range, from running sums; equal ranges have equal keys, others hardly ever."""
    data = np.frombuffer(joined, np.uint8)
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    key = (total[ends] - total[starts]) * down[starts]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, in the order (``bucket``, ``order``).

    Sums per bucket are added up first, so that one task holds a bucket and never a whole group.
    """
    keys = [*group, bucket]
    total, base = f"__{name}_total", f"__{name}_base"
    sums = df.groupBy(*keys).agg(F.sum(value).alias(total))
    earlier = Window.partitionBy(*group).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.coalesce(F.sum(total).over(earlier.orderBy(F.col(bucket).asc_nulls_first())), F.lit(0)).cast("long").alias(base),
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, on, "left")
        .withColumn(name, F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop(base, *[f"__{k}" for k in keys])
    )


def bounded_sample(rows: DataFrame, group: str, most: int, most_groups: int = 1000, id_col: str = "doc_id") -> tuple[DataFrame, dict]:
    """At most ``most`` rows of each group, those with the least hashes of their ids, and the size of each group before.

    The share to keep follows from the size, so what is sorted for the exact cut is little more than what is kept. Rows
    without a group or an id are left out; more than ``most_groups`` groups are an error.
    """
    named = rows.where(F.col(group).isNotNull() & F.col(id_col).isNotNull())
    sizes = dict(named.groupBy(group).count().limit(most_groups + 1).collect())
    if len(sizes) > most_groups:
        raise ValueError(f"more than {most_groups} values of {group}")
    place = F.xxhash64(id_col)
    share = F.lit(0.0)
    for value, n in sorted(sizes.items()):
        share = F.when(F.col(group) == value, F.lit(min(1.0, 1.2 * most / n))).otherwise(share)
    near = named.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    first = Window.partitionBy(group).orderBy(F.pmod(place, F.lit(1 << 30)), id_col)
    return near.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= most).drop("__nth"), sizes
