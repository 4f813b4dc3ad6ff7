"""Shards over fixed virtual slots.

A record hashes into one of a few thousand virtual slots, for good: its id and its text decide, so that records without an
id, or of one id, spread as well, and of equal records the number among them. The bytes of each slot are added up and a
map from slot to shard is kept in versions; rebalancing writes a new version that moves as few slots as it can.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_before

#: Virtual slots; a map has so many rows at most, whatever the input.
SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, bytes long, shard int"


def virtual_slot(*columns: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def record_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def slotted(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record. Equal records are counted first and then numbered."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = records.select(
        F.col(id_col).alias("doc_id"), record_bytes(text_col).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32", "mark").agg(F.count("*").alias("equal"))
    numbered = equal.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1)))
    return numbered.select("doc_id", "size", "text_crc32", virtual_slot("doc_id", "mark", "copy", slots=slots).alias("virtual_slot"))


def slot_bytes(placed: DataFrame) -> DataFrame:
    """(virtual_slot, bytes) of ``slotted`` rows, a row per slot that has records; summed before the shuffle."""
    return placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def spread(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Slots by falling size, each to the shard with the fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (load + sizes[slot], shard))
    return out


def moved(sizes: dict[int, int], old: dict[int, int], shards: int, slack: float = 0.01) -> dict[int, int]:
    """Edit a map for other sizes or another number of shards: only slots of shards that are gone or too full move.

    Each shard keeps its largest slots up to (1 + ``slack``) times the mean; what is left over goes to the emptiest.
    """
    mean = sum(sizes.values()) / shards
    loads, out, loose = [0] * shards, {}, []
    for slot in sorted(sizes, key=lambda k: (-sizes[k], k)):
        shard = old.get(slot)
        if shard is not None and shard < shards and loads[shard] + sizes[slot] <= mean * (1 + slack):
            out[slot] = shard
            loads[shard] += sizes[slot]
        else:
            loose.append(slot)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in loose:
        load, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (load + sizes[slot], shard))
    return out


def new_map(sizes: DataFrame, shards: int, version: int = 0) -> DataFrame:
    """First version of the map, from (virtual_slot, bytes). Made by one task that reads a row per slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b[["virtual_slot", "bytes"]].itertuples(index=False)]
        sizes_ = {int(s): int(n) for s, n in rows}
        placed = spread(sizes_, shards)
        yield pd.DataFrame(
            [(version, s, sizes_[s], placed[s]) for s in sorted(placed)], columns=["version", "virtual_slot", "bytes", "shard"]
        )

    return sizes.repartition(1).mapInPandas(run, MAP_SCHEMA)


def rebalanced(sizes: DataFrame, old: DataFrame, shards: int, slack: float = 0.01) -> DataFrame:
    """Next version of a map for new slot sizes or another number of shards."""
    both = sizes.join(old.select("virtual_slot", "shard", "version"), "virtual_slot", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([*batches, pd.DataFrame(columns=["virtual_slot", "bytes", "shard", "version"])])
        sizes_ = {int(s): int(n) for s, n in zip(frame["virtual_slot"], frame["bytes"])}
        was = {int(s): int(k) for s, k in zip(frame["virtual_slot"], frame["shard"]) if pd.notna(k)}
        version = int(frame["version"].max()) + 1 if was else 0
        placed = moved(sizes_, was, shards, slack)
        yield pd.DataFrame(
            [(version, s, sizes_[s], placed[s]) for s in sorted(placed)], columns=["version", "virtual_slot", "bytes", "shard"]
        )

    return both.repartition(1).mapInPandas(run, MAP_SCHEMA)


def write_map(shard_map: DataFrame, folder: str) -> None:
    """Add a version to the stored maps; earlier versions stay readable."""
    shard_map.write.mode("append").partitionBy("version").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default."""
    maps = spark.read.parquet(folder)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "virtual_slot", "bytes", "shard")


def place(placed: DataFrame, shard_map: DataFrame) -> DataFrame:
    """``slotted`` rows with their shard. The map is broadcast: it has a row per slot at most."""
    return placed.join(F.broadcast(shard_map.select("virtual_slot", "shard")), "virtual_slot", "left")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Every row with shard and position: doc_id, size, text_crc32, law, virtual_slot, shard, slot, grown_shard.

    Law ``bytes``: shards have nearly equal bytes, whatever the ids. ``slot`` is the row's place in its shard, from 0
    without gaps, in the order of virtual slot, id, size and checksum. A null id is a value as any; a null text has size 1
    and checksum 0. Rows that repeat an id, equal ones too, get slots and places of their own. An empty table gives no
    rows. ``grown_shard`` is null, as it belongs to another law. Other columns are ignored.
    """
    rows = slotted(docs, id_col, text_col, slots)
    placed = place(rows, new_map(slot_bytes(rows), shards)).withColumn("one", F.lit(1).cast("long"))
    numbered = running_before(placed, ["shard"], "virtual_slot", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "one", "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "virtual_slot", "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
