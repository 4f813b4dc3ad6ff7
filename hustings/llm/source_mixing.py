"""Mixing sources to target weights with a low-discrepancy schedule of equal-word blocks. DataFrame functions only.

The documents of a source are shuffled by a hash and laid on a line of words, which is cut into blocks of equal length, so
long that the source's target is ``BLOCKS`` of them or a little more. The schedule has a slot for each block that is
taken. The slots' places are the van der Corput points of their numbers: the points below the number of slots, as integers
of so many bits, are mapped through the cumulative slots of the sources, and the rank of a slot within its source names
the block. Every stretch of the schedule is thus mixed as the targets ask, and every source has exactly its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, running_before

#: Blocks of a source's target (up to twice as many; fewer, of one word, where the target has fewer words).
BLOCKS = 256


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, shuffle key, shuffle bucket, rows): one for all rows that are equal in these."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary")).alias("turn"),
    )
    return rows.groupBy("doc_id", "source", "size", "turn").agg(F.count("*").alias("rows")).withColumn("bucket", F.substring("turn", 1, 3))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, weight, target) from (source, size, rows).

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` of all words. A target stops at
    ``most`` times its source's size and the excess is shared again by weight: target = min(cap, level * weight) for the
    one level at which the targets add up. Works on one row per source.
    """
    one = Window.partitionBy(F.lit(1))  # one row per source
    by_name = one.orderBy(F.col("source").isNull(), "source")
    listed = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    s = s.withColumn("weight", F.element_at(listed, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumn("wanted", F.lit(share) * F.sum("source_size").over(one))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("open"))
    # The level rises while it goes past the next cap and falls from there on: the highest is the one at which all adds up.
    s = s.withColumn("level", F.max("level").over(one))
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def block_lines(targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(source, source_size, target, block_words, line_blocks, uses, first): a row per source.

    ``uses`` blocks of the source are taken: whole passes over its line, then blocks from the head of the line as near to
    the rest of the target as they get. ``first`` counts the uses of the sources before it.
    """
    words = F.round("target").cast("long")
    t = targets.withColumn("words", words).withColumn("block_words", F.greatest(F.lit(1).cast("long"), F.floor(words / F.lit(blocks))))
    t = t.withColumn("line_blocks", F.ceil(F.col("source_size") / F.col("block_words")))
    passes = F.floor(F.col("words") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.floor((F.col("words") - passes * F.col("source_size")) / F.col("block_words") + F.lit(0.5))
    t = t.withColumn("uses", passes * F.col("line_blocks") + F.least(F.col("line_blocks"), rest))
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")  # one row per source
    t = t.withColumn("first", F.coalesce(F.sum("uses").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bits = F.greatest(F.length(F.bin(F.sum("uses").over(Window.partitionBy(F.lit(1))) - 1)), F.lit(1))
    return t.select("source", "source_size", "target", "block_words", "line_blocks", "uses", "first", bits.alias("bits"))


def schedule(lines: DataFrame) -> DataFrame:
    """(slot, source, block, pass): what each slot of the mix takes, from ``block_lines``.

    Slots are places among 2 ** bits of them: the bits of the source's numbers from ``first`` on in reverse order. The
    k-th of a source in this order takes its block k modulo its blocks.
    """
    numbered = lines.where("uses > 0").select("*", F.explode(F.sequence("first", F.col("first") + F.col("uses") - 1)).alias("number"))
    place = F.conv(F.reverse(F.lpad(F.bin("number"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    slots = numbered.withColumn("slot", place)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    slots = slots.withColumn("rank", rank.cast("long"))
    return slots.select("slot", "source", F.pmod("rank", "line_blocks").alias("block"), F.floor(F.col("rank") / F.col("line_blocks")).cast("int").alias("pass"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, blocks: int = BLOCKS, id_col: str = "doc_id") -> DataFrame:
    """Per document what the mix takes: doc_id, source, size, source_size, target, taken, first_slot.

    A source's words are off its target by half a block at the most, and exact where the target has under 2 * ``blocks``
    words: one rule for sources of any size. ``first_slot`` is the earliest place in the schedule at which words of the
    document are taken (null: none are); in this order the mix is even throughout.

    A null text has size 0; a null source is a source of its own, last in order. Words of a source come from its blocks,
    ``most`` passes at the utmost, so no document gives more than ``most`` times its size. Repeated rows each get a row.
    Documents of size 0 take 0. An empty table gives no rows. Other columns are ignored.
    """
    rows = sized(docs, id_col)
    lines = block_lines(source_targets(rows, weights, share, most), blocks)
    order = [F.col("turn"), F.col("doc_id"), F.col("size")]
    line = running_before(rows.withColumn("all", F.col("size") * F.col("rows")), ["source"], "bucket", order, "all", "begin")
    line = line.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
    known = lines.select(F.col("source").alias("__s"), "source_size", "target", "block_words", "uses")
    line = line.join(known, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    first, last = F.floor(F.col("begin") / F.col("block_words")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("block_words"))
    last = F.least(last, F.col("uses") - 1)  # blocks from the uses on are not taken
    reach = F.when((F.col("size") > 0) & (first <= last), F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))
    pieces = line.withColumn("block", F.explode(reach))
    stop = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    pieces = pieces.withColumn("words", stop - F.greatest(F.col("begin"), F.col("block") * F.col("block_words")))
    taken = schedule(lines).groupBy("source", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    taken = taken.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "times", "slot")
    pieces = pieces.join(taken, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    mixed = pieces.groupBy("source", "bucket", "turn", "copy", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("times").isNull(), 0).otherwise(F.col("words") * F.col("times"))).cast("long").alias("taken"), F.min("slot").alias("first_slot")
    )
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """The documents of a mix with their columns: a row per whole copy taken, and one cut to the words that are left over.

    A document of which the mix takes nothing is absent; one without words (null or blank text) gives nothing to a mix
    and is absent as well. Rows that repeat a doc_id, source and size share what the mix takes of them evenly.
    """
    taken = mix(docs.select("doc_id", "source", "text"), weights, share, most, blocks).where("taken > 0")
    taken = taken.groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken"))
    taken = taken.select(*[F.col(c).alias(f"__{c}") for c in taken.columns])
    same = (docs["doc_id"].eqNullSafe(F.col("__doc_id"))) & (docs["source"].eqNullSafe(F.col("__source"))) & (word_count(docs["text"]) == F.col("__size"))
    rest = F.pmod(F.floor("__taken"), F.col("__size"))
    whole = F.floor(F.col("__taken") / F.col("__size"))
    copies = docs.join(taken, same).withColumn("__words", F.explode(F.concat(F.array_repeat(F.col("__size"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(parts, 1, F.col("__words").cast("int")), "")
    cut = copies.withColumn("text", F.when(F.col("__words") < F.col("__size"), head).otherwise(F.col("text")))
    return cut.select(*docs.columns)
