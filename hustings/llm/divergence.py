"""Audit of how far the sources of a language diverge in the terms they use.

Each (language, source) group has its counts of kept terms as sorted arrays (term id, count), cut into blocks of terms.
A task per unordered pair of groups and block merges two arrays by a galloping intersection: terms of both, of one side
only, and of neither are each priced, the last ones in one product. Prices are integers and exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hustings.session import cut_lineage

#: A term in UTF-8 bytes: ASCII letters and everything beyond ASCII (fixed value of the contract).
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)
#: Prices are shares of this.
UNIT = 1_000_000_000
#: Kept terms of a block of arrays, on average.
BLOCK_TERMS = 1 << 16
#: Entries that a task adds up before it passes them on.
HELD = 200_000
#: Stretches that the terms of a language are cut into where they meet the figures of their language.
SALTS = 64
#: Elements of the shorter array between two searches from the start.
STRIDE = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and its documents there.

    Null text, lang and source are empty ones. Each group also has a row with a null term, so that groups without terms
    are known. Counts are added up within tasks before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict, dict]] = {}
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                n, docs_ = held.setdefault((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), ({None: 0}, {None: 0}))
                before = len(n)
                for term, k in Counter(_TERM.findall(text.to_pybytes().translate(_FOLD))).items():
                    n[term] = n.get(term, 0) + k
                    docs_[term] = docs_.get(term, 0) + 1
                size += len(n) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs_) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            named = [pa.array([x]).take(pa.array(np.zeros(len(n), np.int64))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*named, terms, pa.array(n.values(), pa.int64()), pa.array(docs_.values(), pa.int64())], names=["lang", "source", "term", "n", "docs"])

    picked = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = picked.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: np.ndarray | int, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), by long division so that no product leaves 64 bits."""
    rest, whole = np.asarray(count, np.int64) + 2, np.int64(0)
    over = np.int64(total + 2 * kept)
    for _ in range(3):
        whole = whole * 1000 + rest * 1000 // over
        rest = rest * 1000 % over
    return 1 + whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)) of two prices."""
    return (p - q) * (p - q) // (p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each of the sorted ``few`` the first place in the sorted ``many`` that is not smaller.

    Every ``STRIDE``-th element is searched from the start. The others go on from where the one before them was found:
    steps double until they pass the element, and the last step is searched by halves.
    """
    anchors = np.searchsorted(many, few[::STRIDE])
    low = np.repeat(anchors, STRIDE)[: len(few)]
    step = np.ones(len(few), np.int64)
    going = np.arange(len(few))
    while len(going):
        reach = low[going] + step[going] - 1
        going = going[reach < len(many)]
        going = going[many[low[going] + step[going] - 1] < few[going]]
        low[going] += step[going]
        step[going] *= 2
    high = np.minimum(low + step - 1, len(many))
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = many[middle] < few[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], kept: int, terms: int) -> int:
    """Sum of distances over the ``terms`` of a block; ``a`` and ``b`` are sorted term ids and their counts."""
    if len(a[0]) > len(b[0]):
        a, b, totals = b, a, totals[::-1]
    at = gallop(a[0], b[0])
    both = at < len(b[0])
    both[both] = b[0][at[both]] == a[0][both]
    alone = np.ones(len(b[0]), bool)
    alone[at[both]] = False
    none = [price(0, t, kept) for t in totals]
    total = distance(price(a[1][both], totals[0], kept), price(b[1][at[both]], totals[1], kept)).sum()
    total += distance(price(a[1][~both], totals[0], kept), none[1]).sum()
    total += distance(none[0], price(b[1][alone], totals[1], kept)).sum()
    absent = terms - len(a[0]) - int(alone.sum())
    return int(total) + absent * int(distance(none[0], none[1]))


class Audit:
    """Counts of a corpus that both parts of the audit start from. Each is written once to the shared folder."""

    def __init__(self, docs: DataFrame, least_docs: int = 10, block_terms: int = BLOCK_TERMS):
        counts = cut_lineage(term_counts(docs))
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = cut_lineage(kept.where(F.col("docs") >= least_docs).drop("docs"))
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        blocks = F.ceil(F.col("kept") / F.lit(block_terms))
        salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))  # one language may have most terms
        langs = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = salted.join(langs, ["lang", "salt"]).withColumn("block", F.pmod(F.xxhash64("term", F.lit(1)), blocks))
        number = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
        self.terms = cut_lineage(placed.select("lang", "term", "block", number.alias("id"), "lang_n", "lang_total", "kept"))
        # one row per term and group, and one row per group with its total
        self.counts = cut_lineage(counts.where("term is not null").join(self.terms, ["lang", "term"]).drop("docs"))
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select("lang", "source")
        self.groups = cut_lineage(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")))

    def arrays(self) -> DataFrame:
        """(lang, source, total, block, terms, kept, ids, ns): a row for each group and block of its language."""
        listed = self.counts.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held"))
        blocks = self.terms.groupBy("lang", "block").agg(F.count("*").alias("terms"), F.first("kept").alias("kept"))
        every = self.groups.join(blocks, "lang").join(listed, ["lang", "source", "block"], "left")
        return every.select("lang", "source", "total", "block", "terms", "kept", F.col("held.id").alias("ids"), F.col("held.n").alias("ns"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for both orders of every pair of sources of a language."""
        arrays = cut_lineage(self.arrays())
        other = arrays.select("lang", "block", F.col("source").alias("other"))
        low = arrays.join(other, ["lang", "block"]).where("source < other").withColumnsRenamed({"source": "low", "other": "high"})
        high = arrays.toDF(*arrays.columns).join(other.toDF(*other.columns), ["lang", "block"]).where("source > other").withColumnsRenamed({"source": "high", "other": "low"})
        keys = ["lang", "low", "high", "block"]

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = (x.drop_columns(["ids", "ns"]).to_pylist()[0] for x in (left, right))
            held = [tuple(x.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "ns")) for x in (left, right)]
            value = merged(*held, (a["total"], b["total"]), a["kept"], a["terms"])
            return pa.table({"lang": [a["lang"]], "low": [a["low"]], "high": [a["high"]], "value": pa.array([value], pa.int64())})

        parts = low.groupBy(*keys).cogroup(high.groupBy(*keys)).applyInArrow(run, "lang string, low string, high string, value long")
        sums = parts.groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
        both = sums.select("lang", F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))).alias("p"), "value")
        both = both.select("lang", "p.source", "p.item", "value")
        # languages without kept terms have pairs, too
        item = self.groups.select("lang", F.col("source").alias("item"))
        asked = self.groups.select("lang", "source").join(item, "lang").where("source <> item")
        return asked.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    def marked(self) -> DataFrame:
        """(lang, source, item, value): the terms that a source uses at a higher price than its language does."""
        priced = self.counts.join(self.groups, ["lang", "source"])
        p, q = _price(F.col("n"), F.col("total"), F.col("kept")), _price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        priced = priced.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return priced.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def _price(count: Column, total: Column, kept: Column) -> Column:
    """As ``price``, in columns."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    share = F.call_function("div", wide(F.lit(UNIT), 10) * wide(count + 2, 19), wide(total + 2 * kept, 19))
    return share.cast("long") + 1


def divergence_audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others, and by which terms.

    Part ``pair`` ranks the other sources of the language by the summed distance over all kept terms, part ``term`` the
    ``top_terms`` terms that set the source apart from its language. Ranks count from 1 by falling value, then by item in
    UTF-8 order. Terms are kept if ``least_docs`` documents (rows) of their language have them. Null text, lang and source
    are read as empty ones; rows that repeat count each; other columns are ignored; an empty table gives no rows.
    """
    audit = Audit(docs, least_docs, block_terms)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pair = audit.pairs().select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term = audit.marked().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pair.unionByName(term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
