"""Groups of spelling variants: each word is led to the most frequent of the words one edit away from it.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so the
one-edit neighbourhoods of the reduced words, joined to the reduced vocabulary, find every near pair, and the original
strings are compared after that. Of a neighbourhood, which is symmetric, the half is made that finds each pair from one
end: deletions (the other word's insertions) and replacements by a greater symbol. Reduced words meet by a rolling 64-bit
key; equal ones have equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.session import cut_lineage

#: A run of letters (fixed value of the contract).
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Keys of one kind made at once.
KEYS_AT_ONCE = 200_000
#: Rounds of doubling that reach the end of any chain of forms: each form occurs twice as often, so 63 steps are the most.
DOUBLINGS = 6
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def spelt(run: str | Column, doc_id: str | Column = "doc_id", every: int = 97) -> Column:
    """The lower-cased run, or where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run without one code point."""
    run = F.col(run) if isinstance(run, str) else run
    h = F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times or more in all texts."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = found.select(spelt("run").alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def symbols(points: np.ndarray) -> np.ndarray:
    """Each code point's symbol of the reduced alphabet, counted from 1."""
    return (points.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(SYMBOLS) + np.uint64(1)


def _spread(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def reduced_keys(words: list[str], around: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the reduced forms of words of one length, in blocks of (index of the word, key).

    A key is the sum of symbol times base to the power of its place, modulo 2 ** 64. With ``around`` the keys of all
    strings follow that are one symbol shorter or have one symbol replaced by a greater one, each string once for a word.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    s = symbols(points).reshape(len(words), -1)
    n = s.shape[1]
    up = np.full(n + 1, _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    part = np.zeros((len(words), n + 1), np.uint64)  # keys of the beginnings
    np.cumsum(s * up[:n], axis=1, out=part[:, 1:])
    whole = part[:, -1:]
    yield np.arange(len(words)), _spread(whole[:, 0])
    if not around:
        return

    def block(keys: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(keep)[0], _spread(keys[keep])

    changed = np.ones(s.shape, bool)
    changed[:, 1:] = s[:, 1:] != s[:, :-1]  # of a row of equal symbols one is deleted
    yield block(part[:, :-1] + (whole - part[:, 1:]) * np.uint64(_BACK), changed)
    for t in range(2, SYMBOLS + 1):
        t = np.uint64(t)
        yield block(whole + (t - s) * up[:n], s < t)


def _reduced(words: DataFrame, around: bool) -> DataFrame:
    """(id, key), a row for the reduced word or also for every member of its neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, ids = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            lengths = np.array([len(w) for w in listed])
            for length in np.unique(lengths).tolist():
                alike = np.flatnonzero(lengths == length)
                step = max(1, KEYS_AT_ONCE // (length + 1))
                for at in range(0, len(alike), step):
                    some = alike[at : at + step]
                    for place, keys in reduced_keys([listed[i] for i in some], around):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some[place]]), pa.array(keys)], names=["id", "key"])

    return words.select("word", "id").mapInArrow(run, "id long, key long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of different words of (word, n) that one edit turns into each other.

    Keys travel with a hash of the word. Where hashes of two words are equal, both are compared, so nothing is mistaken.
    """
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    own = _reduced(named, around=False).withColumnRenamed("id", "other")
    met = _reduced(named, around=True).join(own, "key").select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"))
    one, two = (named.select(F.col("id").alias(name), F.struct("word", "n").alias(f"{name}_word")) for name in ("id", "other"))
    both = met.join(one, "id").join(two, "other").where(F.levenshtein("id_word.word", "other_word.word", 1) == 1).distinct()
    there, back = F.struct(F.col("id_word").alias("a"), F.col("other_word").alias("b")), F.struct(F.col("other_word").alias("a"), F.col("id_word").alias("b"))
    ways = both.select(F.explode(F.when(F.col("id") == F.col("other"), F.array(there)).otherwise(F.array(there, back))).alias("w"))
    return ways.select(F.col("w.a.word").alias("word"), F.col("w.b.word").alias("near"), F.col("w.b.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last of the chain of forms, the word itself where it has none.

    Steps are doubled in each round, and written to the shared folder.
    """
    step = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(DOUBLINGS):
        further = step.select(F.col("word").alias("__at"), F.col("root").alias("__to"))
        step = cut_lineage(step.join(further, F.col("root") == F.col("__at")).select("word", F.col("__to").alias("root")))
    return step


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """Per word of (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n, the smallest in code-point order among equals, if that n is ``times`` the
    word's or more, else null. ``words`` has each word once; an empty table gives no rows.
    """
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    found = words.join(near, "word", "left")
    leads = -F.col("best.rank") >= times * F.col("n")
    found = cut_lineage(found.select(
        "word", F.when(leads, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(leads, -F.col("best.rank")).alias("form_n"),
    ))
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """Spelling groups of the words of all documents (see ``vocabulary`` and ``spelling_groups``).

    A null text has no words; a null doc_id counts as an empty one; rows that repeat count each; other columns are
    ignored; an empty table gives no rows.
    """
    return spelling_groups(cut_lineage(vocabulary(docs, least_length, least_count)), times)
