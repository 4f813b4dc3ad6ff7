"""Languages of the words of a text, by Viterbi over per-word scores with a penalty for each switch.

A word's script narrows the candidates to the languages learned in that script. Its score for each of them is the sum
of log probabilities of its letter trigrams. Adjacent words with one label make a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

#: Labelled documents of each language that the model learns from, at most.
SAMPLE_PER_LANGUAGE = 1500
#: Languages learned at most; more are an error.
MOST_LANGUAGES = 200
#: Cells of the trigram table.
CELLS = 1 << 16
#: Cost of a switch of language between two words, in nats.
SWITCH = 12.0
#: A language is a candidate for a script that holds this share of its letters.
LEAST_SCRIPT_SHARE = 0.01
#: Bytes of text worked on at once; Viterbi runs over all their texts in step.
SLICE_CHARS = 6_000_000
UNDETERMINED = "und"

# First code point of each range and its script, from the Unicode charts.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})

_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter (0 for what is no letter), and its script."""
    if not _tables:
        fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (s := chr(c)).isalpha():
                low = s.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        script = np.zeros(0x110000, np.int8)
        edges = [start for start, _ in SCRIPT_RANGES] + [0x110000]
        for (start, name), end in zip(SCRIPT_RANGES, edges[1:]):
            script[start:end] = SCRIPTS.index(name)
        _tables.update(fold=fold, script=script)
    return _tables["fold"], _tables["script"]


@dataclass
class Words:
    """Words of several texts: trigram cell of each letter, and for each word its first letter, length, script, place."""

    cells: np.ndarray
    first: np.ndarray
    length: np.ndarray
    script: np.ndarray
    begin: np.ndarray
    per_text: np.ndarray


def split_words(texts: list[str | None]) -> Words:
    """Maximal runs of letters. ``begin`` is the character offset of a word in its text."""
    fold, scripts = _letters()
    sizes = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    raw = "\0".join([t or "" for t in texts]) + "\0"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    z = fold[points]
    is_letter = z != 0
    before = np.empty_like(is_letter)
    before[0], before[1:] = False, is_letter[:-1]
    starts = np.flatnonzero(is_letter & ~before)
    at = np.flatnonzero(is_letter)
    text_end = np.cumsum(sizes)
    left = np.where(before[at], z[at - 1], 0).astype(np.uint32)
    cells = left * np.uint32(2654435761) + z[at] * np.uint32(2246822519) + z[at + 1] * np.uint32(3266489917)
    cells = (cells ^ (cells >> np.uint32(15))) * np.uint32(668265263)
    cells = (cells >> np.uint32(16)).astype(np.int32)
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    text_of = np.searchsorted(text_end, starts, side="right")
    per_text = np.bincount(text_of, minlength=len(texts))
    return Words(cells, first, length, scripts[points[starts]], starts - (text_end - sizes)[text_of], per_text)


@dataclass
class LanguageModel:
    """Log probability of each trigram cell, and which languages each script leaves; a column per language."""

    languages: list[str]
    log_p: np.ndarray
    allowed: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.languages)), np.float32)
        by_word = np.add.reduceat(self.log_p[words.cells], words.first, axis=0)
        by_word[~self.allowed[words.script]] -= np.float32(1e6)
        return by_word


def viterbi(scores: np.ndarray, per_text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word, for all texts in step: texts by falling length, word t of every text that has one."""
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    start = (np.cumsum(per_text) - per_text)[order]
    label = np.zeros(len(scores), np.int16)
    if not len(scores):
        return label
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts with more than t words
    state = scores[start[: active[0]]]
    for t in range(1, lengths[0]):
        m = active[t]
        if m < len(state):
            label[start[m : len(state)] + t - 1] = state[m:].argmax(axis=1)
            state = state[:m]
        at = start[:m] + t
        best = state.argmax(axis=1)
        state = state - state[np.arange(m), best][:, None]  # the best is 0, so sums stay small in texts of any length
        leap = state < -switch
        switched[at], source[at] = leap, best
        state = np.where(leap, np.float32(-switch), state) + scores[at]
    label[start[: len(state)] + lengths[0] - 1] = state.argmax(axis=1)
    for t in range(lengths[0] - 1, 0, -1):
        at = start[: active[t]] + t
        now = label[at]
        label[at - 1] = np.where(switched[at, now], source[at], now)
    return label


def learnable(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: a language is given, and the id does not fall into the held-out fold."""
    return docs.where(F.col("lang").isNotNull() & (fold_of("doc_id") != 2))


def fold_of(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from whole texts of at most ``per_language`` documents of each language (``docs``: doc_id, lang, text).

    The sample is taken in the order of a hash of the ids. Spark sums trigram counts; the driver gets the counted cells
    (``CELLS`` for each language at most) and no text.
    """
    ids, sizes = bounded_sample(docs.select("doc_id", "lang"), "lang", per_language, MOST_LANGUAGES)
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((CELLS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    number = {name: i for i, name in enumerate(names)}
    sample = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                own = [t for lang, t in zip(langs, texts) if lang == name]
                words = split_words(own)
                cells = np.bincount(words.cells, minlength=CELLS)
                script = np.bincount(words.script, weights=words.length, minlength=len(SCRIPTS)).astype(np.int64)
                both = np.concatenate([cells, script])
                there = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(there), number[name], np.int32)), pa.array(there.astype(np.int32)), pa.array(both[there].astype(np.int64))],
                    names=["lang", "cell", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((CELLS + len(SCRIPTS), len(names)))
    table[counted.column("cell").to_numpy(), counted.column("lang").to_numpy()] = counted.column("n").to_numpy()
    cells, script = table[:CELLS], table[CELLS:]
    log_p = np.log((cells + 0.5) / (cells.sum(axis=0) + 0.5 * CELLS)).astype(np.float32)
    allowed = script >= LEAST_SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script never learned leaves all
    return LanguageModel(names, log_p, allowed)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE_CHARS and i > start:
            yield start, i
            start, size = i, len(t or "")
    if texts:
        yield start, len(texts)


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_spans) of every row, from the whole text alone.

    lang_pred is the label of most letters (ties: the first by name), score its share of the letters. A text that is null
    or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Repeated rows are each
    labelled; other columns are ignored; an empty table gives no rows.
    """
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = batch.column(1).to_pylist(), []
            for a, b in _slices(texts):
                parts.append(_labelled(texts[a:b], model, switch))
            pred, score, n_words, n_spans = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[np.asarray(pred, int)].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(n_words, pa.int64()), pa.array(n_spans, pa.int64())],
                names=["doc_id", "lang_pred", "score", "n_words", "n_spans"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, n_spans long")


def _labelled(texts: list[str | None], model: LanguageModel, switch: float):
    n, k = len(texts), len(model.languages)
    words = split_words(texts)
    if not k:
        return np.zeros(n, int), np.zeros(n), words.per_text, np.zeros(n, int)
    label = viterbi(model.scores(words), words.per_text, switch)
    text_of = np.repeat(np.arange(n), words.per_text)
    letters = np.bincount(text_of * k + label, weights=words.length, minlength=n * k).reshape(n, k)
    total = letters.sum(axis=1)
    pred = np.where(total > 0, letters.argmax(axis=1), k)
    changes = np.ones(len(label), bool)
    changes[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
    spans = np.bincount(text_of, weights=changes, minlength=n).astype(int)
    return pred, np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0), words.per_text, spans


def language_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """(doc_id, begin, end, lang): maximal runs of words with one label, as character offsets of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                words = split_words(texts[a:b])
                if not len(words.first) or not model.languages:
                    continue
                label = viterbi(model.scores(words), words.per_text, switch)
                text_of = np.repeat(np.arange(b - a), words.per_text)
                cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])]))
                last = np.append(cut[1:], len(label)) - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text_of[cut] + a)), pa.array(words.begin[cut]), pa.array(words.begin[last] + words.length[last]), pa.array([model.languages[i] for i in label[cut]], pa.string())],
                    names=["doc_id", "begin", "end", "lang"],
                )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, begin long, end long, lang string")
