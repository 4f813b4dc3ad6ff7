"""Packing of token sequences under several limits at once: tokens, segments and loss-bearing tokens of a sequence.

Every example is a demand vector (tokens, one segment, loss-bearing tokens). A sequence is opened with all of its limits
free; of a pool of waiting examples that fit, the one with the greatest dot product of demand and what is still free, each
in shares of its limit, goes in next. Where nothing fits any more, an example is cut and its head fills the sequence.

A task packs the rows of its own partition as they stream by, from a pool of bounded size: nothing is shuffled, and only
the last sequence of a partition can stay unfilled. With cutting it is dealt to sequences of a power of two, which need
no padding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of ``public_tokenizers``, and the id that ends a document.
VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
#: Examples that wait in a task at the most, and their tokens (one example may have more).
POOL = 512
POOL_TOKENS = 2_000_000
#: Pre-tokens whose ids a task keeps.
CACHE = 400_000
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: The pre-token pattern of the vocabulary for texts up to U+024F, where ``re`` can spell out its letters and numbers.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\x00-ɏ]")


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at the most."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Encoder(dict):
    """Ids of pre-tokens as little-endian bytes, each encoded by the vocabulary's own model when first met.

    Merges never cross pre-tokens, so their ids in a row are those of the text. A text with characters beyond U+024F is
    encoded as a whole. The strings of special tokens are ordinary text.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        plain = piece.isascii() and piece.isprintable()
        shown = piece.replace(" ", self.letters[32]) if plain else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        self[piece] = packed_ids = struct.pack(f"<{len(ids)}I", *ids)
        return packed_ids

    def ids(self, text: str) -> bytes:
        if _BEYOND.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text and an end id, as little-endian 32-bit integers in a binary column.

    A null text is an empty one and has the end id alone. Rows that repeat are each encoded; an empty table gives none.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.ids(t or "") + end for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


class Example:
    """What is left of an example: its ids, its running count of loss-bearing tokens, and where the rest starts."""

    __slots__ = ("id", "ids", "loss", "start")

    def __init__(self, id_, ids: np.ndarray, trained: np.ndarray | None = None):
        self.id, self.ids, self.start = id_, ids, 0
        if trained is None:  # every token but the first, which nothing foretells
            self.loss = np.maximum(np.arange(-1, len(ids), dtype=np.int64), 0)
        else:
            self.loss = np.concatenate([[0], np.cumsum(trained, dtype=np.int64)])

    def need(self) -> tuple[int, int]:
        """Tokens left, and how many of them bear loss."""
        return len(self.ids) - self.start, int(self.loss[-1] - self.loss[self.start])

    def head(self, tokens: int, loss: int) -> int:
        """How many of the next tokens stay within both limits."""
        within = int(np.searchsorted(self.loss, self.loss[self.start] + loss, side="right")) - 1
        return min(tokens, within - self.start)

    def take(self, n: int) -> Piece:
        self.start += n
        return self, self.start - n, n


#: An example, the place of its first token there, and tokens.
Piece = tuple[Example, int, int]


class Pool:
    """Waiting examples of a stream, and sequences made of them."""

    def __init__(self, examples: Iterator[Example], limits: Limits, cut: bool):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit is 1 or more")
        self.examples, self.limits, self.cut, self.more = examples, limits, cut, True
        self.waiting: list[Example | None] = [None] * POOL
        self.tokens, self.loss = np.zeros(POOL, np.int64), np.zeros(POOL, np.int64)  # 0 tokens: a free place
        self.free = list(range(POOL))

    def fill(self) -> Iterator[list[Piece]]:
        """Take examples up to the bounds of the pool; what fills a sequence alone is given back at once."""
        held = int(self.tokens.sum())
        while self.more and self.free and held < POOL_TOKENS:
            example = next(self.examples, None)
            if example is None:
                self.more = False
                return
            size, most = self.limits.tokens, self.limits.loss
            while example.need()[0] > size and example.head(size, most) == size:
                yield [example.take(size)]
            if example.need()[0]:
                held += example.need()[0]
                self._put(self.free.pop(), example)

    def _put(self, place: int, example: Example) -> None:
        self.tokens[place], self.loss[place] = example.need()
        left = bool(self.tokens[place])
        self.waiting[place] = example if left else None
        if not left:
            self.free.append(place)

    def _best(self, tokens: int, segments: int, loss: int) -> int | None:
        """The fitting example with the greatest dot product of its demand and what is free, in shares of the limits."""
        fits = (self.tokens > 0) & (self.tokens <= tokens) & (self.loss <= loss)
        if not fits.any():
            return None
        most = self.limits
        score = self.tokens * (tokens / most.tokens**2) + segments / most.segments**2 + self.loss * (loss / most.loss**2)
        return int(np.where(fits, score, -1.0).argmax())

    def _longest_head(self, tokens: int, loss: int) -> tuple[int | None, int]:
        best, length = None, 0
        for k in np.argsort(-self.tokens, kind="stable").tolist():
            if not self.tokens[k] or length == tokens:
                break
            n = self.waiting[k].head(tokens, loss)
            if n > length:
                best, length = k, n
        return best, length

    def sequences(self) -> Iterator[list[Piece]]:
        while True:
            yield from self.fill()
            if len(self.free) == POOL:
                return
            tokens, segments, loss, pieces = self.limits.tokens, self.limits.segments, self.limits.loss, []
            while tokens and segments:
                k = self._best(tokens, segments, loss)
                if k is None and self.more and self.free:
                    yield from self.fill()
                    k = self._best(tokens, segments, loss)
                n = int(self.tokens[k]) if k is not None else 0
                if k is None and (self.cut or not pieces):
                    k, n = self._longest_head(tokens, loss)
                if k is None:
                    break
                example = self.waiting[k]
                pieces.append(example.take(n))
                tokens, segments = tokens - n, segments - 1
                loss -= int(example.loss[example.start] - example.loss[example.start - n])
                self._put(k, example)
            if tokens and self.cut:
                yield from powers_of_two(pieces)
            else:
                yield pieces


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces of an unfilled sequence dealt out to sequences whose lengths are falling powers of two."""
    left, rest = sum(p[2] for p in pieces), pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            example, start, n = rest.pop()
            if n > room:
                rest.append((example, start + room, n - room))
                n = room
            out.append((example, start, n))
            room -= n
        yield out


def pack(examples: DataFrame, limits: Limits = Limits(), cut: bool = True, id_col: str = "doc_id", ids_col: str = "ids", trained_col: str | None = None) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset.

    ``ids_col`` holds 32-bit ids in a binary column (see ``tokenised``), ``trained_col`` a byte a token that is 1 where the
    token bears loss; without it all tokens of an example but its first do. ``start`` counts the ids of the example before
    the piece, ``offset`` those of the sequence. Every id lies in exactly one piece.

    With ``cut`` an example may be cut anywhere, and what is no full sequence has a length of a power of two. Without it
    examples stay whole unless one alone exceeds a limit, and sequences have room left. Null or empty ids give no piece; a
    null id is kept. Rows that repeat are packed each for itself; other columns are ignored; an empty table gives no
    rows. Sequences hold rows of one partition, so the order of the input is kept roughly: shuffle it before if it is
    sorted. ``sequence_id`` is unique, and the same again for the same partitions.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    picked = examples.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"), *([F.col(trained_col).alias("trained")] if trained_col else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(1)[i].as_py()
                if ids:
                    trained = np.frombuffer(batch.column(2)[i].as_py(), np.uint8) if trained_col else None
                    ids = np.frombuffer(ids, "<u4")
                    if trained is not None and len(trained) != len(ids):
                        raise ValueError("an example has not as many loss flags as ids")
                    yield Example(batch.column(0)[i].as_py(), ids, trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 33, [], 0
        for nth, pieces in enumerate(Pool(read(batches), limits, cut).sequences()):
            offset = 0
            for example, start, n in pieces:
                loss = int(example.loss[start + n] - example.loss[start])
                held.append((example.id, start, n, example.ids[start : start + n].tobytes(), len(example.ids), loss, first + nth, offset))
                offset += n
            size += offset
            if size > 500_000:
                yield columns(held)
                held, size = [], 0
        if held:
            yield columns(held)

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        made = [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, zip(*rows))]
        return pa.RecordBatch.from_arrays(made, names=names)

    return picked.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))


def packed_documents(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents: texts encoded and packed in one pass over the table, without a shuffle."""
    return pack(tokenised(docs, vocabulary=vocabulary), limits)
