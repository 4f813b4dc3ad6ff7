"""Token counts that follow edits without encoding a whole text again.

A text is cut before white space that follows other text. No pre-token of the byte-level vocabularies spans such a cut,
so tokens of the parts add up to tokens of the whole. Runs of pre-tokens are the leaves of a segment tree of counts per
document. An edit encodes only the leaves it touches, with the leaf before and after as context, and updates the sums
above them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level vocabulary: a token in base64 and its rank on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that a leaf holds at least, where the text has a cut.
LEAF_CHARS = 256
#: A place before white space that follows other text.
_CUT = re.compile(r"(?<=\S)(?=\s)")
_PERSONAL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b")

Edit = tuple[int, int, str]
_encodings: dict[int, tuple] = {}


def encoding(ranks_file: bytes):
    """Encoder and the byte length of each of its tokens, made once per worker."""
    import tiktoken

    key = hash(ranks_file)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[key] = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[key]


def cuts(text: str, begin: int = 0, end: int | None = None) -> list[int]:
    """Leaf starts in text[begin:end], the first at ``begin``; each leaf has ``LEAF_CHARS`` or more characters but the last."""
    end = len(text) if end is None else end
    found, at = [begin], begin + LEAF_CHARS
    while at < end:
        m = _CUT.search(text, at, end)
        if not m or m.start() >= end:
            break
        found.append(m.start())
        at = m.start() + LEAF_CHARS
    return found if end > begin else []


class TokenTree:
    """Counts of the tokens of a text's leaves, summed in a binary tree; node i has the children 2i and 2i + 1."""

    def __init__(self, text: str, encoder, sizes: np.ndarray):
        self.encoder, self.sizes, self.text = encoder, sizes, text
        self.starts = cuts(text)
        self.reencoded = 0
        self._build(self._counts(text, self.starts))

    def _counts(self, text: str, starts: list[int]) -> np.ndarray:
        """Tokens of each leaf from one encoding of the stretch that begins at the first and ends with the text."""
        if not starts:
            return np.zeros(0, np.int64)
        stretch = text[starts[0] :]
        tokens = self.encoder.encode_ordinary(stretch)
        ends = np.cumsum(self.sizes[np.asarray(tokens, np.int64)])
        if stretch.isascii():
            marks = np.asarray(starts[1:], np.int64) - starts[0]
        else:
            widths = [len(stretch[a - starts[0] : b - starts[0]].encode()) for a, b in zip(starts, starts[1:])]
            marks = np.cumsum(np.asarray(widths, np.int64)) if widths else np.zeros(0, np.int64)
        upto = np.searchsorted(ends, marks, side="right")
        return np.diff(np.concatenate([[0], upto, [len(tokens)]]))

    def _build(self, counts: np.ndarray) -> None:
        self.leaves = 1 << max(0, (len(counts) - 1)).bit_length()
        self.tree = np.zeros(2 * self.leaves, np.int64)
        self.tree[self.leaves : self.leaves + len(counts)] = counts
        for level in range(self.leaves.bit_length() - 1, 0, -1):
            lo, hi = 1 << (level - 1), 1 << level
            self.tree[lo:hi] = self.tree[2 * lo : 2 * hi : 2] + self.tree[2 * lo + 1 : 2 * hi : 2]

    @property
    def total(self) -> int:
        return int(self.tree[1])

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replace text[begin:end] by ``new``; only the leaves it touches and one neighbour on each side are encoded."""
        before = len(self.starts)
        a = max(int(np.searchsorted(self.starts, begin, side="right")) - 2, 0)
        b = min(int(np.searchsorted(self.starts, end, side="right")) + 1, before)  # leaves a .. b - 1
        stop = self.starts[b] if b < before else len(self.text)
        start = self.starts[a] if before else 0
        shift = len(new) - (end - begin)
        text = self.text[:begin] + new + self.text[end:]
        region = text[: stop + shift]
        fresh = cuts(region, start)
        counts = self._counts(region, fresh)
        self.reencoded += stop + shift - start
        held = self.tree[self.leaves : self.leaves + before]
        self.text = text
        self.starts = self.starts[:a] + fresh + [s + shift for s in self.starts[b:]]
        if len(fresh) == b - a:  # same shape: update the sums above the leaves
            for i, n in zip(range(a, b), counts.tolist()):
                node, grown = self.leaves + i, n - int(held[i])
                while grown and node:
                    self.tree[node] += grown
                    node //= 2
        else:
            self._build(np.concatenate([held[:a], counts, held[b:]]))


def redactions(text: str, sign: str = "<hidden>") -> list[Edit]:
    """Edits that hide mail and IP addresses, from the last to the first so that offsets stay valid."""
    return [(m.start(), m.end(), sign) for m in _PERSONAL.finditer(text)][::-1]


def recount(docs: DataFrame, edits: Callable[[str], list[Edit]] | str = redactions, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, n_tokens_after, n_edits, n_leaves, n_chars_after, n_chars_reencoded.

    ``edits`` gives a text's edits, or names an array column of (begin, end, text) structs in the order to apply. Offsets
    are characters; one that lies outside the text is taken to its nearest end. A null text is an empty one with 0
    tokens, and edits may fill it. Repeated rows are each counted; other columns are ignored; an empty table gives no
    rows. Work is per document and nothing is shuffled. The vocabulary file is read on the driver and sent to the tasks.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, independent of the input
    column = edits if isinstance(edits, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = encoding(ranks.value)
        for batch in batches:
            rows = []
            given = batch.column(2).to_pylist() if column else None
            for i, text in enumerate(batch.column(1).to_pylist()):
                tree = TokenTree(text or "", encoder, sizes)
                before, n = tree.total, 0
                todo = [(e["begin"], e["end"], e["text"]) for e in given[i] or []] if column else edits(text or "")
                for begin, end, new in todo:
                    begin = min(max(begin or 0, 0), len(tree.text))
                    tree.edit(begin, min(max(end or 0, begin), len(tree.text)), new or "")
                    n += 1
                rows.append((before, tree.total, n, len(tree.starts), len(tree.text), tree.reencoded))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    names = ["doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_leaves", "n_chars_after", "n_chars_reencoded"]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([column] if column else []))
    return picked.mapInArrow(run, ", ".join(f"{n} long" for n in names))
