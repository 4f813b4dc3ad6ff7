import hashlib
import random

import numpy as np

from hustings.llm import suffix_dedup as S


def brute(rows, length=50):
    """(doc_id, bytes, removed, spans, digest) by looking up every string."""
    last = 2**63
    raw = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in raw:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, last), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if d == last else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, S.repeat_digests(docs).collect()), key=str) == want
    kept = S.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, hashlib.sha256(r.kept).hexdigest(), len(r.spans)) for r in kept), key=str) == sorted(((r[0], r[4], r[3]) for r in want), key=str)


def test_documents_match_brute_force(documents):
    check(documents)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert S.repeat_digests(no_docs).count() == 0


def test_periodic_overlapping_and_edited_texts(spark):
    rng = random.Random(4)
    part = ["".join(rng.choice("abcé \n") for _ in range(n)) for n in (20, 49, 50, 51, 80, 200)]
    rows = [(i, "".join(rng.choice(part) for _ in range(rng.randint(0, 6)))) for i in rng.sample(range(500), 120)]
    rows += [(600, "a" * 300), (601, "a" * 120), (602, "ab" * 80), (603, "x" + "ab" * 60), (604, "a" * 49), (605, "\0" * 70), (606, "\0" * 60)]
    rows += [(601, "a" * 70), (601, part[5]), (700, part[5]), (700, part[5])]  # ids that repeat
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_classes_by_backward_extension():
    rng = random.Random(5)
    for _ in range(20):
        frag = [bytes(rng.choice(b"ab \n") for _ in range(rng.choice([30, 60, 90]))) for _ in range(6)]
        contents = [b"".join(rng.choice(frag) for _ in range(rng.randint(1, 4))).ljust(50, b"x") for _ in range(20)]
        ids = np.array([rng.randint(0, 50) for _ in contents])
        want = {}
        for c, i in zip(contents, ids):
            for p in range(len(c) - 49):
                want[c[p : p + 50]] = min(want.get(c[p : p + 50], 99), i)
        for c, got in zip(contents, S.least_ids(contents, ids)):
            assert [want[c[p : p + 50]] for p in range(len(c) - 49)] == got.tolist()
