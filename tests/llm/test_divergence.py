import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hustings.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = {i: i + 32 for i in range(65, 91)}


def audit(rows, least=10, top=10):
    """The whole audit in plain integers."""
    docs, seen, counts = defaultdict(set), set(), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(rows):
        text, lang, source = text or "", lang or "", source or ""
        seen.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            docs[lang, term.translate(LOWER)].add(i)
            counts[lang, source][term.translate(LOWER)] += 1
    out = set()
    for lang in {x for x, _ in seen}:
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least]
        sources = sorted(s for x, s in seen if x == lang)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        everything = {t: sum(of[s][t] for s in sources) for t in kept}

        def priced(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (n + 2) // total for t, n in c.items()}

        q, p = priced(everything), {s: priced(c) for s, c in of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, r) for r, (value, item) in enumerate(items, 1) if part == "pair" or r <= top}
    return out


def got(frame, **more):
    return {tuple(r) for r in D.divergence_audit(frame, **more).collect()}


@pytest.mark.parametrize("block_terms", [7, 1 << 16])
def test_audit_matches_plain_integers(spark, block_terms):
    rng = random.Random(block_terms)
    terms = ["".join(rng.choice("abcdéßŁ漢") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "b", "b", None, "é", "z"])
        said = [rng.choice(terms[: rng.randint(1, 150)]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([i, None]), rng.choice([" ", "-", "9"]).join(said).title(), lang, source))
    rows += [(1, None, "en", "silent"), (1, None, "fr", "a"), (2, "few words", "fr", "b"), (3, "", "xx", "alone")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame, block_terms=block_terms) == audit([r[1:] for r in rows])


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert got(odd_docs) == audit(rows)
    assert got(odd_docs, least_docs=1) == audit(rows, least=1)
    assert got(no_docs) == set()


def test_gallop_finds_first_places():
    rng = np.random.default_rng(1)
    for few, many in ((0, 0), (0, 5), (5, 0), (1, 1000), (1000, 1), (300, 40_000), (2000, 2000)):
        a, b = (np.unique(rng.integers(0, 50_000, n)) for n in (few, many))
        assert np.array_equal(D.gallop(a, b), np.searchsorted(b, a))


def test_merging_prices_both_sides_and_absent_terms():
    rng = np.random.default_rng(4)
    for _ in range(50):
        counts = rng.integers(0, 4, (2, 90)) * rng.integers(0, 10**6, (2, 90)) * (rng.random((2, 90)) < rng.random())
        arrays = [(np.flatnonzero(c), c[c > 0]) for c in counts]
        totals = [int(c.sum()) for c in counts]
        p, q = ([1 + 10**9 * (int(n) + 2) // (t + 180) for n in c] for c, t in zip(counts, totals))
        want = sum((x - y) ** 2 // (x + y) for x, y in zip(p, q))
        assert D.merged(*arrays, tuple(totals), 90, 90) == want == D.merged(*arrays[::-1], tuple(totals[::-1]), 90, 90)


def test_prices_are_exact_for_large_counts(spark):
    for n, total, kept in ((0, 1, 1), (9 * 10**14, 9 * 10**14 + 5, 10**6), (10**13 + 7, 3 * 10**14, 123_457)):
        want = 1 + 10**9 * (n + 2) // (total + 2 * kept)
        assert int(D.price(n, total, kept)) == want
        from pyspark.sql import functions as F

        assert spark.range(1).select(D._price(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p == want
