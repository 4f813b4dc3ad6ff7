import re
from collections import defaultdict

import numpy as np
import xxhash

from hustings.llm import simhash_dedup as S
from hustings.llm.components import components


def brute_print(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, p, min(least[find(i)], default=None)) for i, (d, p) in enumerate(rows)), key=str)


def check(docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = S.near_duplicate_groups(docs).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == brute_groups(rows)


def test_documents_match_brute_force(documents):
    check(documents)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert S.near_duplicate_groups(no_docs).count() == 0


def test_walk_finds_all_pairs_in_parts(spark):
    rng = np.random.default_rng(3)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    ball = base[0] ^ one(200) ^ one(200)
    prints = np.unique(np.concatenate([base, base ^ one(150) ^ one(150) ^ one(150) ^ one(150), ball])).view(np.int64)
    points = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    want = brute_groups([(int(x), int(x) % 2**64) for x in prints])
    for part_rows in (20_000, 40):  # whole subtries, and hot ones cut into parts
        roots = {r.node: r.root for r in components(S.trie_links(points, 4, part_rows)).collect()}
        assert sorted(((int(x), int(x) % 2**64, roots.get(int(x), int(x))) for x in prints), key=str) == want


def test_links_stay_few_in_a_dense_group(spark):
    points = spark.createDataFrame([(i,) for i in range(64)], "fp long")  # all within six bits
    assert S.trie_links(points).count() <= 63 * 15
    assert {r.root for r in components(S.trie_links(points)).collect()} == {0}


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or {" ".join(words)}


def test_near_copies_are_grouped_and_others_left_alone(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, family = [], {}
    for base in range(0, 600, 6):
        words = [word() for _ in range(rng.integers(80, 300))]
        for copy in range(6):
            own = list(words)
            if copy >= 4:  # not similar enough: half of the words anew
                own[: len(own) // 2] = [word() for _ in range(len(own) // 2)]
            for _ in range(copy % 4 * len(own) // 100):  # about 10 % of the shingles for each
                own[rng.integers(len(own))] = word()
            rows.append((base + copy, " ".join(own)))
            family[base + copy] = base
    got = {r.doc_id: r.component_id for r in S.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {d: shingle_set(t) for d, t in rows}
    near, far = [], []
    for d in text:
        a, b = text[d], text[family[d]]
        (near if len(a & b) / len(a | b) >= 0.8 else far if len(a & b) / len(a | b) < 0.5 else []).append(got[d] == family[d])
    assert np.mean(near) > 0.97 and len(near) > 250 and not any(far)


def test_only_exact_near_copies_are_linked(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, want = [], []
    for pair in range(300):
        words = [word() for _ in range(300)]
        other = list(words)
        for at in rng.choice(60, 4 + pair % 12, replace=False):  # each new word changes five shingles
            other[5 * at] = word()
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        want.append(len(a & b) / len(a | b) >= 0.8)
    got = {r.doc_id: r.component_id for r in S.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = np.array([got[2 * k + 1] == 2 * k for k in range(300)])
    want = np.array(want)
    assert 50 < want.sum() < 250 and not linked[~want].any() and linked[want].mean() > 0.98


def test_a_crowded_node_is_thinned_without_losing_links(spark):
    rng = np.random.default_rng(6)
    middle = int(rng.integers(2**63))
    prints = sorted({middle ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False)) for _ in range(700)} | {middle ^ (0b11111111 << 24), middle ^ (0b111111111 << 40)})
    want = brute_groups([(p, p) for p in prints])
    roots = {r.node: r.root for r in components(S.trie_links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    assert sorted(((p, p, roots.get(p, p)) for p in prints), key=str) == want


def test_representatives_keep_one_of_each_group(documents, odd_docs):
    kept = S.representatives(documents)
    groups = S.near_copy_groups(documents).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in groups})
    assert kept.columns == documents.columns
    assert S.representatives(odd_docs).where("doc_id is null").count() == 1


def exact_groups(sets, least=0.8):
    """Smallest row of each group connected by pairs of ``least`` similarity or more, over all pairs."""
    index, label = defaultdict(list), list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in enumerate(sets):
        common = defaultdict(int)
        for x in own:
            for j in index[x]:
                common[j] += 1
            index[x].append(i)
        for j, c in common.items():
            if c / (len(own) + len(sets[j]) - c) >= least:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(sets))]


def test_a_family_of_two_thousand_near_copies(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base, rows = [word() for _ in range(150)], []
    for i in range(2000):  # around the original most are above 0.8, among themselves most are below
        own = list(base)
        for at in rng.choice(30, rng.integers(0, 6), replace=False):
            own[5 * at] = word()
        rows.append((i, " ".join(own)))
    want = exact_groups([shingle_set(t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for part_texts in (S.PART_TEXTS, 60):
        got = {r.doc_id: r.component_id for r in S.near_copy_groups(docs, part_texts=part_texts).collect()}
        assert np.mean([got[i] == want[i] for i in range(2000)]) > 0.99
        assert all(want[got[i]] == want[i] for i in range(2000))  # nothing is linked that is not linked exactly
    assert len(set(want)) > 50


def test_units_cover_all_pairs_of_different_parts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2, 3, 4 + i])), 7) for i in range(60)] + [(100, 100, 8), (101, 101, 8), (102, 100, 9), (103, 100, 9), (104, 100, 9)]
    part = {p: c for p, c, _ in rows}
    units = defaultdict(lambda: ([], []))
    for r in S.open_units(spark.createDataFrame(rows, "print long, part long, gid long"), 7).collect():
        assert r.gid == 7
        units[r.kind, r.p, r.q][r.side].append(r.print)
    met = defaultdict(int)
    for (kind, p, q), (a, b) in units.items():
        pairs = [(x, y) for x in a for y in b] if p != q or kind == 0 else [(x, y) for x in a for y in a if x < y]
        for x, y in pairs:
            met[min(x, y), max(x, y)] += 1
    want = {(x, y) for x in range(60) for y in range(x + 1, 60) if part[x] != part[y]}
    assert want <= set(met) and all(met[k] == 1 for k in want) and max(len(a) + len(b) for a, b in units.values()) < 60


def test_candidate_rows_do_not_grow_with_pairs(spark):
    rng = np.random.default_rng(2)
    middle = rng.integers(0, 2**63, S.COMPARED_WORDS, dtype=np.int64)
    rows = []
    for i in range(600):
        sketch = middle.copy()
        sketch[rng.integers(S.COMPARED_WORDS)] ^= np.int64(1) << rng.integers(63)
        rows += [(i, key, [int(x) for x in sketch]) for key in (1, 2)]
    near = S.subtrie_links(spark.createDataFrame(rows, "name long, key long, rest array<long>"), S.SKETCH_BUDGET, 64 * S.COMPARED_WORDS, nearest=True)
    assert near.count() == len(rows) and near.where("near = u").count() == 0
