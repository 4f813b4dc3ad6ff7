import random
import re
from collections import Counter

from hustings.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best(doc, item):
    d, i = words(doc), words(item)
    w = min(5, len(i))
    if not w:
        return 0.0
    s, own = [tuple(d[a : a + w]) for a in range(len(d) - w + 1)], Counter(tuple(i[a : a + w]) for a in range(len(i) - w + 1))
    n = own.total()
    return max((D.weighted_jaccard(Counter(s[a : a + n]), own) for a in range(max(1, len(s) - n + 1))), default=0.0)


def check(docs, bench):
    d, b = docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect()
    want = Counter((x.doc_id, y.item_id, round(v, 9)) for x in d for y in b if (v := best(x.text, y.text)) >= 0.8)
    got = D.leaks(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == want
    return got


def test_documents_match_brute_force(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = check(documents, bench)
    assert got
    text, item = {r.doc_id: r.text for r in documents.collect()}, {r.item_id: r.text for r in bench.collect()}
    for r in got:
        if r.similarity == 1.0:
            assert words(text[r.doc_id])[r.first_word : r.first_word + r.n_words] == words(item[r.item_id])


def test_edited_passages(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(9)) for _ in range(rng.choice([15, 25, 40, 60]))) for _ in range(12)]
    docs = []
    for k in range(150):
        ws = items[k % 12].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.randrange(len(ws))
            if rng.random() < 0.5:
                del ws[p]
            else:
                ws.insert(p, "new")
        docs.append((k, " ".join(["pre"] * rng.choice([0, 3, 30]) + ws + ["post"] * rng.choice([0, 3, 30]))))
    check(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, " "), (4, "Quick BROWN fox jumps over the lazy dog again"), (4, "Quick BROWN fox jumps over the lazy dog again"), (5, "漢字")], "item_id long, text string").selectExpr("*", "9 AS doc_id")
    check(odd_docs, bench)
    assert D.leaks(no_docs, bench).count() == 0 and D.leaks(odd_docs, bench.where("false")).count() == 0


def test_several_passes_find_the_same(spark, documents, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    once = sorted(D.leaks(documents, bench).collect())
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 15)
    assert sorted(D.leaks(documents, bench).collect()) == once


def test_index_finds_everything_within_the_radius():
    rng = random.Random(2)
    items = D.Items([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(40)])
    prints = D.np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(26))) for p in items.prints for _ in range(20)], D.np.uint64)
    want = {(i, n) for i, p in enumerate(prints.tolist()) for n, q in enumerate(items.prints.tolist()) if (p ^ q).bit_count() <= D.RADIUS}
    assert set(items.within(prints)) == want
