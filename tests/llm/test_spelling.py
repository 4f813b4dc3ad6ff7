import random
import re
import zlib
from collections import Counter

import numpy as np

from hustings.llm import spelling as S

LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups(words):
    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = (form, n, len(close), words[form] if form else None)
    return {(w, form, root(out, w), n, k, m) for w, (form, n, k, m) in out.items()}


def root(out, w):
    while out[w][0]:
        w = out[w][0]
    return w


def texts(rng, many):
    stems = ["".join(rng.choice("abcdeéÿñ") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab"]
    for i in range(many):
        said = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] * 2]) + w[at + 1 :]
            said.append(w.upper() if rng.random() < 0.1 else w)
        yield rng.choice([i, i, None]), rng.choice([" ", ", ", "7"]).join(said)


def test_groups_match_brute_force(spark):
    rows = list(texts(random.Random(5), 150))
    got = S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == groups(words_of(rows)) and len(words_of(rows)) > 200


def test_neighbourhoods_find_each_pair_from_one_end_and_hold_each_string_once():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzàÿ") for _ in range(7)) for _ in range(50)] + ["aaaaaaa", "aabbaab"]
    own = lambda w: next(S.reduced_keys([w], False))[1][0]
    around = lambda w: {int(k) for _, keys in S.reduced_keys([w], True) for k in keys}
    found = [[] for _ in words]
    for place, keys in S.reduced_keys(words, True):
        for i, k in zip(place.tolist(), keys.tolist()):
            found[i].append(k)
    for w, keys in zip(words, found):
        s = S.symbols(np.array([ord(c) for c in w])).astype(int)
        assert len(set(keys)) == len(keys) == 2 + int((s[1:] != s[:-1]).sum()) + int((S.SYMBOLS - s).sum())
        for _ in range(20):
            at, c = rng.randrange(7), rng.choice("abcxyzé")
            assert own(w[:at] + w[at + 1 :]) in keys and own(w) in around(w[:at] + c + w[at:])
            other = w[:at] + c + w[at + 1 :]
            assert own(other) in keys or own(w) in around(other)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in S.spelling_variants(odd_docs).collect()} == groups(words_of(rows))
    assert S.spelling_variants(no_docs).count() == 0


def test_long_words_and_long_chains(spark):
    long = "ab" * 5_000
    words = {long: 5, long[:-1]: 20} | {"b" * i + "a" * (12 - i): 2**i for i in range(13)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in S.spelling_groups(frame).collect()}
    assert got[long].form == got[long].root == long[:-1]
    assert got["a" * 12].root == "b" * 12 and got["b" * 12].form is None and got["b" * 12].root == "b" * 12


def test_one_word_in_a_third_of_all_places(spark):
    rows = [(i, "common " * 40 + f"common{'abcdefgh'[i % 8]}") for i in range(400)]
    got = {r.word: r for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {tuple(r) for r in got.values()} == groups(words_of(rows)) and got["commona"].root == "common"
