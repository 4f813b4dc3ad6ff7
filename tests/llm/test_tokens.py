import random

import pytest

from hustings.llm import token_counts as T

ENCODER = T.encoding(open(T.VOCABULARY, "rb").read())


def full(text):
    return len(ENCODER[0].encode_ordinary(text))


def test_edits_keep_the_count_of_a_whole_encoding():
    rng = random.Random(1)
    for _ in range(150):
        text = " ".join("".join(rng.choice("abcé ñü 1,.\n  漢😀'") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 400)))
        tree = T.TokenTree(text, *ENCODER)
        assert tree.total == full(text)
        for _ in range(4):
            a = rng.randint(0, len(tree.text))
            b = min(len(tree.text), a + rng.choice([0, 1, 5, 700]))
            tree.edit(a, b, "".join(rng.choice("ab c\n é") for _ in range(rng.choice([0, 1, 3, 900]))))
            assert tree.total == full(tree.text)
            assert tree.tree[tree.leaves : tree.leaves + len(tree.starts)].sum() == tree.total


def test_a_small_edit_encodes_a_small_region():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = T.TokenTree(text, *ENCODER)
    tree.edit(60_000, 60_005, "changed")
    assert tree.total == full(tree.text) and tree.reencoded < 10 * T.LEAF_CHARS


def test_documents_match_full_encoding(documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    rows = T.recount(documents).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        after = text[r.doc_id]
        for a, b, new in T.redactions(after):
            after = after[:a] + new + after[b:]
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (full(text[r.doc_id]), full(after), len(after))
    assert sum(r.n_edits for r in rows) > 0


def test_odd_rows_and_given_edits(spark, odd_docs, no_docs):
    rows = T.recount(odd_docs).collect()
    want = sorted((full(r.text or "") for r in odd_docs.collect()))
    assert sorted(r.n_tokens for r in rows) == want
    assert T.recount(no_docs).count() == 0
    given = spark.createDataFrame(
        [(1, "some words here", [(5, 10, "more words")]), (2, None, [(-3, 99, "filled")]), (3, "kept", None), (4, "x", [(None, None, None)])],
        "doc_id long, text string, edits array<struct<begin: long, end: long, text: string>>",
    )
    got = {r.doc_id: r.n_tokens_after for r in T.recount(given, "edits").collect()}
    assert got == {1: full("some more words here"), 2: full("filled"), 3: full("kept"), 4: full("x")}


def test_missing_vocabulary_is_an_error(documents):
    with pytest.raises(FileNotFoundError):
        T.recount(documents, vocabulary="/nowhere")
