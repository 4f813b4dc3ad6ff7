import random
import zlib

import numpy as np
import pytest

from hustings.llm import packing as P


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def held(pieces, want, limits, cut=True):
    """Every id in one piece, sequences gapless and within all limits; the lengths of the sequences."""
    parts, sequences = {}, {}
    for r in pieces:
        parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
        assert r.length == len(r.ids) // 4 > 0 and r.doc_tokens == len(want[r.doc_id])
    for key, ids in want.items():
        got = sorted(parts.get(key, []))
        assert [x for _, p in got for x in p] == ids
        assert [s for s, _ in got] == np.cumsum([0] + [len(p) for _, p in got])[:-1].tolist()
    lengths = []
    for rows in sequences.values():
        rows.sort()
        sizes = [n for _, n, _ in rows]
        assert [o for o, _, _ in rows] == np.cumsum([0, *sizes])[:-1].tolist()
        assert sum(sizes) <= limits.tokens and len(rows) <= limits.segments and sum(x for _, _, x in rows) <= limits.loss
        if cut:
            assert sum(sizes) == limits.tokens or sum(sizes).bit_count() == 1
        lengths.append(sum(sizes))
    return lengths


def test_documents_are_packed_whole(documents, encode):
    want = {r.doc_id: [*encode(r.text), 1] for r in documents.collect()}
    pieces = P.packed_documents(documents).collect()
    lengths = held(pieces, want, P.Limits())
    full = sum(n == 2048 for n in lengths)
    assert full >= sum(map(len, want.values())) // 2048 - documents.rdd.getNumPartitions() * 2
    assert all(r.loss_tokens == r.length - (r.start == 0) for r in pieces)


def test_query_digests(spark, sf, encode):
    from hustings.llm.queries import op11_packed_sequences

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op11_packed_sequences(spark, sf).limit(60).collect():
        ids = np.array([*encode(text[r.doc_id]), 1], "<u4")[r.start : r.start + r.length]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_odd_rows(odd_docs, no_docs, encode):
    rows = P.packed_documents(odd_docs).collect()
    assert sum(r.length for r in rows) == sum(len(encode(r.text)) + 1 for r in odd_docs.collect())
    assert sum(r.doc_id == 2 and r.start == 0 for r in rows) == 2 and any(r.doc_id is None for r in rows)
    assert P.packed_documents(no_docs).count() == 0


def test_pre_tokens_encode_as_the_whole_text(encode):
    encoder, rng = P.Encoder(), random.Random(3)
    signs = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000] + list("  \n\t'’1a漢😀") * 20
    for _ in range(300):
        text = "".join(rng.choice(signs) if rng.random() < 0.5 else rng.choice([" the", "'s", " 12", "word", "  ", "\n\n", "é"]) for _ in range(40))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encode(text)


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("limits", [P.Limits(64, 4, 64), P.Limits(64, 64, 20), P.Limits(100, 6, 31), P.Limits(7, 1, 1)])
def test_all_limits_hold_for_instruction_data(spark, limits, cut):
    rng = random.Random(repr((limits, cut)))
    rows, want = [], {}
    for i in range(700):
        n = rng.choice([0, 1, 3, 12, 30, 64, 65, 150])
        prompt = rng.randint(0, n)
        ids = [rng.randint(0, 50_000) for _ in range(n)]
        rows.append((i, bytearray(np.array(ids, "<u4").tobytes()), bytearray([0] * prompt + [1] * (n - prompt)), "x"))
        want[i] = ids
    frame = spark.createDataFrame(rows, "doc_id long, ids binary, trained binary, length string").repartition(2)
    pieces = P.pack(frame, limits, cut, trained_col="trained").collect()
    lengths = held(pieces, want, limits, cut)
    flags = {r[0]: r[2] for r in rows}
    assert all(r.loss_tokens == sum(flags[r.doc_id][r.start : r.start + r.length]) for r in pieces)
    if not cut:
        for r in pieces:
            if r.length < r.doc_tokens:
                assert len(want[r.doc_id]) > limits.tokens or sum(flags[r.doc_id]) > limits.loss
    assert sum(lengths) == sum(map(len, want.values()))


def test_one_token_examples_and_more_segments_than_waiting_places(spark):
    frame = spark.range(3000).selectExpr("id AS doc_id", "unhex('01000000') AS ids").coalesce(1)
    few = P.pack(frame).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in few)[-23:] == [128] * 23 and sum(r["count"] for r in few) == 3000
    many = P.pack(frame, P.Limits(2048, 4000, 2048)).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in many) == [8, 16, 32, 128, 256, 512, 2048]


def test_wrong_arguments(spark):
    with pytest.raises(ValueError):
        P.Pool(iter(()), P.Limits(0, 1, 1), True)
