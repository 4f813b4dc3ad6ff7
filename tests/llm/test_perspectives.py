from collections import defaultdict

from hustings.llm import perspectives as P


def brute(rows):
    """Rendering and masked text of each dialogue from each view."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn, (role or "").strip() or "unknown", text or ""))
    out = {}
    for conv, turns in said.items():
        for view in {s for _, s, _ in turns} - {"system"}:
            out[conv, view] = sum(len(t) for _, s, t in turns if s == view), len(turns)
    return out


def check(turns):
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    pieces = defaultdict(list)
    for r in P.perspectives(turns).collect():
        pieces[r.conv_id, r.viewpoint].append(r)
    want = brute(rows)
    assert pieces.keys() == want.keys()
    for key, own in pieces.items():
        own.sort(key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(want[key][1]))
        text = "".join(r.piece for r in own)
        assert [r.begin for r in own] == [0, *[r.end for r in own[:-1]]] and own[-1].end == len(text)
        masked = sum(r.mask_end - r.mask_begin - len(P.CLOSE) + 1 for r in own if r.trained)
        assert masked == want[key][0]
        for r in own:
            assert (r.role == "assistant") == r.trained and (r.name is not None) == (r.role == "user")
            assert text[r.begin : r.end] == r.piece
            if r.trained:
                assert text[r.mask_begin : r.mask_end].endswith("<|im_end|>") and text[: r.mask_begin].endswith("assistant\n")
    assembled = {(r.conv_id, r.viewpoint): r for r in P.assembled(P.perspectives(turns)).collect()}
    assert all(assembled[k].rendered == "".join(r.piece for r in own) and len(assembled[k].spans) == sum(r.trained for r in own) for k, own in pieces.items())


def test_conversations(spark, sf):
    check(spark.read.parquet(f"{sf}/conversations.parquet"))


def test_many_parties_nulls_ties_and_repeats(spark):
    rows = [(1, t, s, f"{s} says {t}") for t, s in enumerate(["ann", "bob", "cid", "ann", "system", "bob"])]
    rows += [(2, None, "ann", "x"), (2, 0, None, None), (2, 0, " ", ""), (2, 0, "bob", "same"), (2, 0, "bob", "same"), (None, 1, "eve", "hi"), (3, 0, "system", "alone")]
    rows += [(4, t, "ab"[t % 2], "long" * (t % 7)) for t in range(1200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS viewpoint", "2 AS bucket", "3 AS one", "4 AS head")
    check(turns)
    assert P.perspectives(turns.where("false")).count() == 0
