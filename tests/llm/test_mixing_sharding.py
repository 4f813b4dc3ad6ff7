import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from hustings.llm import sharding as H
from hustings.llm import source_mixing as M


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(docs):
    rows = [(r.doc_id, r.source, words(r.text)) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = brute_targets(sizes)
    got = M.mix(docs).collect()
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(rows, key=str)
    taken, slots = Counter(), set()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        assert (r.first_slot is not None) == (r.taken > 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.5001, target[s] / M.BLOCKS)
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(5)).collect()))


def test_mix_of_documents(documents):
    check_mix(documents)


def test_mix_of_odd_rows(odd_docs, no_docs):
    check_mix(odd_docs)
    assert M.mix(no_docs).count() == 0
    assert M.mix(odd_docs.where("trim(text) = ''")).count() == 1


def test_schedule_is_even_everywhere(spark):
    targets = spark.createDataFrame([("a", 1000, 900.0), ("b", 500, 450.0), (None, 300, 150.0)], "source string, source_size long, target double")
    lines = M.block_lines(targets, 50)
    uses = {r.source: r.uses for r in lines.collect()}
    slots = sorted(M.schedule(lines).collect())
    total = len(slots)
    assert len({r.slot for r in slots}) == total == sum(uses.values()) and all(50 <= n < 100 for n in uses.values())
    for n in range(10, total + 1):
        seen = Counter(r.source for r in slots[:n])
        assert all(abs(seen[s] - uses[s] / total * n) < 5 for s in uses)
    for line in lines.collect():
        own = [r for r in slots if r.source == line.source]
        assert [(r.block, r["pass"]) for r in own] == [(i % line.line_blocks, i // line.line_blocks) for i in range(len(own))]


def test_mixed_documents_hold_the_words_taken(documents, odd_docs):
    for docs in (documents, odd_docs):
        copies = M.mixed_documents(docs)
        assert copies.columns == docs.columns
        got, want = Counter(), Counter()
        for r in copies.select("doc_id", "source", "text").collect():
            got[r.doc_id, r.source] += words(r.text)
        for r in M.mix(docs).collect():
            if r.taken:
                want[r.doc_id, r.source] += r.taken
        assert got == want


def test_small_sources_meet_their_targets_as_large_ones_do(spark):
    # Sources of 0.0001 % to 0.1 % of the words beside two large ones.
    rows = [(i, "large" + str(i % 2), "w " * 1000) for i in range(2000)]
    for nth, n in enumerate((2, 5, 20, 37, 150, 2000)):
        rows += [(10_000 + 100 * nth + k, f"small{nth}", "v " * (n // 2 + k * (n % 2))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += words(t)
    target = brute_targets(sizes)
    per_doc, taken, piped = M.mix(docs).collect(), Counter(), Counter()
    assert len(per_doc) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in per_doc)
    for r in per_doc:
        taken[r.source] += r.taken
    for r in C.mix_sources(spark, docs, "").collect():
        piped[r.source] += words(r.text)
    for s in sizes:
        assert taken[s] == piped[s] and abs(taken[s] - target[s]) <= max(0.5001, target[s] / 2 / M.BLOCKS)


def test_one_place_in_the_line_for_each_of_many_equal_rows(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "'s' AS source", "'one two three' AS text")
    got = M.mix(docs.unionByName(spark.range(300).selectExpr("id AS doc_id", "'t' AS source", "'x' AS text"))).collect()
    assert len(got) == 3300 and {r.taken for r in got if r.source == "s"} <= set(range(7))
    assert abs(sum(r.taken for r in got if r.source == "s") - next(r.target for r in got if r.source == "s")) <= 27


def check_shards(docs, shards=16):
    rows = docs.select("doc_id", "text").collect()
    got = H.shard_documents(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows), key=str)
    places, total, of_slot = defaultdict(list), Counter(), {}
    for r in got:
        assert 0 <= r["shard"] < shards and r.law == "bytes" and r.grown_shard is None
        places[r["shard"]].append(r.slot)
        total[r["shard"]] += r.size
        assert of_slot.setdefault(r.virtual_slot, r["shard"]) == r["shard"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return total


def test_shards_of_documents(spark):
    total = check_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(total) == 16 and max(total.values()) < 1.02 * min(total.values())


def test_shards_of_odd_rows(odd_docs, no_docs):
    check_shards(odd_docs)
    assert H.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("doc_id, text", [("null", "repeat('x', 200 + id % 50)"), ("null", "'always the same'"), ("7", "concat('text ', id)"), ("if(id % 3 = 0, null, id)", "'same'")])
def test_null_and_repeated_ids_spread_over_all_shards(spark, doc_id, text):
    docs = spark.range(20_000).selectExpr(f"cast({doc_id} AS long) AS doc_id", f"{text} AS text")
    total = check_shards(docs)
    assert len(total) == 16 and max(total.values()) < 1.02 * min(total.values())


def test_map_versions_move_few_slots(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = H.slot_bytes(H.slotted(docs))
    folder = str(tmp_path / "maps")
    H.write_map(H.new_map(sizes, 8), folder)
    H.write_map(H.rebalanced(sizes, H.read_map(spark, folder), 9), folder)
    old = {r.virtual_slot: r["shard"] for r in H.read_map(spark, folder, 0).collect()}
    rows = H.read_map(spark, folder).collect()
    assert {r.version for r in rows} == {1} and {r.virtual_slot for r in rows} == set(old)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r.bytes
    assert len(load) == 9 and max(load.values()) < 1.05 * sum(load.values()) / 9
    moved = sum(r.bytes for r in rows if old[r.virtual_slot] != r["shard"])
    assert moved < 1.3 * sum(load.values()) / 9
    H.write_map(H.rebalanced(sizes, H.read_map(spark, folder), 7), folder)
    assert {r["shard"] for r in H.read_map(spark, folder).collect()} == set(range(7))
