from collections import Counter

import pytest

import corpus_pipeline as C
from pyspark.sql import functions as F
from hustings.llm import decontamination, simhash_dedup, sharding, source_mixing, toxicity


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in C.STAGES:
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    for out in seen[1:-1]:
        assert out.columns == columns
    raw, mild, single, clean, mixed, sharded = seen
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    before, after = {r.doc_id for r in raw.collect()}, {r.doc_id for r in mild.collect()}
    assert len(toxic & after) <= 0.05 * len(toxic) and len(before - after - toxic) <= 0.1 * len(before)
    groups = simhash_dedup.near_copy_groups(mild).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups}
    assert single.count() < mild.count()
    leaked = {r.doc_id for r in decontamination.leaks(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert leaked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    took = {r.doc_id: (r.size, r.taken) for r in source_mixing.mix(clean).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[d] == -(-n // s) if s else copies[d] == 0 for d, (s, n) in took.items())
    assert sharded.count() == mixed.count() and {r["shard"] for r in sharded.collect()} == set(range(16))


@pytest.mark.parametrize("kind", ["odd_docs", "no_docs"])
def test_odd_and_empty_tables(spark, kind, request):
    docs = request.getfixturevalue(kind).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/{kind}")
    docs = spark.read.parquet(path)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.count()


def test_rows_are_judged_by_their_own_text(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1"), "doc_id").select(docs.columns).limit(40)
    leaking = docs.join(decontamination.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct(), "doc_id").select(docs.columns).limit(40)
    clean = docs.where("doc_id < 300").withColumn("doc_id", F.lit(5).cast("long"))
    for bad, stage in ((toxic, C.drop_toxic), (leaking, C.drop_benchmark)):
        kept = stage(spark, docs, sf)
        for given in (None, 5):  # no id, and the id that clean rows share
            rows = bad.withColumn("doc_id", F.lit(given).cast("long")).unionByName(clean).unionByName(docs)
            left = stage(spark, rows, sf).where(F.col("doc_id").eqNullSafe(F.lit(given))).count()
            want = kept.where("doc_id < 300").count() if given else 0
            assert want - 1 <= left <= want + 1 + 0.05 * bad.count()
