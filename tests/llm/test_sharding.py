import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import sharding as X


def test_fisher_yates_is_a_seeded_uniform_permutation():
    assert sorted(X.fisher_yates(50, (1, 2)).tolist()) == list(range(50))
    assert (X.fisher_yates(50, (1, 2)) == X.fisher_yates(50, (1, 2))).all() and (X.fisher_yates(50, (1, 2)) != X.fisher_yates(50, (1, 3))).any()
    seen = Counter(tuple(X.fisher_yates(3, (0, s)).tolist()) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def law_holds(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rows_law_and_digests(documents, texts):
    rows = X.digest_columns(X.sharded(documents, bucket_bytes=100_000)).collect()
    law_holds(rows, 8)
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    order = sorted(range(len(rows)), key=lambda k: (rows[k]["slot"], rows[k]["shard"]))
    ids = np.array([r["doc_id"] for r in rows])[order]
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.3


def test_result_does_not_depend_on_partitions(documents):
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in X.sharded(documents, bucket_bytes=100_000).collect()}
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in X.sharded(documents.repartition(7), bucket_bytes=100_000).collect()}
    assert one == other


def test_odd_and_empty_tables(odd_docs, no_docs, tmp_path, spark):
    rows = X.digest_columns(X.sharded(odd_docs, bucket_bytes=4096)).collect()
    law_holds(rows, 8)
    assert len(rows) == odd_docs.count() and {r["size"] for r in rows if r["doc_id"] == 0} == {1}
    assert X.sharded(no_docs).count() == 0
    X.write_shards(odd_docs, f"{tmp_path}/s", 3)
    assert spark.read.parquet(f"{tmp_path}/s").count() == odd_docs.count()


def test_equal_rows_spread_over_the_buckets(spark):
    rows = spark.createDataFrame([(None, "one text in very many rows")] * 20000 + [(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    dealt, n, total = X.scattered(rows, 42)
    assert (n, total) == (23000, sum(len(r["text"]) + 1 for r in rows.collect()))
    sizes = [r["count"] for r in dealt.groupBy(F.pmod("h", F.lit(51))).count().collect()]
    assert sum(sizes) == 23000 and len(sizes) == 51 and max(sizes) < 1.5 * 23000 / 51
    out = X.sharded(rows, bucket_bytes=1 << 14).collect()
    law_holds(out, 8)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(map(tuple, rows.collect()))


def test_tasks_of_many_buckets_give_the_same_sequence(spark, documents):
    copies = spark.createDataFrame([(9999, "copy")] * 2000, "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(copies)
    made = {}
    for most in (10_000, 5, 1):
        out = X.sharded(rows, bucket_bytes=20_000, most_tasks=most)
        made[most] = sorted((r["shard"], r["slot"], r["doc_id"]) for r in out.collect())
        tasks = out.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == most if most <= 5 else tasks > 20
    assert made[10_000] == made[5] == made[1]
    law_holds(X.sharded(rows, bucket_bytes=20_000, most_tasks=5).collect(), 8)


def test_a_task_holds_one_bucket_at_a_time(documents):
    """Rows that come to a task sorted by bucket are one bucket after the other, whatever batches they come in."""
    documents.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        few = sorted(map(tuple, X.sharded(documents, bucket_bytes=50_000, most_tasks=2).select("doc_id", "shard", "slot").collect()))
    finally:
        documents.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert few == sorted(map(tuple, X.sharded(documents, bucket_bytes=50_000).select("doc_id", "shard", "slot").collect()))
