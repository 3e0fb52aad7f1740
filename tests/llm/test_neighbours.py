import math

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import neighbours as X


def brute(rows, queries, k=20):
    out = {}
    for q, v in rows.items():
        if q in queries:
            scored = sorted((-math.fsum(float(a) * float(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in e.collect()}
    got = found(X.nearest(e, F.col("vec_id") % 20 == 0))
    want = brute(rows, {i for i in rows if i % 20 == 0})
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in near}
        exact = {i: math.fsum(float(a) * float(b) for a, b in zip(rows[q], rows[i], strict=True)) for i, _ in near}
        assert all(s == exact[i] for i, s in near)


def test_inner_product_not_cosine_and_many_equal_vectors(spark):
    rng = np.random.default_rng(7)
    rows = {i: (rng.normal(size=8) * rng.uniform(0.1, 9)).tolist() for i in range(300)}
    rows |= {1000 + i: rows[3] for i in range(400)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got, want = found(X.nearest(df, F.col("vec_id") % 100 == 0)), brute(rows, {i for i in rows if i % 100 == 0})
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert got[1000] == want[1000]  # ties to smaller ids


def test_unusable_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 0.0], "x"), (2, None, "x"), (3, [nan, 1.0], "x"), (4, [1.0, inf], "x"), (5, [1.0, None], "x"), (6, [2.0, 1.0], "x"), (7, [1.0, 1.0, 1.0], "x"), (None, [1.0, 1.0], "x"), (20, [1.0, 0.0], "x"), (20, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string")
    got = found(X.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(6, 2.0), (20, 1.0)], 20: [(6, 2.0), (0, 1.0)]}
    assert X.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_ranges_are_shared_prefixes():
    x = np.random.default_rng(1).normal(size=(200, 6))
    s = X.Settings(trees=2, bits=16)
    f = X.Forest(x, s)
    low, high = f.ranges(x[:5])
    asked = f._codes(X.turned(x[:5]))
    for t in range(2):
        for i in range(5):
            for depth in range(len(low)):
                shift = np.uint64(64 - depth)
                same = sum(int(c >> shift == asked[t, i] >> shift) for c in f.codes[t]) if depth else 200
                assert high[depth, t, i] - low[depth, t, i] == same


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(3)
    for size in (1e160, 1e-160, 1e300):
        rows = {i: (rng.normal(size=6) * size).tolist() for i in range(60)}
        df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
        got = found(X.nearest(df, F.col("vec_id") % 20 == 0))
        assert set(got) == {0, 20, 40} and all(len(v) == 20 for v in got.values())
    assert X.inner(np.array([1e200, 1e200]), np.array([1e200, -1e200])) == 0.0 and X.inner(np.array([1e200]), np.array([-1e200])) == -math.inf


def clustered(n, centres, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16)) * 5
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, 16)) * 0.3
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_keep_the_recall_and_spare_most_blocks(spark):
    s = X.Settings(block_rows=1024, sample_queries=60)
    x = clustered(12000, 300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    keyed = X.usable(df)
    plan = X.plans(keyed, keyed, s)[16]
    assert plan.bits > 0
    sent = X.dealt(keyed, {16: plan}, s, False)
    assert sent.count() == 12000 * plan.trees
    sizes = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
    visits = [-(-sizes.get(r["cell"], 0) // 1024) for r in X.dealt(keyed, {16: plan}, s, True).collect()]
    assert sum(visits) < 0.6 * 12000 * 12  # without cells, each query visits each of 12 blocks
    got = found(X.nearest(df, F.lit(True), s))
    hits = 0
    for q in range(0, 12000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
        assert len(got[q]) == 20 and len({i for i, _ in got[q]}) == 20
    assert hits >= 0.9 * 600 * 20


def test_recall_over_several_blocks(spark):
    """Vectors in random directions: the share of candidates is measured at the blocks' size."""
    x = np.random.default_rng(6).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(X.nearest(df, F.col("vec_id") % 100 == 0, X.Settings(block_rows=1024, chunk_queries=11)))
    hits = 0
    for q in range(0, 3000, 100):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 30 * 20


def test_an_id_is_one_vector(spark):
    """Of an id with several vectors the smallest stands for it, as query and as neighbour."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (2, [5.0, 5.0]), (3, [0.2, 0.7]), (3, [0.2, 0.7]), (4, [9.0]), (4, [7.0, 7.0])]
    out = X.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 2, 0.9), (2, 3, 0.7), (3, 1, 0.1)]


def test_the_search_is_dealt_over_tasks(spark):
    """Few bytes, but much work: adaptive execution joins no blocks into one task. One product with a block's rows finds what
    gathered candidates find."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = X.nearest(df, F.col("vec_id") % 100 == 0, X.Settings(block_rows=1024, k=5))
    assert out._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") == 1
    s = X.Settings(k=5)
    f, asked = X.Forest(x, s), x[::500]
    ids, own = np.arange(len(x)), np.arange(0, 5000, 500)
    dense = f.search(asked, ids, own, 0.6)
    X.DENSE, was = 99.0, X.DENSE
    try:
        assert f.search(asked, ids, own, 0.6) == dense
    finally:
        X.DENSE = was
