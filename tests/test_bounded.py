"""Ranks, quantiles and window counts that gather no group: against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import models as M
from inkstone.operators import relational as R


def plain_ranks(rows):
    """(group, score) -> rank: one more than the rows of a higher score; null is the lowest."""
    key = lambda s: float("-inf") if s is None else s
    return {(g, s): 1 + sum(key(t) > key(s) for h, t, _ in rows if h == g) for g, s, _ in rows}


@pytest.mark.parametrize("seed", range(4))
def test_competition_rank_with_large_groups_and_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 2, 2, 2, 2, 2, 3, rng.randint(4, 60)]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, s int, k int").repartition(7)
    want = plain_ranks(rows)
    got = R.competition_rank(df, "s", by=["g"]).collect()
    assert sorted((r["g"] or "", -1 if r["s"] is None else r["s"], r["k"]) for r in got) == sorted((g or "", -1 if s is None else s, k) for g, s, k in rows)
    assert all(r["rank"] == want[r["g"], r["s"]] for r in got)
    whole = plain_ranks([(0, s, k) for _, s, k in rows])
    assert all(r["place"] == whole[0, r["s"]] for r in R.competition_rank(df, "s", "place").collect())


def test_a_rank_task_holds_no_whole_group(spark, monkeypatch):
    """One group, one score: its rows lie in all ranges alike."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.lit(1).alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = R.competition_rank(df, "s", by=["g"])
        seen = []
        monkeypatch.setattr(R, "written", lambda rows, name: seen.append(rows) or rows.checkpoint())
        assert R.competition_rank(df, "s", by=["g"]).count() == 40_000 and out.count() == 40_000
        sizes = [r["count"] for r in seen[0].groupBy("__p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    assert R.competition_rank(df, "s", by=["g"]).agg(F.min("rank"), F.max("rank"), F.count("*")).first() == (1, 1, 40_000)
    assert R.competition_rank(df.limit(0), "s", by=["g"]).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.025, 0.5, 0.77, 1.0])
def test_exact_quantiles(spark, q, monkeypatch):
    monkeypatch.setattr(R, "FEW_VALUES", 16)  # so that rounds are needed
    rng = np.random.default_rng(4)
    samples = [rng.normal(size=30_000), np.r_[np.arange(5000.0), np.full(60_000, 1e6)], np.repeat([3.0, 4.0], 20_000), np.r_[rng.random(9000), np.full(9000, 0.5), 1e300, -1e300], np.array([7.0])]
    for x in samples:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert R.exact_quantile(df, "x", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12)
    assert R.exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", q) is None


def plain_windows(docs, terms, window):
    single, joint, total = {}, {}, 0
    for words in docs:
        if not words:
            continue
        for s in range(max(1, len(words) - window + 1)):
            total += 1
            own = sorted(set(words[s : s + window]) & set(terms))
            for i, a in enumerate(own):
                single[a] = single.get(a, 0) + 1
                for b in own[i + 1 :]:
                    joint[a, b] = joint.get((a, b), 0) + 1
    return single, joint, total


@pytest.mark.parametrize("window", [1, 3, 10, 110])
def test_swept_windows_equal_each_window(spark, window, monkeypatch):
    monkeypatch.setattr(M, "SWEPT", 7)
    rng = random.Random(window)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 60, 300]))] for _ in range(25)]
    rows = [(d, k, len(w), t) for d, w in enumerate(docs) for k, t in enumerate(w)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, n long, token string")
    assert M.window_counts(tokens, list("abcd"), window) == plain_windows(docs, "abcd", window)


def test_documents_of_a_block_travel_in_few_bytes():
    import numpy as np

    from inkstone.operators import similarity as S

    rng = np.random.default_rng(5)
    size = rng.integers(1, 400, 60)
    place = np.concatenate([np.sort(rng.choice(40_000, n, replace=False)) + 1 for n in size]).astype(np.int32)
    given = rng.integers(-5, 1 << 40, 60), rng.integers(0, 1 << 62, 60), size, place, rng.integers(1, 3, len(place)).astype(np.int32)
    data = S.packed(*given)
    assert all(np.array_equal(x, y) for x, y in zip(given, S.unpacked(data, 60, len(place)), strict=True))
    assert len(data) < len(place) * 8 / 3
    one = S.packed(*(np.zeros(n, np.int64) for n in (1, 1, 1, 0, 0)))
    assert [len(x) for x in S.unpacked(one, 1, 0)] == [1, 1, 1, 0, 0]


def test_candidates_are_verified_from_counts(spark):
    from inkstone.operators import similarity as S

    vectors = spark.createDataFrame([(1, [1, 3], [2, 1]), (2, [1, 3], [4, 2]), (3, [2, 3], [1, 1])], "doc_id long, places array<int>, tfs array<int>")
    top = spark.createDataFrame([(1, 2.0), (2, 1.5), (3, 1.0)], "place int, idf double")
    candidates = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r["similarity"] for r in S._verified(candidates, vectors, top, 0.1).collect()}
    assert abs(got[1, 2] - 1) < 1e-12 and abs(got[1, 3] - 1 / (17 * 3.25) ** 0.5) < 1e-12
