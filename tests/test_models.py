"""Topic models against plain numpy, and what is built on them."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import models as M
from inkstone.operators import topics as P
from inkstone.operators.relational import IntegrityError


def corpus(units=30, terms=40, topics=3, seed=1):
    rng = np.random.default_rng(seed)
    phi = rng.dirichlet(np.full(terms, 0.1), topics)
    counts = np.array([rng.multinomial(60, rng.dirichlet(np.full(topics, 0.2)) @ phi) for _ in range(units)], float)
    return counts[:, counts.sum(axis=0) > 0]


def frame(spark, counts):
    rows = [(i // 2, i % 2, [int(t) for t in np.flatnonzero(c)], [float(x) for x in c[c > 0]]) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "doc_id long, unit int, terms array<int>, counts array<double>")


def psi(x):
    h = 1e-5
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def plain_fit(counts, s, updates):
    """Batch variational Bayes, unit by unit and term by term."""
    k, v = s.k, counts.shape[1]
    expect = lambda row: np.array([psi(x) for x in row]) - psi(float(sum(row)))
    lam = np.random.default_rng(s.seed).gamma(100.0, 0.01, (k, v))
    alpha = np.full(k, 1 / k)
    bounds = []
    for _ in range(updates + 1):
        beta = np.exp([expect(row) for row in lam])
        new, bound = np.full((k, v), s.eta), 0.0
        for c in counts:
            gamma = np.ones(k)
            theta = np.exp(expect(gamma))
            for _ in range(s.inner):
                last = gamma
                norm = theta @ beta
                gamma = alpha + theta * (beta @ (c / norm))
                theta = np.exp(expect(gamma))
                if np.abs(gamma - last).mean() < s.change:
                    break
            norm = theta @ beta
            new += theta[:, None] * (c / norm) * beta
            log = expect(gamma)
            bound += float(c @ np.log(norm)) + sum((a - g) * x + math.lgamma(g) - math.lgamma(a) for a, g, x in zip(alpha, gamma, log, strict=True)) + math.lgamma(alpha.sum()) - math.lgamma(gamma.sum())
        for row in lam:
            log = expect(row)
            bound += sum((s.eta - x) * y + math.lgamma(x) - math.lgamma(s.eta) for x, y in zip(row, log, strict=True)) + math.lgamma(v * s.eta) - math.lgamma(row.sum())
        bounds.append(bound)
        last_lam, lam = lam, new
    return last_lam, bounds[1:]


def test_special_functions():
    x = np.array([1e-3, 0.01, 0.4, 1.0, 2.5, 7.0, 300.0])
    assert np.allclose(M.digamma(x)[2:], [psi(v) for v in x[2:]], atol=1e-6)
    assert np.isclose(M.digamma(np.array([1.0]))[0], -0.5772156649015329) and np.isclose(M.digamma(np.array([0.01]))[0], -100.56088545786867)
    assert np.allclose(M.gammaln(x), [math.lgamma(v) for v in x])
    assert np.isclose(M.trigamma(np.array([1.0]))[0], math.pi**2 / 6) and np.isclose(M.trigamma(np.array([0.5]))[0], math.pi**2 / 2)


def test_exp_digamma_is_one_expression():
    x = np.array([1e-3, 0.05, 0.4, 1.0, 2.5, 5.999, 6.0, 7.0, 300.0, 1e9])
    assert np.allclose(M.exp_digamma(x)[1:], np.exp(M.digamma(x))[1:], rtol=1e-12) and M.exp_digamma(x)[0] == 0
    steps = M.digamma(x + 1) - M.digamma(x)
    assert np.allclose(steps, 1 / x, rtol=1e-9, atol=1e-9)


def test_fit_equals_plain_variational_bayes(spark):
    counts = corpus()
    s = M.TopicSettings(k=3, seed=5, iterations=4, tolerance=0.0, inner=40)
    rows = frame(spark, counts)
    model = M.fit(rows.repartition(3), s, counts.shape[1])
    lam, bounds = plain_fit(counts, s, 4)
    assert np.allclose(model.components, lam, rtol=1e-5)
    assert np.allclose([t["bound"] for t in model.trace], bounds, rtol=1e-7) and [t["iteration"] for t in model.trace] == [1, 2, 3, 4]
    assert np.allclose([t["perplexity"] for t in model.trace], np.exp(-np.array(bounds) / counts.sum()), rtol=1e-6)


def test_bound_rises_and_fits_end(spark):
    counts = corpus(60)
    rows = frame(spark, counts)
    both = M.fit_all(rows, [M.TopicSettings(k=3, seed=1), M.TopicSettings(k=4, seed=2, iterations=7, tolerance=0.0)], counts.shape[1])
    bounds = [t["bound"] for t in both[0].trace]
    assert all(b >= a - 1e-3 * abs(a) * 1e-3 for a, b in itertools.pairwise(bounds)) and both[0].converged
    assert both[1].iterations == 7 and not both[1].converged
    alone = M.fit(rows, M.TopicSettings(k=3, seed=1), counts.shape[1])
    assert np.allclose(alone.components, both[0].components)
    theta = M.infer(both[0], rows)
    assert theta.groupBy("doc_id", "unit").agg(F.sum("w").alias("s"), F.count("*").alias("n")).filter("abs(s - 1) > 1e-9 OR n <> 3").isEmpty()
    assert np.allclose(M.phi_matrix(both[1]).sum(axis=1), 1)


def test_weights_in_blocks_equal_those_unit_by_unit(monkeypatch):
    rng = np.random.default_rng(3)
    many = rng.permutation([1, 1, 2, 3, 5, 8, 13, 40, 40, 41, 60, 200])
    terms = np.concatenate([np.sort(rng.choice(300, n, replace=False)) for n in many])
    counts, starts = rng.integers(1, 9, len(terms)).astype(float), np.cumsum(many) - many
    m = M._sent(M.initial(M.TopicSettings(k=4, seed=2, inner=90), 300))
    expect = lambda g: np.exp(M.digamma(g) - M.digamma(g.sum()))
    parts = []
    for s, n in zip(starts, many, strict=True):
        gamma, words, c = np.ones(4), m.exp_topics[terms[s : s + n]], counts[s : s + n]
        for _ in range(m.inner):
            last, theta = gamma, expect(gamma)
            gamma = m.alpha + theta * ((c / (words @ theta)) @ words)
            if np.abs(gamma - last).mean() < m.change:
                break
        parts.append((gamma, expect(gamma), words @ expect(gamma)))
    largest = []
    product = M.exp_digamma
    monkeypatch.setattr(M, "exp_digamma", lambda x: largest.append(len(x)) or product(x))
    for block in (1, 64, 1 << 15):
        monkeypatch.setattr(M, "BLOCK", block)
        got = M.unit_weights(m, terms, counts, starts)
        assert np.allclose(got[0], [p[0] for p in parts], rtol=1e-6) and np.allclose(got[1], [p[1] for p in parts], rtol=1e-6)
        assert np.allclose(got[2], np.concatenate([p[2] for p in parts]), rtol=1e-6)
        assert block > 1 or max(largest) == 1


def test_first_generation_learns_its_prior(spark):
    counts = corpus(40)
    s = M.TopicSettings(k=3, seed=1, iterations=6, tolerance=0.0, alpha="asymmetric", learn_alpha=True, learn_eta=True)
    model = M.fit(frame(spark, counts), s, counts.shape[1])
    assert (model.alpha > 0).all() and model.eta > 0 and model.eta != s.eta and len(set(model.alpha.round(6))) == 3
    prior, n = np.array([0.3, 0.7]), 50.0
    logs = n * (M.digamma(np.array([0.9, 1.6])) - M.digamma(np.array([2.5])))
    for _ in range(60):
        prior = M._newton(prior, n, logs)
    assert np.allclose(prior, [0.9, 1.6], atol=1e-6)


def test_units_without_terms_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, [0, 1], [2.0, 1.0]), (2, 0, [], [])], "doc_id long, unit int, terms array<int>, counts array<double>")
    model = M.fit(rows, M.TopicSettings(k=2, iterations=2), 2)
    got = {(r["doc_id"], r["topic"]): (r["n"], r["w"]) for r in M.infer(model, rows).collect()}
    assert got[2, 0] == got[2, 1] == (0.0, 0.5) and got[1, 0][0] == 3.0
    assert M.fit(rows.limit(0), M.TopicSettings(k=2), 2).trace == []


def test_models_are_saved_whole(spark, tmp_path):
    counts = corpus()
    rows = frame(spark, counts)
    made = []

    def make():
        made.append(1)
        return M.fit(rows, M.TopicSettings(k=2, iterations=2), counts.shape[1])

    a, b = (M.save_or_load(spark, f"{tmp_path}/m", make) for _ in range(2))
    assert len(made) == 1 and np.allclose(a.components, b.components) and a.trace == b.trace and a.settings == b.settings
    for f in (tmp_path / "m").glob("part-*"):
        f.write_bytes(b"broken")
    assert np.allclose(M.save_or_load(spark, f"{tmp_path}/m", make).components, a.components) and len(made) == 2

    def fails():
        raise IntegrityError("no data")

    with pytest.raises(IntegrityError):
        M.save_or_load(spark, f"{tmp_path}/other", fails)
    assert not (tmp_path / "other").exists()


def rand_index(x, y):
    pairs = list(itertools.combinations(range(len(x)), 2))
    both = sum(x[i] == x[j] and y[i] == y[j] for i, j in pairs)
    a, b = sum(x[i] == x[j] for i, j in pairs), sum(y[i] == y[j] for i, j in pairs)
    due = a * b / len(pairs)
    return (both - due) / ((a + b) / 2 - due)


def test_seed_stability_equals_plain_counting(spark):
    rng = np.random.default_rng(3)
    phis = {s: rng.dirichlet(np.ones(20), 3) for s in (7, 9, 11)}
    thetas = {s: rng.dirichlet(np.ones(3), 25) for s in phis}
    rows = [(s, d, t, float(w)) for s, m in thetas.items() for d, row in enumerate(m) for t, w in enumerate(row)]
    got, medoid = M.seed_stability(phis, spark.createDataFrame(rows, "seed int, doc_id long, topic int, w double"), 5)
    total = dict.fromkeys(phis, 0.0)
    for r in got:
        cost = M.js_matrix(phis[r["seed_a"]], phis[r["seed_b"]])
        to = min(itertools.permutations(range(3)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
        a, b = thetas[r["seed_a"]], thetas[r["seed_b"]]
        assert np.isclose(r["similarity"], np.mean([1 - cost[i, j] for i, j in enumerate(to)]))
        assert np.isclose(r["l1"], np.abs(a - b[:, list(to)]).sum(axis=1).mean())
        assert np.isclose(r["ari"], rand_index(a.argmax(1).tolist(), b.argmax(1).tolist()))
        total[r["seed_a"]] += r["similarity"]
        total[r["seed_b"]] += r["similarity"]
    assert len(got) == 3 and medoid == max(phis, key=lambda s: total[s])


def test_sensitivity_and_paired_audit(spark):
    counts = corpus(40)
    rows, v = frame(spark, counts), counts.shape[1]
    base = M.fit(rows, M.TopicSettings(k=3, seed=1, iterations=10), v)
    theta = P.token_weighted(M.infer(base, rows))
    same = [M.Variant("same", rows, rows), M.Variant("eta", rows, rows, {"eta": 0.5})]
    runs, phis = M.sensitivity(base, theta, same, [1, 2], v)
    first = next(r for r in runs if r["variant"] == "same" and r["seed"] == 1)
    assert np.isclose(first["similarity"], 1) and first["l1"] < 1e-6 and first["largest_shift"] < 1e-6 and len(runs) == 4
    pairs, summary = M.paired_audit({1: M.phi_matrix(base)}, phis)
    assert [p["variant"] for p in pairs] == ["same", "eta"] and pairs[0]["largest"] < 1e-9 and summary[0]["n"] == 1 and summary[1]["mean_similarity"] < 1
    with pytest.raises(IntegrityError):
        M.paired_audit({1: M.phi_matrix(base)[:2]}, phis)


def test_variants_of_the_same_units_share_their_passes(spark):
    counts = corpus(20)
    rows, v = frame(spark, counts), counts.shape[1]
    other = rows.repartition(2)
    base = M.fit(rows, M.TopicSettings(k=3, seed=1, iterations=3), v)
    asked = []

    def fits(units, settings, terms):
        asked.append((units is rows, [(s.alpha, s.eta, s.seed) for s in settings]))
        return M.fit_all(units, settings, terms)

    variants = [M.Variant("alpha", rows, rows, {"alpha": 0.1}), M.Variant("whole", other, other), M.Variant("eta", rows, rows, {"eta": 0.1})]
    runs, phis = M.sensitivity(base, None, variants, [1, 2], v, fits)
    assert sorted(asked, key=str) == [(False, [(None, 0.01, 1), (None, 0.01, 2)]), (True, [(0.1, 0.01, 1), (0.1, 0.01, 2), (None, 0.1, 1), (None, 0.1, 2)])]
    assert [(r["variant"], r["seed"]) for r in runs] == [(n, s) for n in ("alpha", "whole", "eta") for s in (1, 2)]
    alone = M.fit(rows, M.TopicSettings(k=3, seed=2, iterations=3, eta=0.1), v)
    assert np.allclose(phis["eta", 2], M.phi_matrix(alone), rtol=1e-9)


def test_completion_equals_plain_scores(spark):
    counts = corpus(20)
    rng = np.random.default_rng(2)
    seen = rng.binomial(counts.astype(int), 0.5).astype(float)
    model = M.fit(frame(spark, counts), M.TopicSettings(k=3, seed=1, iterations=5), counts.shape[1])
    rows = [(i // 2, i % 2, np.flatnonzero(c).tolist(), o[c > 0].tolist(), (c - o)[c > 0].tolist()) for i, (c, o) in enumerate(zip(counts, seen, strict=True))]
    uni = counts.sum(axis=0) / counts.sum()
    got = {r["doc_id"]: r for r in M.completion([model], uni, spark.createDataFrame(rows, "doc_id long, unit int, terms array<int>, observed array<double>, target array<double>")).collect()}
    theta = {(r["doc_id"], r["unit"], r["topic"]): r["w"] for r in M.infer(model, spark.createDataFrame([r[:4] for r in rows], "doc_id long, unit int, terms array<int>, counts array<double>")).collect()}
    phi = M.phi_matrix(model)
    for d in range(10):
        ll = ul = n = 0.0
        for u in (0, 1):
            target = counts[2 * d + u] - seen[2 * d + u]
            p = sum(theta[d, u, t] * phi[t] for t in range(3))
            ll, ul, n = ll + target @ np.log(p), ul + target @ np.log(uni), n + target.sum()
        assert np.allclose([got[d]["loglik"], got[d]["unigram"], got[d]["tokens"]], [ll, ul, n])


def test_matching_of_many_topics_is_the_best():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (3, 3), (4, 6), (7, 7)):
        cost = rng.random((n, m)).round(1)
        got = P.matched(cost)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and np.isclose(sum(cost[i, j] for i, j in enumerate(got)), best)
    assert sorted(P.matched(rng.random((60, 60)))) == list(range(60)) and P.matched(np.zeros((0, 0))) == []


def test_bootstrap_equals_plain_resampling(spark):
    rng = np.random.default_rng(4)
    w = rng.dirichlet(np.ones(3), 40)
    theta = spark.createDataFrame([(d, t, float(x)) for d, row in enumerate(w) for t, x in enumerate(row)], "doc_id long, topic int, w double")
    ids = np.array([r["h"] for r in theta.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("doc_id").collect()], np.int64)
    copies = P.poisson_copies(ids, 300, 42)
    assert abs(copies.mean() - 1) < 0.05 and abs(copies.var() - 1) < 0.1
    means = (copies @ w) / copies.sum(axis=1, keepdims=True)
    got = {r["topic"]: (r["low"], r["high"]) for r in P.bootstrap_interval(theta.repartition(3), 300).collect()}
    for t in range(3):
        assert np.allclose(got[t], np.quantile(means[:, t], [0.025, 0.975]))
        assert got[t][0] < w[:, t].mean() < got[t][1]


def test_halves_are_not_empty(spark):
    rows = spark.createDataFrame([(1, "a", 40), (1, "b", 30), (2, "c", 1)], "doc_id long, term string, n long")
    halves = P.thinned(rows, ["doc_id", "term"])
    assert halves.filter("observed + target <> n OR observed < 0 OR target < 0").isEmpty()
    with pytest.raises(IntegrityError):
        P.require_halves(halves, ["doc_id"])
    P.require_halves(halves.filter("doc_id = 1"), ["doc_id"])


def test_coherence_equals_plain_windows(spark):
    rng = np.random.default_rng(12)
    texts = [list(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 25, 30)]
    rows = [(d, len(t), i, w, t[i + 1] if i + 1 < len(t) else None) for d, t in enumerate(texts) for i, w in enumerate(t)]
    tokens = spark.createDataFrame(rows, "doc_id long, n int, pos int, token string, next string")
    lists, window, eps = [["a", "b", "c"], ["d", "e", "zz"]], 6, 1e-12
    sets = [set(t[i : i + window]) for t in texts if t for i in range(max(1, len(t) - window + 1))]
    p = lambda *ws: sum(all(w in s for w in ws) for s in sets) / len(sets)

    def npmi(a, b):
        both = p(a, b)
        return np.log((both + eps) / (p(a) * p(b))) / -np.log(both + eps) if p(a) and p(b) else 0.0

    v, n = M.coherence(tokens, lists, window), M.coherence(tokens, lists, window, "c_npmi")
    for words, got_v, got_n in zip(lists, v, n, strict=True):
        m = np.array([[npmi(a, b) for b in words] for a in words])
        whole = m.sum(axis=0)
        cosines = [float(r @ whole / (np.linalg.norm(r) * np.linalg.norm(whole))) if np.linalg.norm(r) else 0.0 for r in m]
        assert np.isclose(got_v, np.mean(cosines)) and np.isclose(got_n, np.mean([m[i, j] for i, j in itertools.combinations(range(3), 2)]))


def test_models_of_the_same_units_and_settings_are_fitted_once(spark, monkeypatch):
    counts = corpus(20)
    rows, v = frame(spark, counts), counts.shape[1]
    s = M.TopicSettings(k=3, seed=1, iterations=2)
    base, asked, whole = M.fit(rows, s, v), [], M.fit_all
    monkeypatch.setattr(M, "fit_all", lambda units, settings, terms: asked.append((units is rows, list(settings))) or whole(units, settings, terms))
    memo, other = M.FitMemo(rows, [base]), M.TopicSettings(k=3, seed=2, iterations=2)
    first = memo.fit_all(rows, [other, s, other], v)
    assert first[1] is base and first[0] is first[2] and first[0].settings == other
    again = memo.fit_all(rows.repartition(2), [s], v)[0]
    assert again is not base and np.allclose(again.components, base.components)
    assert asked == [(True, [other]), (False, [s])]


def test_slow_units_of_many_blocks_share_their_calls(monkeypatch):
    rng = np.random.default_rng(4)
    many = rng.integers(3, 30, 600)
    terms = np.concatenate([np.sort(rng.choice(300, n, replace=False)) for n in many])
    counts, starts = rng.integers(1, 9, len(terms)).astype(float), np.cumsum(many) - many
    m = M._sent(M.initial(M.TopicSettings(k=4, seed=2, inner=250), 300))
    m.exp_topics[:] = rng.dirichlet(np.full(300, 0.05), 4).T + 1e-9
    calls, product = [], M.exp_digamma
    monkeypatch.setattr(M, "exp_digamma", lambda x: calls.append(len(x)) or product(x))
    monkeypatch.setattr(M, "BLOCK", 512)
    monkeypatch.setattr(M, "ROUNDS", ())
    alone = M.unit_weights(m, terms, counts, starts)
    before = len(calls)
    for rounds in ((1, 2, 3), (8, 20, 60)):
        monkeypatch.setattr(M, "ROUNDS", rounds)
        calls.clear()
        for x, y in zip(alone, M.unit_weights(m, terms, counts, starts), strict=True):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-12)
    assert len(calls) < 0.8 * before


def test_units_are_dealt_evenly(spark):
    rows = M.evened(spark.range(0, 10_000, 1, 1).withColumn("terms", F.array(F.lit(1))))
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == M.PARTS * spark.sparkContext.defaultParallelism and max(sizes) <= 1.1 * min(sizes)
