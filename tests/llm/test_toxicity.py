import itertools
import re
import zlib

import numpy as np

from inkstone.llm import toxicity as X


def test_both_forward_backwards_equal_enumeration():
    f = X.Field(X.Settings(hash_bits=6))
    rng = np.random.default_rng(1)
    f.emit[1:] = rng.normal(size=len(f.emit) - 1)
    f.move, f.first = rng.normal(size=(2, 2)), 0.3
    lines = [["ab", "cd", "efghij", "kl"], ["one"], ["x", "yy"]]
    got, at = f.posterior(lines), 0
    for words in lines:
        u = [f.score(w) for w in words]
        weight = {}
        for tags in itertools.product((0, 1), repeat=len(words)):
            s = f.first * tags[0] + sum(x * t for x, t in zip(u, tags, strict=True)) + sum(f.move[a, b] for a, b in itertools.pairwise(tags))
            weight[tags] = np.exp(s)
        z = sum(weight.values())
        want = [sum(w for tags, w in weight.items() if tags[i]) / z for i in range(len(words))]
        assert np.allclose(got[at : at + len(words)], want)
        p, pair, logz = f.marginals(np.array([u]), np.array([len(words)]))
        assert np.allclose(p[0], want) and np.isclose(logz[0], np.log(z))
        for a, b in itertools.product((0, 1), repeat=2):
            due = sum(w * sum((x, y) == (a, b) for x, y in itertools.pairwise(tags)) for tags, w in weight.items()) / z
            assert np.isclose(pair[0, a, b], due)
        at += len(words)


def test_held_out_accuracy_and_spans(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    field = X.trained(X.sample(docs, labels.filter(~labels.doc_id.isin(list(held)))))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in X.scored(docs, field).collect() if r["doc_id"] in held]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in rows)
    assert right >= 0.92 * len(rows)
    score, spans = field.judged(["such a stupid idiot and a clown he is"])[0]
    assert score > 0.5 and (7, 19) in spans


def test_long_lines_and_unusual_case():
    field = X.Field(X.Settings())
    assert field.judged(["İ" * 10 + " word", None, ""]) == [(0.0, []), (0.0, []), (0.0, [])]
    assert len(field.posterior(X.lines_of("w " * 1000))) == 1000
    field.emit[field.features("bad")[0]], field.ready = 9.0, True
    field.first, field.move = -2.0, np.array([[2.0, -2.0], [2.0, -2.0]])
    assert field.judged(["İİ good bad"])[0][1] == [(8, 11)]


def plain_marginals(field, words):
    """Forward-backward in logarithms, word by word."""
    add = np.logaddexp
    u, m = [field.score(w) for w in words], field.move
    f = [(0.0, field.first + u[0])]
    for x in u[1:]:
        f.append((add(f[-1][0] + m[0, 0], f[-1][1] + m[1, 0]), add(f[-1][0] + m[0, 1], f[-1][1] + m[1, 1]) + x))
    b = [(0.0, 0.0)]
    for x in reversed(u[1:]):
        b.append(tuple(add(m[i, 0] + b[-1][0], m[i, 1] + x + b[-1][1]) for i in (0, 1)))
    z = add(*f[-1])
    return [float(np.exp(x[1] + y[1] - z)) for x, y in zip(f, reversed(b), strict=True)]


def test_a_line_is_one_chain_however_long():
    f = X.Field(X.Settings(hash_bits=8))
    rng = np.random.default_rng(4)
    f.emit[1:], f.move, f.first = rng.normal(size=len(f.emit) - 1), rng.normal(size=(2, 2)), -0.4
    lines = [["".join(rng.choice(list("abcdef"), 4)) for _ in range(n)] for n in (3, 63, 64, 65, 700, 2048, 2049, 5003)]
    got, at = f.posterior(lines), 0
    for words in lines:
        assert np.allclose(got[at : at + len(words)], plain_marginals(f, words), atol=1e-9)
        at += len(words)


def test_scores_and_spans_equal_plain_forward_backward(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    field = X.trained(X.sample(docs, labels))
    got = {r["doc_id"]: r for r in X.scored(docs, field).collect()}
    a, b, c = field.calibration
    for r in docs.collect():
        text, p, spans = r["text"] or "", [], []
        for line in re.finditer(r"[^\n]+", text):
            words = [(line.start() + m.start(), line.start() + m.end()) for m in re.finditer(r"[^\W\d_]+", line[0])]
            near = plain_marginals(field, [text[i:j].lower() for i, j in words]) if words else []
            p += zip(near, words, strict=True)
        for k, (q, (i, j)) in enumerate(p):
            if q >= 0.5:
                spans = [*spans[:-1], (spans[-1][0], j)] if k and p[k - 1][0] >= 0.5 else [*spans, (i, j)]
        x = a + b * max((q for q, _ in p), default=0.0) + c * np.log1p(sum(q for q, _ in p))
        own = got[r["doc_id"]]
        assert np.isclose(own["score"], 1 / (1 + np.exp(-x)), atol=1e-9) and [tuple(s) for s in own["spans"]] == spans
    assert sum(r["predicted"] for r in got.values()) > 0


def test_sample_takes_one_text_of_an_id_that_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other"), (3, "x" * 70000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    assert X.sample(docs, labels, X.Settings(toxic_texts=1, other_texts=2)) == [("other", False), ("text 0", True)]


def test_odd_and_empty_tables(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    field = X.trained(X.sample(odd_docs, labels))
    rows = X.scored(odd_docs, field).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert X.scored(no_docs, X.trained([])).count() == 0 and X.sample(no_docs, labels) == []
