import itertools
import random

import corpus_pipeline
from inkstone.llm import shingles as X
from tests.llm.conftest import extras_kept


def jaccard(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def brute(texts):
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if r == i}


def copies():
    r, out = random.Random(6), []
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        for changed in (0, 0.004, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(f"x{r.randrange(5000)}" if r.random() < changed else w for w in words))
    return out


def test_stage_equals_brute_force(spark, data):
    texts = copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    assert len(want) < len(texts) / 2
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect()} == want
    assert {r["doc_id"] for r in X.keep_first(docs, block=2).collect()} == want


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    kept = X.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and extras_kept(kept) and kept.filter("coalesce(trim(replace(replace(text, '\n', ''), '\t', '')), '') = ''").count() == 1
    assert kept.filter("text = 'one'").count() == 1 and kept.filter("doc_id IS NULL").count() == 1
    assert X.keep_first(no_docs).count() == 0


def test_a_chain_of_copies_and_unlike_texts_in_one_band_group(spark, data):
    """Links that lead from text to text, beyond the similarity of the hub, and passages that unlike texts share."""
    r = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    texts = []
    for step in range(12):
        texts.append(" ".join(words))
        at = 15 * step
        words = [*words[:at], *(f"n{step}x{k}" for k in range(6)), *words[at + 6 :]]
    shared = " ".join(f"s{k}" for k in range(120))
    texts += [shared + " " + " ".join(f"v{r.randrange(9999)}" for _ in range(n)) for n in (30, 31, 32, 33, 34, 20, 21, 22)]
    want = brute(texts)
    assert 1 < len(want) < len(texts)
    for block in (2, 512):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {x["doc_id"] for x in X.keep_first(docs, block=block).collect()} == want
