"""Every core query against its SQL on the smallest tables, and the registry."""

import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkstone.operators import evidence as E
from inkstone.operators import topics as P
from inkstone.plans import catalog

catalog.load()
#: Queries that fit models, tested one by one below; their fits themselves are held against plain numpy in test_models.
MODELS = {"lda_topics", "lda_trace", "lda_first_generation", "lda_seed_stability", "lda_sensitivity", "lda_paired_audit"}


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 5) + 0.0)
    return str(v)


def rows(frame):
    return sorted(tuple(map(norm, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, spark, data, duck):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - MODELS))
def test_query_without_sql_has_rows(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_topic_weights_sum_to_one_and_fits_converge(spark, data):
    out = catalog.QUERIES["lda_topics"](spark, data).groupBy("doc_id").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    assert out.filter("abs(s - 1) > 1e-9 OR n <> 11").isEmpty() and out.count() > 150
    trace = [tuple(r) for r in catalog.QUERIES["lda_trace"](spark, data).orderBy("iteration").collect()]
    assert [i for i, *_ in trace] == list(range(1, len(trace) + 1)) and abs(trace[-1][1] - trace[-2][1]) < 0.1 and trace[-1][1] < trace[0][1]


def test_first_generation_lists_ten_terms_of_each_topic(spark, data):
    rows = catalog.QUERIES["lda_first_generation"](spark, data).collect()
    assert sorted((r["topic"], r["rank"]) for r in rows) == [(t, k) for t in range(7) for k in range(1, 11)]
    assert all(a["p"] >= b["p"] for a, b in zip(rows, rows[1:], strict=False) if a["topic"] == b["topic"])


def test_stability_and_sensitivity(spark, data):
    pairs = catalog.QUERIES["lda_seed_stability"](spark, data).collect()
    assert len(pairs) == 10 and len({r["medoid"] for r in pairs}) == 1
    assert all(0 < r["similarity"] < 1 and 0 <= r["jaccard"] <= 1 and -1 <= r["ari"] <= 1 and 0 <= r["l1"] <= 2 for r in pairs)
    rows = {r["variant"]: r for r in catalog.QUERIES["lda_paired_audit"](spark, data).collect()}
    assert set(rows) == {"whole_document_units", "chunks_200", "chunks_800", "uncapped_training_chunks", "alpha_0_1", "eta_0_1"} and all(r["n"] == 2 and r["min_similarity"] <= r["mean_similarity"] <= r["max_similarity"] for r in rows.values())


def test_near_duplicate_groups_equal_brute_force(spark, data):
    """Cosines of TF-IDF vectors over five-grams of padded words, on all documents, compared pair by pair."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    first: dict = {}
    for d in sorted(docs):
        first.setdefault("".join(docs[d].split()), d)
    alone = sorted(first.values())
    grams = {}
    for d in alone:
        own = Counter()
        for w in re.findall(r"\S+", docs[d].lower()):
            padded = f" {w} "
            own.update(padded[i : i + 5] for i in range(max(1, len(padded) - 4)))
        grams[d] = own
    df, cf = Counter(g for own in grams.values() for g in own), sum(grams.values(), Counter())
    top = sorted((g for g in df if df[g] >= 2), key=lambda g: (-cf[g], g))[:40_000]
    idf = {g: math.log((1 + len(alone)) / (1 + df[g])) + 1 for g in top}
    unit = {}
    for d, own in grams.items():
        v = {g: n * idf[g] for g, n in own.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[d] = {g: x / norm for g, x in v.items()}
    root = {d: d for d in alone}
    for i, a in enumerate(alone):
        for b in alone[i + 1 :]:
            small, large = sorted((unit[a], unit[b]), key=len)
            if sum(x * large.get(g, 0.0) for g, x in small.items()) >= 0.93:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = dict(catalog.QUERIES["near_duplicate_groups"](spark, data).collect())
    assert got == {d: root[first["".join(docs[d].split())]] for d in docs}


def test_unique_keywords_equal_a_plain_loop(spark, data):
    rows = [(r["topic"], r["term"], r["score"]) for r in P.exclusive_score(catalog.phi(spark, data)).collect()]
    used, want = set(), set()
    for topic in sorted({t for t, *_ in rows}):
        pool = sorted((r for r in rows if r[0] == topic), key=lambda r: (-r[2], r[1]))[:50]
        fresh = [t for _, t, _ in pool if t not in used][:10]
        used |= set(fresh)
        want |= {(topic, t) for t in fresh}
    assert {tuple(r) for r in catalog.QUERIES["topic_unique_keywords"](spark, data).collect()} == want


def test_intruders_are_rare_in_their_topic(spark, data):
    p = {(r["topic"], r["term"]): r["p"] for r in catalog.phi(spark, data).collect()}
    for r in catalog.QUERIES["intruder_tasks"](spark, data).collect():
        own = sorted(v for (t, _), v in p.items() if t == r["topic"])
        best = sorted((w for t, w in p if t == r["topic"]), key=lambda w: (-p[r["topic"], w], w))[:5]
        options = r["options"].split(",")
        assert sorted(options) == sorted([*best, r["intruder"]]) and p.get((r["topic"], r["intruder"]), 0.0) < float(np.median(own))


def test_digests_hold_what_they_are_made_of(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scored = {r["doc_id"]: r for r in E.scores(docs, catalog.LEXICON, catalog.RULES).collect()}
    shown, tops = {}, {}
    for r in E.excerpts(docs, catalog.LEXICON, catalog.RULES).filter("rank <= 5").orderBy("rank").collect():
        shown.setdefault(r["doc_id"], []).append(f"- {r['rank']}. {r['excerpt']}")
    for r in E.top_terms(docs, catalog.LEXICON).filter("rank <= 5").orderBy("rank").collect():
        tops.setdefault(r["doc_id"], {}).setdefault(r["category"], []).append(f"{r['term']}={r['n']}")
    for r in catalog.QUERIES["evidence_digests"](spark, data).collect():
        s, own = scored[r["doc_id"]], tops.get(r["doc_id"], {})
        head = f"document {r['doc_id']} ({s['relevance']})\n" + ", ".join(f"{c}: {s[f'n_{c}']}" for c in catalog.LEXICON)
        terms = "; ".join(f"{c}: {', '.join(own[c])}" for c in catalog.LEXICON if c in own)
        assert r["digest"] == "\n".join([head, terms, "\n".join(shown.get(r["doc_id"], []))])


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
