"""Tokens as codes: held against the tokenizer of columns, and counts against lists."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import tokens as K
from inkstone.operators import topics as P
from inkstone.operators import vocabulary as V
from inkstone.plans import catalog

STOP = ["the", "bus"]
PIECES = [
    "The the cats", "buses bus b 9lives 9 12345 __init__ _x9 a1_b", "flies skies glass classes boxes", "Größe naïve—dash İstanbul Kelvin Kelvin", "see https://a.b/c?d=1 now",
    "www.x.org/y end", "mail me@host.org. or a@b", "doi 10.1234/abc.def rest", "10.12 10.99999999999/x", "x" * 35 + " " + "y" * 36, "one\none\tone", "", " ", "s ss sss", "cat\x0bcats\x1fdogs",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    texts = [None, "", "9_", *PIECES, *PIECES[:3], *(" ".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(150))]
    return spark.createDataFrame([(i, i % 3 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, topic int, text string").repartition(3).cache()


TOKENIZER = K.Tokenizer(STOP, lemma=T.singular)


def words_of(docs):
    """By the tokenizer of columns: (doc_id, topic) and the words."""
    rows = V.token_lists(docs, STOP, lemma=T.noun_lemma()).select("doc_id", "topic", "words").collect()
    return {(r["doc_id"], r["topic"]): r["words"] for r in rows}


@pytest.fixture(params=[(64, 16), (1 << 12, 1 << 8), (K.CHUNK, K.BLOCK)])
def small(request, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", request.param[0])
    monkeypatch.setattr(K, "BLOCK", request.param[1])


def test_lists_equal_the_tokenizer_of_columns(docs):
    assert {(r["doc_id"], r["topic"]): r["words"] for r in K.lists(docs, TOKENIZER).collect()} == words_of(docs)


def test_codes_do_not_depend_on_chunks_and_blocks(docs, small):
    want = words_of(docs.filter("text IS NOT NULL"))
    rows = docs.filter("text IS NOT NULL").select("doc_id", "topic", T.plain(F.lower("text")).alias("text")).collect()
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in rows[i : i + 40]], pa.schema([("doc_id", pa.int64()), ("topic", pa.int32()), ("text", pa.string())])) for i in range(0, len(rows), 40)]
    got = {}
    for b in K.chunks(iter(batches), 2):
        c = TOKENIZER.coded(b.column(2))
        assert sum(c.many) == len(c.code)
        for k, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            got[d, t] = [c.terms[x].as_py() for x in c.code[c.own == k].tolist()]
    assert got == want


def test_counts_equal_those_of_lists(docs):
    rows = V.token_lists(docs, STOP, lemma=T.noun_lemma())
    key = lambda df, *cs: sorted(tuple(map(str, r)) for r in df.select(*cs).collect())
    assert key(K.document_counts(docs, TOKENIZER), "doc_id", "topic", "term", "n", "size") == key(V.list_counts(rows), "doc_id", "topic", "term", "n", "size")
    units = ("doc_id", "unit", "term", "n")
    assert key(K.document_counts(docs, TOKENIZER, 10, 4), *units) == key(V.list_counts(rows, 10, 4), *units)
    among = K.document_counts(docs, TOKENIZER, 10, 4, ["cat", "one", "none"])
    assert key(among, *units) == key(V.list_counts(rows, 10, 4).filter("term IN ('cat', 'one')"), *units)


def test_term_counts_are_sums_over_documents(docs):
    want, rates = {}, Counter()
    for (_, topic), words in words_of(docs).items():
        for term, n in Counter(words or []).items():
            for k in ((None, term), (topic, term, "by")):
                a, b = want.get(k, (0, 0))
                want[k] = (a + n, b + 1)
            rates[term] += n / len(words)
    got = {(None, r["term"]): (r["n"], r["d"]) for r in K.term_counts(docs, TOKENIZER).collect()}
    got |= {(r["topic"], r["term"], "by"): (r["n"], r["d"]) for r in K.term_counts(docs, TOKENIZER, "topic").collect()}
    assert got == want
    assert {r["term"]: r["rates"] for r in K.term_counts(docs, TOKENIZER).collect()} == pytest.approx(dict(rates))


def test_coverage_and_occurrences(docs):
    words = {k[0]: w for k, w in words_of(docs).items() if w}
    got = {r["doc_id"]: tuple(r)[1:] for r in K.coverage(docs, TOKENIZER, ["cat", "one"]).collect()}
    known = {d: sum(x in ("cat", "one") for x in w) for d, w in words.items()}
    assert got == {d: (len(w), known[d], pytest.approx(1 - known[d] / len(w))) for d, w in words.items()}
    rows = sorted(map(tuple, K.occurrences(docs, TOKENIZER, ["cat", "one"]).collect()))
    assert rows == sorted((d, len(w), p, x) for d, w in words.items() for p, x in enumerate(w) if x in ("cat", "one") or p == 0)


def test_no_tokens_give_no_rows(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "the 12")], "doc_id long, text string")
    assert K.term_counts(none, TOKENIZER).count() == 0
    assert [r["words"] for r in K.lists(none.orderBy("doc_id"), TOKENIZER).collect()] == [None, [], []]
    assert K.term_counts(none.limit(0), TOKENIZER).count() == 0


def test_a_term_leaves_a_task_once_for_each_chunk(spark, data):
    """Before, it left once for each document that has it."""
    rows = K.term_counts(catalog.texts(spark, data).coalesce(1), TOKENIZER)
    node = rows._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    sent = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node).count()
    assert rows.count() <= sent < rows.agg(F.sum("d")).first()[0] / 2


def test_thinned_goes_by_the_hash_of_each_occurrence(spark):
    ns = [1, 2, 7, 8, 9, 10, 40]
    rows = P.thinned(spark.createDataFrame([(i, "t", n) for i, n in enumerate(ns)], "doc_id long, term string, n long"), ["doc_id", "term"]).collect()
    want = {i: sum(hashlib.md5(f"42|{k}|{i}|t".encode()).hexdigest() < "8" for k in range(1, n + 1)) for i, n in enumerate(ns)}
    assert {r["doc_id"]: (r["observed"], r["target"]) for r in rows} == {i: (want[i], ns[i] - want[i]) for i in want}


def test_normalized_phi_sorts_no_topic(spark):
    counts = spark.createDataFrame([(1, "a", 1, 5), (1, "b", 3, 6), (None, "a", 2, 7)], "topic int, term string, n long, tf long")
    rows = P.normalized_phi(counts, keep=["tf"])
    assert sorted(map(str, rows.collect())) == sorted(map(str, spark.createDataFrame([(1, "a", 5, 0.25), (1, "b", 6, 0.75), (None, "a", 7, 1.0)], rows.schema).collect()))
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_own_topic_score_takes_the_unigram_from_phi(spark):
    target = spark.createDataFrame([(1, 0, "a", 2), (2, 1, "a", 1), (2, 1, "b", 1)], "doc_id long, topic int, term string, n long")
    both = spark.createDataFrame([(0, "a", 1.0, 0.5), (1, "a", 0.25, 0.5), (1, "b", 0.75, 0.5)], "topic int, term string, p double, u double")
    apart = P.own_topic_score(target, both.select("topic", "term", "p"), both.select("term", F.col("u").alias("p")).distinct())
    assert sorted(P.own_topic_score(target, both).collect()) == sorted(apart.collect())


def test_unit_bags_equal_counted_lists(docs, small):
    from inkstone.operators import models as M

    lists = K.lists(docs, TOKENIZER).select("doc_id", "words").cache()
    vocab = V.vocabulary(lists, docs.count(), 2, 1.0, 12).cache()
    known = [r["term"] for r in vocab.orderBy("term_id").collect()]
    cuts = [(20, 5), (0, 0), (7, 3)]
    got = K.unit_bags(docs, TOKENIZER, known, cuts).collect()
    for k, (size, tail) in enumerate(cuts):
        counts = V.list_counts(lists, size, tail) if size else V.list_counts(lists).withColumn("unit", F.lit(0))
        want = {(r["doc_id"], r["unit"]): (r["terms"], r["counts"]) for r in M.unit_rows(V.bag_of_words(counts, vocab)).collect()}
        own = [r for r in got if r["cut"] == k]
        assert len(own) == len(want) > 100 and {(r["doc_id"], r["unit"]): (r["terms"], r["counts"]) for r in own} == want
    assert K.unit_bags(docs, TOKENIZER, [], cuts).isEmpty() and K.unit_bags(docs.limit(0), TOKENIZER, known, cuts).isEmpty()
