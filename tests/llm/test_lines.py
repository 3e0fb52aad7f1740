import random

from pyspark.sql import functions as F

from inkstone.llm import lines as X
from tests.llm.conftest import extras_kept


def brute(docs, window=2, long_words=50):
    """Texts without repeats, for (doc_id, text) with unlike ids."""
    seen, out = set(), {}
    place = {}
    split = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for d, t in docs}
    for d in sorted(split):
        for k in range(len(split[d])):
            for n in {window if k + window <= len(split[d]) else 0, int(len(split[d][k][1].split()) >= long_words)} - {0}:
                run = (n, tuple(x for _, x in split[d][k : k + n]))
                if run in seen:
                    place.setdefault(d, set()).update(range(k, k + n))
                seen.add(run)
    for d, t in docs:
        gone = {split[d][k][0] for k in place.get(d, ())}
        out[d] = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def test_result_equals_brute_force(documents, texts):
    got = {r["doc_id"]: r["text"] for r in X.cleaned(documents).collect()}
    assert got == brute(list(texts.items()))
    assert got != texts


def test_random_runs_and_ties_equal_brute_force(spark):
    r = random.Random(2)
    pool = [f"line number {i}" for i in range(12)] + ["", "   ", "w " * 60]
    docs = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for d in range(150)]
    got = {x["doc_id"]: x["text"] for x in X.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_a_shared_passage_goes_and_its_first_place_stays(spark):
    passage = "\n".join(f"sentence {i} of a passage that many documents share" for i in range(6))
    docs = spark.createDataFrame([(d, f"own start {d}\n{passage}\nown end {d}") for d in range(20)] + [(99, "clean\nand whole\ntext")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in X.cleaned(docs).collect()}
    assert passage in got[0] and got[5] == "own start 5\nown end 5" and got[99] == "clean\nand whole\ntext"


def test_colliding_hashes_match_nothing(spark):
    r = random.Random(3)
    pool = [f"line number {i}" for i in range(40)] + ["w " * 60, "v " * 70]
    docs = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for d in range(120)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (1, 2, 3):
        got = {x["doc_id"]: x["text"] for x in X.cleaned(table, window, hashed=lambda c: F.pmod(F.xxhash64(c), F.lit(3))).collect()}
        assert got == brute(docs, window)


def test_fingerprints_are_window_minima_only(spark):
    docs = [(1, "\n".join(f"line {i}" for i in range(400)))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (2, 4, 8):
        rows = X.fingerprints(table, window).collect()
        h = [r[0] for r in spark.createDataFrame([(f"line {i}",) for i in range(400)], "t string").select(F.xxhash64("t")).collect()]
        want = {max(j for j in range(i, i + window) if h[j] == min(h[i : i + window])) for i in range(401 - window)}
        assert {r["place"] for r in rows} == want and len(rows) == len(want) < 1.2 * 400 * 2 / (window + 1)
        assert sorted(s["at"] for r in rows for s in r["spans"]) == list(range(401 - window))


def test_null_id_and_smallest_id_are_two_places(spark):
    text = "first line\nsecond line"
    rows = spark.createDataFrame([(None, text), (-(1 << 63), text), (5, text), (5, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in X.cleaned(rows).collect())
    assert got == [(False, 0, text), (True, -(1 << 63), ""), (True, 5, ""), (True, 5, "")]


def test_odd_and_empty_tables(odd_docs, no_docs):
    out = X.cleaned(odd_docs)
    assert [c.lower() for c in out.columns] == [c.lower() for c in odd_docs.columns] and out.count() == odd_docs.count() and extras_kept(out)
    got = {r["doc_id"]: r[1] for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[3] == "one"
    assert X.cleaned(no_docs).count() == 0
    assert X.digest_columns(X.deduplicated(odd_docs)).count() == odd_docs.count()
