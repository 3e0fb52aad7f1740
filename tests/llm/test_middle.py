import hashlib
import re
import tracemalloc

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import middle as X
from inkstone.llm import queries

POINTS = re.compile(X.UNIT)


def plain_cut(units, text, low, high):
    ends = [0, *(m.end() for m in units.finditer(text))]
    return ends[low], ends[high]


@given(st.text(max_size=40), st.sampled_from([X.UNIT, r"\w+", r"[^\n]*\n"]), st.integers(0, 99), st.integers(0, 99))
@settings(max_examples=200, deadline=None)
def test_two_passes_equal_a_list_of_units(text, unit, a, b):
    unit = re.compile(unit)
    n = X.units(unit, text)
    assert n == len(unit.findall(text))
    low, high = sorted((a % (n + 1), b % (n + 1)))
    assert X.cuts(unit, text, low, high) == plain_cut(unit, text, low, high)


def test_passes_take_constant_memory():
    text = "ab\n" * 500_000
    tracemalloc.start()
    assert X.units(POINTS, text) == len(text) and X.cuts(POINTS, text, 700_000, 1_400_000) == (700_000, 1_400_000)
    assert tracemalloc.get_traced_memory()[1] < 20_000
    tracemalloc.stop()


def plainly(doc_id, text):
    """The whole transformation by slices."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_documents_equal_slices_and_come_back(documents, texts):
    out = X.transformed(documents).withColumn("back", X.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        assert tuple(r)[1:6] == plainly(r["doc_id"], texts[r["doc_id"]]) and r["back"] == texts[r["doc_id"]]
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark, data):
    got = sorted(map(tuple, queries.op11_fill_middle(spark, data).collect()))
    want = duckdb.connect().execute(queries.FILL_MIDDLE.replace("documents", f"'{data}/documents.parquet'")).fetchall()
    assert got == sorted(want)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    want = sorted((str(r["doc_id"]), *map(str, plainly(r["doc_id"], r["TEXT"]))) for r in odd_docs.collect())
    assert sorted(tuple(map(str, r)) for r in X.transformed(odd_docs).collect()) == want
    assert X.transformed(no_docs).count() == 0
    # sentinels in the text, and parts of them at every border
    rows = [(i, t) for i, t in enumerate(["a<P>b", "<S>", "x <M>", "<<<", "<P", "P>", "<P><", "><><S", "<"] * 40)]
    out = X.transformed(spark.createDataFrame(rows, "doc_id long, text string"), rate=100)
    for r in out.withColumn("back", X.restored(F.col("output"), F.col("form"))).collect():
        text = rows[r["doc_id"]][1]
        assert r["back"] == text and (r["form"] == "plain") == any(s in text for s in ("<P>", "<S>", "<M>"))


def test_other_units(spark):
    docs = spark.createDataFrame([(i, "one two  three, four. ") for i in range(60)], "doc_id long, text string")
    for r in X.transformed(docs, unit=r"\w+", rate=100).collect():
        assert r["n"] == 4 and r["prefix_chars"] in (0, 3, 7, 14, 20) and r["prefix_chars"] + r["middle_chars"] in (0, 3, 7, 14, 20)
