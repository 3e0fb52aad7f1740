"""The whole analysis on the smallest tables, and its checks on tables that break them."""

import pytest
from pyspark.sql import functions as F

from inkstone import workflow as W
from inkstone.operators.relational import IntegrityError


@pytest.fixture(scope="module")
def done(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    folder = str(tmp_path_factory.mktemp("run"))
    config = W.Config(profile="smoke", max_features=400, phrase_min_count=5, min_document_tokens=30)
    return W.run(docs, folder, config), docs, config


def test_run_writes_all_tables_and_passes_its_checks(spark, done):
    out, docs, _ = done
    assert all(out["checks"].values()) and len(out["checks"]) == 13
    read = lambda name: spark.read.parquet(f"{out['folder']}/tables/{name}")
    assert read("corpus_manifest").count() == docs.count() and read("corpus_manifest").filter("status = 'error'").count() == docs.count() - out["documents"]
    assert {r["k"] for r in read("model_selection_summary").collect()} == {2, 7, 8} and out["decision"]["final_k"] in (2, 7, 8)
    assert read("model_selection_runs").count() == 2 * 3 * 2 and read("model_selection_runs").filter("gain <= 0").count() < 12
    assert read("sensitivity_runs").count() == 6 * 2 and read("paired_sensitivity_summary").count() == 6
    assert read("document_topics").select("doc_id").distinct().count() == out["documents"]
    assert read("verification").filter("NOT passed").isEmpty() and read("package_manifest").filter("path LIKE '%/private/%'").isEmpty()
    report = "\n".join(r[0] for r in spark.read.text(f"{out['folder']}/report.md").collect())
    assert report.startswith("# Analysis run") and "topic_prevalence" in report
    guide, prose = ("\n".join(r[0] for r in spark.read.text(f"{out['folder']}/{name}.md").collect()) for name in ("tables", "methods"))
    assert "## topic_words" in guide and "| display_rank |" in guide and f"{out['documents']} documents of 30 tokens" in prose and f"the final model has {out['decision']['final_k']}" in prose
    timings = read("run_record").first()
    assert "cross_validate" in timings["timings"] and len(timings["code"]) == 64 and "pyspark" in timings["packages"]


def test_each_integrity_check_can_fail(spark, done):
    out, _, c = done
    tables = {f: spark.read.parquet(f"{out['folder']}/tables/{f}") for f in (*W.REQUIRED, "model_selection_runs")}
    report = " ".join(tables)
    units = spark.createDataFrame([(1, 0, [0], [1.0])], "doc_id long, unit int, terms array<int>, counts array<double>")
    judge = lambda units=units, report=report, n=out["documents"], **other: {k for k, v in W.integrity({**tables, **other}, n, units, 2, report).items() if not v}
    assert judge() == set()
    double = lambda name, column: {name: tables[name].withColumn(column, F.col(column) * 2)}
    assert judge(n=1) == {"all document rows present"}
    assert judge(**double("document_topics", "w")) == {"document probabilities sum to one"}
    assert judge(**double("topic_prevalence", "equal_document")) == {"mean prevalence sums to one"}
    assert judge(units=units.withColumn("counts", F.array(F.lit(-1.0)))) == {"counts are not negative"}
    assert judge(units=units.union(units)) == {"training units are unlike"}
    splits = tables["document_validation_splits"]
    assert "no family is on both sides of a fold" in judge(document_validation_splits=splits.withColumns({"family": F.lit(1), "fold": (F.col("doc_id") % 2).cast("int")}))
    assert judge(document_validation_splits=splits.union(splits)) == {"every document is validated once"}
    assert judge(**double("topic_words", "p")) == {"topic words sum to one"}
    assert judge(topic_terms=tables["topic_terms"].filter("display_rank IS NULL OR display_rank <> 2")) == {"shown ranks are gapless"}
    assert judge(topic_similarity=tables["topic_similarity"].withColumn("similarity", F.lit(3.0))) == {"similarities lie between 0 and 1"}
    assert judge(topic_similarity=tables["topic_similarity"].select(F.col("b").alias("a"), F.col("a").alias("b"), "js", "similarity")) == {"each pair of topics is compared once"}
    assert judge(report="") == {"the report names every table"}
    fewer = {k: v for k, v in tables.items() if k != "seed_stability"}
    assert {k for k, v in W.integrity(fewer, out["documents"], units, 2, report).items() if not v} == {"requested tables exist"}


def test_guide_and_methods(spark):
    rows = spark.createDataFrame([(1, "a")], "x long, y string")
    assert W.IO.table_guide("T", {"t": rows}, {"t": "Rows."}).split("\n") == ["# T", "", "## t", "", "Rows. 1 rows.", "", "| column | type |", "|---|---|", "| x | bigint |", "| y | string |", ""]
    with pytest.raises(IntegrityError):
        W.IO.table_guide("T", {"t": rows}, {})
    facts = {"documents": 9, "recommended topics": 4, "topics": 5, "seed": 3, "updates": 7}
    text = W.methods(W.Config(final_k=5, lemmatize=False, train_chunks_per_doc=None, run_sensitivity=False), facts)
    assert "kept as they stand" in text and "recommends 4; the final model has 5, as the settings ask" in text and "all units of a document" in text and "Not run." in text
    assert "by a dictionary" in W.methods(W.Config(lemma_dictionary="x"), facts) and "suffix rules" in W.methods(W.Config(), facts)


def test_settings_are_checked(spark):
    for wrong in ({"profile": "none"}, {"folds": 1}, {"seeds": (1, 1)}, {"k_values": (1, 2)}, {"chunk_size": 50}, {"final_k": 99}):
        with pytest.raises(IntegrityError):
            W.Config(**wrong).checked()
    assert W.Config(profile="smoke").checked().k_values == (2, 7, 8)
    with pytest.raises(IntegrityError):
        W.audit(W.Run(spark, ""), spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"), W.Config())


def test_a_run_goes_on_where_it_ended(spark, data, done, tmp_path, monkeypatch):
    """A run that fails in its second fold repeats no fit when it is started again, and ends with the same tables."""
    out, docs, config = done
    config = W.replace(config, run_sensitivity=False)
    folder, calls = str(tmp_path), []
    whole = W.M.coherence

    def failing(*args, **more):
        calls.append(args)
        if len(calls) == 3:  # two a fold
            raise ConnectionError("lost")
        return whole(*args, **more)

    fits = []
    fit = W.M.fit_all
    monkeypatch.setattr(W.M, "fit_all", lambda rows, settings, terms, done=None: fits.append(len(settings)) or fit(rows, settings, terms, done))
    monkeypatch.setattr(W.M, "coherence", failing)
    with pytest.raises(ConnectionError):
        W.run(docs, folder, config)
    assert sum(fits) == 2 * 6  # both folds: the second one's fits had ended
    monkeypatch.setattr(W.M, "coherence", whole)
    fits.clear()
    again = W.run(docs, folder, config)
    assert sum(fits) == 2 * 3 and all(again["checks"].values())  # the candidates on all documents alone
    events = [r.asDict() for r in spark.read.json(f"{again['folder']}/log").orderBy("at").collect()]
    assert [e["event"] for e in events if "cross_validate" in e["fields"]] == ["began", "failed", "began", "done"]
    for name in ("model_selection_runs", "seed_stability_cv", "model_selection_summary", "topic_words", "document_topics", "keyword_network"):
        a, b = (spark.read.parquet(f"{o['folder']}/tables/{name}").toPandas() for o in (out, again))
        keys = [c for c in a.columns if a[c].dtype != float]
        a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b))
        W.np.testing.assert_allclose(a.select_dtypes(float), b.select_dtypes(float), rtol=1e-6, atol=1e-9)
        assert a[keys].equals(b[keys])


def test_stored_models_depend_on_units_and_settings(spark, tmp_path):
    units = spark.createDataFrame([(d, 0, [d % 3, 3 + d % 2], [2.0, 1.0]) for d in range(12)], "doc_id long, unit int, terms array<int>, counts array<double>")
    s = W.M.TopicSettings(k=2, iterations=3)
    store = W.M.FitStore(spark, str(tmp_path))
    first = store.fit_all(units, [s, W.replace(s, seed=1), s], 5)
    assert (store.fitted, store.found) == (2, 0) and first[0] is first[2]
    again = store.fit_all(units.repartition(3), [W.replace(s, seed=1), s], 5)
    assert (store.fitted, store.found) == (2, 2) and (again[1].components == first[0].components).all()
    store.fit_all(units.limit(11), [s], 5)
    store.fit_all(units, [W.replace(s, k=3)], 5)
    W.M.FitStore(spark, str(tmp_path), "other code").fit_all(units, [s], 5)
    assert store.fitted == 4
    path = next(p for p in tmp_path.iterdir() if p.is_dir())
    for f in path.glob("*.parquet"):
        f.write_bytes(b"broken")
    broken = W.M.FitStore(spark, str(tmp_path))
    broken.fit_all(units, [s, W.replace(s, seed=1), W.replace(s, k=3)], 5)
    assert broken.fitted <= 1 and broken.fitted + broken.found == 3
