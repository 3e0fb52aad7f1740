import corpus_pipeline
from inkstone.llm import encoding, packing, quality, secrets, simhash
from tests.llm.test_lines import brute as without_repeats
from tests.llm.test_packing import checked
from tests.llm.test_shingles import brute as first_of_each


def test_stages_equal_brute_force(spark, documents, data, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "pack"]
    docs, want = documents, {r["doc_id"]: r["text"] for r in documents.collect()}
    judge, enc = quality.Judge(quality.Bands()), secrets.encoding(secrets.vocabulary())
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if name == "pack":
            assert checked(out.collect(), want) < 0.05
            break
        assert out.columns == documents.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "quality_rules":
            want = {d: t for d, t in want.items() if judge(t)[6]}
        elif name == "line_dedup":
            want = without_repeats(list(want.items()))
        elif name == "near_dedup":
            ids = sorted(want)
            want = {ids[i]: want[ids[i]] for i in first_of_each([want[d] for d in ids])}
        else:
            want = {d: secrets.redacted(t, secrets.spans(t, enc)) for d, t in want.items()}
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want


def test_run_on_odd_tables(spark, documents, odd_docs, no_docs, tmp_path):
    mixed = odd_docs.unionByName(documents.limit(8), allowMissingColumns=True)
    for name, docs in (("odd", mixed), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= (name == "odd")


def test_modules_share_no_state():
    assert encoding.codec(encoding.vocabulary()) is encoding.codec(encoding.vocabulary())
    assert packing.SIZE == 2048 and simhash.DISTANCE == 3
