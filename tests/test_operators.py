"""Edge cases of the core operators on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import evidence as E
from inkstone.operators import graph as H
from inkstone.operators import models
from inkstone.operators import pages as G
from inkstone.operators import relational as R
from inkstone.operators import similarity as S
from inkstone.operators import topics as P
from inkstone.operators import vocabulary as V
from inkstone.functions import text as T
from inkstone.sources import tables as IO
from inkstone.streaming import evidence as ST


def test_short_tail_joins_only_if_there_is_a_unit_before(spark):
    rows = spark.createDataFrame([(n, p) for n in (5, 10, 12, 16) for p in range(n)], "n int, pos int")
    got = {(r["n"], r["u"]): r["c"] for r in rows.withColumn("u", V.unit_of(F.col("pos"), F.col("n"), 10, 5)).groupBy("n", "u").agg(F.count("*").alias("c")).collect()}
    assert got == {(5, 0): 5, (10, 0): 10, (12, 0): 12, (16, 0): 10, (16, 1): 6}


def test_terms_count_as_whole_words_of_any_script(spark):
    rows = spark.createDataFrame([("the theory, éthe the_ the; of the of the",)], "t string")
    got = rows.select(T.term_count(F.col("t"), "the"), T.term_count(F.col("t"), "of the")).first()
    assert tuple(got) == (4, 2)


def test_empty_and_null_texts_score_zero(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta")], "doc_id long, text string")
    got = {r["doc_id"]: (r["total"], r["relevance"]) for r in E.scores(docs, {"a": ["alpha"], "b": ["beta", "alpha"]}, E.Rules()).collect()}
    assert got == {1: (0, "peripheral"), 2: (0, "peripheral"), 3: (3, "peripheral")}


def test_matching_is_the_best_permutation():
    cost = np.random.default_rng(1).random((5, 5))
    best = min(itertools.permutations(range(5)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
    assert P.matched(cost) == list(best)


def test_js_matrix_is_zero_on_itself():
    m = np.random.default_rng(2).dirichlet(np.ones(6), 3)
    assert np.allclose(np.diag(models.js_matrix(m, m)), 0, atol=1e-7)


def test_communities_of_two_cliques():
    clique = lambda names: [(a, b, 1.0) for a, b in itertools.combinations(names, 2)]
    found = V.greedy_communities(clique("abcd") + clique("wxyz") + [("d", "w", 0.1)])
    assert {found[c] for c in "abcd"} == {1} and {found[c] for c in "wxyz"} == {2}


def test_invariants_raise(spark):
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    once = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(R.IntegrityError):
        R.one_to_one(twice, once.select("k"), ["k"])
    with pytest.raises(R.IntegrityError):
        R.same_keys(once, spark.createDataFrame([(2,)], "k int"), ["k"])
    with pytest.raises(R.IntegrityError):
        R.cohen_kappa(spark.createDataFrame([(1, None)], "x int, y int"))
    with pytest.raises(R.IntegrityError):
        R.require_columns(once, ["absent"])
    on_record = {"tag": "m:7b", "digest": "abc", "layers": "sha256:1"}
    IO.identity_gate({"tag": "m:7b", "digest": "abcdef", "layers": ["sha256:0", "sha256:1"]}, on_record)
    for found in ({"tag": "m:7", "digest": "abcdef", "layers": ["sha256:1"]}, {"tag": "m:7b", "digest": "ab", "layers": ["sha256:1"]}, {"tag": "m:7b", "digest": "abc", "layers": []}, {"tag": "m:7b"}):
        with pytest.raises(R.IntegrityError):
            IO.identity_gate(found, on_record)


def test_reference_heading_keys(spark):
    rows = spark.createDataFrame([("4. References:",), ("IV Works Cited",), ("Referenced",)], "l string")
    assert [r[0] for r in rows.select(G.heading_key(F.col("l"))).collect()] == ["references", "workscited", "referenced"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(H.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(21)} == {0} and {got[100 + i] for i in range(30)} == {100}


def test_similar_pairs_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew potions"
    texts = [base, base + " again", base.replace("fox", "cat"), "entirely different words stand here without relation", base, "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = {}
    for r in S.gram_weights(docs, min_df=1).collect():
        w.setdefault(r["doc_id"], {})[r["gram"]] = r["w"]
    want = {(a, b) for a, b in itertools.combinations(sorted(w), 2) if sum(x * w[b].get(g, 0) for g, x in w[a].items()) >= 0.6}
    got = {(r["a"], r["b"]) for r in S.similar_pairs(docs, 0.6, min_df=1).collect()}
    assert got == want and (0, 4) in got
    groups = dict(S.near_duplicate_groups(docs, 0.6, min_df=1).collect())
    assert groups[4] == 0 and groups[3] == 3 and len(groups) == 6


def test_phrase_merge_is_greedy_from_the_left(spark):
    words = ["a", "b", "c", "x", "a", "b"]
    rows = [(1, len(words), i, w, x) for i, (w, x) in enumerate(zip(words, [*words[1:], None], strict=True))]
    tokens = spark.createDataFrame(rows, "doc_id long, n int, pos int, token string, next string")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    merged = V.merge_phrases(tokens, phrases)
    assert [(r["n"], r["token"], r["next"]) for r in merged.orderBy("pos").collect()] == [(4, "a_b", "c"), (4, "c", "x"), (4, "x", "a_b"), (4, "a_b", None)]
    again = V.restopped(merged, ["x", "c"])
    assert [(r["n"], r["pos"], r["token"], r["next"]) for r in again.collect()] == [(1, 0, "a_b", None)]


def test_sources_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("1", "f", 2, "body\nline"), ("2", "g", 1, "")], "doc_id string, filename string, pages int, text string")
    with pytest.raises(R.IntegrityError):
        IO.checked_record_text(docs, docs.filter("doc_id = '1'").select("doc_id", "pages"))
    IO.write_csv(docs, f"{tmp_path}/c", ["doc_id", "text", "none"])
    assert IO.csv_table(spark, f"{tmp_path}/c").columns == ["doc_id", "text", "none"]
    IO.write_json(docs, f"{tmp_path}/j")
    assert IO.json_lines(spark, f"{tmp_path}/j").count() == 2
    IO.write_records(docs, f"{tmp_path}/r")
    assert [r["filename"] for r in IO.read_records(spark, f"{tmp_path}/r").collect()] == ["f"]
    IO.log_event(spark, f"{tmp_path}/l", "start", n=1)
    assert spark.read.json(f"{tmp_path}/l").count() == 1
    assert IO.package_manifest(spark, f"{tmp_path}/c").count() >= 1
    nodes = spark.createDataFrame([("a&b", "x", "t", "")], "id string, label string, type string, detail string")
    edges = spark.createDataFrame([("a&b", "a&b", "r", "o", 1.0, "")], "source string, target string, relation string, origin string, weight double, evidence string")
    IO.write_graphml(nodes, edges, f"{tmp_path}/g")
    assert "a&amp;b" in "".join(r[0] for r in spark.read.text(f"{tmp_path}/g").collect())
    IO.write_sheets({"one": docs}, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w/one").count() == 2
    with pytest.raises(R.IntegrityError):
        IO.binary_corpus(spark, f"{tmp_path}/w")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tmp_path}/c")
    assert IO.extracted(files, lambda content: [content.decode()]).filter("error IS NULL").count() >= 1
    assert IO.run_record(spark, {"k": 1}).count() == 1


def test_generation_retries_and_audit(spark):
    req = spark.createDataFrame([(0, "s0", "good"), (1, "s1", "bad")], "batch long, request_sha256 string, prompt string")

    def stub(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return {"done": True, "done_reason": "stop", "response": "names 1 and 99"}

    got = IO.generated(req, stub, wait=0.01)
    assert {r["batch"]: r["attempts"] for r in got.collect()} == {0: 1, 1: 3}
    assert tuple(IO.completion_gate(req, got).first()) == (2, 1, False)
    audit = IO.response_audit(got.filter("done"), spark.createDataFrame([(0, [1, 2])], "batch long, members array<long>")).first()
    assert (audit["own"], audit["foreign"], audit["words"]) == (1, 1, 4)


def test_stream_equals_batch(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(20).write.parquet(f"{tmp_path}/in")
    lexicon, rules = {"a": ["the"], "b": ["und"]}, E.Rules()
    ST.score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", lexicon, rules).awaitTermination(120)
    want = E.scores(spark.read.parquet(f"{tmp_path}/in"), lexicon, rules)
    assert R.same_multiset(spark.read.parquet(f"{tmp_path}/out"), want)


def test_worksheets_hide_the_answer(spark):
    blind, key = IO.worksheets(spark.createDataFrame([(1, ["x", "y"], "y")], "topic int, options array<string>, intruder string"))
    assert "correct" not in blind.columns and blind.join(key, "task_id").count() == 1


def test_evenly_spaced_and_final_candidates(spark):
    rows = spark.createDataFrame([(1, i) for i in range(11)], "k int, i int")
    assert [r["i"] for r in V.evenly_spaced(rows, "k", "i", 5).orderBy("i").collect()] == [0, 2, 5, 7, 10]
    assert P.final_candidates(11, range(2, 13)) == [7, 8, 10, 11, 12]
    assert P.unique_keywords([(0, "a", 2.0), (0, "b", 1.0), (1, "a", 3.0), (1, "c", 0.5)], 1) == [(0, "a"), (1, "c")]


def containing(passages, docs):
    return sorted((i, d) for i, p in passages for d, t in docs if p is not None and t is not None and p in t)


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["aa", "bb", "cc", "dd", "ee", "longer", "words"]
    docs = [(d, " ".join(rng.choice(words, rng.integers(0, 40)))) for d in range(60)] + [(98, None), (99, ""), (97, '("aa bb cc", said\n\tdd  ee.')]
    passages = []
    for i in range(80):  # pieces that start and end anywhere
        text = docs[int(rng.integers(0, 60))][1]
        a = int(rng.integers(0, max(1, len(text))))
        passages.append((i, text[a : a + int(rng.integers(0, 60))]))
    passages += [(100, None), (101, ""), (102, "aa"), (103, "bb cc"), (104, "a bb cc dd e"), (105, "cc\", said\n\tdd"), (106, " "), (107, "aa bb cc"), (107, "aa bb cc")]
    p, t = spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(set(containing(passages, docs)))
    assert sorted(map(tuple, R.containment(p, t).collect())) == want
    assert sorted(map(tuple, R.containment(p, t, words=2, short=1).collect())) == want
    assert R.containment(p.limit(0), t).count() == 0 and R.containment(p, t.limit(0)).count() == 0


def test_aliases_are_replaced_once_and_longest_first(spark):
    to = {"of the": "OF_THE", "of": "x", "the cat": "y", "a.b": "of"}
    rows = spark.createDataFrame([("of the of the cat; often of_the a.b aXb \ue000 of",), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(R.replace_aliases(F.col("t"), to)).collect()]
    assert got == ["OF_THE OF_THE cat; often of_the of aXb \ue000 x", None, ""]


def test_tokenizers(spark):
    text = "The Cats, 2nd wives! www.x.org/y a@b.org re-use the theories bus cat cats 10.1234/ab the_cats 3dprint"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(T.tokens(F.col("t"), ["the", "bus", "cat"], lemma=T.noun_lemma())).collect()]
    assert got == [["wive", "use", "theory", "the_cats", "dprint"], None, []]
    plain = rows.select(T.tokens(F.col("t"), ["the"], aliases={"cats": "felines"})).first()[0]
    assert plain == ["felines", "wives", "use", "theories", "bus", "cat", "felines", "the_cats", "dprint"]
    first = T.tokens_with_aliases(F.col("t"), [(r"\\bn[ -]?f[ -]?ts?\\b".replace("\\\\", "\\"), " nft ")], {"e_mail": "email"}, ["the"], lemma=T.noun_lemma())
    rows = spark.createDataFrame([("The NFTs, e-mail and/or a / b 12.5 doi: 10.1/x state-of-the-art 'tis -- ab",)], "t string")
    assert rows.select(first).first()[0] == ["nft", "email", "and", "state_of_the_art", "tis"]


def test_unicode_and_broken_words(spark):
    rows = spark.createDataFrame([("ﬁnan-\n  cial Ｃrime soft\u00adhyphen A-\nB x1-\ny",), (None,), ("plain",)], "t string")
    got = [r[0] for r in rows.select(T.clean_unicode(F.col("t"))).collect()]
    assert got == ["financial Crime softhyphen A-\nB x1-\ny", None, "plain"]


def test_shown_terms(spark):
    rules = T.DisplayRules(fragments=["xx"], exact=["gone"], noise=["noise"], stop=["and", "of"], hidden_single=["alone"], single=["nft", "alone", "kept"], canonical={"nfts": "NFT", "smart contract": "smart contracts"})
    terms = ["nfts", "kept", "other", "alone", "smart_contract", "a_xx_b", "gone", "some_noise", "and_of", "ab", "vr_set", "", None]
    rows = spark.createDataFrame([(t,) for t in terms], "t string")
    got = [r[0] for r in rows.select(T.displayable(F.col("t"), rules)).collect()]
    assert got == [True, True, False, False, True, False, False, False, False, False, True, False, False]
    keys = rows.select(T.readable_term(F.col("t"), rules.canonical), T.family_key(F.col("t"), rules.canonical, {"smart contracts": "contract"})).collect()
    assert tuple(keys[0]) == ("NFT", "nft") and tuple(keys[4]) == ("smart contracts", "contract") and tuple(keys[10]) == ("vr set", "vr set")


def test_wrapped_lines_and_unique_keywords_equal_plain_loops(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join("w" * int(n) for n in rng.integers(1, 14, rng.integers(0, 30))) for _ in range(40)]

    def plain(t, width):
        lines = []
        for w in t.split():
            if lines and len(lines[-1]) + 1 + len(w) <= width:
                lines[-1] += " " + w
            else:
                lines.append(w)
        return lines

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(T.wrapped(F.col("t"), 20)).collect()] == [plain(t, 20) for t in texts]


def test_kappa_and_agreement_equal_plain_counts(spark):
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 4, 200), rng.integers(0, 4, 200)
    rows = spark.createDataFrame([(int(a), int(b), int(a) % 2) for a, b in zip(x, y, strict=True)], "x int, y int, k int")
    for quadratic in (False, True):
        d = (np.arange(4)[:, None] - np.arange(4)) ** 2 if quadratic else 1 - np.eye(4)
        o = np.zeros((4, 4))
        np.add.at(o, (x, y), 1)
        due = np.outer(o.sum(axis=1), o.sum(axis=0)) / 200
        assert np.isclose(R.cohen_kappa(rows, quadratic).first()[0], 1 - (d * o).sum() / (d * due).sum())
    got = {r["k"]: (r["n"], r["agree"]) for r in R.agreement(rows, ["k"]).collect()}
    assert got[None] == (200, float((x == y).mean())) and np.isclose(got[1][1], (x == y)[x % 2 == 1].mean())


def test_numbered_rows_and_least_values(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i % 3) for i in range(1000)], "v int, g int").repartition(7)
    got = {r["v"]: r["place"] for r in R.numbered(rows, ["v"], "place", 0).collect()}
    assert got == {i: i for i in range(1000)}
    least = {r["g"]: r["low"] for r in R.least_of(rows, ["g"], "v", 4, "low").collect()}
    assert least == {g: sorted(i * 7919 % 1000 for i in range(1000) if i % 3 == g)[:4] for g in range(3)}
    assert R.numbered(rows.limit(0), ["v"], "place").count() == 0


def test_generator_limits_and_gates(spark):
    import time

    req = spark.createDataFrame([(0, "s", "x" * 100)], "batch long, request_sha256 string, prompt string")
    slow = IO.generated(req, lambda p: time.sleep(3), retries=1, wait=0.01, limit=0.05).first()
    assert (slow["done"], slow["attempts"]) == (False, 2) and slow["done_reason"].startswith("no answer")
    assert tuple(IO.fit_check(req, 10, 50).first()) == (0, 100, 36, True) and not IO.fit_check(req, 10, 50, 0.5).first()["fits"]
    seen = spark.createDataFrame([("x" * 100, 30), ("x" * 100, 5), ("", 3)], "prompt string, prompt_tokens int")
    assert IO.observed_ratio(seen) == 0.3 and IO.observed_ratio(seen.limit(0)) is None
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    batched = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 9)], "batch long, doc_id long")
    assert tuple(IO.coverage_gate(batched, docs).first()) == (5, 3, 1, 1, False)
    assert IO.coverage_gate(docs.withColumn("batch", F.lit(0)), docs).first()["covered"]


def test_record_text_checks_words(spark):
    docs = spark.createDataFrame([(1, "f", 2, "two words"), (2, "g", 1, "")], "doc_id long, filename string, pages int, text string")
    due = spark.createDataFrame([(1, 2, 2), (2, 1, 0)], "doc_id long, pages int, words int")
    assert IO.checked_record_text(docs, due).count() == 1
    for wrong in (due.withColumn("words", F.lit(2)), due.withColumn("pages", F.lit(1)), due.union(due)):
        with pytest.raises(R.IntegrityError):
            IO.checked_record_text(docs, wrong)


def test_extractors_are_tried_in_order(spark):
    files = spark.createDataFrame([("a", bytearray(b"one two three four")), ("b", bytearray(b"few")), ("c", bytearray(b"bad")), ("d", bytearray(b"scan"))], "path string, content binary")

    def first(content):
        if content in (b"bad", b"scan"):
            raise ValueError("unreadable")
        return [content.decode()]

    def second(content):
        if content == b"bad":
            raise OSError("gone")
        return [content.decode(), "more"]

    rows = [tuple(r) for r in IO.extracted(files, [first, second], least=3).orderBy("path", "page").collect()]
    assert rows == [("a", 1, "one two three four", None, 0), ("b", 1, "few", None, 1), ("b", 2, "more", None, 1), ("c", None, None, "ValueError: unreadable; OSError: gone", None), ("d", 1, "scan", None, 1), ("d", 2, "more", None, 1)]
    seen = IO.extracted(files.filter("path = 'd'"), first, ocr=lambda c: ["read by eye and more"], least=3).first()
    assert (seen["text"], seen["by"]) == ("read by eye and more", -1)


def test_synthesis_prompt(spark):
    responses = spark.createDataFrame([(1, "second"), (0, "first")], "batch long, response string")
    stats = spark.createDataFrame([(3, 7)], "documents long, n_a long")
    got = E.synthesis(responses, stats, "Write.").first()
    assert got["prompt"] == "Write.\n\ndocuments: 3\nn_a: 7\n\nBatch 0\nfirst\n\nBatch 1\nsecond"
    with pytest.raises(R.IntegrityError):
        E.synthesis(responses, stats, "Write.", most=1)


def test_groups_without_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9)))) for _ in range(120)]
    texts = []
    for _ in range(6):
        own = list(rng.choice(words, 60))
        for step in range(12):  # copies, each further from the first
            texts.append(" ".join(own))
            own[int(rng.integers(0, 60))] = str(rng.choice(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = [(r["a"], r["b"]) for r in S.similar_pairs(docs, 0.93, min_df=1).collect()]
    root = list(range(len(texts)))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    got = dict(S.near_duplicate_groups(docs, 0.93, min_df=1).collect())
    assert [got[i] for i in range(len(texts))] == root and 6 <= len(set(root)) < len(texts)


def test_blocks_of_documents_equal_brute_force(spark, monkeypatch):
    """Several blocks, few meetings at once; documents go to the tasks once and nothing but links comes back."""
    rng = np.random.default_rng(4)
    base = [rng.choice(400, 25, replace=False) + 1 for _ in range(5)]
    idf = np.concatenate(([0.0], rng.uniform(1, 6, 400)))
    docs = []
    for k in range(60):
        own = set(base[k % 5].tolist())
        own = sorted(own - set(rng.choice(sorted(own), k % 4, replace=False).tolist()) | set((rng.choice(400, k % 3, replace=False) + 1).tolist()))
        docs.append((k, k if k % 6 else 0, own, rng.integers(1, 3, len(own)).tolist()))
    dense = np.zeros((60, 401))
    for k, _, own, tf in docs:
        dense[k, own] = tf * idf[own]
    cosine = (dense := dense / np.linalg.norm(dense, axis=1, keepdims=True)) @ dense.T
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if cosine[a, b] >= 0.8 and docs[a][1] != docs[b][1]}
    size, place, tf = (np.concatenate([np.atleast_1d(x) for x in xs]).astype(np.int64) for xs in ([len(d[2]) for d in docs], [d[2] for d in docs], [d[3] for d in docs]))
    block = S._Block(np.arange(60), np.array([d[1] for d in docs]), size, place, tf, idf, 0.8)
    for pairs in (1, 50, 1 << 22):
        monkeypatch.setattr(S, "PAIRS", pairs)
        found = [(a, b) for i, j in S._candidates(block, block, 0.8) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(found) == len(set(found)) and want <= set(found) and all(a < b for a, b in found)
    monkeypatch.setattr(S, "BLOCK", 9)
    vectors = spark.createDataFrame(docs, "doc_id long, c long, places array<int>, tfs array<int>")
    top = spark.createDataFrame([(k, float(idf[k])) for k in range(1, 401)], "place int, idf double")
    every = S._linked(vectors, top, 0.8, False)
    assert every._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = every.collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(want) and all(abs(r["similarity"] - cosine[r["a"], r["b"]]) < 1e-9 for r in rows)
    few = [(r["a"], r["b"]) for r in S._linked(vectors, top, 0.8, True).collect()]
    same = [(0, k) for k in range(0, 60, 6)]
    groups = lambda links: dict(H.connected_components(spark.createDataFrame([*links, *same], "a long, b long")).collect())
    assert set(few) <= want and len(few) < len(want) and groups(few) == groups(want)


def test_lists_are_counted_where_they_stand(spark):
    """The same counts as from token rows, without an exchange; units cut as ``units`` cuts them; null and empty lists."""
    words = [["b", "a", "b", "é"] * 7, [], None, ["a"], ["x", "y"] * 13]
    lists = spark.createDataFrame([(i, i % 2, w) for i, w in enumerate(words)], "doc_id long, topic int, words array<string>")
    rows = V.rows_of(lists)
    got = V.list_counts(lists)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(got, "doc_id", "term", "n", "size") == key(V.per_document(rows), "doc_id", "term", "n", "size")
    assert {(r["doc_id"], r["topic"]) for r in got.collect()} == {(0, 0), (3, 1), (4, 0)}
    units = V.units(rows, 10, 4).groupBy("doc_id", "unit", F.col("token").alias("term")).agg(F.count("*").alias("n"))
    assert key(V.list_counts(lists, 10, 4), "doc_id", "unit", "term", "n") == key(units, "doc_id", "unit", "term", "n")


def test_lists_merge_as_rows_do(spark):
    rng = np.random.default_rng(3)
    lists = spark.createDataFrame([(i, [str(w) for w in rng.choice(list("abcd"), n)]) for i, n in enumerate([0, 1, 2, 3, 9, 40, 400])], "doc_id long, words array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a")], "a string, b string")
    rows = V.merge_phrases(V.rows_of(lists), phrases).orderBy("doc_id", "pos").collect()
    want = {d: [r["token"] for r in g] for d, g in itertools.groupby(rows, key=lambda r: r["doc_id"])}
    merged = V.merge_lists(lists, phrases)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, merged.collect())) == dict(map(tuple, V.merge_lists(lists, phrases, 2).collect())) == want


def test_own_topic_score_equals_the_mixture_of_one(spark):
    target = spark.createDataFrame([(1, 0, "a", 2), (1, 0, "z", 1), (2, 1, "a", 1), (2, 1, "b", 3)], "doc_id long, topic int, term string, n long")
    phi = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "a", 0.1), (1, "b", 0.9)], "topic int, term string, p double")
    uni = spark.createDataFrame([("a", 0.3), ("b", 0.6), ("z", 0.1)], "term string, p double")
    theta = target.select("doc_id", "topic", F.lit(1.0).alias("w")).distinct()
    key = lambda df: {r["doc_id"]: (pytest.approx(r["loglik"]), r["tokens"], pytest.approx(r["unigram"])) for r in df.collect()}
    got = P.own_topic_score(target, phi, uni)
    assert {r["doc_id"]: (r["loglik"], r["tokens"], r["unigram"]) for r in got.collect()} == key(P.completion_score(target.drop("topic"), theta, phi, uni))


def test_tokens_are_made_once_and_few_passes(spark):
    """Overlapping units ask for a document's tokens once; without aliases no text is rewritten for characters that part tokens."""
    docs = spark.createDataFrame([(1, "ab-cde fgh‐ijk café x.y"), (2, ""), (3, None)], "doc_id long, text string")
    plan = V.overlapping_units(docs, 3, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [r["w"] for r in docs.select(T.tokens(F.col("text")).alias("w")).collect()] == [["cde", "fgh", "ijk", "caf"], [], None]


def test_only_texts_with_an_at_sign_are_searched_for_mail_addresses(spark):
    texts = ["See HTTPS://a.example/x and www.b.example, then Mail", "write to Anna.Bell@mail.example now; https://c.example/q@r", "@ alone, a @b c@ ddd@eee fff", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = rows.select("k", T.without_addresses(F.col("t")).alias("a"), F.regexp_replace(F.lower("t"), T.ADDRESSES, " ").alias("b")).orderBy("k").collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and found[0]["a"] == "see   and   then mail"
    assert found[1]["a"] == "write to   now;  "


def test_listed_passages_are_found_without_windows(spark):
    """One pass over each text, whose words make no rows of their own; joined passages find the same."""
    passages = ["aa bb cc dd", "a bb c", "bb", "é b", "bb cc", "", None, "aa bb cc dd", "x" * 40]
    texts = ["aa bb cc dd ee", "xa bb cx", None, "", "é bb", "x" * 39, "y" + "x" * 50, "aa  bb cc dd"]
    p = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, d) for i, a in enumerate(passages) for d, b in enumerate(texts) if a is not None and b is not None and a in b)
    got = R.containment(p.filter("text <> ''"), t)
    assert "xxhash64" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, R.containment(p, t).collect())) == sorted(map(tuple, R.containment(p, t, listed=0).collect())) == want
    assert sorted(map(tuple, R.containment(p, t, words=2, short=1, listed=0).collect())) == want
