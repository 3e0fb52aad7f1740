"""The whole analysis of a corpus: cleaning, model selection, final topics, sensitivity, tables and checks.

``run`` calls the operators in order and writes every table below the output
folder, in a folder named after a digest of settings, corpus, packages and code,
so that a run with anything changed stands beside the one before, and the same
run, started again, goes on where it ended: whole tables are read, not made, and
models are looked up by what they depend on. On the command line:
python -m inkstone.workflow --input docs.parquet --output results.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import lemmas as L
from inkstone.operators import models as M
from inkstone.operators import pages as G
from inkstone.operators import similarity as S
from inkstone.operators import topics as P
from inkstone.operators import vocabulary as V
from inkstone.operators.relational import IntegrityError, require_columns, require_unique
from inkstone.sources import tables as IO
from inkstone.storage import checkpointed, shared_folder, written

SMOKE = {"k_values": (2, 7, 8), "seeds": (11, 42), "folds": 2, "max_iter": 12, "inner": 60, "resamples": 200}
REFERENCE_HEADINGS = ("references", "bibliography", "workscited")


@dataclass(frozen=True)
class Config:
    """Settings of a run; ``smoke`` as profile takes the small ones that try the plumbing out."""

    profile: str = "research"
    k_values: tuple[int, ...] = tuple(range(2, 13))
    seeds: tuple[int, ...] = (11, 42, 97, 2026, 31415)
    folds: int = 3
    split_seed: int = 20260915
    max_iter: int = 250
    inner: int = 250
    tolerance: float = 0.1
    alpha: float | None = None
    eta: float = 0.01
    chunk_size: int = 400
    min_tail: int = 100
    train_chunks_per_doc: int | None = 50
    min_document_tokens: int = 100
    min_df: int = 2
    max_df: float = 1.0
    max_features: int = 10_000
    learned_phrases: bool = True
    phrase_min_count: int = 10
    phrase_threshold: float = 10.0
    lemmatize: bool = True
    #: A folder with nouns in WordNet's file format; without it lemmas follow suffix rules.
    lemma_dictionary: str | None = None
    strip_references: bool = True
    near_duplicate_threshold: float = 0.93
    coherence_topn: int = 10
    coherence_tolerance: float = 0.02
    minimum_stability: float = 0.70
    minimum_diversity: float = 0.60
    minimum_converged: float = 0.80
    final_k: int | None = None
    resamples: int = 2000
    network_terms: int = 40
    network_max_edges: int = 150
    run_sensitivity: bool = True
    stop: tuple[str, ...] = ()

    def checked(self) -> Config:
        """The settings with the profile's values, or an error."""
        c = replace(self, **SMOKE) if self.profile == "smoke" else self
        if c.profile not in ("research", "smoke"):
            raise IntegrityError(f"no profile {c.profile}")
        if c.folds < 2 or len(c.seeds) < 2 or len(set(c.seeds)) != len(c.seeds) or len(set(c.k_values)) != len(c.k_values):
            raise IntegrityError("at least two folds and two seeds are needed, and seeds and numbers of topics must be unlike")
        if any(k < 2 for k in c.k_values) or c.chunk_size < c.min_tail or (c.final_k is not None and c.final_k not in c.k_values):
            raise IntegrityError("numbers of topics are 2 or more, units longer than their tails, and the final number one of those tried")
        return c

    def settings(self, k: int, seed: int) -> M.TopicSettings:
        return M.TopicSettings(k=k, seed=seed, iterations=self.max_iter, tolerance=self.tolerance, alpha=self.alpha, eta=self.eta, inner=self.inner)


@dataclass(frozen=True)
class Representation:
    """A corpus in numbers: its tokens with phrases, its vocabulary in order, units (all, and those trained on)."""

    tokens: DataFrame
    terms: list[str]
    units: DataFrame
    training: DataFrame


class Run:
    """The folder of one run, the tables written so far, the store of its models, and the seconds of its steps."""

    def __init__(self, spark: SparkSession, folder: str, fits: str | None = None):
        self.spark, self.folder = spark, folder
        self.store = M.FitStore(spark, fits or f"{folder}/private/fits", f"{IO.code_digest()} {json.dumps(IO.versions(), sort_keys=True)}")
        self.timings: dict[str, float] = {}
        self.tables: dict[str, DataFrame] = {}

    def step(self, name: str, make: Callable, *args):
        """One step, logged when it begins and ends, or fails."""
        began, event = time.time(), "failed"
        IO.log_event(self.spark, f"{self.folder}/log", "began", step=name)
        try:
            out = make(self, *args)
            event = "done"
        finally:
            self.timings[name] = round(time.time() - began, 3)
            IO.log_event(self.spark, f"{self.folder}/log", event, step=name, seconds=self.timings[name], fitted=self.store.fitted, found=self.store.found)
        return out

    def whole(self, path: str) -> bool:
        """Whether a table was written there to its end."""
        return IO.exists(self.spark, f"{path}/_SUCCESS")

    def table(self, name: str, rows: DataFrame) -> DataFrame:
        """A table of the results, read again if a run of the same digest wrote it, else written and read."""
        path = f"{self.folder}/tables/{name}"
        if not self.whole(path):
            rows.write.mode("overwrite").parquet(path)
        self.tables[name] = self.spark.read.parquet(path)
        return self.tables[name]

    def rows(self, name: str, rows: list[dict], schema: str) -> DataFrame:
        return self.table(name, self.frame(rows, schema))

    def frame(self, rows: list[dict], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    def stage(self, name: str, make: Callable[[], dict[str, DataFrame]], names: Sequence[str]) -> dict[str, DataFrame]:
        """The tables of a part of a step, made only if one of them is missing. The last one is written last, so that a part
        that was cut short is made again."""
        path = lambda x: f"{self.folder}/private/stages/{name}-{x}"
        if not all(self.whole(path(x)) for x in names):
            made = make()
            for x in names:
                made[x].write.mode("overwrite").parquet(path(x))
        return {x: self.spark.read.parquet(path(x)) for x in names}


# --- steps -----------------------------------------------------------------------------------------


def audit(run: Run, docs: DataFrame, c: Config) -> DataFrame:
    """The documents that are long enough, cleaned, with their near-duplicate family (doc_id, text, family); writes the
    manifest of all of them."""
    require_unique(require_columns(docs, ["doc_id", "text"]), ["doc_id"])
    text = T.clean_unicode(F.coalesce("text", F.lit("")))
    clean = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), text.alias("text"))
    if c.strip_references:
        clean = clean.withColumn("cut", G.reference_start(F.col("text"), REFERENCE_HEADINGS))
        clean = clean.withColumn("text", F.when(F.col("cut").isNotNull(), F.substr("text", F.lit(1), F.col("cut").cast("int"))).otherwise(F.col("text")))
    clean = written(clean, "clean")
    gate = G.token_gate(clean, c.min_document_tokens)
    families = S.near_duplicate_groups(clean.select("doc_id", "text"), c.near_duplicate_threshold).withColumnRenamed("group", "family")
    manifest = run.table("corpus_manifest", clean.select("doc_id", "sha256", T.body_hash(F.col("text")).alias("body_hash"), T.count_words(F.col("text")).alias("words")).join(gate, "doc_id").join(families, "doc_id"))
    kept = manifest.filter("status = 'ok'").select("doc_id", "family")
    if kept.isEmpty():
        raise IntegrityError(f"no document has {c.min_document_tokens} tokens")
    return written(clean.select("doc_id", "text").join(kept, "doc_id"), "kept")


def represent(docs: DataFrame, c: Config, learn: DataFrame | None = None) -> Representation:
    """``docs`` in numbers, phrases and vocabulary learned on ``learn`` (doc_id; all)."""
    own = lambda rows: rows if learn is None else rows.join(learn.select("doc_id"), "doc_id", "left_semi")
    by_rules = c.lemmatize and c.lemma_dictionary is None
    tokens = written(V.token_rows(docs, list(c.stop), lemma=T.noun_lemma() if by_rules else None), "tokens")
    if c.lemmatize and not by_rules:
        tokens = written(L.lemmatized(tokens, L.noun_dictionary(docs.sparkSession, c.lemma_dictionary), list(c.stop)), "lemmatized")
    if c.learned_phrases:
        for _ in range(2):  # pairs, then longer ones
            phrases = V.phrase_scores(own(tokens), c.phrase_min_count, c.phrase_threshold)
            tokens = written(V.merge_phrases(tokens, phrases), "phrased")
    n = own(docs).count()
    vocab = checkpointed(V.vocabulary(own(tokens), n, c.min_df, c.max_df, c.max_features))
    terms = [r["term"] for r in vocab.orderBy("term_id").collect()]  # max_features at most
    if not terms:
        raise IntegrityError("no term is found in enough documents")
    units = written(M.unit_rows(V.bag_of_words(V.units(tokens, c.chunk_size, c.min_tail), vocab)), "units")
    training = own(units)
    if c.train_chunks_per_doc is not None:
        training = V.evenly_spaced(training, "doc_id", "unit", c.train_chunks_per_doc)
    return Representation(tokens, terms, units, written(training, "training"))


def lists_of(m: M.TopicModel, terms: list[str], n: int) -> list[list[str]]:
    return [[terms[i] for i in np.argsort(-row, kind="stable")[:n]] for row in M.phi_matrix(m)]


def cross_validate(run: Run, docs: DataFrame, c: Config) -> DataFrame:
    """A row for each number of topics: means over folds of coherence, predictive score, stability over seeds, diversity and
    convergence. All models of a fold share the passes over its units."""
    folds = P.grouped_folds(docs.select(F.col("family").alias("group")), c.folds, c.split_seed).withColumnRenamed("group", "family")
    splits = run.table("document_validation_splits", docs.select("doc_id", "family").join(folds, "family"))
    names = ("pairs", "runs")
    made = [run.stage(f"fold-{fold}", lambda fold=fold: _fold(run, docs, splits, c, fold), names) for fold in range(c.folds)]
    pairs, table = (run.table(name, reduce(DataFrame.union, [m[x] for m in made])) for x, name in zip(names, ("seed_stability_cv", "model_selection_runs"), strict=True))
    out = pairs.groupBy("k").agg(F.avg("similarity").alias("stability"))
    for metric in ("c_v", "c_npmi", "score", "diversity", "converged"):
        s = P.fold_summary(table, metric)
        out = out.join(s.select("k", *[F.col(x).alias(f"{metric}_{x}") for x in ("mean", "sd", "se", "seed_sd")]), "k")
    return run.table("model_selection_summary", out)


def _fold(run: Run, docs: DataFrame, splits: DataFrame, c: Config, fold: int) -> dict[str, DataFrame]:
    """A fold's models, scored: a row for each model, and one for each pair of seeds."""
    runs, stability = [], []
    train, held = (splits.filter(F.col("fold") != fold), splits.filter(F.col("fold") == fold))
    rep = represent(docs, c, train)
    asked = [(k, seed) for k in c.k_values for seed in c.seeds]
    fitted = run.store.fit_all(rep.training, [c.settings(k, seed) for k, seed in asked], len(rep.terms))
    unigram = _unigram(rep.units.join(train.select("doc_id"), "doc_id", "left_semi"), len(rep.terms))
    halves = _halves(rep.units.join(held.select("doc_id"), "doc_id", "left_semi"), c.split_seed)
    scores = {r["m"]: r for r in P.completion_by(M.completion(fitted, unigram, halves), "m").collect()}  # a row for each model
    tops = [words for m in fitted for words in lists_of(m, rep.terms, c.coherence_topn)]
    own = rep.tokens.join(train.select("doc_id"), "doc_id", "left_semi")
    c_v, c_npmi = M.coherence(own, tops, 110), M.coherence(own, tops, 10, "c_npmi")
    at = 0
    for i, ((k, seed), m) in enumerate(zip(asked, fitted, strict=True)):
        words = [w for t in tops[at : at + k] for w in t]
        runs.append({
            "fold": fold, "k": k, "seed": seed, "iterations": m.iterations, "converged": float(m.converged), "c_v": float(np.mean(c_v[at : at + k])), "c_npmi": float(np.mean(c_npmi[at : at + k])),
            "diversity": len(set(words)) / max(1, len(words)), "score": scores[i]["macro"] if i in scores else float("nan"), "gain": scores[i]["gain"] if i in scores else float("nan"),
        })
        at += k
    for k in c.k_values:
        pairs, _ = M.seed_stability({seed: M.phi_matrix(m) for (j, seed), m in zip(asked, fitted, strict=True) if j == k})
        stability += [{"fold": fold, "k": k, **p} for p in pairs]
    return {
        "runs": run.frame(runs, "fold int, k int, seed int, iterations int, converged double, c_v double, c_npmi double, diversity double, score double, gain double"),
        "pairs": run.frame(stability, "fold int, k int, seed_a int, seed_b int, similarity double, jaccard double"),
    }


def _unigram(units: DataFrame, terms: int) -> np.ndarray:
    """The units' term probabilities, a token added to each term so that none is impossible."""
    counts = units.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).collect()  # a row for each term
    p = np.ones(terms)
    for t, n in counts:
        p[t] += n
    return p / p.sum()


def _halves(units: DataFrame, seed: int) -> DataFrame:
    """Units with the observed and target halves of their counts; units of which a half is empty are an error where they
    have ten tokens or more, and else are left to the observed half, as one can't be predicted from the other."""
    rows = units.select("doc_id", "unit", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("doc_id", "unit", F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("n"))
    halves = checkpointed(P.thinned(rows, ["doc_id", "unit", "term"], seed))
    size = halves.groupBy("doc_id", "unit").agg(F.sum("n").alias("size"))
    P.require_halves(halves.join(size, ["doc_id", "unit"]).filter("size >= 10"), ["doc_id", "unit"])
    packed = F.array_sort(F.collect_list(F.struct("term", F.col("observed").cast("double").alias("o"), F.col("target").cast("double").alias("t"))))
    wide = halves.groupBy("doc_id", "unit").agg(packed.alias("x"), F.sum("target").alias("t"), F.sum("observed").alias("o")).filter("t > 0 AND o > 0")
    pick = lambda f: F.transform("x", lambda x: x[f])
    return wide.select("doc_id", "unit", pick("term").alias("terms"), pick("o").alias("observed"), pick("t").alias("target"))


def choose(run: Run, summary: DataFrame, c: Config) -> dict:
    s = summary.select(
        "k", F.col("c_v_mean").alias("coherence"), F.coalesce("c_v_se", F.lit(0.0)).alias("coherence_se"), "stability", F.col("diversity_mean").alias("diversity"),
        F.col("converged_mean").alias("converged"), F.col("score_mean").alias("score"), F.coalesce("score_se", F.lit(0.0)).alias("score_se"),
    )
    best = P.recommended_k(s, c.coherence_tolerance, c.minimum_stability, c.minimum_diversity, c.minimum_converged).first().asDict()
    decision = {**best, "final_k": c.final_k or best["recommended_k"], "profile": c.profile}
    IO.write_text(run.spark, json.dumps(decision, indent=1), f"{run.folder}/decision.json")
    return decision


def finish(run: Run, docs: DataFrame, c: Config, decision: dict) -> tuple[Representation, M.TopicModel, DataFrame]:
    """Fits the final candidates on all documents; writes the medoid's topics, weights and prevalence; returns the
    representation, that model, and the documents' weights."""
    rep = represent(docs, c)
    ks = P.final_candidates(decision["final_k"], c.k_values)
    asked = [(k, seed) for k in ks for seed in c.seeds]
    fitted = dict(zip(asked, run.store.fit_all(rep.training, [c.settings(k, seed) for k, seed in asked], len(rep.terms)), strict=True))
    trace = [{"k": k, "seed": seed, **t} for (k, seed), m in fitted.items() for t in m.trace]
    run.rows("convergence_traces", trace, "k int, seed int, iteration int, perplexity double, bound double, bound_per_token double")
    pairs, final = [], None
    for k in ks:
        own = {seed: fitted[k, seed] for seed in c.seeds}
        thetas = reduce(DataFrame.union, [P.token_weighted(M.infer(m, rep.units)).select(F.lit(seed).alias("seed"), "doc_id", "topic", "w") for seed, m in own.items()])
        found, medoid = M.seed_stability({seed: M.phi_matrix(m) for seed, m in own.items()}, written(thetas, "thetas"), c.coherence_topn)
        pairs += [{"k": k, **p} for p in found]
        if k == decision["final_k"]:
            final = own[medoid]
    run.rows("seed_stability", pairs, "k int, seed_a int, seed_b int, similarity double, jaccard double, ari double, l1 double")
    k, phi = final.settings.k, M.phi_matrix(final)
    unit_theta = written(M.infer(final, rep.units), "unit-theta")
    theta = run.table("document_topics", P.token_weighted(unit_theta))
    prevalence = P.prevalence(unit_theta).join(P.bootstrap_interval(theta, c.resamples), "topic")
    run.table("topic_prevalence", prevalence)
    long = run.spark.createDataFrame([(t, rep.terms[i], float(p)) for t, row in enumerate(phi) for i, p in enumerate(row)], "topic int, term string, p double")  # topics by max_features
    words = run.table("topic_words", long)
    weights = theta.groupBy("topic").agg(F.avg("w").alias("weight"))
    shown = P.term_table(words, weights, list(c.stop), shown=c.coherence_topn)
    run.table("topic_terms", shown)
    run.table("topic_similarity", P.topic_distances(words))
    run.table("representative_documents", P.representative_documents(theta))
    run.table("document_influence", P.influence(theta))
    run.table("theta_diagnostics", P.diagnostics(theta))
    tops = lists_of(final, rep.terms, c.coherence_topn)
    v, n = M.coherence(rep.tokens, tops, 110), M.coherence(rep.tokens, tops, 10, "c_npmi")
    run.rows("topic_coherence", [{"topic": t, "c_v": v[t], "c_npmi": n[t]} for t in range(k)], "topic int, c_v double, c_npmi double")
    tasks = P.intruder_tasks(P.top_terms(words, 30), words)
    for name, rows in zip(("worksheet", "worksheet_key"), IO.worksheets(tasks), strict=True):
        run.table(name, rows)
    M.save(run.spark, final, f"{run.folder}/private/model")
    return rep, final, theta


def network(run: Run, docs: DataFrame, rep: Representation, c: Config) -> None:
    rows = run.table("keyword_network", V.keyword_network(rep.tokens, docs.count(), c.network_terms, max_edges=c.network_max_edges))
    edges = [tuple(r) for r in rows.select("source", "target", "jaccard").collect()]  # network_max_edges at most
    run.rows("keyword_communities", [{"term": t, "community": g} for t, g in sorted(V.greedy_communities(edges).items())], "term string, community int")


def refits(run: Run, docs: DataFrame, rep: Representation, final: M.TopicModel, theta: DataFrame, c: Config) -> None:
    """The variants of units and priors over the same vocabulary, three seeds each, against the final model and, seed by
    seed, against models of its own settings."""
    vocab = run.spark.createDataFrame([(t, i) for i, t in enumerate(rep.terms)], "term string, term_id int")
    bags = lambda units: written(M.unit_rows(V.bag_of_words(units, vocab)), "variant")
    capped = lambda rows: rows if c.train_chunks_per_doc is None else V.evenly_spaced(rows, "doc_id", "unit", c.train_chunks_per_doc)
    whole, small, large = bags(rep.tokens.withColumn("unit", F.lit(0))), bags(V.units(rep.tokens, 200, 50)), bags(V.units(rep.tokens, 800, 100))
    variants = [M.Variant("whole_document_units", whole, whole), M.Variant("chunks_200", small, capped(small)), M.Variant("chunks_800", large, capped(large))]
    variants.append(M.Variant("uncapped_training_chunks", rep.units, rep.units))
    variants += [M.Variant("alpha_0_1", rep.units, rep.training, {"alpha": 0.1}), M.Variant("eta_0_1", rep.units, rep.training, {"eta": 0.1})]
    seeds = c.seeds[:3]
    rows, phis = M.sensitivity(final, theta, variants, seeds, len(rep.terms), run.store.fit_all)
    run.rows("sensitivity_runs", rows, "variant string, seed int, iterations int, converged boolean, similarity double, jaccard double, l1 double, largest_shift double")
    run.table("sensitivity_summary", P.sensitivity_summary(run.tables["sensitivity_runs"], "variant"))
    base = dict(zip(seeds, map(M.phi_matrix, run.store.fit_all(rep.training, [replace(final.settings, seed=s) for s in seeds], len(rep.terms))), strict=True))
    pairs, summary = M.paired_audit(base, phis)
    run.rows("paired_sensitivity_pairs", pairs, "variant string, seed int, similarity double, jaccard double, largest double")
    run.rows("paired_sensitivity_summary", summary, "variant string, n int, mean_similarity double, min_similarity double, max_similarity double, mean_jaccard double, largest double")


# --- checks of what was written ----------------------------------------------------------------------

REQUIRED = (
    "corpus_manifest", "document_validation_splits", "model_selection_summary", "convergence_traces", "document_topics", "topic_prevalence", "topic_words", "topic_terms",
    "topic_similarity", "keyword_network", "seed_stability",
)


def integrity(tables: Mapping[str, DataFrame], documents: int, training: DataFrame, folds: int, report: str) -> dict[str, bool]:
    """Named checks of a run's tables; all must hold. ``documents``: how many the models saw; ``training``: its units."""
    close = lambda rows, by, value: rows.groupBy(*by).agg(F.sum(value).alias("s")).filter("abs(s - 1) > 1e-6").isEmpty()
    theta, words, splits = tables["document_topics"], tables["topic_words"], tables["document_validation_splits"]
    similarity = tables["topic_similarity"]
    shown = tables["topic_terms"].filter("display_rank IS NOT NULL")
    topics = words.select("topic").distinct().count()
    return {
        "all document rows present": theta.select("doc_id").distinct().count() == documents,
        "document probabilities sum to one": close(theta, ["doc_id"], "w"),
        "mean prevalence sums to one": abs((tables["topic_prevalence"].agg(F.sum("equal_document")).first()[0] or 0.0) - 1) < 1e-6,
        "counts are not negative": training.filter(F.exists("counts", lambda n: n < 0)).isEmpty(),
        "training units are unlike": training.groupBy("doc_id", "unit").count().filter("count > 1").isEmpty(),
        "no family is on both sides of a fold": splits.groupBy("family").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty(),
        "every document is validated once": splits.groupBy("doc_id").count().filter("count <> 1").isEmpty() and splits.filter(~F.col("fold").between(0, folds - 1)).isEmpty(),
        "topic words sum to one": close(words, ["topic"], "p"),
        "shown ranks are gapless": shown.groupBy("topic").agg(F.max("display_rank").alias("m"), F.count("*").alias("n")).filter("m <> n").isEmpty(),
        "similarities lie between 0 and 1": similarity.filter("similarity < -1e-9 OR similarity > 1 + 1e-9 OR js < 0").isEmpty(),
        "each pair of topics is compared once": similarity.filter("a >= b").isEmpty() and similarity.groupBy("a", "b").count().filter("count > 1").isEmpty() and similarity.count() <= topics * (topics - 1) // 2,
        "requested tables exist": set(REQUIRED) <= set(tables),
        "the report names every table": all(name in report for name in tables),
    }


#: What each table of a run holds.
ABOUT = {
    "corpus_manifest": "Each document with digests of its file and body, its words and tokens, whether it is long enough, and its near-duplicate family.",
    "document_validation_splits": "The fold of each document; a family is never on both sides.",
    "model_selection_runs": "Each model of the cross-validation: coherence, predictive score and gain over a unigram, diversity, convergence.",
    "model_selection_summary": "The same by number of topics: means, deviations and errors over folds, and the mean stability over seeds.",
    "seed_stability_cv": "For each fold and pair of seeds how alike the matched topics are.",
    "seed_stability": "The same for the fits on all documents, with the agreement of dominant topics and the distance of weights.",
    "convergence_traces": "Perplexity and bound of each update of the fits on all documents.",
    "document_topics": "Each document's topic weights, its units weighted by tokens.",
    "topic_prevalence": "Each topic's mean weight by four weightings, the documents it dominates, and a bootstrap interval.",
    "topic_words": "Each topic's probabilities of all terms.",
    "topic_terms": "Each topic's terms ranked for display, with exclusivity and lift.",
    "topic_similarity": "Jensen-Shannon distance and similarity of each pair of topics.",
    "representative_documents": "The documents of most weight in each topic.",
    "document_influence": "How far leaving a document out moves a topic's mean, at most.",
    "theta_diagnostics": "Mean and median entropy of the documents' weights, and the least dominant weight.",
    "topic_coherence": "Coherence of each topic's first terms, by two measures.",
    "worksheet": "Raters' tasks: a topic's terms and an intruder, unmarked.",
    "worksheet_key": "The intruder of each task.",
    "keyword_network": "Pairs of keywords that occur in the same documents, the strongest ones.",
    "keyword_communities": "Communities of that network.",
    "sensitivity_runs": "Each refit with other units or priors against the final model.",
    "sensitivity_summary": "The same by variant.",
    "paired_sensitivity_pairs": "Each refit against the model of the same seed and the final settings.",
    "paired_sensitivity_summary": "The same by variant.",
    "verification": "The checks of these tables.",
    "run_record": "Settings, digests, versions, host and seconds of the run.",
}


def methods(c: Config, facts: Mapping[str, object]) -> str:
    """How the run came to its tables, in words, with its settings."""
    units = f"{c.chunk_size} tokens, a tail of fewer than {c.min_tail} joined to the unit before"
    cap = "all units of a document are trained on" if c.train_chunks_per_doc is None else f"at most {c.train_chunks_per_doc} units of a document, evenly spaced, are trained on"
    lemma = "are kept as they stand" if not c.lemmatize else "are reduced to nouns' singulars by suffix rules" if c.lemma_dictionary is None else "are reduced to lemmas by a dictionary of nouns"
    phrases = f"Phrases that come {c.phrase_min_count} times or more and score over {c.phrase_threshold:g} are one token each." if c.learned_phrases else "No phrases are learned."
    alpha = "one over their number" if c.alpha is None else f"{c.alpha:g}"
    parts = [
        ("Corpus", f"{facts['documents']} documents of {c.min_document_tokens} tokens or more. Texts whose cosine over character grams is {c.near_duplicate_threshold:g} or more are one family; all are kept." + (" What follows a heading of references is left out." if c.strip_references else "")),
        ("Representation", f"Tokens {lemma}; stop words and repeats of the token before go. {phrases} The vocabulary holds the {c.max_features} most frequent terms of {c.min_df} documents or more and at most {c.max_df:.0%} of them. Units are of {units}; {cap}."),
        ("Models", f"Latent Dirichlet allocation by batch variational Bayes, at most {c.max_iter} updates, until the perplexity changes by less than {c.tolerance:g}; topics' prior {alpha}, terms' prior {c.eta:g}."),
        ("Number of topics", f"{', '.join(map(str, c.k_values))} topics, {len(c.seeds)} seeds and {c.folds} folds each. Of those within {c.coherence_tolerance:g} of the best coherence that reach a stability of {c.minimum_stability:g}, a diversity of {c.minimum_diversity:g} and a converged share of {c.minimum_converged:g} the rule recommends {facts['recommended topics']}; the final model has {facts['topics']}" + (", as the settings ask." if c.final_k else ".")),
        ("Final model", f"The medoid of {len(c.seeds)} seeds (seed {facts['seed']}), {facts['updates']} updates. Prevalence has bootstrap intervals of {c.resamples} resamples of documents."),
        ("Sensitivity", "Units of other lengths, all units, and other priors, three seeds each." if c.run_sensitivity else "Not run."),
    ]
    return "\n".join(["# Methods", ""] + [line for name, text in parts for line in (f"## {name}", "", text, "")])


def run(docs: DataFrame, output: str, config: Config = Config()) -> dict:
    """The whole analysis of ``docs`` (doc_id, text); returns the folder, the decision and the checks."""
    spark, c = docs.sparkSession, config.checked()
    shared_folder(spark)
    # the corpus' digest does not depend on the order of its rows
    corpus = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)")).alias("h")).first()
    record = IO.run_record(spark, {**asdict(c), "documents": corpus["n"], "corpus": str(corpus["h"])})
    here = Run(spark, f"{output}/run_{record.first()['digest'][:12]}", f"{output}/fits")
    kept = here.step("audit", audit, docs, c)
    summary = here.step("cross_validate", cross_validate, kept, c)
    decision = here.step("choose", choose, summary, c)
    rep, final, theta = here.step("finish", finish, kept, c, decision)
    here.step("network", network, kept, rep, c)
    if c.run_sensitivity:
        here.step("refits", refits, kept, rep, final, theta, c)
    n = kept.count()
    facts = {"profile": c.profile, "documents": n, "topics": final.settings.k, "seed": final.settings.seed, "updates": final.iterations, "converged": final.converged, "recommended topics": decision["recommended_k"], "gates passed": decision["gates_passed"]}
    prose = [
        "The bound is variational, not an exact likelihood; predictive scores infer weights from one half of the counts and score the other.",
        "Folds keep near-duplicate families together and guide the choice of the number of topics; they are no untouched test set. Where no number of topics passes all gates, the choice is exploratory.",
        "Tables: " + ", ".join(sorted(here.tables)) + ".",
    ]
    text = IO.report("Analysis run", facts, {name: here.tables[name] for name in ("model_selection_summary", "topic_prevalence", "topic_coherence")}, prose)
    IO.write_text(spark, text, f"{here.folder}/report.md")
    IO.write_text(spark, methods(c, facts), f"{here.folder}/methods.md")
    checks = integrity(here.tables, n, rep.training, c.folds, text)
    here.rows("verification", [{"check": k, "passed": v} for k, v in checks.items()], "check string, passed boolean")
    here.table("run_record", IO.run_record(spark, {**asdict(c), "documents": corpus["n"], "corpus": str(corpus["h"])}, here.timings))
    IO.write_text(spark, IO.table_guide("Tables of the run", here.tables, ABOUT), f"{here.folder}/tables.md")
    if not all(checks.values()):
        raise IntegrityError(f"checks failed: {[k for k, v in checks.items() if not v]}")
    here.table("package_manifest", IO.package_manifest(spark, here.folder, ["/private/"]))
    return {"folder": here.folder, "decision": decision, "checks": checks, "documents": n}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", required=True, help="a Parquet table with doc_id and text")
    parser.add_argument("--output", required=True)
    parser.add_argument("--profile", choices=["research", "smoke"], default="research")
    parser.add_argument("--config-json", help="other settings, as JSON text")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    other = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(args.config_json or "{}").items()}
    out = run(spark.read.parquet(args.input).select("doc_id", "text"), args.output, Config(**{**other, "profile": args.profile}))
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
