"""Operators downstream of a topic model.

theta rows are (doc_id, topic, w), one per document and topic; phi rows are
(topic, term, p). Both are long; topics number a dozen or so, which bounds the
topic-by-topic tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import measures as M
from inkstone.operators.relational import IntegrityError, exact_quantile, numbered
from inkstone.storage import written


# --- document weights -----------------------------------------------------------------------


def long_theta(rows: DataFrame, weights: str = "theta") -> DataFrame:
    """(doc_id, ..., topic, w) from an array column; topics count from 0."""
    rest = [c for c in rows.columns if c != weights]
    return rows.select(*rest, F.posexplode(weights).alias("topic", "w"))


def token_weighted(unit_theta: DataFrame) -> DataFrame:
    """Document weights from unit weights (doc_id, n, topic, w): by tokens, renormalized."""
    rows = unit_theta.groupBy("doc_id", "topic").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w"))
    return rows.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")))


def equal_units(unit_theta: DataFrame) -> DataFrame:
    """Document weights as the mean over units, renormalized."""
    rows = unit_theta.groupBy("doc_id", "topic").agg(F.avg("w").alias("w"))
    return rows.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("doc_id")))


def dominant(theta: DataFrame) -> DataFrame:
    """(doc_id, topic, w): each document's heaviest topic, the first of equal ones."""
    best = theta.groupBy("doc_id").agg(F.max(F.struct("w", (-F.col("topic")).alias("t"))).alias("m"))
    return best.select("doc_id", (-F.col("m.t")).alias("topic"), F.col("m.w").alias("w"))


def dominant_counts(theta: DataFrame) -> DataFrame:
    return dominant(theta).groupBy("topic").agg(F.count("*").alias("documents"))


def prevalence(unit_theta: DataFrame) -> DataFrame:
    """(topic, equal_document, equal_chunk, equal_unit, token_weighted, dominant): weightings of the same units - documents
    equal, their units by tokens or equal; units equal; tokens equal - and the documents that a topic dominates."""
    docs = token_weighted(unit_theta)
    a = docs.groupBy("topic").agg(F.avg("w").alias("equal_document"))
    e = equal_units(unit_theta).groupBy("topic").agg(F.avg("w").alias("equal_chunk"))
    b = unit_theta.groupBy("topic").agg(F.avg("w").alias("equal_unit"), (F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("token_weighted"))
    c = dominant_counts(docs).withColumnRenamed("documents", "dominant")
    return a.join(e, "topic").join(b, "topic").join(c, "topic", "left").fillna(0, ["dominant"])


def poisson_copies(ids: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """[resamples, documents]: how often each document stands in each resample, Poisson with mean 1, from a hash of both;
    ``ids`` are the documents' 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[None, :] ^ ((np.arange(resamples, dtype=np.uint64)[:, None] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, (x >> np.uint64(11)).astype(float) / float(1 << 53), side="right")


def bootstrap_interval(theta: DataFrame, resamples: int = 2000, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """(topic, low, high): quantiles of the mean weight over resamples of documents (``poisson_copies``). A task sums its
    documents for all resamples at once and brings a row for each resample and topic, however many documents it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            topics, w = b.column(1).to_numpy(), b.column(2).to_numpy()
            ids, place = np.unique(b.column(0).to_numpy(), return_inverse=True)
            for k in range(0, len(ids), 256):
                copies = poisson_copies(ids[k : k + 256], resamples, seed)
                for t in np.unique(topics).tolist():
                    own = (topics == t) & (place >= k) & (place < k + 256)
                    part = sums.setdefault(t, np.zeros((2, resamples)))
                    each = copies[:, place[own] - k]
                    part += np.stack([each @ w[own], each.sum(axis=1)])
        for t, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t] * resamples, pa.int32()), pa.array(np.arange(resamples), pa.int32()), pa.array(part[0]), pa.array(part[1])], ["topic", "r", "w", "n"])

    rows = theta.select(F.xxhash64("doc_id").alias("id"), F.col("topic").cast("int").alias("topic"), F.col("w").cast("double").alias("w"))
    means = rows.mapInArrow(run, "topic int, r int, w double, n double").groupBy("topic", "r").agg((F.sum("w") / F.sum("n")).alias("m"))
    return means.groupBy("topic").agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))


def influence(theta: DataFrame) -> DataFrame:
    """(doc_id, influence): the largest change of a topic's mean when the document is left out, in percentage points."""
    sums = theta.groupBy("topic").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    rows = theta.join(F.broadcast(sums), "topic")  # a row for each topic
    change = F.abs((F.col("s") - F.col("w")) / (F.col("n") - 1) - F.col("s") / F.col("n")) * 100
    return rows.groupBy("doc_id").agg(F.max(change).alias("influence"))


def diagnostics(theta: DataFrame) -> DataFrame:
    """One row: mean and median entropy of documents, and the least dominant weight. The median is exact, and found by
    counts."""
    h = F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(0.0))
    docs = written(theta.groupBy("doc_id").agg(h.alias("h"), F.max("w").alias("top")), "entropy")
    median = F.lit(exact_quantile(docs, "h", 0.5)).cast("double")
    return docs.agg(F.avg("h").alias("mean_entropy"), median.alias("median_entropy"), F.min("top").alias("least_dominant"))


def representative_documents(theta: DataFrame, limit: int = 3) -> DataFrame:
    """(topic, rank, doc_id, w): the documents of most weight, ties by doc_id."""
    w = Window.partitionBy("topic").orderBy(F.desc("w"), "doc_id")
    return theta.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("topic", "rank", "doc_id", "w")


def best_units(unit_theta: DataFrame, chosen: DataFrame) -> DataFrame:
    """(topic, doc_id, unit): of each chosen (topic, doc_id) the unit of most weight, the first of equal ones."""
    rows = unit_theta.join(chosen.select("topic", "doc_id"), ["topic", "doc_id"])
    best = rows.groupBy("topic", "doc_id").agg(F.max(F.struct("w", (-F.col("unit")).alias("u"))).alias("m"))
    return best.select("topic", "doc_id", (-F.col("m.u")).alias("unit"), F.col("m.w").alias("w"))


# --- words ----------------------------------------------------------------------------------


def normalized_phi(counts: DataFrame, smoothing: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """(topic, term, p) from (topic, term, n), with the columns ``keep``."""
    n = F.col("n") + smoothing
    whole = F.broadcast(counts.groupBy(F.col("topic").alias("__topic")).agg(F.sum(n).alias("__all")))  # a row for each topic
    return counts.join(whole, F.col("topic").eqNullSafe(F.col("__topic"))).select("topic", "term", *keep, (n / F.col("__all")).alias("p"))


def top_terms(phi: DataFrame, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.desc("p"), "term")
    return phi.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def background(phi: DataFrame, weights: DataFrame) -> DataFrame:
    """(term, bg): the terms' probabilities under the topics' weights (topic, weight)."""
    return phi.join(F.broadcast(weights), "topic").groupBy("term").agg(F.sum(F.col("p") * F.col("weight")).alias("bg"))


# The weights of the display score and of the first generation's score, and what a phrase adds to each.
P_WEIGHT, LIFT_WEIGHT, PHRASE_BONUS = 0.6, 0.4, 0.1
PLAIN_WEIGHT, EXCLUSIVE_WEIGHT, PHRASE_FACTOR = 0.35, 0.65, 1.15


def term_table(phi: DataFrame, weights: DataFrame, hidden: Sequence[str] = (), pool: int = 100, shown: int = 10) -> DataFrame:
    """The ``pool`` likeliest terms of each topic with exclusivity, lift, display score and display rank; hidden terms
    are scored but not ranked."""
    wide = phi.join(background(phi, weights), "term").withColumn("exclusivity", F.col("p") / F.sum("p").over(Window.partitionBy("term")))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "term"))
    rows = wide.withColumn("raw_rank", rank).filter(F.col("raw_rank") <= pool).withColumn("lift", F.col("p") / F.col("bg"))
    score = P_WEIGHT * F.log("p") + LIFT_WEIGHT * F.log("lift") + F.when(F.col("term").contains("_"), PHRASE_BONUS).otherwise(0.0)
    rows = rows.withColumns({"score": score, "hidden": F.col("term").isin(*hidden) if hidden else F.lit(False)})
    place = F.row_number().over(Window.partitionBy("topic", "hidden").orderBy(F.desc(F.round("score", 9)), "term"))
    return rows.withColumn("display_rank", F.when(~F.col("hidden") & (place <= shown), place)).select("topic", "term", "raw_rank", "p", "exclusivity", "lift", "score", "hidden", "display_rank")


def exclusive_score(phi: DataFrame) -> DataFrame:
    """The first-generation score: probability by exclusivity, phrases favoured."""
    rows = phi.withColumn("exclusivity", F.col("p") / F.sum("p").over(Window.partitionBy("term")))
    score = F.col("p") * (PLAIN_WEIGHT + EXCLUSIVE_WEIGHT * F.col("exclusivity")) * F.when(F.col("term").contains("_"), PHRASE_FACTOR).otherwise(1.0)
    return rows.withColumn("score", score)


def unique_keywords(ranked: Sequence[tuple[int, str, float]], limit: int = 10, family=lambda term: term) -> list[tuple[int, str]]:
    """Display terms used once only: topics in order, terms by score; a term whose family is taken is passed over.
    ``ranked``: (topic, term, score) rows of the candidate pools, topics times pool in number."""
    used: set[str] = set()
    out = []
    for topic in sorted({t for t, *_ in ranked}):
        n = 0
        for _, term, _ in sorted((r for r in ranked if r[0] == topic), key=lambda r: (-r[2], r[1])):
            if n < limit and family(term) not in used:
                used.add(family(term))
                out.append((topic, term))
                n += 1
    return out


def label(words: Column, rules: Sequence[tuple[str, Sequence[str]]], fallback: Column) -> Column:
    """The first rule's label whose keywords meet ``words``, else ``fallback``."""
    out = None
    for name, keys in rules:
        hit = F.arrays_overlap(words, F.array(*map(F.lit, keys)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return fallback if out is None else out.otherwise(fallback)


def diversity(top: DataFrame) -> DataFrame:
    """One row: distinct terms over all places in the topics' lists."""
    return top.agg((F.countDistinct("term") / F.count("*")).alias("diversity"))


# --- topics against topics --------------------------------------------------------------------


def topic_distances(phi: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b, js, similarity) for each pair of topics of ``phi`` and ``other`` (itself: a < b).

    A term adds js_term(p, q) to the pair's divergence; where one side lacks it, half of the other's p. So the sum
    over common terms, and what they leave of each side's mass, give the whole without a row for a missing term."""
    b = phi if other is None else other
    left, right = phi.select(F.col("topic").alias("a"), "term", F.col("p").alias("p")), b.select(F.col("topic").alias("b"), "term", F.col("p").alias("q"))
    common = left.join(right, "term").filter("a < b" if other is None else "true")
    sums = common.groupBy("a", "b").agg(F.sum(M.js_term(F.col("p"), F.col("q"))).alias("s"), F.sum("p").alias("pa"), F.sum("q").alias("qb"))
    divergence = F.col("s") + (1 - F.col("pa")) / 2 + (1 - F.col("qb")) / 2
    return sums.select("a", "b", F.sqrt(F.greatest(divergence, F.lit(0.0))).alias("js"), M.js_similarity(divergence).alias("similarity"))


def term_overlap(top: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard) of the topics' term lists."""
    sets = lambda t, k: t.groupBy(F.col("topic").alias(k)).agg(F.array_sort(F.collect_set("term")).alias(f"s{k}"))
    x, y = sets(top, "a"), sets(top if other is None else other, "b")
    pairs = x.join(F.broadcast(y), F.col("a") < F.col("b") if other is None else F.lit(True))  # topics squared
    return pairs.select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("jaccard"))


def best_match(overlap: DataFrame) -> DataFrame:
    """(a, jaccard): each topic's closest topic of the other model, which may serve several."""
    return overlap.groupBy("a").agg(F.max("jaccard").alias("jaccard"))


def matched(cost: np.ndarray) -> list[int]:
    """The assignment of rows to columns of least total cost (rows at most as many as columns), on the driver: rows are
    placed one by one along the cheapest path of swaps, kept cheap by prices of rows and columns."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    holder = np.full(m, -1)
    for row in range(n):
        least, before = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        at, reached, col = row, 0.0, -1
        while True:
            through = reached + cost[at] - row_price[at] - col_price
            better = ~done & (through < least)
            least[better], before[better] = through[better], col
            open_least = np.where(done, np.inf, least)
            col = int(open_least.argmin())
            reached = float(open_least[col])
            done[col] = True
            if holder[col] < 0:
                break
            at = int(holder[col])
        passed = done & (least < reached)
        row_price[row] += reached
        for c in np.flatnonzero(passed):
            row_price[holder[c]] += reached - least[c]
            col_price[c] -= reached - least[c]
        while col >= 0:
            last = int(before[col])
            holder[col] = holder[last] if last >= 0 else row
            col = last
    out = [0] * n
    for c, r in enumerate(holder.tolist()):
        if r >= 0:
            out[r] = c
    return out


def adjusted_rand_of(cells: Mapping[tuple, int]) -> float:
    """The adjusted Rand index from counts of pairs of labels; 1 where it has no value, as all labellings agree then."""
    two = lambda n: n * (n - 1) / 2
    sums: tuple[dict, dict] = ({}, {})
    for labels, n in cells.items():
        for side, label in zip(sums, labels, strict=True):
            side[label] = side.get(label, 0) + n
    a, b, c, all_ = (sum(map(two, sums[0].values())), sum(map(two, sums[1].values())), sum(map(two, cells.values())), two(sum(cells.values())))
    due = a * b / all_ if all_ else 0.0
    return 1.0 if (a + b) / 2 == due else (c - due) / ((a + b) / 2 - due)


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index of two labellings (x, y), from their contingency counts."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    two = lambda c: F.sum(c * (c - 1) / 2)
    a = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("a"))
    b = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("b"))
    c = cells.agg(two(F.col("n")).alias("c"), F.sum("n").alias("n"))
    row = c.join(a).join(b)  # one row each
    expected = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    return row.select(((F.col("c") - expected) / ((F.col("a") + F.col("b")) / 2 - expected)).alias("ari"))


def medoid(similarity: DataFrame) -> DataFrame:
    """(item, total) of the item most similar to all others, from pairs (a, b, similarity); the first of equal ones."""
    both = similarity.select("a", "similarity").union(similarity.select("b", "similarity"))
    sums = both.groupBy(F.col("a").alias("item")).agg(F.sum("similarity").alias("total"))
    return sums.orderBy(F.desc(F.round("total", 9)), "item").limit(1)


# --- choosing the number of topics ------------------------------------------------------------


def fold_summary(runs: DataFrame, metric: str) -> DataFrame:
    """(k, mean, sd, se, seed_sd) from (k, fold, seed, METRIC): of the folds' means, and the mean spread of seeds."""
    folds = runs.groupBy("k", "fold").agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"))
    sd = F.stddev_samp("m")
    return folds.groupBy("k").agg(F.avg("m").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("m"))).alias("se"), F.avg("s").alias("seed_sd"))


def recommended_k(summary: DataFrame, tolerance: float = 0.02, stability: float = 0.7, diversity: float = 0.6, converged: float = 0.9) -> DataFrame:
    """One row (recommended_k, gates_passed, best_k): shortlist by coherence, gates, then the smallest k within one
    standard error of the best predictive score. ``summary``: a row for each k with coherence, coherence_se,
    stability, diversity, converged, score, score_se."""
    whole = Window.partitionBy(F.lit(1))  # a row for each k
    top = F.max(F.struct("coherence", (-F.col("k")).alias("k"), "coherence_se")).over(whole)
    rows = summary.withColumn("best", top)
    rows = rows.withColumn("short", F.col("coherence") >= F.col("best.coherence") - F.greatest(F.lit(tolerance), F.col("best.coherence_se")))
    rows = rows.withColumn("ok", F.col("short") & (F.col("stability") >= stability) & (F.col("diversity") >= diversity) & (F.col("converged") >= converged))
    rows = rows.withColumn("passed", F.max("ok").over(whole))
    rows = rows.filter(F.when(F.col("passed"), F.col("ok")).otherwise(F.col("short")))
    lead = F.max(F.struct("score", (-F.col("k")).alias("k"), "score_se")).over(whole)
    rows = rows.withColumn("lead", lead).filter(F.col("score") >= F.col("lead.score") - F.col("lead.score_se"))
    return rows.agg(F.min("k").alias("recommended_k"), F.first("passed").alias("gates_passed"), (-F.first("best.k")).alias("best_k"))


def final_candidates(k: int, tested: Sequence[int], always: Sequence[int] = (7, 8)) -> list[int]:
    return sorted({k - 1, k, k + 1, *always} & set(tested))


def grouped_folds(groups: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """(group, fold): every group in one fold, folds of near-equal size, by a seeded hash."""
    keyed = groups.select("group").distinct().withColumn("__h", F.md5(F.concat_ws("|", F.col("group").cast("string"), F.lit(str(seed)))))
    placed = numbered(keyed, ["__h", "group"], "__place", 0)
    n = placed.agg(F.count("*").alias("__n"))  # one row
    small, large = F.floor(F.col("__n") / folds), F.col("__n") % folds  # the first folds hold one group more
    fold = F.when(F.col("__place") < large * (small + 1), F.floor(F.col("__place") / (small + 1)))
    fold = fold.otherwise(large + F.floor((F.col("__place") - large * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.join(F.broadcast(n), F.lit(True)).select("group", fold.cast("int").alias("fold"))


def thinned(counts: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Counts split in two halves that add up to them: each occurrence goes by a bit of a hash. The first eight, which most
    counts do not exceed, are looked at one by one, as only that is compiled."""
    own = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    mark = lambda i: F.when(F.md5(F.concat_ws("|", F.lit(str(seed)), i, own)) < "8", 1).otherwise(0)
    n = F.col("n").cast("int")
    rest = F.filter(F.sequence(F.lit(9), n), lambda i: mark(i.cast("string")) == 1)
    seen = F.when(n > 8, F.size(rest)).otherwise(0)
    for i in range(8, 0, -1):
        seen = F.when(n >= i, mark(F.lit(str(i))) + seen).otherwise(0)
    return counts.withColumn("observed", seen).withColumn("target", F.col("n") - F.col("observed"))


def require_halves(halves: DataFrame, by: Sequence[str]) -> DataFrame:
    """``halves`` (``thinned``), or an error that names some groups of which a half is empty."""
    bad = halves.groupBy(*by).agg(F.sum("observed").alias("o"), F.sum("target").alias("t")).filter("o = 0 OR t = 0").limit(5).collect()
    if bad:
        raise IntegrityError(f"a completion half is empty: {[tuple(r)[: len(by)] for r in bad]}")
    return halves


def completion_score(target: DataFrame, theta: DataFrame, phi: DataFrame, unigram: DataFrame | None = None) -> DataFrame:
    """(doc_id, loglik, tokens): the held-back counts' (doc_id, term, n) log likelihood under theta and phi. With ``unigram``
    (term, p) also that under it, ``unigram``."""
    mix = target.join(theta, "doc_id").join(phi, ["topic", "term"]).groupBy("doc_id", "term", "n").agg(F.sum(F.col("w") * F.col("p")).alias("p"))
    out = [F.sum(F.col("n") * F.log(F.greatest("p", F.lit(1e-300)))).alias("loglik"), F.sum("n").alias("tokens")]
    if unigram is not None:
        mix = mix.join(unigram.select("term", F.col("p").alias("__u")), "term")
        out.append(F.sum(F.col("n") * F.log("__u")).alias("unigram"))
    return mix.groupBy("doc_id").agg(*out)


def own_topic_score(target: DataFrame, phi: DataFrame, unigram: DataFrame | None = None) -> DataFrame:
    """``completion_score`` with a unigram, of documents that have one topic each, of weight 1: ``target`` (doc_id, topic, term,
    n). Without ``unigram`` its probabilities are in ``phi``, as u. The counts are joined once."""
    known = phi.select("topic", "term", "p", F.col("u").alias("__u")) if unigram is None else phi.select("topic", "term", "p").join(unigram.select("term", F.col("p").alias("__u")), "term")
    rows = target.join(known, ["topic", "term"])
    return rows.groupBy("doc_id").agg(F.sum(F.col("n") * F.log(F.greatest("p", F.lit(1e-300)))).alias("loglik"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.log("__u")).alias("unigram"))


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: exp of minus the mean over documents of the log likelihood per token."""
    return scores.agg(F.exp(-F.avg(F.col("loglik") / F.col("tokens"))).alias("perplexity"))


def completion_by(scores: DataFrame, *by: str) -> DataFrame:
    """From ``completion_score`` with a unigram, for each group: macro and micro log likelihood per token, their total, the
    perplexity, and the mean gain per token over the unigram."""
    per = F.col("loglik") / F.col("tokens")
    return scores.groupBy(*by).agg(
        F.avg(per).alias("macro"), F.exp(-F.avg(per)).alias("perplexity"), F.sum("loglik").alias("total"),
        (F.sum("loglik") / F.sum("tokens")).alias("micro"), F.avg(per - F.col("unigram") / F.col("tokens")).alias("gain"),
    )


def completion_summary(scores: DataFrame) -> DataFrame:
    """``completion_by`` over all documents: one row."""
    return completion_by(scores)


# --- sensitivity ------------------------------------------------------------------------------


def sensitivity_summary(rows: DataFrame, by: str, skip: Sequence[str] = ("seed",)) -> DataFrame:
    """Mean and standard deviation of every numeric column, by variant."""
    numeric = [c for c, t in rows.dtypes if c not in (by, *skip) and t in ("double", "float", "int", "bigint")]
    return rows.groupBy(by).agg(*[f(c).alias(f"{c}_{n}") for c in numeric for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def intruder_tasks(top: DataFrame, phi: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(topic, options, intruder): each topic's best words and one of another topic's that it rarely uses, shuffled."""
    median = phi.groupBy("topic").agg(F.percentile("p", F.lit(0.5)).alias("mid"))
    own = top.filter(F.col("rank") <= n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    foreign = top.filter("rank <= 30").select(F.col("topic").alias("other"), "term")
    topics = F.broadcast(median)  # a row for each topic
    pool = foreign.join(topics, foreign.other != median.topic).join(phi.select("topic", "term", "p"), ["topic", "term"], "left").filter(F.coalesce("p", F.lit(0.0)) < F.col("mid"))
    pick = pool.groupBy("topic").agg(F.min(F.struct(F.md5(F.concat_ws("|", F.col("topic").cast("string"), "term", F.lit(str(seed)))), "term")).alias("x"))
    rows = own.join(pick, "topic").select("topic", F.col("x.term").alias("intruder"), F.transform("t", lambda x: x["term"]).alias("t"))
    shuffled = F.array_sort(F.transform(F.array_append("t", F.col("intruder")), lambda w: F.struct(F.md5(F.concat_ws("|", F.col("topic").cast("string"), w, F.lit(str(seed + 1)))).alias("h"), w.alias("w"))))
    return rows.select("topic", F.transform(shuffled, lambda x: x["w"]).alias("options"), "intruder")
