"""Topic models: fitting, inference, coherence, stability over seeds, sensitivity to settings.

Models are latent Dirichlet allocations fitted by batch variational Bayes. An
update is one pass over the units on executors: each task works through its
units against the broadcast topics and brings one matrix of topics by terms for
each model; these are summed in the JVM before they reach the driver, which
updates the topics. Several models - seeds, priors - share a pass. The driver
keeps matrices of topics by vocabulary, whose size the vocabulary cap bounds.

Units start from equal weights and the topics from a seeded draw, so a fit does
not depend on how rows are partitioned, but for rounding in the order of sums.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import topics as P
from inkstone.operators.relational import IntegrityError


@dataclass(frozen=True)
class TopicSettings:
    k: int = 11
    seed: int = 2026
    #: Updates at most; they end when the perplexity changes by less than ``tolerance``.
    iterations: int = 250
    tolerance: float = 0.1
    #: Prior of a unit's topics: a number, None for 1 / k, or "asymmetric".
    alpha: float | str | None = None
    eta: float = 0.01
    #: A unit's inner iterations at most, and the mean change at which they end.
    inner: int = 250
    change: float = 0.001
    #: Whether the priors are fitted too, by Newton's steps after each update.
    learn_alpha: bool = False
    learn_eta: bool = False


#: The first generation's model: an asymmetric prior, a fitted topic prior, a fixed number of passes.
FIRST_GENERATION = TopicSettings(k=7, seed=42, iterations=12, tolerance=0.0, alpha="asymmetric", learn_eta=True)


@dataclass
class TopicModel:
    """Topics as pseudo-counts (topics by terms), their priors, and a trace of the updates."""

    settings: TopicSettings
    components: np.ndarray
    alpha: np.ndarray
    eta: float
    trace: list[dict] = field(default_factory=list)
    converged: bool = False

    @property
    def iterations(self) -> int:
        return self.trace[-1]["iteration"] if self.trace else 0


def initial(s: TopicSettings, terms: int) -> TopicModel:
    if s.alpha == "asymmetric":
        alpha = 1 / (np.arange(s.k) + math.sqrt(s.k))
        alpha = alpha / alpha.sum()
    else:
        alpha = np.full(s.k, float(s.alpha) if s.alpha is not None else 1 / s.k)
    return TopicModel(s, np.random.default_rng(s.seed).gamma(100.0, 0.01, (s.k, terms)), alpha, s.eta)


# --- functions of the gamma distribution ---------------------------------------------------


def _digamma_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y = x + 6, and what digamma(x) is beside log(y): the asymptotic series at y, and the six steps down to x as one
    fraction, their reciprocals taken in pairs."""
    x = np.asarray(x, float)
    y, u = x + 6, x * (x + 5)
    w = 1 / y
    z = w * w
    rest = z * (-1 / 132)
    for c in (1 / 240, -1 / 252, 1 / 120, -1 / 12):
        rest += c
        rest *= z
    rest -= 0.5 * w
    steps = (2 * x + 5) * ((3 * u + 20) * u + 24)
    steps /= u * (u + 4) * (u + 6)
    return y, rest - steps


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive numbers."""
    y, rest = _digamma_parts(x)
    return np.log(y) + rest


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of ``digamma``, without its logarithm."""
    y, rest = _digamma_parts(x)
    return y * np.exp(rest)


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gammaln(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def _expected_log(x: np.ndarray) -> np.ndarray:
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


# --- units -----------------------------------------------------------------------------------


def unit_rows(bags: DataFrame) -> DataFrame:
    """(doc_id, unit, terms, counts) from (doc_id, unit, term_id, n)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("t"), F.col("n").cast("double").alias("n"))))
    rows = bags.groupBy("doc_id", "unit").agg(packed.alias("x"))  # a unit's distinct terms
    return rows.select("doc_id", "unit", F.transform("x", lambda x: x["t"]).alias("terms"), F.transform("x", lambda x: x["n"]).alias("counts"))


#: Parts of like size for each core into which units are dealt before their passes.
PARTS = 3


def evened(units: DataFrame) -> DataFrame:
    """``units`` dealt into parts of like size, so that no core waits for another's in every pass."""
    return units.repartition(PARTS * units.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class _Sent:
    """What tasks need of a model."""

    exp_topics: np.ndarray  # exp of the expected log probability, terms by topics
    alpha: np.ndarray
    inner: int
    change: float


def _sent(m: TopicModel) -> _Sent:
    return _Sent(np.exp(_expected_log(m.components)).T.copy(), m.alpha, m.settings.inner, m.settings.change)


#: Terms of units that are worked through together, padding included: enough for the calls to cost little beside the work.
BLOCK = 1 << 16
#: Inner iterations after which the units that are not settled are dealt into blocks anew.
ROUNDS = (18, 30, 60, 110)
#: Terms of units, at least, that a task gathers before it works through them: their slow ones fill blocks too.
GATHERED = 1 << 20


def unit_weights(m: _Sent, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units laid end to end (each begins at one of ``starts`` and has terms). Each unit's topic pseudo-counts; exp of
    their expected logs; and for each term of a unit the sum of both sides' products. Units of like size are blocks of
    topics by terms, worked through one after the other by products of matrices with vectors; those whose mean change
    falls below the limit are settled, and leave the block when they are a third of it. Most units settle soon and a few
    take many iterations, so after each of ``ROUNDS`` those left of all blocks make new ones: a block's calls cost the
    same for one unit as for hundreds."""
    n, k = len(starts), len(m.alpha)
    gamma, expected, norms = np.ones((n, k)), np.empty((n, k)), np.empty(len(terms))
    sizes = np.diff(np.append(starts, len(terms)))
    order = np.argsort(sizes, kind="stable")
    topics = np.ascontiguousarray(m.exp_topics.T)  # a topic's row stays in a core's cache while its terms are taken
    terms, done_before = terms.astype(np.intp, copy=False), 0
    for upto in (*(r for r in ROUNDS if r < m.inner), m.inner):
        ordered, first = sizes[order], 0
        unsettled = np.zeros(n, bool)
        while first < len(order):
            # the next units, as many as fit a block at the largest one's size
            held = ordered[first : first + BLOCK] * np.arange(1, len(ordered[first : first + BLOCK]) + 1)
            own = order[first : first + max(1, int(np.searchsorted(held, BLOCK, side="right")))]
            first += len(own)
            at = np.arange(sizes[own[-1]])
            there = at < sizes[own][:, None]
            place = np.where(there, starts[own][:, None] + at, starts[own][:, None])
            whole = topics.take(terms[place], axis=1, mode="clip").transpose(1, 0, 2)  # all are within; the other modes look at each twice
            live, going, words, weight = own, np.ones(len(own), bool), whole, np.where(there, counts[place], 0.0)
            now = gamma[own]
            for _ in range(done_before, upto):
                # exp of digamma less each unit's constant, which ``norm`` divides out
                part = exp_digamma(now)
                norm = np.matmul(part[:, None, :], words)[:, 0]
                norm += 1e-100
                new = m.alpha + part * np.matmul(words, np.divide(weight, norm, out=norm)[:, :, None])[:, :, 0]
                moved = np.abs(new - now).sum(axis=1)
                now = new
                done = going & (moved < k * m.change)
                if done.any():
                    gamma[live[done]] = now[done]
                    going &= ~done
                    left = np.count_nonzero(going)
                    if not left:
                        break
                    if left <= 0.67 * len(going):
                        live, now, words, weight, going = live[going], now[going], words[going], weight[going], going[going]
            gamma[live[going]] = now[going]
            unsettled[live[going]] = upto < m.inner
            expected[own] = exp_digamma(gamma[own]) / exp_digamma(gamma[own].sum(axis=1, keepdims=True))
            norms[place[there]] = np.matmul(expected[own][:, None, :], whole)[:, 0][there] + 1e-100  # once more for those not settled
        order, done_before = order[unsettled[order]], upto
        if not len(order):
            break
    return gamma, expected, norms


def _flat(b: pa.RecordBatch, terms: int, counts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of a batch that have terms, laid end to end."""
    lists = b.column(terms)
    sizes = np.diff(lists.offsets.to_numpy())
    kept = np.flatnonzero(sizes > 0)
    return kept, lists.flatten().to_numpy(), b.column(counts).flatten().to_numpy(), (np.cumsum(sizes) - sizes)[kept]


def _gathered(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """``batches``, as many together as have ``GATHERED`` terms in column ``terms``, whose slow units are worked through as one."""
    held, many = [], 0
    for b in batches:
        held.append(b)
        many += len(b.column(terms).flatten())
        if many >= GATHERED:
            yield pa.concat_batches(held)
            held, many = [], 0
    if held:
        yield pa.concat_batches(held)


def _passed(rows: DataFrame, models: Sequence[TopicModel]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One pass over the units: for each model the expected counts (topics by terms), and the units' part of the bound,
    their tokens and number, and the sum of the expected logs of their topics."""
    sent = rows.sparkSession.sparkContext.broadcast([_sent(m) for m in models])  # topics by terms for each model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums = [np.zeros((m.exp_topics.shape[1], m.exp_topics.shape[0])) for m in own]
        parts = [np.zeros(3 + len(m.alpha)) for m in own]
        for b in _gathered(batches, 0):
            kept, terms, counts, starts = _flat(b, 0, 1)
            if not len(kept):
                continue
            sizes = np.diff(np.append(starts, len(terms)))
            for m, total, part in zip(own, sums, parts, strict=True):
                gamma, expected, norm = unit_weights(m, terms, counts, starts)
                share = counts / norm
                for t in range(len(m.alpha)):
                    total[t] += np.bincount(terms, weights=np.repeat(expected[:, t], sizes) * share, minlength=total.shape[1])
                logs = _expected_log(gamma)
                bound = (counts * np.log(norm)).sum() + ((m.alpha - gamma) * logs + gammaln(gamma) - gammaln(m.alpha)).sum()
                bound += len(gamma) * float(gammaln(m.alpha.sum()[None])[0]) - gammaln(gamma.sum(axis=1)).sum()
                part += np.concatenate(([bound, counts.sum(), len(gamma)], logs.sum(axis=0)))
        out = [(i, t, row) for i, (m, total) in enumerate(zip(own, sums, strict=True)) for t, row in enumerate(total * m.exp_topics.T)]
        out += [(i, -1, part) for i, part in enumerate(parts)]
        for i, t, row in out:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([t], pa.int32()), pa.array([row], pa.list_(pa.float64()))], ["m", "t", "x"])

    found = rows.select("terms", "counts").mapInArrow(run, "m int, t int, x array<double>")
    summed = found.groupBy("m", "t").agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x")).collect()  # topics and one more for each model
    sent.destroy()
    got = {(r["m"], r["t"]): np.array(r["x"]) for r in summed}
    empty = lambda m: (np.zeros_like(m.components), np.zeros(3 + len(m.alpha)))
    return [(np.stack([got[i, t] for t in range(len(m.alpha))]), got[i, -1]) if (i, -1) in got else empty(m) for i, m in enumerate(models)]


# --- fitting ---------------------------------------------------------------------------------


def _newton(prior: np.ndarray, n: float, logs: np.ndarray) -> np.ndarray:
    """A Dirichlet prior after one Newton step towards the likeliest for n draws whose expected logs sum to ``logs``; halved
    while it would leave the positive numbers."""
    gradient = n * (digamma(prior.sum()[None]) - digamma(prior)) + logs
    q, z = -n * trigamma(prior), n * float(trigamma(prior.sum()[None])[0])
    b = (gradient / q).sum() / (1 / z + (1 / q).sum())
    step = (gradient - b) / q
    for _ in range(20):
        if (prior - step > 1e-6).all():
            return prior - step
        step = step / 2
    return prior


def _scalar_newton(eta: float, k: int, v: int, logs: float) -> float:
    """The same for a symmetric prior of k topics over v terms."""
    gradient = k * v * float((digamma(np.array([v * eta])) - digamma(np.array([eta])))[0]) + logs
    slope = k * v * float((v * trigamma(np.array([v * eta])) - trigamma(np.array([eta])))[0])
    step = gradient / slope if slope else 0.0
    for _ in range(20):
        if eta - step > 1e-6:
            return eta - step
        step /= 2
    return eta


def fit_all(rows: DataFrame, settings: Sequence[TopicSettings], terms: int, done: Callable[[int, TopicModel], None] | None = None) -> list[TopicModel]:
    """A model of the units (``unit_rows``) for each of ``settings``. The bound of a model's topics comes with the pass
    that updates them next, so the trace costs no pass of its own; models that are done leave the passes, and are given to
    ``done`` with their number."""
    models = [initial(s, terms) for s in settings]
    live = list(range(len(models)))
    updates = [0] * len(models)
    while live:
        for i, (counts, part) in zip(list(live), _passed(rows, [models[i] for i in live]), strict=True):
            m, s = models[i], models[i].settings
            bound, tokens, units = part[:3]
            logs = _expected_log(m.components)
            bound += ((m.eta - m.components) * logs + gammaln(m.components)).sum() - gammaln(m.components.sum(axis=1)).sum()
            bound += s.k * float(gammaln(np.array([m.eta * terms]))[0]) - s.k * terms * float(gammaln(np.array([m.eta]))[0])
            per_token = bound / max(tokens, 1.0)
            if updates[i]:
                m.trace.append({"iteration": updates[i], "perplexity": float(np.exp(min(700.0, -per_token))), "bound": float(bound), "bound_per_token": float(per_token)})
                m.converged = len(m.trace) > 1 and abs(m.trace[-2]["perplexity"] - m.trace[-1]["perplexity"]) < s.tolerance
            if m.converged or updates[i] >= s.iterations or not tokens:
                live.remove(i)
                if done is not None:
                    done(i, m)
                continue
            if s.learn_alpha:
                m.alpha = _newton(m.alpha, units, part[3:])
            m.components = counts + m.eta
            if s.learn_eta:
                m.eta = _scalar_newton(m.eta, s.k, terms, float(_expected_log(m.components).sum()))
            updates[i] += 1
    return models


def fit(rows: DataFrame, s: TopicSettings, terms: int) -> TopicModel:
    return fit_all(rows, [s], terms)[0]


def infer(model: TopicModel, rows: DataFrame) -> DataFrame:
    """(doc_id, unit, n, topic, w): every unit's tokens and topic weights; a unit without known terms has the prior's."""
    sent = rows.sparkSession.sparkContext.broadcast(_sent(model))  # topics by terms
    keys = rows.select("doc_id", "unit").schema
    prior = model.alpha / model.alpha.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, 2):
            kept, terms, counts, starts = _flat(b, 2, 3)
            theta = np.tile(prior, (b.num_rows, 1))
            n = np.zeros(b.num_rows)
            if len(kept):
                gamma = unit_weights(sent.value, terms, counts, starts)[0]
                theta[kept] = gamma / gamma.sum(axis=1, keepdims=True)
                n[kept] = np.add.reduceat(counts, starts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(list(theta), pa.list_(pa.float64()))], ["doc_id", "unit", "n", "theta"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.fields)
    return P.long_theta(rows.select("doc_id", "unit", "terms", "counts").mapInArrow(run, f"{kinds}, n double, theta array<double>"), "theta")


def completion(models: Sequence[TopicModel], unigram: np.ndarray, rows: DataFrame) -> DataFrame:
    """(m, doc_id, loglik, unigram, tokens) for each model: the target halves of units (doc_id, unit, terms, observed, target)
    scored under the topic weights inferred from their observed halves, and under a unigram (a probability for each
    term), summed over a document's units."""
    sent = rows.sparkSession.sparkContext.broadcast(([(_sent(m), phi_matrix(m).T.copy()) for m in models], np.log(unigram)))  # terms by topics for each model
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = sent.value
        for b in batches:
            kept, terms, seen, starts = _flat(b, 1, 2)
            if not len(kept):
                continue
            target, docs = b.column(3).flatten().to_numpy(), b.column(0).take(pa.array(kept))
            unit = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
            for i, (m, phi) in enumerate(own):
                gamma = unit_weights(m, terms, seen, starts)[0]
                theta = gamma / gamma.sum(axis=1, keepdims=True)
                p = np.maximum(np.einsum("ij,ij->i", theta[unit], phi[terms]), 1e-300)
                parts = [np.add.reduceat(target * x, starts) for x in (np.log(p), base[terms], 1.0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), i, np.int32)), docs, *map(pa.array, parts)], ["m", "doc_id", "loglik", "unigram", "tokens"])

    found = rows.select("doc_id", "terms", "observed", "target").mapInArrow(run, f"m int, doc_id {kind}, loglik double, unigram double, tokens double")
    return found.groupBy("m", "doc_id").agg(*[F.sum(c).alias(c) for c in ("loglik", "unigram", "tokens")])


def phi_matrix(model: TopicModel) -> np.ndarray:
    """Topics by terms, rows that sum to 1."""
    return model.components / model.components.sum(axis=1, keepdims=True)


def save(spark: SparkSession, model: TopicModel, path: str) -> None:
    """Writes a model beside ``path`` and then renames it, so that what stands at ``path`` is whole."""
    fs, here, there = _paths(spark, path)
    fs.delete(there, True)
    about = json.dumps({"settings": asdict(model.settings), "alpha": model.alpha.tolist(), "eta": model.eta, "trace": model.trace, "converged": model.converged})
    rows = [(-1, about, [])] + [(t, "", row.tolist()) for t, row in enumerate(model.components)]
    spark.createDataFrame(rows, "topic int, about string, x array<double>").coalesce(1).write.parquet(there.toString())
    fs.delete(here, True)
    if not fs.rename(there, here):
        raise IntegrityError(f"the model could not be moved to {path}")


def load(spark: SparkSession, path: str) -> TopicModel:
    rows = {r["topic"]: r for r in spark.read.parquet(path).collect()}  # topics by terms
    about = json.loads(rows[-1]["about"])
    components = np.array([rows[t]["x"] for t in range(len(rows) - 1)])
    return TopicModel(TopicSettings(**about["settings"]), components, np.array(about["alpha"]), about["eta"], about["trace"], about["converged"])


def _paths(spark: SparkSession, path: str):
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), here, spark._jvm.org.apache.hadoop.fs.Path(path + ".part")


class FitStore:
    """Models by what they depend on: a digest of the settings, of the units - whatever their order - and of ``salt``, such
    as the code's. Each is saved when its fit ends, so a run that was cut short fits only what it hadn't."""

    def __init__(self, spark: SparkSession, folder: str, salt: str = ""):
        self.spark, self.folder, self.salt = spark, folder, salt
        #: How many models were fitted, and how many were found.
        self.fitted = self.found = 0
        self._counts = Lock()

    def path(self, data: str, s: TopicSettings, terms: int) -> str:
        key = json.dumps([self.salt, data, asdict(s), terms], sort_keys=True)
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def fit_all(self, rows: DataFrame, settings: Sequence[TopicSettings], terms: int) -> list[TopicModel]:
        """``fit_all``, with the models that are stored left out of the passes."""
        units = rows.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "unit", "terms", "counts").cast("decimal(38,0)"))).first()
        paths = [self.path(f"{units[0]} {units[1]}", s, terms) for s in settings]
        have: dict[str, TopicModel] = {}
        for path in dict.fromkeys(paths):
            model = stored(self.spark, path)
            if model is not None:
                have[path] = model
        with self._counts:
            self.found += len(have)
        missing = {path: s for path, s in zip(paths, settings, strict=True) if path not in have}
        names = list(missing)

        def keep(i: int, model: TopicModel) -> None:
            save(self.spark, model, names[i])
            have[names[i]] = model
            with self._counts:
                self.fitted += 1

        if missing:
            fit_all(rows, list(missing.values()), terms, keep)
        return [have[path] for path in paths]


class FitMemo:
    """Models by their DataFrame of units and settings: ``fit_all`` makes only those that ``models`` of ``units`` lack."""

    def __init__(self, units: DataFrame, models: Iterable[TopicModel]):
        self.units, self.models = units, {m.settings: m for m in models}

    def fit_all(self, rows: DataFrame, settings: Sequence[TopicSettings], terms: int) -> list[TopicModel]:
        have = self.models if rows is self.units else {}
        missing = [s for s in dict.fromkeys(settings) if s not in have]
        have = have | dict(zip(missing, fit_all(rows, missing, terms), strict=True))
        return [have[s] for s in settings]


def stored(spark: SparkSession, path: str) -> TopicModel | None:
    """The model saved at ``path``; None where there is none, or one that can't be read."""
    fs, here, _ = _paths(spark, path)
    if not fs.exists(here):
        return None
    try:
        return load(spark, path)
    except Exception as e:  # noqa: BLE001  reported, and fitted again
        print(f"unreadable model at {path}, fitted again: {type(e).__name__}")
        return None


def save_or_load(spark: SparkSession, path: str, make: Callable[[], TopicModel]) -> TopicModel:
    """The model saved at ``path``, or a new one, saved there. One that stands there but can't be read is made anew;
    errors in making one are not hidden."""
    model = stored(spark, path)
    if model is None:
        model = make()
        save(spark, model, path)
    return model


#: Occurrences of which the windows are counted together.
SWEPT = 4096


def swept(at: np.ndarray, term: np.ndarray, first: int, last: int, window: int, terms: int) -> np.ndarray:
    """In how many windows with a start from ``first`` to ``last`` each pair of terms occurs, a term with itself on the
    diagonal, from occurrences (place, term). An occurrence is in the windows that start at most ``window`` - 1 before it: a
    term's windows are a union of intervals of starts, and a pair's are where two unions meet. Between the intervals' ends
    all windows hold the same terms, so one matrix product over the stretches between them counts all pairs."""
    low, high = np.maximum(at - window + 1, first), np.minimum(at, last) + 1
    ok = low < high
    low, high, term = low[ok], high[ok], term[ok]
    edges = np.unique(np.concatenate((low, high)))
    if not len(edges):
        return np.zeros((terms, terms))
    own, term = np.unique(term, return_inverse=True)
    change = np.zeros((len(edges), len(own)), np.int32)
    np.add.at(change, (np.searchsorted(edges, low), term), 1)
    np.add.at(change, (np.searchsorted(edges, high), term), -1)
    there = (np.cumsum(change, axis=0)[:-1] > 0).astype(np.float64)
    out = np.zeros((terms, terms))
    out[np.ix_(own, own)] = there.T @ (there * np.diff(edges)[:, None])
    return out


def window_counts(tokens: DataFrame, terms: Sequence[str], window: int) -> tuple[dict, dict, int]:
    """In how many windows of so many tokens each term, and each pair of terms, occurs; and how many windows there are.
    A text shorter than a window is one window. Only occurrences of ``terms`` leave the first stage, one row each; a task
    sweeps over them in order and brings one matrix of terms by terms."""
    spark, names = tokens.sparkSession, sorted(set(terms))
    total = tokens.filter("pos = 0").agg(F.sum(F.greatest(F.col("n") - window + 1, F.lit(1)))).first()[0] or 0
    side = F.broadcast(spark.createDataFrame([(t, k) for k, t in enumerate(names)], "token string, __k int"))
    rows = tokens.join(side, "token").select("doc_id", F.col("pos").cast("long").alias("pos"), F.greatest(F.col("n") - window, F.lit(0)).cast("long").alias("last"), "__k")  # the lists' terms
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), len(names)))
        doc, first = None, 0
        at, term, end = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in batches:
            ids = b.column(0)
            code = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            pos, last, k = (b.column(c).to_numpy().astype(np.int64) for c in (1, 2, 3))
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if doc is None or ids[i].as_py() != doc[0]:
                    sums += swept(at, term, first, end, window, len(names))
                    doc, first, at, term = (ids[i].as_py(),), 0, at[:0], term[:0]
                at, term, end = np.concatenate((at, pos[i:j])), np.concatenate((term, k[i:j])), int(last[i])
                while len(at) > SWEPT:  # windows that start before the next occurrence's first one are complete
                    upto = int(at[SWEPT]) - window
                    if upto < first:
                        break
                    sums += swept(at[:SWEPT], term[:SWEPT], first, min(upto, end), window, len(names))
                    first = upto + 1
                    at, term = at[at >= first], term[at >= first]
        sums += swept(at, term, first, end, window, len(names))
        x, y = np.nonzero(np.triu(sums))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(sums[x, y])], ["a", "b", "n"])

    found = rows.mapInArrow(run, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # terms squared
    single = {names[a]: int(n) for a, b, n in found if a == b}
    joint = {(names[a], names[b]): int(n) for a, b, n in found if a != b}
    return single, joint, int(total)


def coherence(tokens: DataFrame, lists: Sequence[Sequence[str]], window: int = 110, kind: str = "c_v", eps: float = 1e-12) -> list[float]:
    """Each term list's coherence: c_v - the mean cosine of the terms' NPMI vectors with their sum - or c_npmi, the mean
    NPMI of pairs."""
    single, joint, total = window_counts(tokens, [t for words in lists for t in words], window)

    def npmi(a: str, b: str) -> float:
        pa, pb = single.get(a, 0) / total, single.get(b, 0) / total
        p = pa if a == b else joint.get((min(a, b), max(a, b)), 0) / total
        if not pa or not pb:
            return 0.0
        return float(np.log((p + eps) / (pa * pb)) / -np.log(p + eps))

    out = []
    for words in lists:
        m = np.array([[npmi(a, b) for b in words] for a in words])
        if kind == "c_npmi":
            out.append(float(m[np.triu_indices(len(words), 1)].mean()) if len(words) > 1 else 0.0)
            continue
        whole = m.sum(axis=0)
        norms = np.linalg.norm(m, axis=1) * np.linalg.norm(whole)
        out.append(float(np.mean(np.divide(m @ whole, norms, out=np.zeros(len(words)), where=norms > 0))))
    return out


def js_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Square roots of the Jensen-Shannon divergences (base 2) of the rows of two matrices."""
    out = np.zeros((len(a), len(b)))
    for i, p in enumerate(a):
        m = (p + b) / 2
        left = np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
        right = np.where(b > 0, b * np.log2(np.where(b > 0, b, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
        out[i] = np.sqrt(np.maximum((left + right) / 2, 0))
    return out


def matched_topics(a: np.ndarray, b: np.ndarray, terms: int = 10) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For each topic of ``a`` the one of ``b`` matched for least total distance, their similarity, and the overlap of
    their likeliest terms."""
    cost = js_matrix(a, b)
    to = P.matched(cost)
    tops = [[set(np.argsort(-row, kind="stable")[:terms].tolist()) for row in m] for m in (a, b)]
    overlap = [len(tops[0][i] & tops[1][j]) / len(tops[0][i] | tops[1][j]) for i, j in enumerate(to)]
    return to, np.array([1 - cost[i, j] for i, j in enumerate(to)]), np.array(overlap)


def seed_stability(phis: Mapping[int, np.ndarray], thetas: DataFrame | None = None, terms: int = 10) -> tuple[list[dict], int]:
    """A row for each pair of seeds - similarity and term overlap of the topics matched for least distance, and with
    ``thetas`` (seed, doc_id, topic, w) the Rand index of the documents' dominant topics and their mean difference of
    aligned weights - and the seed most similar to all others, the first of equal ones."""
    seeds = list(phis)
    out, aligned = [], {}
    total = dict.fromkeys(seeds, 0.0)
    for i, x in enumerate(seeds):
        for y in seeds[i + 1 :]:
            to, similarity, overlap = matched_topics(phis[x], phis[y], terms)
            aligned[x, y] = to
            total[x] += float(similarity.mean())
            total[y] += float(similarity.mean())
            out.append({"seed_a": x, "seed_b": y, "similarity": float(similarity.mean()), "jaccard": float(overlap.mean())})
    if thetas is not None and out:
        # each document's weights of every seed in one row: an array of the topics for each
        wide = thetas.groupBy("doc_id", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "w"))), lambda x: x["w"]).alias("t"))
        wide = wide.groupBy("doc_id").pivot("seed", seeds).agg(F.first("t"))
        pairs = []
        for n, r in enumerate(out):
            a, b = F.col(str(r["seed_a"])), F.col(str(r["seed_b"]))
            moved = F.array(*[F.element_at(b, j + 1) for j in aligned[r["seed_a"], r["seed_b"]]])
            l1 = F.aggregate(F.zip_with(a, moved, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v)
            first = lambda t: F.array_position(t, F.array_max(t))
            pairs.append(F.struct(F.lit(n).alias("pair"), first(a).alias("x"), first(b).alias("y"), l1.alias("l1")))
        rows = wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        cells = rows.groupBy("pair", "x", "y").agg(F.count("*").alias("n"), F.sum("l1").alias("l1")).collect()  # pairs times topics squared
        for n, r in enumerate(out):
            own = [c for c in cells if c["pair"] == n]
            r["ari"] = P.adjusted_rand_of({(c["x"], c["y"]): c["n"] for c in own})
            r["l1"] = sum(c["l1"] for c in own) / sum(c["n"] for c in own)
    return out, max(seeds, key=lambda s: total[s])


# --- sensitivity -------------------------------------------------------------------------------


#: Sets of units whose passes run side by side: the cores that one leaves idle between its passes work on another's.
TOGETHER = 3


@dataclass(frozen=True)
class Variant:
    """A refit: its units (all, and those trained on), and what differs from the base's settings."""

    name: str
    rows: DataFrame
    training: DataFrame
    change: Mapping[str, object] = field(default_factory=dict)


def sensitivity(base: TopicModel, base_theta: DataFrame | None, variants: Sequence[Variant], seeds: Sequence[int], terms: int, fits: Callable[..., list[TopicModel]] = fit_all) -> tuple[list[dict], dict[tuple[str, int], np.ndarray]]:
    """A row for each variant and seed - how alike its topics are to the base's, matched, and how far the documents'
    aligned weights and the prevalence move - and the topics by (variant, seed). Variants trained on the same
    DataFrame are fitted in the same passes. ``base_theta``: (doc_id, topic, w); without
    it the rows end before the weights."""
    rows, phis = [], {}
    reference = phi_matrix(base)
    shared: dict[int, list[Variant]] = {}
    for v in variants:
        shared.setdefault(id(v.training), []).append(v)

    def fitted(own: list[Variant]) -> Iterator[tuple[Variant, list[TopicModel]]]:
        models = fits(own[0].training, [replace(base.settings, **{**v.change, "seed": seed}) for v in own for seed in seeds], terms)
        return ((v, models[k * len(seeds) : (k + 1) * len(seeds)]) for k, v in enumerate(own))

    with ThreadPoolExecutor(TOGETHER) as pool:
        found = {v.name: models for part in pool.map(fitted, shared.values()) for v, models in part}
    for v in variants:
        for seed, model in zip(seeds, found[v.name], strict=True):
            phis[v.name, seed] = phi_matrix(model)
            to, similarity, overlap = matched_topics(reference, phis[v.name, seed])
            row = {"variant": v.name, "seed": seed, "iterations": model.iterations, "converged": model.converged, "similarity": float(similarity.mean()), "jaccard": float(overlap.mean())}
            rows.append(row)
            if base_theta is None:
                continue
            place = F.create_map(*[F.lit(x) for i, j in enumerate(to) for x in (j, i)])
            own = P.token_weighted(infer(model, v.rows)).select("doc_id", F.element_at(place, F.col("topic")).alias("topic"), F.col("w").alias("v"))
            both = own.join(base_theta, ["doc_id", "topic"])
            moved = both.groupBy("topic").agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("l1"), F.count("*").alias("n"), (F.avg("v") - F.avg("w")).alias("shift")).collect()  # a row for each topic
            row["l1"] = sum(r["l1"] for r in moved) / max(1, moved[0]["n"]) if moved else 0.0
            row["largest_shift"] = 100 * max((abs(r["shift"]) for r in moved), default=0.0)
    return rows, phis


def paired_audit(base: Mapping[int, np.ndarray], variants: Mapping[tuple[str, int], np.ndarray]) -> tuple[list[dict], list[dict]]:
    """A row for each variant and seed that the base has too - similarity, term overlap and largest difference of the
    matched topics -, and their summary by variant. Topics of another number or vocabulary are an error."""
    pairs = []
    for (name, seed), phi in variants.items():
        if seed not in base:
            continue
        if base[seed].shape != phi.shape:
            raise IntegrityError(f"vocabulary or topics of {name}, seed {seed}, differ from the base's")
        to, similarity, overlap = matched_topics(base[seed], phi)
        pairs.append({"variant": name, "seed": seed, "similarity": float(similarity.mean()), "jaccard": float(overlap.mean()), "largest": float(np.abs(base[seed] - phi[to]).max())})
    summary = []
    for name in dict.fromkeys(p["variant"] for p in pairs):
        own = [p for p in pairs if p["variant"] == name]
        each = [p["similarity"] for p in own]
        summary.append({
            "variant": name, "n": len(own), "mean_similarity": float(np.mean(each)), "min_similarity": min(each), "max_similarity": max(each),
            "mean_jaccard": float(np.mean([p["jaccard"] for p in own])), "largest": max(p["largest"] for p in own),
        })
    return pairs, summary
