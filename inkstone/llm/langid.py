"""Language identification by a byte convolutional network.

A text's lower-cased UTF-8 bytes are cut into windows of fixed length. Each byte
is embedded, filters of several widths slide over the window, each filter's
response is max-pooled over it, and a softmax over the pooled responses gives
the window's language probabilities. A text's probabilities are the mean over
all its windows, weighted by the letters they hold. The network is trained in
numpy on windows of labelled texts, each distinct text counting once.

Defined results: a null text, or one without a letter (``str.isalpha``), is
``und`` with score 0. Ties go to the alphabetically first language. Equal rows
get equal results. An empty table gives an empty result; with no labelled row
every prediction is ``und``. Very long texts are read whole. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import tune


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Settings:
    window: int = 96
    dims: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    #: Filters of each width.
    filters: int = 12
    #: The bound of the training sample: languages (those of most distinct texts), labelled texts of a language, and
    #: windows of a text.
    langs: int = 1000
    texts_per_lang: int = 300
    windows_per_text: int = 12
    epochs: int = 4
    batch: int = 128
    rate: float = 0.01
    seed: int = 42


def windows_of(text: str, size: int) -> np.ndarray:
    """The lower-cased text's bytes as rows of ``size``, the last one padded with zeros."""
    data = text.lower().encode("utf-8", "surrogatepass")
    rows = -(-len(data) // size)
    return np.frombuffer(data + bytes(rows * size - len(data)), np.uint8).reshape(rows, size)


class Network:
    """Embedding, convolutions of several widths in one product, max pooling, softmax."""

    def __init__(self, langs: list[str], settings: Settings):
        self.langs, self.s = langs, settings
        rng = np.random.default_rng(settings.seed)
        self.reach = max(settings.widths)
        n = settings.filters * len(settings.widths)
        self.emb = rng.normal(0, 0.5, (256, settings.dims)).astype(np.float32)
        self.emb[0] = 0  # padding
        # a filter of width w has weights for its first w bytes only
        self.mask = np.zeros((self.reach * settings.dims, n), np.float32)
        for k, w in enumerate(settings.widths):
            self.mask[: w * settings.dims, k * settings.filters : (k + 1) * settings.filters] = 1
        self.conv = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """The embedded bytes under each filter position: [windows, positions, reach * dims]."""
        padded = np.zeros((len(rows), rows.shape[1] + self.reach - 1), np.uint8)
        padded[:, : rows.shape[1]] = rows
        e = self.emb[padded].reshape(len(rows), -1)
        d = self.s.dims
        view = np.lib.stride_tricks.as_strided(e, (len(rows), rows.shape[1], self.reach * d), (e.strides[0], d * e.itemsize, e.itemsize))
        return np.ascontiguousarray(view)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        p = self.patches(rows)
        return np.maximum((p.reshape(-1, p.shape[2]) @ self.conv).reshape(len(rows), rows.shape[1], -1).max(axis=1) + self.bias, 0)

    def probabilities(self, rows: np.ndarray, block: int = 128) -> np.ndarray:
        parts = [self.pooled(rows[k : k + block]) @ self.out + self.out_bias for k in range(0, len(rows), block)]
        z = np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)
        z = np.exp((z - z.max(axis=1, keepdims=True)).astype(np.float64))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Adam on the weighted cross-entropy."""
        s, rng = self.s, np.random.default_rng(self.s.seed + 1)
        names = ("emb", "conv", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), s.batch):
                pick = order[k : k + s.batch]
                for name, g in self._gradients(rows[pick], labels[pick], weights[pick]).items():
                    if name == "emb":
                        t += 1
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g * g - v[name])
                    step = s.rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-7)
                    setattr(self, name, (getattr(self, name) - step).astype(np.float32))

    def _gradients(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        n, width, d = len(rows), rows.shape[1], self.s.dims
        p = self.patches(rows)
        response = (p.reshape(-1, p.shape[2]) @ self.conv).reshape(n, width, -1)
        at = response.argmax(axis=1)
        top = np.take_along_axis(response, at[:, None], 1)[:, 0] + self.bias
        h = np.maximum(top, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), labels] -= 1
        z *= (weights / weights.sum())[:, None]
        dh = (z @ self.out.T) * (top > 0)
        hit = p[np.arange(n)[:, None], at]  # the winning patches: [windows, filters, reach * dims]
        conv = np.einsum("nf,nfk->kf", dh, hit) * self.mask
        emb = np.zeros_like(self.emb)
        padded = np.zeros((n, width + self.reach - 1), np.uint8)
        padded[:, :width] = rows
        for j in range(self.reach):
            under = padded[np.arange(n)[:, None], at + j]
            np.add.at(emb, under.ravel(), (dh[:, :, None] * self.conv[j * d : (j + 1) * d].T[None]).reshape(-1, d))
        emb[0] = 0
        return {"emb": emb, "conv": conv, "bias": dh.sum(axis=0), "out": h.T @ z, "out_bias": z.sum(axis=0)}


def sample(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, h, windows): evenly spaced windows of at most ``texts_per_lang`` distinct texts of each language, those
    of smallest hash h of the text.

    A sketch counts each language's distinct texts, which gives the hash below which about four times as many lie; only
    those are ranked, so a language of any size, and any number of copies, brings a bounded number of hashes to its
    task. The texts themselves aren't shuffled: tasks cut the windows of the picked ones."""
    spark = labelled.sparkSession
    tune(spark)
    rows = labelled.filter("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(settings.langs)
    sizes = sizes.select("lang", (4.0 * settings.texts_per_lang / F.col("n")).alias("rate"))
    chance = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(sizes), "lang").filter(chance < F.col("rate")).select("lang", "h").distinct()  # sizes: at most settings.langs rows
    w = Window.partitionBy("lang").orderBy(chance, "h")
    picked = few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= settings.texts_per_lang).select("lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            out: list[tuple[str, int, bytes]] = []
            for lang, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    if has_letter(t := text.as_py()):
                        cut = windows_of(t, settings.window)
                        out.append((lang, h, cut[np.unique(np.linspace(0, len(cut) - 1, settings.windows_per_text).astype(int))].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "windows"])

    cut = rows.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", "text").mapInArrow(run, "lang string, h long, windows binary")  # picked: bounded by the settings
    return cut.groupBy("lang", "h").agg(F.min("windows").alias("windows"))


def trained(labelled: DataFrame, settings: Settings = Settings()) -> Network:
    """A network fitted on the driver to ``sample`` of ``labelled`` (text, lang)."""
    rows = sorted((r["h"], r["lang"], bytes(r["windows"])) for r in sample(labelled, settings).collect())
    langs = sorted({y for _, y, _ in rows})
    net = Network(langs, settings)
    if len(langs) > 1:
        parts, labels, weights = [], [], []
        size = {y: sum(x == y for _, x, _ in rows) for y in langs}
        for _, lang, data in rows:
            parts.append(np.frombuffer(data, np.uint8).reshape(-1, settings.window))
            labels += [langs.index(lang)] * len(parts[-1])
            weights += [1 / (size[lang] * len(parts[-1])) ** 0.5] * len(parts[-1])
        net.train(np.concatenate(parts), np.array(labels), np.array(weights, np.float32))
    return net


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """Each row's doc_id with lang_pred and score, the mean probability of that language over all windows."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        size = net.s.window
        for b in batches:
            names: list[str] = []
            scores: list[float] = []
            for k in range(0, b.num_rows, 64):
                texts = [t.as_py() or "" for t in b.column(1).slice(k, 64)]
                known = [i for i, t in enumerate(texts) if net.langs and has_letter(t)]
                rows = [windows_of(texts[i], size) for i in known]
                got: dict[int, tuple[str, float]] = {}
                if rows:
                    all_rows = np.concatenate(rows)
                    p = net.probabilities(all_rows)
                    weight = ((all_rows >= 97) & (all_rows != 127)).sum(axis=1) + 1e-3  # letters, and bytes of letters beyond ASCII
                    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
                    mean = np.add.reduceat(p * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
                    for i, q in zip(known, mean, strict=True):
                        got[i] = (net.langs[int(q.argmax())], float(min(1.0, q.max())))
                for i in range(len(texts)):
                    name, score = got.get(i, ("und", 0.0))
                    names.append(name)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
