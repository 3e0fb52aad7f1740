"""Toxicity by a linear-chain conditional random field.

Token labels: labels mark whole texts, so a word of a toxic text is labelled
toxic when the word's share of toxic texts far exceeds its share of others, with
near copies counted once. The field tags each line's words clean or toxic from
features of the word and its affixes, and from the transition between the tags
of neighbours; it is trained by gradient descent on the exact likelihood
(forward-backward). A line is one chain, however long. A text's score is a
logistic function, also fitted, of its toxic marginals: the largest one and the
expected number of toxic words. Offending offsets are the runs of words with a
marginal of one half or more, in the text as it stands.

Defined results: a null or empty text, or one without a word, has no marginals
and gets the score of none. Ties at one half count as toxic. Equal rows get
equal results. An empty table gives an empty result; without labelled texts of
both kinds every score is 0. Very long texts and lines are read whole. Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import tune

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word prefixes among the features.
PREFIXES = (4, 5, 6, 7)
#: Features of a word at most: itself, its prefixes, its suffix; shorter words repeat the suffix feature's empty slot.
SLOTS = 2 + len(PREFIXES)


@dataclass(frozen=True)
class Settings:
    #: The bound of the training sample: toxic and other labelled texts.
    toxic_texts: int = 600
    other_texts: int = 3000
    #: Longer texts (code points) take no part in the fit, so that the sample's bytes are bounded too.
    sample_chars: int = 65536
    #: A word is labelled toxic in toxic texts with this share of them, and so many times the share of others.
    min_share: float = 0.02
    min_texts: float = 4.0
    min_lift: float = 20.0
    #: Clean lines trained on for each line with a toxic word.
    clean_lines: int = 4
    hash_bits: int = 15
    epochs: int = 8
    rate: float = 0.5
    l2: float = 1e-5
    seed: int = 42


#: Cells of a block of lines in training.
CELLS = 1 << 17
#: Words whose chains are passed through at a time; a longer line by itself.
WORDS = 1 << 18


def lines_of(text: str) -> list[list[str]]:
    """The words of each line that has any, as they stand; features lower-case each by itself."""
    return [words for line in text.split("\n") if (words := _WORD.findall(line))]


def passed(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, start: float) -> np.ndarray:
    """The values r[t] = (c[t] + d[t] r) / (a[t] + b[t] r), r before the first one being ``start``. As such maps compose
    like matrices, pieces of the chain are composed side by side, their ends are passed through one after the other, and
    then all pieces side by side from their true beginnings."""
    n = len(a)
    size = max(1, math.isqrt(n))
    pieces = -(-n // size)
    spare = pieces * size - n
    rows = [np.ascontiguousarray(np.append(x, np.full(spare, fill)).reshape(pieces, size).T) for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    ea, eb, ec, ed = (row[0] for row in rows)
    for ta, tb, tc, td in zip(*(row[1:] for row in rows), strict=True):
        ea, eb, ec, ed = ta * ea + tb * ec, ta * eb + tb * ed, tc * ea + td * ec, tc * eb + td * ed
        top = np.maximum(np.maximum(ea, eb), np.maximum(ec, ed))
        ea, eb, ec, ed = ea / top, eb / top, ec / top, ed / top
    begin, r = [], start
    for pa_, pb, pc, pd in zip(ea.tolist(), eb.tolist(), ec.tolist(), ed.tolist(), strict=True):
        begin.append(r)
        r = (pc + pd * r) / (pa_ + pb * r)
    out, now = np.empty((size, pieces)), np.array(begin)
    for t, (ta, tb, tc, td) in enumerate(zip(*rows, strict=True)):
        now = out[t] = (tc + td * now) / (ta + tb * now)
    return out.T.reshape(-1)[:n]


def marks_of(word: str) -> list[str]:
    """The features that may mark a word: itself and its proper prefixes."""
    return [f"w{word}", *[f"p{word[:k]}" for k in PREFIXES if len(word) > k]]


class Field:
    """A two-tag field over hashed word features. ``emit`` holds a weight for each feature: the score of tag
    toxic over clean; ``move`` the transition scores; ``first`` the score of starting toxic."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.emit = np.zeros(1 << settings.hash_bits)
        self.move = np.zeros((2, 2))
        self.first = 0.0
        self.calibration = (0.0, 0.0, 0.0)  # bias, largest marginal, log of expected toxic words and one
        self.ready = False
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def features(self, word: str) -> list[int]:
        """The word's feature numbers, from 1; 0 fills what it lacks and has weight zero."""
        top, word = len(self.emit) - 1, word.lower()
        out = [1 + zlib.crc32(x.encode()) % top for x in (*marks_of(word), f"s{word[-3:]}")]
        return out + [0] * (SLOTS - len(out))

    def score(self, word: str) -> float:
        """The word's emission; kept for words that come again."""
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 300_000:
                self._known.clear()
            emit = self.emit
            known = self._known[word] = float(sum(emit[f] for f in self.features(word)))
        return known

    def posterior(self, lines: list[list[str]]) -> np.ndarray:
        """P(toxic) of every word, lines laid end to end. Forward and backward messages as the odds of the two tags."""
        known, score = self._known.get, self.score
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = np.array([score(w) if (v := known(w)) is None else v for line in lines for w in line], np.float64)
        starts = np.cumsum(lengths) - lengths
        out, k = [], 0
        while k < len(lines):
            end = max(k + 1, int(np.searchsorted(starts + lengths, starts[k] + WORDS, side="right")))
            a, b = int(starts[k]), int(starts[end - 1] + lengths[end - 1])
            out.append(self._chains(flat[a:b], starts[k:end] - a))
            k = end
        return np.concatenate(out) if out else np.zeros(0)

    def _chains(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(toxic) of every word of lines laid end to end, as one chain each way: at a line's start, and coming back at its
        end, the map does not depend on what was before."""
        (m00, m01), (m10, m11) = np.exp(self.move).tolist()
        odds = np.exp(np.clip(scores, -300, 300))
        a, b, c, d = np.full(len(odds), m00), np.full(len(odds), m10), odds * m01, odds * m11
        a[starts], b[starts], c[starts], d[starts] = 1.0, 0.0, odds[starts] * math.exp(self.first), 0.0
        ahead = passed(a, b, c, d, 0.0)
        ends = np.append(starts[1:], len(odds)) - 1
        after = np.append(odds[1:], 1.0)
        a, b, c, d = np.full(len(odds), m00), after * m01, np.full(len(odds), m10), after * m11
        a[ends], b[ends], c[ends], d[ends] = 1.0, 0.0, 1.0, 0.0
        r = ahead * passed(a[::-1], b[::-1], c[::-1], d[::-1], 1.0)[::-1]
        return r / (1 + r)

    def marginals(self, unary: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For training: forward-backward in logarithms over rows of emissions [lines, words]. P(toxic) of each word,
        the expected transitions summed over each line [lines, 2, 2], and each line's log partition."""
        n, width = unary.shape
        rows = np.arange(n)
        alpha = np.full((n, width, 2), 0.0)
        alpha[:, 0, 1] = unary[:, 0] + self.first
        for t in range(1, width):
            a = alpha[:, t - 1, :, None] + self.move[None]
            alpha[:, t] = np.logaddexp(a[:, 0], a[:, 1])
            alpha[:, t, 1] += unary[:, t]
        end = alpha[rows, lengths - 1]
        z = np.logaddexp(end[:, 0], end[:, 1])
        beta = np.zeros((n, width, 2))
        pair = np.zeros((n, 2, 2))
        for t in range(width - 2, -1, -1):
            live = t + 1 < lengths
            nxt = beta[:, t + 1].copy()
            nxt[:, 1] += unary[:, t + 1]
            b = self.move[None] + nxt[:, None, :]
            beta[:, t] = np.where(live[:, None], np.logaddexp(b[:, :, 0], b[:, :, 1]), 0.0)
            pair += np.where(live[:, None, None], np.exp(np.minimum(0, alpha[:, t, :, None] + b - z[:, None, None])), 0.0)
        p = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - z[:, None]))
        return np.where(np.arange(width) < lengths[:, None], p, 0.0), pair, z

    def judged(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Each text's score and offending offsets."""
        lines = [lines_of(t or "") for t in texts]
        p = self.posterior([line for of in lines for line in of])
        out, at = [], 0
        for text, of in zip(texts, lines, strict=True):
            n = sum(map(len, of))
            own = p[at : at + n]
            at += n
            out.append((self.text_score(own), self.spans(text or "", own) if self.ready else []))
        return out

    def text_score(self, p: np.ndarray) -> float:
        if not self.ready:
            return 0.0
        a, b, c = self.calibration
        x = a + b * (p.max() if len(p) else 0.0) + c * math.log1p(p.sum())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))

    @staticmethod
    def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
        """The runs of words of marginal one half or more, as (start, end) in code points."""
        found = np.flatnonzero(p >= 0.5).tolist()
        if not found:
            return []
        words = [m.span() for m in _WORD.finditer(text)]  # the same words as those of its lines
        out: list[tuple[int, int]] = []
        last = -2
        for i in found:
            if i == last + 1:
                out[-1] = (out[-1][0], words[i][1])
            else:
                out.append(words[i])
            last = i
        return out


def _copies(texts: list[str]) -> list[float]:
    """A weight for each text: one over the texts that share its smallest three-word hash, so that near copies count once."""
    keys = []
    for t in texts:
        w = [x.lower() for x in _WORD.findall(t)]
        keys.append(min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
    size = Counter(keys)
    return [1 / size[k] for k in keys]


def toxic_marks(texts: list[str], toxic: list[bool], settings: Settings) -> set[str]:
    """The words and word prefixes that mark toxic texts."""
    weights = _copies(texts)
    have: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0.0, 0.0]
    for t, y, w in zip(texts, toxic, weights, strict=True):
        total[y] += w
        for mark in {m for word in {x.lower() for x in _WORD.findall(t)} for m in marks_of(word)}:
            have[y][mark] += w
    if not total[1] or not total[0]:
        return set()
    return {w for w, n in have[1].items() if n >= max(settings.min_texts, settings.min_share * total[1]) and n / total[1] >= settings.min_lift * (have[0][w] + 0.1) / total[0]}


def sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[tuple[str, bool]]:
    """The texts of at most ``toxic_texts`` toxic and ``other_texts`` other rows of ``labels`` (doc_id, toxic), picked by a
    hash of the id. Ids are picked first; texts are then read through a broadcast of those ids, so none is shuffled."""
    rows = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("__id"), "toxic")
    picked = [rows.filter(F.col("toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in ((1, settings.toxic_texts), (0, settings.other_texts))]
    ids = picked[0].unionByName(picked[1]).distinct()  # at most toxic_texts + other_texts rows
    found = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").filter(F.length("text") <= settings.sample_chars).join(F.broadcast(ids), "__id")
    got = found.groupBy("__id", "toxic").agg(F.min("text").alias("text")).collect()  # one text for an id that repeats
    return sorted((r["text"], bool(r["toxic"])) for r in got)


def trained(rows: list[tuple[str, bool]], settings: Settings = Settings()) -> Field:
    """A field fitted on the driver to (text, toxic) rows."""
    field = Field(settings)
    texts, toxic = [t for t, _ in rows], [y for _, y in rows]
    marks = toxic_marks(texts, toxic, settings)
    if not marks:
        return field
    hot, cold = [], []
    marked: dict[str, bool] = {}
    for text, y in rows:
        for words in lines_of(text):
            tags = [y and (marked[w] if w in marked else marked.setdefault(w, not marks.isdisjoint(marks_of(w.lower())))) for w in words]
            (hot if any(tags) else cold).append((words, tags))
    rng = np.random.default_rng(settings.seed)
    cold = [cold[i] for i in sorted(rng.permutation(len(cold))[: settings.clean_lines * len(hot)])]
    _fit(field, hot + cold, settings)
    _calibrate(field, rows, settings)
    return field


def _fit(field: Field, lines: list[tuple[list[str], list[bool]]], settings: Settings) -> None:
    lines = sorted(lines, key=lambda x: (len(x[0]), x))
    cache: dict[str, list[int]] = {}
    blocks = []
    k = 0
    while k < len(lines):
        part = lines[k : k + max(1, min(512, CELLS // len(lines[min(k + 511, len(lines) - 1)][0])))]
        k += len(part)
        lengths = np.array([len(w) for w, _ in part])
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        feats = np.array([cache.setdefault(w, field.features(w)) for words, _ in part for w in words])
        tags = np.zeros((len(part), width), np.int64)
        tags[inside] = [t for _, ts in part for t in ts]
        moves = np.zeros((2, 2))
        both = inside[:, 1:]
        np.add.at(moves, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        blocks.append((lengths, inside, feats, tags, moves))
    n = sum(int(b[0].sum()) for b in blocks)
    sums = {"emit": np.zeros_like(field.emit), "move": np.zeros((2, 2)), "first": 0.0}
    for _ in range(settings.epochs):
        for lengths, inside, feats, tags, moves in blocks:
            unary = np.zeros(inside.shape)
            unary[inside] = field.emit[feats].sum(axis=1)
            p, pair, _ = field.marginals(unary, lengths)
            error = (tags - p)[inside]
            grad = np.zeros_like(field.emit)
            np.add.at(grad, feats, error[:, None])
            for name, g in (("emit", grad - settings.l2 * n * field.emit), ("move", moves - pair.sum(axis=0)), ("first", float((tags[:, 0] - p[:, 0]).sum()))):
                if name == "emit":
                    g[0] = 0.0  # the empty slot
                sums[name] = sums[name] + g * g
                setattr(field, name, getattr(field, name) + settings.rate * g / (np.sqrt(sums[name]) + 1e-6))
    field._known.clear()


def _calibrate(field: Field, rows: list[tuple[str, bool]], settings: Settings) -> None:
    """Fits the logistic of a text's score by Newton's steps, near copies weighing as one."""
    x, y = [], []
    for text, toxic in rows:
        p = field.posterior(lines_of(text))
        x.append((1.0, float(p.max()) if len(p) else 0.0, math.log1p(float(p.sum()))))
        y.append(float(toxic))
    a, b, w = np.array(x), np.array(y), np.array(_copies([t for t, _ in rows]))
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * q * (1 - q))[:, None]).T @ a + 1e-2 * np.eye(3)
        beta = beta + np.linalg.solve(h, a.T @ (w * (b - q)) - 1e-2 * beta)
    field.calibration = tuple(float(v) for v in beta)
    field.ready = True


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """Each row's doc_id with score, predicted and the offending spans, array<struct<start, end>>."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 2 ** hash_bits weights
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for k in range(0, b.num_rows, 64) for x in shared.value.judged([t.as_py() for t in b.column(1).slice(k, 64)])]
            scores = [s for s, _ in found]
            spans = pa.array([[{"start": x, "end": y} for x, y in s] for _, s in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), spans], ["doc_id", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start: long, end: long>>")
