"""Periodic runs of words by suffix trees.

A run is a stretch of words that repeats itself with some smallest period, twice
or more, and that no neighbouring word extends. Each text has a suffix tree of
its words, laid out flat: suffixes in order, with the words that each has in
common with the one before; an internal node is an interval of suffixes. The trees
of a batch stand side by side, as no suffix reaches beyond its text.

At a node of depth D two leaves i and i + D begin a tandem repeat of period D at i.
It branches if the word after it is not its first word, so that it can't be
rotated to the right. For each node all child leaf lists but the largest are
walked, so a leaf is walked at most log2 n times, and each leaf i is tested
against i + D and i - D through the leaf's rank. A branching repeat is rotated to
the left as far as it goes; the rotations of one, merged, are a maximal stretch.
Stretches with the same bounds are one run, of the smallest of their periods.

Defined results: a null, empty or blank text has no words and no runs. Equal rows
get equal results. An empty table gives an empty result. Very long texts are
handled whole, by themselves; memory is some 200 bytes a word. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import tune

LEAST = 12
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text whose trees are made together; a longer text by itself.
TOGETHER = 2 << 20
_RUN = "array<struct<start: long, length: long, period: long>>"


# --- the tree -----------------------------------------------------------------------------


class Tree:
    """The suffix trees of several texts. ``words`` are numbers, those of text k from bounds[k] to bounds[k + 1]."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n = len(words)
        sizes = np.diff(bounds)
        self.words, self.n = words, n
        self.begin, self.end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        self._sorted()

    def _sorted(self) -> None:
        """Suffixes by prefix doubling, and the words that neighbours have in common: ``order``, ``rank``, ``common``."""
        n, end = self.n, self.end
        key = self.begin * (int(self.words.max(initial=0)) + 1) + self.words
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = np.diff(key[order]) != 0
        common = np.zeros(n, np.int64)
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = head  # the place of the first suffix with the same beginning
        levels: list[np.ndarray] = []  # by doubling: ranks by the first 2 ** k words
        h = 1
        while True:
            twin = np.flatnonzero(~new)
            if not len(twin):
                break
            levels.append(rank.copy())
            mine = np.zeros(n, bool)
            mine[twin] = mine[twin - 1] = True
            at = np.flatnonzero(mine)  # places in groups of two or more
            pos = order[at]
            ahead = pos + h
            inside = ahead < end[pos]
            second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            group = rank[pos]
            by = np.argsort(group * (n + 1) + second, kind="stable")
            order[at] = pos = pos[by]
            second = second[by]
            # where a group parts, neighbours have h words in common, and what those h words on have
            apart = np.zeros(len(at), bool)
            apart[1:] = (second[1:] != second[:-1]) & ~new[at[1:]]
            where = np.flatnonzero(apart)
            common[at[where]] = self._shared(pos[where - 1], pos[where], h, levels)
            new[at[where]] = True
            rank[pos] = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
            h *= 2
        self.order, self.rank, self.common = order, rank, common

    def _shared(self, a: np.ndarray, b: np.ndarray, h: int, levels: list[np.ndarray]) -> np.ndarray:
        """How many words suffixes have in common that agree on their first h words and not on 2 * h."""
        found = np.full(len(a), h)
        for k in reversed(range(len(levels) - 1)):
            x, y = a + found, b + found
            ok = (x < self.end[a]) & (y < self.end[b])
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            found[ok] += 1 << k
        return found

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, left, right, border) for each border between children, ordered by node: a node's leaves stand at left to
        right - 1, and at each border a child begins."""
        at = np.flatnonzero(self.common)
        left = _smaller(self.common, at)
        right = self.n - _smaller(np.append(self.common[:0:-1], 0), self.n - 1 - at) - 1 if self.n else at
        by = np.lexsort((at, right, left))
        return self.common[at[by]], left[by], right[by], at[by]

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of the branching tandem repeats, each once."""
        depth, left, right, border = self.nodes()
        m = len(border)
        if not m:
            return border, border
        first = np.ones(m, bool)
        first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        last = np.append(first[1:], True)
        # children: one at each border, and one before a node's first border
        node = np.cumsum(first) - 1
        start = np.concatenate((border, left[first]))
        stop = np.concatenate((np.where(last, right, np.append(border[1:], 0)), border[first]))
        owner = np.concatenate((node, np.arange(node[-1] + 1)))
        size = stop - start
        by = np.lexsort((size, owner))
        small = np.ones(len(by), bool)
        small[np.append(np.flatnonzero(np.diff(owner[by])), len(by) - 1)] = False  # the largest child of each node
        walk = by[small]
        sizes = size[walk]
        jump = np.repeat(start[walk] - (np.cumsum(sizes) - sizes), sizes)
        leaf = self.order[jump + np.arange(len(jump))]
        of = np.repeat(owner[walk], sizes)
        d, low, high = depth[first][of], left[first][of], right[first][of]
        found = []
        for i, j, ok in ((leaf, leaf + d, leaf + d < self.end[leaf]), (leaf - d, leaf - d, leaf - d >= self.begin[leaf])):
            i, j, k, lo, hi = i[ok], j[ok], d[ok], low[ok], high[ok]
            r = self.rank[j]
            ok = (r >= lo) & (r < hi)
            i, k = i[ok], k[ok]
            after = i + 2 * k  # at most the text's end, as both leaves have k words
            stop = self.end[i]
            ok = (after == stop) | (self.words[np.minimum(after, stop - 1)] != self.words[i])
            found.append(i[ok] * (self.n + 1) + k[ok])
        each = np.unique(np.concatenate(found))
        return each // (self.n + 1), each % (self.n + 1)

    def runs(self, least: int = LEAST) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of ``least`` words or more, by start and period; start counts from the first
        text's first word."""
        place, period = self.branching()
        words, begin = self.words, self.begin
        # too short even when rotated as far as ``least`` asks: gone at once
        need = np.maximum(least - 2 * period, 0)
        for t in range(1, int(need.max(initial=0)) + 1):
            ok = need < t
            back = place - t
            test = ~ok & (back >= begin[place])
            ok[test] = words[back[test]] == words[back[test] + period[test]]
            place, period, need = place[ok], period[ok], need[ok]
        found: dict[tuple[int, int], int] = {}
        by_end: dict[int, list[tuple[int, int]]] = {}
        for i in np.lexsort((period, place + 2 * period)).tolist():
            p, q = int(place[i]), int(period[i])
            end, low = p + 2 * q, int(begin[place[i]])
            same = by_end.setdefault(end, [])
            if any(q % q0 == 0 and start <= p for start, q0 in same):
                continue  # a power of a repeat of the same run
            start, step = p, 64
            while start > low:
                m = min(step, start - low)
                unlike = np.flatnonzero(words[start - m : start] != words[start - m + q : start + q])
                if len(unlike):
                    start += int(unlike[-1]) + 1 - m
                    break
                start, step = start - m, step * 2
            same.append((start, q))
            found.setdefault((start, end), q)  # periods rise
        return sorted((s, e - s, q) for (s, e), q in found.items())


def _smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of ``at`` the nearest place before it with a smaller value; value 0 stands before each."""
    back = np.arange(-1, len(values) - 1)
    todo = at
    while len(todo):
        to = back[todo]
        more = values[to] >= values[todo]  # all between are no smaller: on to what is smaller than that
        todo, to = todo[more], to[more]
        back[todo] = back[to]
        if len(todo) < 32:
            for k in todo.tolist():  # from the left, so that what is jumped to is done
                p = int(back[k])
                while values[p] >= values[k]:
                    p = int(back[p])
                back[k] = p
            break
    return back[at]


# --- texts --------------------------------------------------------------------------------


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin (and the last one's end)."""
    cut = pc.ascii_split_whitespace(texts)
    flat = cut.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    offsets = cut.offsets.to_numpy()
    return flat.filter(real), before[offsets - offsets[0]]


def found(texts: pa.Array, least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """Each text's runs, start counted from its own first word, and each text without the repeats in its runs: the words
    that no run holds after its first period, joined by blanks."""
    words, bounds = split(texts)
    tree = Tree(words.dictionary_encode().indices.to_numpy().astype(np.int64), bounds)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    keep = np.ones(len(words), bool)
    every = tree.runs(least)
    text = np.searchsorted(bounds, [r[0] for r in every], side="right") - 1
    for k, (start, length, period) in zip(text.tolist(), every, strict=True):
        out[k].append((start - int(bounds[k]), length, period))
        keep[start + period : start + length] = False
    left = words.filter(pa.array(keep))
    at = np.concatenate(([0], np.cumsum(keep)))[bounds]
    return out, pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), left), " ")


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            part = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for k, m in zip(cuts, cuts[1:], strict=False):
                if m > k:
                    runs, left = found(texts.slice(k, m - k), least)
                    column = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], kind)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, m - k), column, left], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, runs {_RUN}, collapsed string")


# --- the query's columns ------------------------------------------------------------------


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tenth of the texts, by their id's crc32 h, made periodic: with g = h div 10, the words from
    number g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them. A null id leaves its text as it is."""
    h = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("words", words).withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words").cast("long")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rest = F.col("n") - F.col("a")
    rows = rows.withColumn("p", 1 + F.floor(rest / (3 + F.col("g") % 8)))
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    many = F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int")))
    made = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(many, F.lit(1), rest.cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digest_columns(out: DataFrame) -> DataFrame:
    """The result's columns from ``repeated``'s."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    written: Column = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = out.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
