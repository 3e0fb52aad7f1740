"""Nearest neighbours by a hash-prefix forest.

Each tree of the forest gives every vector a long bit string - the signs of its
products with random hyperplanes - and keeps the strings as a sorted array. A
query descends each tree to its longest matching prefix by binary search; then
all trees ascend together, a bit at a time, until the ranges of strings that
share the prefix hold enough candidates. Candidates are scored exactly.

Largest inner product becomes largest cosine by one more dimension, which gives
all vectors of a block the same length. The first bits of some trees' strings
deal the rows over the cluster: a cell is a tree and a prefix, a query goes to
its own cell of each such tree, and a cell of many rows has several blocks, each
with a forest of its own. How many trees and bits are spent on that, and how many
candidates of a block are enough, is measured against brute force on a bounded
sample as large as a block, for the recall that ``Settings`` names: rows with
near neighbours need few cells, rows in random directions all of them (no bits,
one tree), which is then also the cheapest plan found.

Of equal vectors the k + 1 smallest ids are indexed: no other can be among a
query's k nearest, as ties go to smaller ids.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither do rows without an id. Vectors of different
lengths are not compared. An id is one vector: of its rows the shortest counts, of
these the smallest, component by component. A product beyond the largest double
is infinite; such scores tie. With fewer candidates than k all are returned; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import checkpointed, tune


@dataclass(frozen=True)
class Settings:
    k: int = 20
    trees: int = 24
    #: Length of the hash strings; at most 64.
    bits: int = 48
    #: Rows of a block, fewer for long vectors: so many numbers at most.
    block_rows: int = 16384
    block_numbers: int = 1 << 24
    chunk_queries: int = 16384
    #: Tasks of the search at most.
    tasks: int = 4096
    seed: int = 42
    #: The recall asked of a block's forest, and of the cells before it.
    recall: float = 0.96
    cell_recall: float = 0.97
    #: Trees whose prefixes may deal the rows, and bits of a prefix at most.
    cell_trees: tuple[int, ...] = (1, 2, 4, 8, 16)
    cell_bits: int = 20
    #: Queries measured in a sample, queries measured against all rows, and vector lengths (those of most rows) that are measured; others are searched whole.
    sample_queries: int = 100
    cell_queries: int = 300
    lengths: int = 8
    shares: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.2, 1.8, 2.5, 4.0, 6.0, 9.0, 14.0, 24.0)

    def rows_of_block(self, dim: int) -> int:
        return max(1024, min(self.block_rows, self.block_numbers // (dim + 1)))


@dataclass(frozen=True)
class Plan:
    """How vectors of one length are searched: their largest component and (over it) length, the trees and bits of the
    cells, and the candidates that are enough, as a share of a block."""

    scale: float = 1.0
    top: float = 1.0
    trees: int = 1
    bits: int = 0
    share: float = math.inf


def power_of_two(x: float) -> float:
    """A power of two not far from x, by which numbers are divided without rounding."""
    return math.ldexp(1.0, max(-1000, min(1000, math.frexp(x)[1])))


def planes(s: Settings, trees: int, dim: int, bits: int, salt: int = 0) -> np.ndarray:
    return np.random.default_rng((s.seed, salt)).normal(size=(trees, dim + 1, bits)).astype(np.float32)


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors of length at most ``top`` with one more component that makes them all of length one."""
    return np.concatenate([x, np.sqrt(np.maximum(top**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1) / top


def turned(queries: np.ndarray) -> np.ndarray:
    """Queries as unit vectors, the component more being zero."""
    unit = queries / np.abs(queries).max(axis=1, keepdims=True)
    return np.concatenate([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((len(unit), 1))], axis=1)


def prefixes(lifted: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[trees, vectors]: the strings of ``p``'s hyperplanes as whole numbers."""
    weights = np.int64(1) << np.arange(p.shape[2] - 1, -1, -1, dtype=np.int64)
    lifted = lifted.astype(np.float32)
    return np.stack([((lifted @ q) > 0) @ weights for q in p])


def inner(x: np.ndarray, q: np.ndarray) -> float:
    """The inner product in double precision, its sum without rounding errors on the way."""
    with np.errstate(over="ignore"):
        products = x * q
    if np.isfinite(products).all():
        try:
            return math.fsum(products.tolist())
        except OverflowError:
            pass
    a, b = power_of_two(np.abs(x).max()), power_of_two(np.abs(q).max())
    return float(math.fsum((x / a * (q / b)).tolist()) * a * b)


#: The share of candidates, counted in every tree, from which on a block's rows are all multiplied.
DENSE = 0.5


class Forest:
    """The trees over one block's vectors. ``share``: candidates that are enough, counted in every tree, over rows."""

    def __init__(self, vectors: np.ndarray, s: Settings):
        self.x = vectors.astype(np.float64)
        self.s = s
        n, d = self.x.shape
        self.scaled = self.x / power_of_two(np.abs(self.x).max(initial=1e-300))
        self.top = float(np.sqrt((self.scaled**2).sum(axis=1)).max(initial=1e-300))
        self.planes = planes(s, s.trees, d, s.bits)
        codes = self._codes(lift(self.scaled, self.top))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        """[trees, vectors]: the bit strings, as the top bits of 64."""
        weights = (np.uint64(1) << np.arange(63, 63 - self.s.bits, -1, dtype=np.uint64))
        lifted = lifted.astype(np.float32)
        return np.stack([((lifted @ p) > 0) @ weights for p in self.planes])

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[depths + 1, trees, queries]: for prefixes of each length, where strings that share the query's begin and end."""
        codes = self._codes(turned(queries))
        depths = min(self.s.bits, max(1, len(self.x)).bit_length() + 8)
        low = np.zeros((depths + 1, *codes.shape), np.int32)
        high = np.full((depths + 1, *codes.shape), len(self.x), np.int32)
        for depth in range(1, depths + 1):
            rest = np.uint64((1 << (64 - depth)) - 1)
            for t in range(self.s.trees):
                low[depth, t] = np.searchsorted(self.codes[t], codes[t] & ~rest, side="left")
                high[depth, t] = np.searchsorted(self.codes[t], codes[t] | rest, side="right")
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, enough: float) -> np.ndarray:
        """One query's candidates: all trees ascend together to the longest prefixes that hold enough."""
        counts = (high - low).sum(axis=1)
        depth = int(np.flatnonzero(counts >= min(enough, counts[0])).max())
        if depth == 0:
            return np.arange(len(self.x))
        seen = np.zeros(len(self.x), bool)
        for t in range(self.s.trees):
            seen[self.order[t, low[depth, t] : high[depth, t]]] = True
        return np.flatnonzero(seen)

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, share: float) -> list[list[tuple[float, int]]]:
        """For each query its k best (score, id), best first; ``own`` holds the ids that queries pass over."""
        low, high = self.ranges(queries)
        k, out = self.s.k, []
        # where a query has much of the block as candidates, one product with all rows costs less than to gather them
        units = queries / np.array([power_of_two(x) for x in np.abs(queries).max(axis=1)])[:, None]
        dense = units @ self.scaled.T if share >= DENSE else None
        for i, q in enumerate(queries.astype(np.float64)):
            at = self.candidates(low[:, :, i], high[:, :, i], max(4 * k, share * len(self.x)))
            at = at[ids[at] != own[i]]
            if not len(at):
                out.append([])
                continue
            unit = units[i]
            near = self.scaled[at] @ unit if dense is None else dense[i, at]
            if len(at) > k:
                least = np.partition(near, len(at) - k)[len(at) - k]
                at = at[near >= least - 1e-10 * self.top * np.linalg.norm(unit)]
            exact = [(inner(self.x[j], q), int(ids[j])) for j in at.tolist()]
            out.append(sorted(exact, key=lambda e: (-e[0], e[1]))[:k])
        return out


def _truth(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled rows, their products with all rows (their own left out), and the k-th best of each."""
    pick = np.unique(np.linspace(0, len(x) - 1, s.sample_queries).astype(int))
    scores = x[pick] @ x.T
    scores[np.arange(len(pick)), pick] = -np.inf
    return pick, scores, np.partition(scores, len(x) - s.k, axis=1)[:, len(x) - s.k]


def measured_share(vectors: np.ndarray, s: Settings = Settings()) -> float:
    """The smallest of ``shares`` with which a forest over ``vectors`` has the recall asked for."""
    n = len(vectors)
    if n <= 2 * s.k:
        return math.inf
    forest = Forest(vectors, s)
    pick, scores, least = _truth(forest.scaled, s)
    low, high = forest.ranges(forest.scaled[pick])

    def enough(share: float) -> bool:
        hits = 0
        for i in range(len(pick)):
            at = forest.candidates(low[:, :, i], high[:, :, i], max(4 * s.k, share * n))
            hits += min(s.k, int((scores[i, at] >= least[i] - 1e-12).sum()))
        return hits >= s.recall * s.k * len(pick)

    a, b = 0, len(s.shares)  # more candidates never lower the recall, so the first share that is enough is bisected
    while a < b:
        m = (a + b) // 2
        a, b = (a, m) if enough(s.shares[m]) else (m + 1, b)
    return s.shares[a] if a < len(s.shares) else math.inf


def measured_cells(vectors: np.ndarray, asked: np.ndarray, near: list[np.ndarray], top: float, rows: int, queries: int, s: Settings = Settings()) -> tuple[int, int]:
    """The trees and bits by which ``rows`` and ``queries`` are dealt: of those with the recall asked for, the ones that
    send least - rows and queries once for each tree and block - and compare least. ``vectors`` is a sample of the rows;
    ``near`` holds the nearest of all rows for each of the queries ``asked``."""
    block = s.rows_of_block(vectors.shape[1])
    trees = max(s.cell_trees)
    p = planes(s, trees, vectors.shape[1], s.cell_bits, 1)
    codes, own = prefixes(lift(vectors, top), p), prefixes(turned(asked), p)
    due = prefixes(lift(np.concatenate(near), top), p) ^ np.repeat(own, [len(x) for x in near], axis=1)
    best = (queries * rows / block + rows * max(1.0, queries / s.chunk_queries), 1, 0)
    for bits in range(1, s.cell_bits + 1):
        shift = s.cell_bits - bits
        share = float(((codes >> shift)[:, None, :] == (own >> shift)[:, :, None]).mean())  # rows of a query's cell
        for t in s.cell_trees:
            if ((due[:t] >> shift) == 0).any(axis=0).mean() >= s.cell_recall:
                cost = t * (queries * max(1.0, share * rows / block) + rows * max(1.0, queries * share / s.chunk_queries))
                best = min(best, (cost, t, bits))
    return best[1:]


def true_neighbours(rows: DataFrame, asked: np.ndarray, ids: np.ndarray, scale: float, k: int) -> list[np.ndarray]:
    """The k nearest of all ``rows`` (vec_id, embedding) for each of a bounded number of queries, by brute force: one
    pass, in which a task keeps k rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[float, int, list[float]]]] = [[] for _ in ids]
        for b in batches:
            own = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            scores = asked @ (x / scale).T
            scores[ids[:, None] == own] = -np.inf
            for i in range(len(ids)):
                few = np.argpartition(-scores[i], min(k, len(own)) - 1)[:k]
                kept[i] = sorted([*kept[i], *((float(scores[i, j]), int(own[j]), x[j].tolist()) for j in few)], key=lambda r: (-r[0], r[1]))[:k]
        flat = [(i, *r) for i, best in enumerate(kept) for r in best if r[1] > -math.inf]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["i", "score", "id", "x"])

    found = rows.select("vec_id", "embedding").mapInArrow(run, "i int, score double, id long, x array<double>")
    best = Window.partitionBy("i").orderBy(F.desc("score"), "id")
    out: list[list[list[float]]] = [[] for _ in ids]
    for r in found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).collect():  # k rows of each query
        out[r["i"]].append(r["x"])
    return [np.array(x, float).reshape(len(x), asked.shape[1]) / scale for x in out]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim): rows whose id is not null and whose vector is finite and not zero, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def plans(indexed: DataFrame, queries: DataFrame, s: Settings) -> dict[int, Plan]:
    """A plan for each of the ``lengths`` vector lengths of most rows, measured on a sample as large as a block."""
    largest = F.array_max(F.transform("embedding", F.abs))
    of = indexed.groupBy("dim").agg(F.count("*").alias("n"), F.max(largest).alias("scale")).orderBy(F.desc("n"), "dim").limit(s.lengths).collect()
    asked = dict(queries.groupBy("dim").agg(F.count("*")).filter(F.col("dim").isin([r["dim"] for r in of])).collect()) if of else {}
    out = {}
    for dim, n, largest in of:
        scale = power_of_two(largest)
        own = indexed.filter(F.col("dim") == dim)
        by_hash = lambda rows, m: rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).select("vec_id", "embedding").collect()
        rows = by_hash(own, s.rows_of_block(dim))  # block_numbers numbers at most
        x = np.array([r["embedding"] for r in rows], float) / scale
        part = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale))
        top, cells = 1.0, (1, 0)
        few = by_hash(queries.filter(F.col("dim") == dim), s.cell_queries) if n > 2 * s.rows_of_block(dim) else []
        if few:
            top = math.sqrt(own.agg(F.max(part)).first()[0]) or 1.0
            q = np.array([r["embedding"] for r in few], float) / scale
            cells = measured_cells(x, q, true_neighbours(own, q, np.array([r["vec_id"] for r in few]), scale, s.k), top, n, asked.get(dim, 0), s)
        out[dim] = Plan(scale, top, *cells, measured_share(x, s))
    return out


def dealt(rows: DataFrame, found: dict[int, Plan], s: Settings, query: bool) -> DataFrame:
    """``rows`` (vec_id, embedding, dim) with their cells, one row for each tree of their length's plan."""
    if not any(p.bits for p in found.values()):
        return rows.withColumn("cell", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part, plan = b.filter(pa.array(dims == dim)), found.get(dim, Plan())
                cells = np.zeros((1, part.num_rows), np.int64)
                if plan.bits:
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    p = planes(s, max(s.cell_trees), dim, s.cell_bits, 1)[: plan.trees, :, : plan.bits]
                    cells = prefixes(turned(x) if query else lift(x / plan.scale, plan.top), p) + (np.arange(plan.trees, dtype=np.int64) << plan.bits)[:, None]
                for of_tree in cells:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of_tree, pa.int64())], ["vec_id", "embedding", "dim", "cell"])

    return rows.select("vec_id", "embedding", "dim").mapInArrow(run, "vec_id long, embedding array<double>, dim int, cell long")


def nearest(vectors: DataFrame, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``vectors`` (vec_id, embedding) for which
    ``is_query`` (of vec_id) holds."""
    tune(vectors.sparkSession)
    one = usable(vectors).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("x"))
    rows = one.select("vec_id", "x.embedding", "x.dim")
    equal = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = checkpointed(rows.withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= s.k + 1).drop("r"))
    queries = checkpointed(rows.filter(is_query))
    found = plans(indexed, queries, s)
    a, b = dealt(indexed, found, s, False), dealt(queries, found, s, True)
    # a row for each cell, of which there are few for each block
    block_rows = F.greatest(F.lit(1024), F.least(F.lit(s.block_rows), F.floor(F.lit(s.block_numbers) / (F.col("dim") + 1))))
    blocks = a.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    chunks = b.groupBy("dim", "cell").agg(F.ceil(F.count("*") / s.chunk_queries).cast("int").alias("chunks"))
    sizes = checkpointed(blocks.join(chunks, ["dim", "cell"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    a = a.join(sizes, ["dim", "cell"]).withColumns({"b": deal("blocks"), "query": F.lit(False)}).withColumn("c", every("chunks"))
    b = b.join(sizes, ["dim", "cell"]).withColumns({"c": deal("chunks"), "query": F.lit(True)}).withColumn("b", every("blocks"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim = t.column("dim")[0].as_py()
        mask = t.column("query").to_numpy(zero_copy_only=False)
        ids = t.column("vec_id").to_numpy()
        x = t.column("embedding").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out: list[tuple[int, float, int]] = []
        if mask.any() and not mask.all():
            order = np.argsort(ids[~mask], kind="stable")
            forest = Forest(x[~mask][order], s)
            known, asked = ids[~mask][order], ids[mask]
            share = min(found.get(dim, Plan()).share, float(s.trees))  # every row counts once in each tree: all rows
            for k in range(0, len(asked), 512):
                near = forest.search(x[mask][k : k + 512], known, asked[k : k + 512], share)
                out += [(int(q), score, j) for q, best in zip(asked[k : k + 512], near, strict=True) for score, j in best]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[2] for o in out], pa.int64()), "score": pa.array([o[1] for o in out], pa.float64())})

    names = ["vec_id", "embedding", "dim", "cell", "b", "c", "query"]
    # a task for each few blocks: joined by their bytes, which say little of their work, they would be one task
    tasks = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("chunks"))).first()[0] or 1
    together = a.select(names).unionByName(b.select(names)).repartition(int(min(max(2 * tasks, 1), s.tasks)), "dim", "cell", "b", "c")
    near = together.groupBy("dim", "cell", "b", "c").applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # a neighbour met in several cells comes with the same score each time
    near = near.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= s.k)
    return near.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")
