"""Near-dedup by SimHash, verified and completed at a Jaccard similarity of word shingles.

Two texts link when their sets of five-word shingles have a Jaccard similarity
of 0.8 or more; linked texts form components. Candidates come from the search of
``simhash`` over fingerprints of the same shingles. As texts of that similarity
differ in 10 of 64 bits on average, far beyond what a pigeonhole search can reach
on large tables, MinHash bands give the other candidates: of the pairs at
similarity 0.8 they miss one in 4800, above it fewer.

Candidates are compared on whole texts, and not all against all. First each text
is compared with the hub of its SimHash links and with the smallest member of
those band groups that it shares most often; what links there is one component
from then on, so a large group of copies costs one comparison a text. Then only
the band groups that still hold several components are compared, members outside
the largest component against all others, in blocks. No pair is written down
before it is found to link.

Texts with equal shingle sets are one class, compared once. Defined results: a
null, empty or blank text has the empty set and links with any other such text.
Texts with fewer words than a shingle use the whole word sequence. Of rows equal
in doc_id and text one stays. An empty table gives an empty result. Very long
texts are read whole. Extra columns of any name are kept as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import simhash
from inkstone.llm.common import checkpointed, components, n_tasks, salted_join, tune, written

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: MinHash values of a band, and bands.
WIDTH, BANDS = 7, 36
#: Texts that one piece compares with their hub, and texts of one side of a comparison block.
PIECE = 64
BLOCK = 512

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, WIDTH * BANDS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(simhash.shingle_hashes(text, shingle, SEED))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[k : k + 1024, None] * _FACTORS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, WIDTH))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two shingle sets, sorted and without repeats, have this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, fp, bands) for each row: node is a hash of the shingle set, th one of the text, fp the
    SimHash fingerprint."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, keys = [], [], []
            for text in b.column(2):
                hashes = simhash.shingle_hashes(text.as_py(), SHINGLE, SEED)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(simhash.majority(hashes))
                keys.append(bands(own))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "node", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, node long, fp long, bands array<long>")


# --- first round: each text with a hub --------------------------------------------------------


def hubs(classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(hub, node): for each node the hub of its SimHash links, and the smallest node of most of its band groups."""
    fps = checkpointed(classes.groupBy("fp").agg(F.min("node").alias("node")))
    found = simhash.links(fps.select("fp"))
    by_bits = found.join(fps.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    equal = salted_join(classes.select("fp", F.col("node").alias("x")), fps.select("fp", F.col("node").alias("y")), ["fp"], "inner", spread=F.xxhash64("x"))
    by_bits = by_bits.select("x", "y").union(equal.select("x", "y")).filter("x != y").select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("hub"))
    often = keys.filter("node != low").groupBy("node", "low").agg(F.count("*").alias("n"))
    by_bands = often.groupBy("node").agg(F.max(F.struct("n", F.bitwise_not("low").alias("low"))).alias("best")).select("node", F.bitwise_not("best.low").alias("hub"))
    return by_bits.unionByName(by_bands).select("hub", "node").distinct()


def starred(pairs: DataFrame, texts: DataFrame, block: int = PIECE) -> DataFrame:
    """The pairs (hub, node) that link. A hub's members are dealt into pieces, each of which gets the hub's text."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    members = salted_join(pairs, sizes, ["hub"], "inner", spread=F.xxhash64("node"))
    members = members.select("hub", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), "node").join(texts, "node")
    own = sizes.withColumn("node", F.col("hub")).join(texts, "node").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = own.select("hub", "piece", F.lit(0).alias("side"), "node", "text").unionByName(members.select("hub", "piece", F.lit(1).alias("side"), "node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, hub = None, np.empty(0, np.uint64)
        for b in batches:
            out = []
            for at, piece, side, node, text in zip(*[b.column(i).to_pylist() for i in range(4)], b.column(4), strict=True):
                if side == 0:
                    here, hub = (at, piece), shingle_set(text.as_py())
                elif here == (at, piece) and similar(hub, shingle_set(text.as_py())):
                    out.append((at, node))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = rows.repartition(n_tasks(pairs.sparkSession), "hub", "piece").sortWithinPartitions("hub", "piece", "side", "node")
    return dealt.select("hub", "piece", "side", "node", "text").mapInArrow(run, "a long, b long")


# --- second round: band groups that hold several components ---------------------------------------


def crossing(rest: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Roots (a, b) that connect all components that links between (root, set) of both lists connect; a spanning
    forest, not all pairs."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    size = np.fromiter((len(s) for _, s in others), np.int64, len(others))
    owner = np.repeat(np.arange(len(others)), size)
    everything = np.concatenate([s for _, s in others])
    order = np.argsort(everything, kind="stable")
    terms, holders = everything[order], owner[order]
    edges = []
    for root, own in rest:
        low, high = np.searchsorted(terms, own, "left"), np.searchsorted(terms, own, "right")
        parts = [holders[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
        if not parts:
            continue
        shared = np.bincount(np.concatenate(parts), minlength=len(others))
        for j in np.flatnonzero(shared >= similarity * (size + len(own) - shared) - 1e-9).tolist():
            a, b = find(root), find(others[j][0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((root, others[j][0]))
    return edges


def crossed(keys: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the roots of ``keys`` (key, node, root) that links within a key connect."""
    sizes = keys.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    stats = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max(F.struct("n", "root")).alias("most")).filter("n > most.n")
    # groups of the same members are compared once
    stats = stats.groupBy("n", "sum", "most").agg(F.min("key").alias("key"))
    count = lambda c: F.ceil(c / block).cast("int")
    stats = checkpointed(stats.select("key", F.col("most.root").alias("most"), count(F.col("n") - F.col("most.n")).alias("g"), count(F.col("n")).alias("m")))
    rows = salted_join(keys, stats, ["key"], "inner", spread=F.xxhash64("node"))
    i, j = F.pmod(F.xxhash64("node"), F.col("g")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")).cast("int")
    every = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    as_other = every("g", lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    as_rest = every("m", lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(0).alias("side")))
    cells = F.when(F.col("root") != F.col("most"), F.concat(as_rest, as_other)).otherwise(as_other)
    rows = rows.select("key", "node", "root", F.explode(cells).alias("c")).select(F.xxhash64("key", "c.i", "c.j").alias("cell"), "c.side", "node", "root").join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(3)], b.column(3), strict=True))
        for _, group in itertools.groupby(each, key=lambda r: r[0]):
            sides: tuple[list, list] = ([], [])
            for _, side, root, text in group:
                sides[side].append((root, shingle_set(text.as_py())))
            edges = crossing(*sides) if sides[0] and sides[1] else []
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition(n_tasks(keys.sparkSession), "cell").sortWithinPartitions("cell", "side", "node")
    return dealt.select("cell", "side", "root", "text").mapInArrow(run, "a long, b long")


def rooted(rows: DataFrame, column: str, edges: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the smallest node that ``edges`` (a, b) reach from it."""
    found = components(edges).toDF(column, "to")
    return rows.join(found, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (all columns of ``docs``) of each component: that of the smallest doc_id (null first), then of the
    smallest text hash; of rows equal in both, one."""
    found = checkpointed(signatures(docs))
    classes = checkpointed(found.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key", "low")
    keys = checkpointed(salted_join(keys, shared, ["key"], "inner", spread=F.xxhash64("node")).select("key", "node", "low"))
    pairs = checkpointed(hubs(classes, keys))
    needed = keys.select("node").union(pairs.select("node")).union(pairs.select("hub")).distinct()
    places = checkpointed(needed.join(classes.select("node", "first"), "node"))
    texts = written(texts_of(docs, places), "near-texts")
    roots = checkpointed(rooted(classes.select("node", "first", F.col("node").alias("root")), "root", starred(pairs, texts, min(block, PIECE))))
    members = keys.select("key", "node").join(roots.select("node", "root"), "node")
    roots = rooted(roots, "root", crossed(checkpointed(members), texts, block))
    return simhash.rows_of(docs, roots.groupBy("root").agg(F.min("first").alias("first")).select("first"))


def texts_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, text) for ``places`` (node, first: doc_id, th)."""
    key = lambda c: [c.isNotNull(), F.coalesce(c.cast("long"), F.lit(0))]
    at = places.select("node", *[c.alias(k) for c, k in zip(key(F.col("first.doc_id")), ("named", "did"), strict=True)], F.col("first.th").alias("th"))
    own = docs.select(*[c.alias(k) for c, k in zip(key(F.col("doc_id")), ("named", "did"), strict=True)], F.xxhash64("text").alias("th"), "text")
    return own.join(at, ["named", "did", "th"]).select("node", "text").dropDuplicates(["node"])
