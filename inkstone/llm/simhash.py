"""SimHash near-dedup by the generalised pigeonhole principle.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles. Two fingerprints link at ``distance`` or fewer differing bits.
Links are found exactly: bits are grouped into partitions, correlated bits
together; a dynamic program gives each partition its own threshold so that the
estimated cost is least, under the constraint that any linked pair agrees to
within the threshold of at least one partition. Every fingerprint then emits a
signature for each way of masking that many bits of a partition; fingerprints
with a common signature are compared. Linked fingerprints form components.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other. Texts with fewer words than a shingle use the whole word
sequence. Equal rows get equal results. An empty table gives an empty result.
Extra columns are not read, or kept as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import checkpointed, components, fresh, n_tasks, quoted, salted_join, tune

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Members of one comparison block: larger signature groups are dealt into blocks, and pairs of blocks compared.
BLOCK = 1024
#: Cost of one comparison, in signature rows; a comparison is an XOR, a row is shuffled and sorted.
COMPARE_COST = 0.002
#: Fingerprints whose pairs are counted for the plan.
SAMPLE = 1024


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hash of each shingle, repeats included; only ASCII letters are lower-cased, only ASCII space splits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter(
        (digest(joined[i:j], seed) for i, j in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
        np.uint64, n - shingle + 1,
    )


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, th, fp) for each row; fp is the fingerprint's bits as a signed long, th a hash of the text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


# --- the plan: which bits go together, and how far each group may differ -------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bit i and bit j set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(np.array(b.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel().tolist(), n], pa.int64())], ["cell", "n"])

    cells = dict(fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())  # 64 * 64 + 1 rows
    both = np.array([cells.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)
    return int(cells.get(BITS * BITS, 0)), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal size: each group starts at the bit least like the
    groups so far and takes the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        taken = [b for g in groups for b in g]
        group = [min(left, key=lambda b: (round(alike[b, taken].sum(), 9) if taken else 0.0, b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (round(alike[b, group].sum(), 9), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def met_by_chance(both: np.ndarray, n: int, group: list[int], threshold: int) -> float:
    """The share of pairs within ``threshold`` bits of each other in a group, were its bits independent."""
    p = np.diag(both)[group] / max(n, 1)
    chance = np.zeros(len(group) + 2)
    chance[0] = 1.0
    for differ in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return float(chance[: threshold + 1].sum())


def expected_pairs(n: int, both: np.ndarray, group: list[int], threshold: int, sample: np.ndarray | None = None) -> float:
    """Pairs expected within ``threshold`` bits of each other in a group. The bits of a group are alike, so the pairs of
    a sample of fingerprints are counted; where that holds too few, the bit frequencies of all of them are the floor."""
    share = met_by_chance(both, n, group, threshold)
    if sample is not None and len(sample) > 1:
        mask = np.uint64(sum(1 << b for b in group))
        met = sum(int((np.bitwise_count((sample[i + 1 :] ^ sample[i]) & mask) <= threshold).sum()) for i in range(len(sample) - 1))
        share = max(share, met / (len(sample) * (len(sample) - 1) / 2))
    return n * (n - 1) / 2 * share


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int, sample: np.ndarray | None = None) -> tuple[float, list[int]]:
    """Thresholds (-1: the group is not probed) of least estimated cost whose slots, threshold + 1 each,
    add up to distance + 1; then every pair within ``distance`` is within the threshold of some group."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        step: dict[int, tuple[float, list[int]]] = {}
        pairs = [expected_pairs(n, both, g, t, sample) for t in range(min(distance + 1, len(g)))]
        for used, (cost, chosen) in best.items():
            for slots in range(min(distance + 1 - used, len(g)) + 1):
                more = 0.0
                if slots:
                    rows = float(np.prod([(len(g) - k) / (k + 1) for k in range(slots - 1)]))
                    more = n * rows + COMPARE_COST * pairs[slots - 1] * rows
                now = (cost + more, [*chosen, slots - 1])
                if used + slots not in step or now < step[used + slots]:
                    step[used + slots] = now
        best = step
    return best[distance + 1]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE, sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """The groups that are probed and their thresholds, of least estimated cost over 1 to distance + 2 groups."""
    options = []
    n = max(n, 1)  # signatures cost something even before there are rows, so that few are chosen
    for parts in range(1, distance + 3):
        groups = group_bits(n, both, parts)
        cost, thresholds = allocate(n, both, groups, distance, sample)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options)[2]


def masks(chosen: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(signature number, mask of the bits that must agree) for each signature that a fingerprint emits."""
    out = []
    for group, threshold in chosen:
        whole = sum(1 << b for b in group)
        out += [whole & ~sum(1 << b for b in gone) for gone in itertools.combinations(group, threshold)]
    return list(enumerate(out))


# --- links and components -----------------------------------------------------------------


def _star(batch_key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the fingerprints of equal key within ``distance``: a spanning star for each connected set."""
    label = np.arange(len(fp))
    u = fp.view(np.uint64)
    alive = np.arange(len(fp))
    step = 1
    while len(alive := alive[alive + step < len(fp)]):
        alive = alive[batch_key[alive] == batch_key[alive + step]]
        near = alive[np.bitwise_count(u[alive] ^ u[alive + step]) <= distance]
        while len(near):  # hook the larger root below the smaller, then flatten
            x, y = label[near], label[near + step]
            near, x, y = near[x != y], x[x != y], y[x != y]
            if not len(near):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label = flat
        step += 1
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own], fp[label[own]]


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``fps`` (fp) that connect just those within ``distance``,
    directly or through others. Not all pairs: in each compared block, a star for each connected set."""
    spark = fps.sparkSession
    some = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    signatures = masks(plan(*bit_statistics(fps), distance, np.array([r["fp"] for r in some], np.int64).view(np.uint64)))
    keys = F.array(*[F.struct(F.lit(k).alias("sig"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("val")) for k, m in signatures])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.sig", "k.val")
    large = rows.groupBy("sig", "val").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = large.select("sig", "val", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = salted_join(rows, large, ["sig", "val"], "left", spread=F.xxhash64("fp"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    with_block = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    rows = rows.select("fp", "sig", "val", F.explode(with_block).alias("p")).select("fp", F.xxhash64("sig", "val", "p.lo", "p.hi").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                kept_key = np.concatenate((kept_key, b.column(0).to_numpy()))
                kept_fp = np.concatenate((kept_fp, b.column(1).to_numpy()))
            if not len(kept_key):
                continue
            cut = len(kept_key) if b is None else int(np.searchsorted(kept_key, kept_key[-1]))  # the last key may go on
            a, c = _star(kept_key[:cut], kept_fp[:cut], distance)
            kept_key, kept_fp = kept_key[cut:], kept_fp[cut:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    sorted_rows = rows.repartition(n_tasks(spark), "key").sortWithinPartitions("key", "fp").select("key", "fp")
    return sorted_rows.mapInArrow(run, "a long, b long")


def _classes(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs``, and (fp, root) for each distinct one."""
    fps = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(fps.select("fp").distinct())
    found = components(links(distinct, distance)).withColumnRenamed("node", "fp")
    return fps, checkpointed(distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text); component_id is the
    smallest doc_id that links reach from it."""
    fps, roots = _classes(docs, shingle, distance)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp")
    smallest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = roots.join(smallest, "root").select("fp", "component_id")
    out = salted_join(fps, ids, ["fp"], "inner", spread=F.xxhash64("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row (all columns of ``docs``) of each component of linked fingerprints: that of the smallest doc_id (null
    first), then of the smallest text hash; of rows equal in both, one."""
    fps, roots = _classes(docs, shingle, distance)
    first = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("first")).join(roots, "fp")
    return rows_of(docs, first.groupBy("root").agg(F.min("first").alias("first")).select("first"))


def rows_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows (all columns) of ``docs`` at ``places`` (first: doc_id, th); of rows equal in both, one."""
    named, did, th = fresh(docs, "named", "did", "th")
    key = lambda c: [c.isNotNull(), F.coalesce(c.cast("long"), F.lit(0))]
    at = places.select(*[c.alias(k) for c, k in zip(key(F.col("first.doc_id")), (named, did), strict=True)], F.col("first.th").alias(th))
    keyed = docs.withColumns(dict(zip((named, did, th), (*key(F.col("doc_id")), F.xxhash64("text")), strict=True)))
    return keyed.join(at, [named, did, th], "left_semi").dropDuplicates([named, did, th]).select(*map(quoted, docs.columns))
