"""Two-pass external shuffle into shards.

First pass: records are scattered uniformly into buckets of a size that fits
memory, by a seeded hash of the record, and of a running number among many equal
ones, so that these spread over the buckets too. Second pass: each bucket is put
in a fixed order, shuffled by Fisher and Yates's method with a seed of its own,
and dealt to the shards. A task has one bucket, or, where there would be more than
``MOST_TASKS``, as many that follow each other, sorted by bucket on disk and
shuffled one after the other: it holds one at a time. Buckets follow each other,
so the shuffled records form one sequence; record k of it goes to shard k mod n,
slot k div n (law ``rows``: shards differ by one record at most). Where a task's
records begin in the sequence is summed up from counts, a number for each task.

Defined results: a null text counts as empty and stays null in the shards. Rows
equal in doc_id and text are interchangeable. An empty table gives an empty
result. A text longer than a bucket gets into a bucket as any other. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import ARROW_ROWS, checkpointed, tune

LAW = "rows"
SEED = 42
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 32 << 20
#: Tasks of the second pass at most: so many counts come to the driver, and so many pieces leave each task of the first.
MOST_TASKS = 8192
#: Equal rows that may share a bucket; the share of all rows, as a power of two, above which equal rows are spread; and
#: the rows that one task makes of a spread row at a time.
FEW_COPIES = 64
HOT_BITS = 20
PIECE = 4096


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A seeded permutation of 0 to n - 1: from the end, each place swaps with one not after it."""
    order = list(range(n))
    picks = np.random.default_rng(seed).random(n)
    for i in range(n - 1, 0, -1):
        j = int(picks[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def size_of_text() -> Column:
    return (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")


def scattered(rows: DataFrame, seed: int, few: int = FEW_COPIES) -> tuple[DataFrame, int, int]:
    """``rows`` (doc_id, text) with a seeded hash ``h``; their number, and their bytes.

    Equal rows have equal hashes. Those of which there are more than ``few``, and more than one in 2 ** HOT_BITS of all
    rows - so at most 2 ** HOT_BITS hashes, whatever the table's size - are counted, which takes one row of each to the
    shuffle, and made again with a running number that goes into the hash."""
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    n, total = rows.agg(F.count("*"), F.sum(size_of_text())).first()
    total = total or 0
    hot = checkpointed(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > max(few, n >> HOT_BITS)).select("h"))
    if hot.isEmpty():
        return rows, n, total
    dealt = rows.join(F.broadcast(hot), "h", "left_anti")
    copies = rows.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "doc_id", "text").agg(F.count("*").alias("n"))
    pieces = copies.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))).repartition("h", "piece")
    each = F.sequence(F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1)
    made = pieces.withColumn("copy", F.explode(each)).select("doc_id", "text", F.xxhash64(F.lit(seed), "h", "copy").alias("h"))
    return dealt.unionByName(made), n, total


def sharded(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """(doc_id, text, shard, slot) for each row of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)
    rows, _, total = scattered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), seed)
    buckets = max(1, -(-total // bucket_bytes))
    tasks = min(buckets, most_tasks)
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    rows = rows.withColumn("task", F.floor(F.col("bucket") * tasks / F.lit(buckets)).cast("int"))
    before = np.zeros(tasks + 1, np.int64)
    for task, n in rows.groupBy("task").count().collect():  # most_tasks rows at most
        before[task + 1] = n
    before = np.cumsum(before)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, at = None, 0

        def shuffled() -> Iterator[pa.RecordBatch]:
            nonlocal at
            t = pa.Table.from_batches(held)  # one bucket
            t = t.take(pa.compute.sort_indices(t.select(["h", "doc_id"]), sort_keys=[("h", "ascending"), ("doc_id", "ascending")]))
            t = t.take(pa.array(fisher_yates(t.num_rows, (seed, number))))
            place = before[t.column("task")[0].as_py()] + at + np.arange(t.num_rows)
            at += t.num_rows
            yield from t.select(["doc_id", "text"]).append_column("shard", pa.array((place % shards).astype(np.int32))).append_column("slot", pa.array(place // shards)).to_batches(ARROW_ROWS)

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), b.num_rows]
            for k, m in zip(cuts, cuts[1:], strict=False):
                if m == k:
                    continue
                if held and bucket[k] != number:
                    yield from shuffled()
                    held = []
                number = int(bucket[k])
                held.append(b.slice(k, m - k))
        if held:
            yield from shuffled()

    # the exchange sends each task the buckets of its number
    dealt = rows.repartitionById(tasks, "task")
    if tasks < buckets:
        dealt = dealt.sortWithinPartitions("bucket")
    return dealt.select("doc_id", "text", "h", "bucket", "task").mapInArrow(shuffle, "doc_id long, text string, shard int, slot long")


def digest_columns(out: DataFrame) -> DataFrame:
    """The result's columns from ``sharded``'s."""
    return out.select(
        "doc_id", size_of_text().alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED) -> None:
    """Writes ``docs``' texts as Parquet, a folder for each shard, rows in files by slot."""
    out = sharded(docs, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
