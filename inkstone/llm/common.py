"""Helpers shared by the training-data operators.

Null, repeated-row and skew rules that hold for every operator here:

* A null text counts as the empty text; a null doc_id is an ordinary id.
* Equal rows are treated alike: they get equal results, and none is dropped.
* Only the columns an operator names are read, and found as Spark finds them,
  whatever their case; where extra columns are carried along, internal columns
  get names that no column of the table has (``fresh``).
* Nothing that grows with the corpus is collected: the driver only ever sees
  per-partition counters, histograms over a fixed domain, and bounded samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.storage import checkpointed, given_up, shared_folder, written

__all__ = ["checkpointed", "given_up", "shared_folder", "written"]

#: Rows in an Arrow batch, so that a batch of long texts stays in tens of MB.
ARROW_ROWS = 2000
#: A key is hot when it holds more than one row in HOT_SHARE; so at most HOT_SHARE keys are hot.
HOT_SHARE = 500
#: Tasks over which one hot key is spread.
HOT_SALTS = 64


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers; a smaller bound of the session's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def place_of(docs: DataFrame, name: str) -> int:
    """The place of a column, found without regard to case."""
    return [c.lower() for c in docs.columns].index(name.lower())


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The ``names``, lengthened where ``docs`` has a column of that name in any case."""
    used, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through ``run``, which keeps the columns; by place, as Spark's own call fails on some column names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *, spread: Column) -> DataFrame:
    """``left`` joined to ``right`` (one row per key) where some keys may hold a large share of ``left``.

    Keys with more than 1/HOT_SHARE of the rows - at most HOT_SHARE of them, so
    the list that is sent to every task is bounded - are dealt over HOT_SALTS
    tasks by ``spread``; their right-hand rows are repeated as often. Keys
    compare null-safe as grouping keys: callers pass non-null keys.
    """
    spark, limit = left.sparkSession, max(1000, left.count() // HOT_SHARE)
    sizes = left.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).drop("__n")
    found = [tuple(r) for r in sizes.collect()]  # fewer than HOT_SHARE keys, as their counts add up to all rows
    if not found:
        return left.join(right, on, how)
    hot = spark.createDataFrame(found, sizes.schema).withColumn("__hot", F.lit(True))
    salt = F.when(F.col("__hot"), F.pmod(spread, F.lit(HOT_SALTS))).otherwise(F.lit(0)).cast("int")
    a = left.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def running_offsets(df: DataFrame, group: list[str], part: str, weight: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the parts of the same group before this one.

    ``part`` is a bucket number; the table of (group, part) sums has as many
    rows as groups times buckets, not as documents.
    """
    sums = df.groupBy(*group, part).agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(out, F.coalesce(F.sum("__w").over(before), F.lit(0))).drop("__w")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int, spread: Column) -> DataFrame:
    """Adds ``out``: a gapless 0-based rank within ``group``, however large a group is.

    Rows are dealt into ``buckets`` by ``spread``; the rank is the row number in
    (group, bucket) plus the rows of the group's earlier buckets.
    """
    df = df.withColumn("__b", F.pmod(spread, F.lit(buckets)).cast("int"))
    within = Window.partitionBy(*group, "__b").orderBy(*order)
    offsets = running_offsets(df, group, "__b", F.lit(1), "__before")
    df = df.withColumn("__r", F.row_number().over(within) - 1)
    return df.join(offsets, [*group, "__b"]).withColumn(out, (F.col("__r") + F.col("__before")).cast("long")).drop("__b", "__r", "__before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node reachable.

    Alternates large-star and small-star steps; each step is two aggregations
    with map-side combine and is checkpointed to the shared folder, so a lost
    executor costs one step. Ends when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    e = checkpointed(e)
    stamp = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == stamp:
            break
        stamp = tuple(new)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select("root", "root")).groupBy("node").agg(F.min("root").alias("root"))
