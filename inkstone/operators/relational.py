"""Validated joins, reconciliation, set comparisons, ranking and agreement."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkstone.functions import text as T
from inkstone.storage import spread, written


class IntegrityError(ValueError):
    """Input that breaks a stated invariant."""


def require_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows``, or an error that names some of the keys that come twice."""
    twice = rows.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise IntegrityError(f"keys {list(keys)} are not unique: {[tuple(r)[:-1] for r in twice]}")
    return rows


def require_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise IntegrityError(f"columns are missing: {missing}")
    return rows


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join in which neither side has a key twice."""
    return require_unique(left, keys).join(require_unique(right, keys), list(keys), how)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner one-to-one join, an error if a key stands on one side only."""
    for a, b, name in ((left, right, "right"), (right, left, "left")):
        gone = a.join(b, list(keys), "left_anti").limit(5).collect()
        if gone:
            raise IntegrityError(f"keys missing on the {name}: {[tuple(r[k] for k in keys) for r in gone]}")
    return one_to_one(left, right, keys, "inner")


def only_in_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that stand on one side only."""
    a = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    b = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, status, mismatches): rows missing on a side, and the fields in which both sides differ (null equals null)."""
    a = left.select(key, F.lit(True).alias("__a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = right.select(key, F.lit(True).alias("__b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    rows = a.join(b, key, "full_outer")
    bad = F.concat_ws(",", *[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])
    status = F.when(F.col("__a").isNull(), "only right").when(F.col("__b").isNull(), "only left").when(bad != "", "differs").otherwise("equal")
    return rows.select(key, status.alias("status"), F.when(status == "differs", bad).otherwise("").alias("mismatches"))


def broadcast_lookup(rows: DataFrame, table: Mapping[str, str], column: str, out: str) -> DataFrame:
    """``rows`` with the value that a driver-side dictionary gives for a column, the column itself where it has none."""
    spark = rows.sparkSession
    side = spark.createDataFrame(list(table.items()) or [("", "")], f"`{column}` string, __to string")
    return rows.join(F.broadcast(side), column, "left").withColumn(out, F.coalesce("__to", column)).drop("__to")


def replace_aliases(text: Column, aliases: Mapping[str, str]) -> Column:
    """Whole-word aliases replaced, longer ones first, each place once."""
    return T.replace_words(text, aliases)


def _held(texts: DataFrame, passages: Sequence[str]) -> DataFrame:
    """(doc_id, passage): the passages, none of them empty, that each text (doc_id, text) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, p in enumerate(passages):
            automaton.add_word(p, k)
        automaton.make_automaton()
        for b in batches:
            found = [sorted({k for _, k in automaton.iter(t.as_py())}) for t in b.column(1)]
            own = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, found))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array([passages[k] for ks in found for k in ks], pa.string())], ["doc_id", "passage"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, passage string")


def containment(passages: DataFrame, docs: DataFrame, words: int = 8, short: int = 2000, listed: int = 1 << 20) -> DataFrame:
    """(item_id, doc_id): documents that hold a whole passage, wherever in the text it starts and ends.

    Passages of at most ``listed`` characters in all go to every task, whose automaton reads each text once. More are
    joined: a passage's first and last word may be pieces of a document's words; those between stand there whole. So its inner
    words, at most ``words`` of them, are a window of the document's words, and the join is an equality over such
    windows, one length at a time; what it finds is verified on the texts. A passage without inner words is looked for
    in each text, in the list of all such passages when there are at most ``short`` of them (each distinct one counts
    once), else by the pieces of text of its length. A null text holds nothing, an empty passage stands in every text."""
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    items = passages.filter("text IS NOT NULL").select("item_id", F.col("text").alias("passage"))
    inner = F.slice("w", 2, F.least(F.lit(words), F.greatest(F.size("w") - 2, F.lit(0))))
    texts = spread(docs.filter("text IS NOT NULL").select("doc_id", "text"))
    out = []
    whole = items.filter("passage <> ''").select("passage").distinct()
    if 0 < (whole.agg(F.sum(F.length("passage"))).first()[0] or 0) <= listed:
        held = _held(texts, [r["passage"] for r in whole.collect()])
        out.append(held.join(items, "passage").select("item_id", "doc_id"))
        items = items.filter("passage = ''")
    # white space at an end makes the word there whole, but does no harm to the rule
    items = items.withColumn("w", split(F.col("passage"))).select("item_id", "passage", inner.alias("w"))
    items = items.withColumns({"n": F.size("w"), "k": F.xxhash64(F.array_join("w", " "))})
    lengths = sorted(r["n"] for r in items.filter("n > 0").select("n").distinct().collect())  # at most ``words`` numbers
    # the words as a column of their own, as each window refers to them
    rows = texts.select("doc_id", split(F.col("text")).alias("w"))
    starts = lambda size, n, first: F.when(size >= n, F.sequence(F.lit(first), size - n + first)).otherwise(F.array().cast("array<int>"))
    window = lambda n: lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.array_join(F.slice("w", i + 1, n), " ")).alias("k"))
    piece = lambda n: lambda i: F.substr("text", i, F.lit(n))
    if lengths:
        windows = F.array_distinct(F.concat(*[F.transform(starts(F.size("w"), n, 0), window(n)) for n in lengths]))
        pairs = rows.select("doc_id", F.explode(windows).alias("x")).select("doc_id", "x.*").join(items.filter("n > 0").select("n", "k", "item_id"), ["n", "k"])
        full = pairs.select("item_id", "doc_id").join(items.select("item_id", "passage"), "item_id").join(texts, "doc_id")
        out.append(full.filter(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id"))
    bare = items.filter("n = 0").select("item_id", "passage")
    distinct = [r["passage"] for r in bare.select("passage").distinct().limit(short + 1).collect()]
    if 0 < len(distinct) <= short:  # a list of bounded size, unrolled into the scan of the texts
        listed = F.array(*map(F.lit, distinct))
        held = texts.select("doc_id", F.explode(F.filter(listed, lambda p: F.col("text").contains(p))).alias("passage"))
        out.append(held.join(bare, "passage").select("item_id", "doc_id"))
    elif distinct:
        sizes = sorted(r["n"] for r in bare.select(F.length("passage").alias("n")).distinct().collect())
        for n in sizes:
            pieces = F.array_distinct(F.transform(starts(F.length("text"), n, 1), piece(n)))
            held = texts.select("doc_id", F.explode(pieces).alias("passage"))
            out.append(held.join(bare.filter(F.length("passage") == n), "passage").select("item_id", "doc_id"))
    if not out:
        kinds = StructType([StructField(c, df.schema[c].dataType) for c, df in (("item_id", passages), ("doc_id", docs))])
        return docs.sparkSession.createDataFrame([], kinds)
    return reduce(DataFrame.union, out).distinct()


# --- sets -----------------------------------------------------------------------------------


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, of one side but not the other."""
    return left.exceptAll(right).unionAll(right.exceptAll(left))


def is_subset(left: DataFrame, right: DataFrame) -> bool:
    return left.join(right, left.columns, "left_anti").isEmpty()


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    return symmetric_difference(left, right).isEmpty()


def list_jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


# --- ranking ----------------------------------------------------------------------------------


def competition_rank(rows: DataFrame, score: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their rank in their group: equal scores share the smallest rank, the highest score first, null last.

    No group or score is gathered: rows are dealt by ranges of (by, score), equal ones over several ranges if they are
    many, and written once. A row's rank is that in its range, and the rows of its group in the ranges before, less those
    of its own score there; the latter are carried from range to range in a table of a few numbers a range and group."""
    by, parts = list(by), "__p"
    rows = rows.withColumn("__s", F.xxhash64(F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(*by, F.desc_nulls_last(score), "__s").withColumn(parts, F.spark_partition_id()).drop("__s")
    here = Window.partitionBy(*by, parts).orderBy(F.desc_nulls_last(score))
    dealt = written(dealt.withColumn("__r", F.rank().over(here)), "ranked")
    ends = dealt.groupBy(*by, parts, score).agg(F.count("*").alias("c"), F.min("__r").alias("r"))
    pick = lambda f: f(F.struct("r", F.struct(F.col(score).alias("v"), "c").alias("x")))
    ends = ends.groupBy(*by, parts).agg(F.sum("c").alias("n"), pick(F.min)["x"].alias("head"), pick(F.max)["x"].alias("tail"))
    ends = ends.withColumn("v", F.col("tail.v"))
    # rows of a range's last score up to and with it; scores fall, so these stand in ranges side by side
    ends = ends.withColumn("run", F.sum("tail.c").over(Window.partitionBy(*by, "v").orderBy(parts).rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*by).orderBy(parts)
    ends = ends.withColumns({
        "__o": F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__t": F.when(F.lag("v").over(before).eqNullSafe(F.col("head.v")), F.lag("run").over(before)).otherwise(F.lit(0)),
        "__v": F.col("head.v"),
    })
    ends = ends.select(*[F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)], F.col(parts).alias("__q"), "__o", "__t", "__v")
    same = F.col(parts) == F.col("__q")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{k}"))
    own = F.col("__r") + F.col("__o") - F.when(F.col(score).eqNullSafe(F.col("__v")), F.coalesce("__t", F.lit(0))).otherwise(F.lit(0))
    return dealt.join(ends, same).withColumn(out, own.cast("long")).drop(parts, "__r", "__q", "__o", "__t", "__v", *[f"__by_{k}" for k in range(len(by))])


#: Distinct values of which the driver reads off one by its rank.
FEW_VALUES = 4096


def value_at(rows: DataFrame, column: str, rank: int) -> tuple[float, int]:
    """The value of a rank, from 0, among a column's values, and how many are no larger. A sketch of the values - sums of
    counts, combined before they are sent - gives two near the rank; a second pass counts what is below each. Unless it is
    one of the two, the same is done with those between them, some thousandth of all, until few unlike ones are left."""
    values, below, left = rows.select(F.col(column).alias("v")), 0, rows.count()
    while True:
        few = values.groupBy("v").agg(F.count("*").alias("c")).limit(FEW_VALUES + 1).collect()
        own = rank - below
        if len(few) <= FEW_VALUES:
            for v, c in sorted(map(tuple, few)):
                if own < c:
                    return v, below + c
                own, below = own - c, below + c
            raise IntegrityError(f"no value has rank {rank}")
        shares = [max(0.0, own / left - 0.0005), min(1.0, own / left + 0.0005)]  # the sketch is off by a ten-thousandth
        a, b = values.agg(F.percentile_approx("v", shares, 10_000)).first()[0]
        v = F.col("v")
        under_a, upto_a, under_b, upto_b = values.agg(*[F.count_if(x) for x in (v < a, v <= a, v < b, v <= b)]).first()
        for x, under, upto in ((a, under_a, upto_a), (b, under_b, upto_b)):
            if under <= own < upto:
                return x, below + upto
        if own < under_a:
            values, left = values.filter(v < a), under_a
        elif own < under_b:
            values, below, left = values.filter((v > a) & (v < b)), below + upto_a, under_b - upto_a
        else:
            values, below, left = values.filter(v > b), below + upto_b, left - upto_b


def exact_quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The ``q`` quantile of a column's values, nulls left out: between the two nearest ones in proportion; None if there
    are none. No task or driver holds more than ``FEW_VALUES`` of them. ``rows`` is read several times."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n = values.count()
    if not n:
        return None
    at = q * (n - 1)
    low, upto = value_at(values, "v", math.floor(at))
    high = low if math.ceil(at) < upto else values.filter(F.col("v") > low).agg(F.min("v")).first()[0]
    return low + (at - math.floor(at)) * (high - low)


def best_row(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(1)


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


def ordered_join(rows: DataFrame, by: str, value: str, order: str, out: str, limit: int | None = None, sep: str = "; ") -> DataFrame:
    """A string of a group's values in order, the first ``limit`` ones."""
    if limit:  # the first ones of each group are found before they meet
        piece = F.pmod(F.xxhash64(order, value), F.lit(256)).alias("__piece")
        w = Window.partitionBy(by, "__piece").orderBy(order, value)
        rows = rows.select(by, value, order, piece) if value != order else rows.select(by, value, piece)
        rows = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit)
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    names = F.transform(F.slice(packed, 1, limit) if limit else packed, lambda x: x["v"])
    return rows.groupBy(by).agg(F.array_join(names, sep).alias(out))


def least_of(rows: DataFrame, by: Sequence[str], value: str, limit: int, out: str) -> DataFrame:
    """(by..., out): the ``limit`` smallest values of each group, rising; rows are dealt into pieces that keep as many
    each, so a group of any size brings a bounded number to its task."""
    piece = F.pmod(F.xxhash64(value), F.lit(256)).alias("__piece")
    w = Window.partitionBy(*by, "__piece").orderBy(value)
    few = rows.select(*by, piece, value).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit)
    return few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(value)), 1, limit).alias(out))


def pivoted(rows: DataFrame, by: str, column: str, values: Sequence, measure: str) -> DataFrame:
    """A wide table with a column for each of ``values``, 0 where a group has none."""
    return rows.groupBy(by).pivot(column, list(values)).agg(F.sum(measure)).fillna(0)


def barycentre(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(target, centre, place): targets by the mean place of their sources, then name."""
    centre = edges.join(places, "source").groupBy("target").agg(F.avg("place").alias("centre"))
    return numbered(centre, ["centre", "target"], "place")


def numbered(rows: DataFrame, order: Sequence[str], out: str, first: int = 1) -> DataFrame:
    """``rows`` with their place in an order, from ``first``. Rows are dealt by ranges of the order and written once; a
    row's place is that in its range plus the rows of the ranges before, so no task sees them all."""
    parts = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    parts = written(parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))), "numbered")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = parts.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = (F.col("__r") + F.col("__o") + (first - 1)).cast("int")
    return parts.join(F.broadcast(offsets), "__p").withColumn(out, place).drop("__p", "__r", "__o")


# --- agreement of raters --------------------------------------------------------------------


def agreement(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, agree): items and the share on which x equals y, for each group and (nulls) over all, in one pass."""
    measures = [F.count("*").alias("n"), F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("agree")]
    if not by:
        return rows.agg(*measures)
    return rows.groupingSets([[F.col(c) for c in by], []], *by).agg(*measures)


def cohen_kappa(rows: DataFrame, quadratic: bool = False) -> DataFrame:
    """One row: Cohen's kappa of two raters (x, y), nominal or with quadratic weights. A null rating is an error."""
    if not rows.filter("x IS NULL OR y IS NULL").isEmpty():
        raise IntegrityError("ratings are missing")
    if quadratic:  # of squared differences only sums and moments are needed, so no grid of ratings
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        seen, n = F.sum((x - y) * (x - y)), F.count("*")
        due = F.sum(x * x) + F.sum(y * y) - 2 * F.sum(x) * F.sum(y) / n
        return rows.agg((1 - seen / due).alias("kappa"))
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    each = cells.select(F.col("x").alias("v"), F.col("n").alias("nx"), F.lit(0).alias("ny")).union(cells.select("y", F.lit(0), "n")).groupBy("v").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"))
    met = each.agg(F.sum(F.col("nx") * F.col("ny")).alias("met"), F.sum("nx").alias("t"))  # agreement by chance, times items
    same = cells.agg(F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    t = F.col("t")
    return met.join(F.broadcast(same), F.lit(True)).select((1 - (t - F.col("same")) / (t - F.col("met") / t)).alias("kappa"))
