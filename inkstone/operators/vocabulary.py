"""Units, vocabulary, phrases and keyword networks over token rows.

Token lists are (doc_id, words), a row for each document; token rows are (doc_id, n,
pos, token, next). A caller that uses either more than once writes the lists first
(``storage.written``), which are many times smaller. A document's terms are counted
where its list stands, so no tokens are shuffled; token rows are aggregated with
map-side combine. Vocabularies are as long as their caps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import measures as M
from inkstone.functions import text as T
from inkstone.storage import checkpointed


def token_lists(docs: DataFrame, stop: Sequence[str] = (), collapse: bool = True, lemma: Callable[[Column], Column] | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """``docs`` with their tokens, ``words``, in place of ``text``."""
    rest = [c for c in docs.columns if c != "text"]
    # the tokens as a column of their own, as the collapse refers to them for each element
    rows = docs.select(*rest, T.tokens(F.col("text"), stop, aliases=aliases, lemma=lemma).alias("words"))
    return rows.withColumn("words", T.without_repeats(F.col("words"))) if collapse else rows


def rows_of(lists: DataFrame) -> DataFrame:
    """(doc_id, n, pos, token, next): the tokens of each list, n in number, each with the one after it (null at the end)."""
    after = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next")
    rows = lists.select("doc_id", F.size("words").alias("n"), F.posexplode(F.arrays_zip(F.col("words").alias("token"), after)).alias("pos", "x"))
    return rows.select("doc_id", "n", "pos", "x.token", "x.next")


def token_rows(docs: DataFrame, stop: Sequence[str] = (), collapse: bool = True, lemma: Callable[[Column], Column] | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """``rows_of`` the documents' lists."""
    return rows_of(token_lists(docs.select("doc_id", "text"), stop, collapse, lemma, aliases))


#: Tokens that are counted together; a longer list by itself.
TOGETHER = 1 << 20


def list_counts(lists: DataFrame, size: int | None = None, min_tail: int = 100) -> DataFrame:
    """``lists`` with a row for each term in place of ``words``: (..., unit, term, n, size), a list's - with ``size`` its
    units' - occurrences of each term, and the list's tokens. Lists are counted where they stand, without a shuffle; null
    and empty ones give no rows."""
    rest = [c for c in lists.columns if c != "words"]

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        words = b.column(len(rest))
        coded = words.flatten().dictionary_encode()
        code, many = coded.indices.to_numpy(), np.diff(words.offsets.to_numpy()).astype(np.int64)
        own = np.repeat(np.arange(b.num_rows), many)
        unit = np.zeros(len(own), np.int64)
        if size:
            last = (many - 1) // size
            last -= (last > 0) & (many - last * size < min_tail)
            pos = np.arange(len(own)) - (np.cumsum(many) - many)[own]
            unit = np.minimum(pos // size, last[own])
        group = np.cumsum(np.append(0, (np.diff(own) != 0) | (np.diff(unit) != 0)))[: len(own)]
        key, at, n = np.unique(group * max(1, len(coded.dictionary)) + code, return_index=True, return_counts=True)
        parent = pa.array(own[at])
        columns = [b.column(k).take(parent) for k in range(len(rest))]
        columns += [pa.array(unit[at].astype(np.int32)), coded.dictionary.take(pa.array(code[at])), pa.array(n.astype(np.int64)), pa.array(many[own[at]].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*rest, "unit", "term", "n", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(len(rest))))
            part = np.cumsum(np.diff(b.column(len(rest)).offsets.to_numpy()).astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    yield counted(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(i, j))) for c in b.columns], b.schema.names))

    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in rest)
    rows = lists.select(*rest, "words").mapInArrow(run, f"{kinds}, unit int, term string, n long, size int")
    return rows if size else rows.drop("unit")


def per_document(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, n, size): a document's occurrences of each term, and its tokens; from token rows, or from lists, of
    which a document has one."""
    if "words" in tokens.columns:
        return list_counts(tokens)
    return tokens.groupBy("doc_id", F.col("token").alias("term")).agg(F.count("*").alias("n"), F.max("n").alias("size"))


def per_term(tokens: DataFrame) -> DataFrame:
    """(term, n, d, rates): occurrences, documents, and the sum of the documents' shares of the term; from token rows or
    lists, or made already (``tokens.term_counts``)."""
    if "rates" in tokens.columns:
        return tokens
    return per_document(tokens).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.sum(F.col("n") / F.col("size")).alias("rates"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    """(term, tf, df, share): occurrences, documents, and the share of all occurrences."""
    terms = checkpointed(per_term(tokens).select("term", F.col("n").alias("tf"), F.col("d").alias("df")))
    return terms.join(F.broadcast(terms.agg(F.sum("tf").alias("__all"))), F.lit(True)).select("term", "tf", "df", (F.col("tf") / F.col("__all")).alias("share"))  # one row


def normalized_frequency(tokens: DataFrame, documents: int) -> DataFrame:
    """(term, total, df, per_10k, mean_per_10k): the corpus rate, and the mean of the documents' rates, those without
    the term included."""
    rates = checkpointed(per_term(tokens).select("term", F.col("n").alias("total"), F.col("d").alias("df"), "rates"))
    whole = F.broadcast(rates.agg(F.sum("total").alias("__all")))  # one row
    rows = rates.join(whole, F.lit(True))
    return rows.select("term", "total", "df", (F.col("total") * 10000 / F.col("__all")).alias("per_10k"), (F.col("rates") * 10000 / F.lit(documents)).alias("mean_per_10k"))


def vocabulary(tokens: DataFrame, documents: int, min_df: int = 2, max_df: float = 1.0, keep: int = 10_000) -> DataFrame:
    """The terms within the document-frequency limits, the most widespread first, ties by term; term_id from 0."""
    terms = term_frequency(tokens).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    top = terms.orderBy(F.desc("df"), "term").limit(keep)
    return top.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).select("term", "term_id", "tf", "df")


def _lookup(vocab: DataFrame, keep: int = 100_000) -> DataFrame:
    """``vocab`` for a join with tokens: broadcast if it has at most ``keep`` terms."""
    return F.broadcast(vocab) if vocab.limit(keep + 1).count() <= keep else vocab


def coverage(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each document's tokens, those in the vocabulary, and the fraction outside."""
    counts = per_document(tokens)
    known = counts.join(_lookup(vocab.select("term", F.lit(True).alias("known"))), "term", "left")
    n, k = F.sum("n"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return known.groupBy("doc_id").agg(n.alias("tokens"), k.alias("known"), (1 - k / F.greatest(n, F.lit(1))).alias("oov"))


def bag_of_words(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, unit, term_id, n) from unit rows with tokens (doc_id, unit, token), or from their counts (``list_counts``)."""
    counts = units if "term" in units.columns else units.groupBy("doc_id", "unit", F.col("token").alias("term")).agg(F.count("*").alias("n"))
    return counts.join(_lookup(vocab.select("term", "term_id")), "term").select("doc_id", "unit", "term_id", "n")


# --- units --------------------------------------------------------------------------------


def unit_of(pos: Column, n: Column, size: int, min_tail: int) -> Column:
    """The unit, from 0, of a token: fixed size, a short tail joined to the unit before."""
    last = F.floor((n - 1) / size)
    short = (last > 0) & (n - last * size < min_tail)
    return F.least(F.floor(pos / size), last - F.when(short, 1).otherwise(0)).cast("int")


def units(tokens: DataFrame, size: int = 400, min_tail: int = 100) -> DataFrame:
    """Token rows with their unit."""
    return tokens.withColumn("unit", unit_of(F.col("pos"), F.col("n"), size, min_tail))


def unit_manifest(with_units: DataFrame) -> DataFrame:
    return with_units.groupBy("doc_id", "unit").agg(F.min("pos").alias("start_token"), (F.max("pos") + 1).alias("end_token"), F.count("*").alias("tokens"))


def overlapping_units(docs: DataFrame, size: int = 900, overlap: int = 100, least: int = 150) -> DataFrame:
    """(doc_id, unit, tokens): windows that start every size - overlap tokens, those long enough."""
    # no filter on the tokens, which would make them twice: a document without any has no starts
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap)))
    rows = words.select("doc_id", "w", F.posexplode(starts).alias("unit", "start"))
    return rows.select("doc_id", "unit", F.slice("w", F.col("start") + 1, size).alias("tokens")).filter(F.size("tokens") >= least)


def evenly_spaced(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each key, at the places floor(i * (n - 1) / (cap - 1)) of its order."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumns({"__r": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(key))})
    i = F.ceil(F.col("__r") * (cap - 1) / (F.col("__n") - 1))
    chosen = (F.col("__n") <= cap) | (F.floor(i * (F.col("__n") - 1) / (cap - 1)) == F.col("__r"))
    return numbered.filter(chosen).drop("__r", "__n")


def hash_sample(rows: DataFrame, key: str, unit: Sequence[str], cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each key, by a seeded hash of ``unit``."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in unit])), *unit)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


# --- phrases ------------------------------------------------------------------------------


def phrase_scores(tokens: DataFrame, min_count: int = 10, threshold: float = 10.0) -> DataFrame:
    """(a, b, n, score) of neighbouring tokens that form phrases: (n - min_count) * terms / (n_a * n_b)."""
    pairs = tokens.filter("next IS NOT NULL").groupBy(F.col("token").alias("a"), F.col("next").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    terms = checkpointed(tokens.groupBy("token").agg(F.count("*").alias("c")))
    rows = pairs.join(terms.select(F.col("token").alias("a"), F.col("c").alias("n_a")), "a").join(terms.select(F.col("token").alias("b"), F.col("c").alias("n_b")), "b")
    rows = rows.join(F.broadcast(terms.agg(F.count("*").alias("__terms"))), F.lit(True))  # one row
    score = (F.col("n") - min_count) * F.col("__terms") / (F.col("n_a") * F.col("n_b"))
    return rows.select("a", "b", "n", score.alias("score")).filter(F.col("score") > threshold)


def merge_phrases(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Token rows with phrases joined by an underscore, from the left: of a chain of phrase pairs the 1st, 3rd, ... merge.

    In a maximal run of neighbouring phrase pairs the greedy choice is every second one, which a row number finds
    without a fold."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("doc_id", "pos", "token", F.col("next").alias("b"))
    known = phrases.select(F.col("a").alias("token"), "b", F.lit(True).alias("hit"))
    rows = rows.join(known, ["token", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("doc_id", "hit", "run").orderBy("pos")
    rows = rows.withColumn("first", F.col("hit") & (F.row_number().over(within) % 2 == 1))
    rows = rows.withColumn("second", F.coalesce(F.lag("first").over(order), F.lit(False))).filter(~F.col("second"))
    merged = F.when(F.col("first"), F.concat_ws("_", "token", "b")).otherwise(F.col("token"))
    rows = rows.select("doc_id", "pos", merged.alias("token"))
    whole = Window.partitionBy("doc_id")
    return rows.select("doc_id", F.count("*").over(whole).cast("int").alias("n"), (F.row_number().over(order) - 1).alias("pos"), "token", F.lead("token").over(order).alias("next"))


def merge_lists(lists: DataFrame, phrases: DataFrame, most: int = 500_000) -> DataFrame:
    """Token lists (doc_id, words) with phrases (a, b) joined as ``merge_phrases`` does. At most ``most`` phrases go to every
    task, which merges its lists where they stand; more are joined with the token rows. Lists without words are left out."""
    found = checkpointed(phrases.select("a", "b"))
    if found.count() > most:
        rows = merge_phrases(rows_of(lists), found).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))  # a document's tokens
        return rows.select("doc_id", F.transform("x", lambda x: x["token"]).alias("words"))
    sent = lists.sparkSession.sparkContext.broadcast({(r["a"], r["b"]) for r in found.toLocalIterator()})

    def merged(words: list[str]) -> list[str]:
        hits = [*map(sent.value.__contains__, zip(words, words[1:], strict=False)), False]
        out, skip = [], False
        for k, hit in enumerate(hits):
            if skip:
                skip = False
            elif hit:
                out.append(f"{words[k]}_{words[k + 1]}")
                skip = True
            else:
                out.append(words[k])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([merged(w) for w in part.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "words"])

    kind = lists.schema["doc_id"].dataType.simpleString()
    return lists.filter(F.size("words") > 0).select("doc_id", "words").mapInArrow(run, f"doc_id {kind}, words array<string>")


def restopped(tokens: DataFrame, stop: Sequence[str] = (), normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """Token rows made normal once more after a merge: stop words and repeats of the token before go."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("doc_id", "pos", (normal(F.col("token")) if normal is not None else F.col("token")).alias("token"))
    rows = rows.filter(~F.col("token").isin(*stop)) if stop else rows
    rows = rows.withColumn("before", F.lag("token").over(order)).filter("before IS NULL OR before <> token")
    return rows.select("doc_id", F.count("*").over(Window.partitionBy("doc_id")).cast("int").alias("n"), (F.row_number().over(order) - 1).alias("pos"), "token", F.lead("token").over(order).alias("next"))


# --- co-occurrence ------------------------------------------------------------------------


def pair_counts(presence: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(source, target, joint): how many keys hold both terms, source < target. ``terms`` is a short list."""
    rows = presence.join(F.broadcast(terms.select("term")), "term").select(key, "term").distinct()
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("t"))  # no longer than ``terms``
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("joint"))


def keyword_network(tokens: DataFrame, documents: int, terms: int = 40, min_docs: int = 3, max_df: float = 0.9,
                    min_jaccard: float = 0.05, min_npmi: float = 0.05, max_edges: int = 150) -> DataFrame:
    """Edges between the keywords of highest mean rate: (source, target, joint, jaccard, npmi), the strongest first."""
    freq = normalized_frequency(tokens, documents).filter((F.col("df") >= min_docs) & (F.col("df") <= max_df * documents))
    top = freq.orderBy(F.desc(F.round("mean_per_10k", 9)), "term").limit(terms).select("term", "df")
    joint = pair_counts(tokens.select("doc_id", F.col("token").alias("term")), "doc_id", top)
    side = lambda end: F.broadcast(top.select(F.col("term").alias(end), F.col("df").alias(f"df_{end}")))
    rows = joint.join(side("source"), "source").join(side("target"), "target")
    rows = rows.withColumn("jaccard", M.pair_jaccard(F.col("joint"), F.col("df_source"), F.col("df_target")))
    rows = rows.withColumn("npmi", M.pair_npmi(F.col("joint"), F.col("df_source"), F.col("df_target"), F.lit(documents)))
    rows = rows.filter((F.col("joint") >= min_docs) & (F.col("jaccard") >= min_jaccard) & (F.col("npmi") >= min_npmi))
    return rows.select("source", "target", "joint", "jaccard", "npmi").orderBy(F.desc("jaccard"), F.desc("joint"), "source", "target").limit(max_edges)


def greedy_communities(edges: Sequence[tuple[str, str, float]]) -> dict[str, int]:
    """Greedy modularity communities of a small weighted graph, on the driver: the pair of communities whose merge
    raises modularity most is merged, ties by name, until none does. Numbered from 1 by size, then first name."""
    total = sum(w for *_, w in edges)
    group = {n: {n} for a, b, _ in edges for n in (a, b)}
    degree = dict.fromkeys(group, 0.0)
    between: dict[frozenset, float] = {}
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
        between[frozenset((a, b))] = between.get(frozenset((a, b)), 0.0) + w
    while between:
        gain = {k: w / total - degree[min(k)] * degree[max(k)] / (2 * total * total) for k, w in between.items() if len(k) == 2}
        best = max(gain, key=lambda k: (round(gain[k], 12), [-ord(c) for c in min(k)]), default=None)
        if best is None or gain[best] <= 1e-12:
            break
        keep, gone = min(best), max(best)
        group[keep] |= group.pop(gone)
        degree[keep] += degree.pop(gone)
        moved: dict[frozenset, float] = {}
        for k, w in between.items():
            k = frozenset(keep if x == gone else x for x in k)
            if len(k) == 2:
                moved[k] = moved.get(k, 0.0) + w
        between = moved
    ordered = sorted(group.values(), key=lambda g: (-len(g), min(g)))
    return {n: i for i, g in enumerate(ordered, 1) for n in g}
