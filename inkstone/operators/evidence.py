"""Rule-based evidence scoring: lexicon counts, tiers, ranked excerpts, digests.

The lexicon is a parameter: an ordered mapping of category to ordered terms. It
is unrolled into count expressions, so documents never meet the lexicon in a
join and every count stays in one pass over the text. A term may stand in
several categories and inside another term; it counts in each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.relational import IntegrityError, least_of, numbered
from inkstone.storage import spread

Lexicon = Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class Rules:
    """How counts become scores and tiers. ``weights``: of a category's hits in a sentence, 2 if not named;
    ``pairs``: categories that earn a bonus when both hit; ``primary``: two categories and their least totals."""

    # The weights, thresholds and lengths of the rules.
    weights: Mapping[str, int] = field(default_factory=dict)
    pairs: Sequence[tuple[str, str]] = ()
    bonus: int = 3
    per_category: int = 2
    primary: tuple[str, str, int] | None = None
    high: int = 80
    context: int = 25
    excerpts: int = 7
    excerpt_length: int = 700
    key_length: int = 120


def category_total(lower: Column, terms: Sequence[str]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + T.term_count(lower, term)
    return total


def _lowered(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the lower-cased text as a column of its own, to which every count refers."""
    return spread(docs).withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit(""))))


def category_totals(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with a column n_CATEGORY for each category."""
    return _lowered(docs, text).withColumns({f"n_{c}": category_total(F.col("__low"), terms) for c, terms in lexicon.items()}).drop("__low")


def tier(lexicon: Lexicon, rules: Rules) -> Column:
    """The relevance tier from the n_CATEGORY columns, the first that fits."""
    total = sum((F.col(f"n_{c}") for c in lexicon), F.lit(0))
    out = F.when(total >= rules.high, "high").when(total >= rules.context, "context").otherwise("peripheral")
    if rules.primary:
        a, b, least = rules.primary
        out = F.when((F.col(f"n_{a}") >= least) & (F.col(f"n_{b}") >= least), "primary").otherwise(out)
    return out


def scores(docs: DataFrame, lexicon: Lexicon, rules: Rules) -> DataFrame:
    """doc_id, the category totals, their sum and the tier."""
    names = [f"n_{c}" for c in lexicon]
    counted = category_totals(docs, lexicon).select("doc_id", *names)
    return counted.withColumns({"total": sum((F.col(n) for n in names), F.lit(0)), "relevance": tier(lexicon, rules)})


def term_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, category, ord, term, n) for each term that occurs in a document."""
    each = [
        F.struct(F.lit(c).alias("category"), F.lit(i).alias("ord"), F.lit(t).alias("term"), T.term_count(F.col("__low"), t).alias("n"))
        for c, terms in lexicon.items() for i, t in enumerate(terms)
    ]
    return _lowered(docs.select("doc_id", "text")).select("doc_id", F.explode(F.filter(F.array(*each), lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.*")


def top_terms(docs: DataFrame, lexicon: Lexicon, limit: int = 8) -> DataFrame:
    """The most frequent terms of each category in each document, ties in the lexicon's order."""
    w = Window.partitionBy("doc_id", "category").orderBy(F.desc("n"), "ord")
    return term_hits(docs, lexicon).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("ord")


def sentence_score(lower: Column, lexicon: Lexicon, rules: Rules) -> Column:
    """A sentence's score. Each distinct term is counted once, into a struct to which the sums refer."""
    terms = list(dict.fromkeys(t for ts in lexicon.values() for t in ts))
    counts = F.struct(*[T.term_count(lower, t).alias(f"t{i}") for i, t in enumerate(terms)])
    place = {t: f"t{i}" for i, t in enumerate(terms)}

    def score(x: Column) -> Column:
        out = F.lit(0)
        for c, n in totals.items():
            out = out + x[n] * rules.weights.get(c, 2) + F.when(x[n] > 0, rules.per_category).otherwise(0)
        for a, b in rules.pairs:
            out = out + F.when((x[totals[a]] > 0) & (x[totals[b]] > 0), rules.bonus).otherwise(0)
        return out

    totals = {c: f"c{i}" for i, c in enumerate(lexicon)}
    summed = lambda x: F.struct(*[sum((x[place[t]] for t in ts), F.lit(0)).alias(totals[c]) for c, ts in lexicon.items()])
    return F.element_at(F.transform(F.transform(F.array(counts), summed), score), 1)


def scored_sentences(docs: DataFrame, lexicon: Lexicon, rules: Rules, least: int | None = None) -> DataFrame:
    """(doc_id, pos, sentence, score) for the sentences of 70 characters or more; pos counts them from 0. ``least``: only
    those of that score, the score being computed once for both."""
    rows = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(T.long_sentences(F.col("text"))).alias("pos", "sentence"))
    score = F.array(sentence_score(F.lower("sentence"), lexicon, rules))
    if least is not None:
        score = F.filter(score, lambda x: x >= least)
    return rows.select("doc_id", "pos", "sentence", F.explode(score).alias("score"))


def excerpts(docs: DataFrame, lexicon: Lexicon, rules: Rules) -> DataFrame:
    """Each document's best sentences: by score, then place; of sentences that start alike the best only."""
    rows = scored_sentences(docs, lexicon, rules, 1)
    rows = rows.select("doc_id", "pos", "score", F.substring("sentence", 1, rules.excerpt_length).alias("excerpt"))
    rows = rows.withColumn("key", F.lower(F.substring("excerpt", 1, rules.key_length)))
    best = Window.partitionBy("doc_id", "key").orderBy(F.desc("score"), "pos")
    rank = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    rows = rows.withColumn("k", F.row_number().over(best)).filter("k = 1")
    return rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= rules.excerpts).select("doc_id", "rank", "score", "excerpt")


def top_documents(scored: DataFrame, limit: int = 20) -> DataFrame:
    """The documents of largest total, ties by doc_id."""
    return scored.orderBy(F.desc("total"), "doc_id").limit(limit)


def corpus_statistics(scored: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row: documents, category totals, and documents of each tier."""
    tiers = ("primary", "high", "context", "peripheral")
    return scored.agg(
        F.count("*").alias("documents"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in lexicon],
        *[F.count_if(F.col("relevance") == t).alias(f"tier_{t}") for t in tiers],
    )


def pattern_frequency(docs: DataFrame, patterns: Mapping[str, str], examples: int = 3) -> DataFrame:
    """For each labelled pattern, without regard to case: documents, occurrences, and the first documents' ids. The
    first ids are kept while counting, so no task sees all hits of a label."""
    each = [F.struct(F.lit(k).alias("label"), F.regexp_count(F.col("text"), F.lit(f"(?i){p}")).alias("n")) for k, p in patterns.items()]
    rows = docs.select("doc_id", F.explode(F.filter(F.array(*each), lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.*")
    counts = rows.groupBy("label").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))
    ids = least_of(rows, ["label"], "doc_id", examples, "ids")
    return counts.join(ids, "label").select("label", "documents", "occurrences", F.array_join(F.col("ids").cast("array<string>"), "; ").alias("examples"))


# --- prompts for a text generator, and its batches ------------------------------------------


def digests(scored: DataFrame, tops: DataFrame, shown: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, digest): a document's totals, most frequent terms and best excerpts as text."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(lexicon) for x in (c, i)])
    words = tops.filter("rank <= 5").groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("=", "term", "n").alias("s")))).alias("t"))
    words = words.select("doc_id", order[F.col("category")].alias("o"), F.concat(F.col("category"), F.lit(": "), F.array_join(F.transform("t", lambda x: x["s"]), ", ")).alias("s"))
    words = words.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), "; ").alias("terms"))
    best = shown.filter("rank <= 5").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))).alias("e"))
    best = best.select("doc_id", F.array_join(F.transform("e", lambda x: F.concat(F.lit("- "), x["rank"].cast("string"), F.lit(". "), x["excerpt"])), "\n").alias("lines"))
    totals = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.col(f"n_{c}").cast("string")) for c in lexicon])
    rows = scored.join(words, "doc_id", "left").join(best, "doc_id", "left")
    head = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("relevance"), F.lit(")"))
    return rows.select("doc_id", F.concat_ws("\n", head, totals, F.coalesce("terms", F.lit("")), F.coalesce("lines", F.lit(""))).alias("digest"))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with the number, from 0, of the batch of ``size`` rows that each falls into by order of ``key``."""
    return numbered(rows, [key], "__place", 0).withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def prompts(batched: DataFrame, text: str, instruction: str) -> DataFrame:
    """(batch, members, prompt, request_sha256): a batch's texts below an instruction."""
    rows = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col(text).alias("t")))).alias("m"))
    prompt = F.concat(F.lit(instruction + "\n\n"), F.array_join(F.transform("m", lambda x: x["t"]), "\n\n"))
    return rows.select("batch", F.transform("m", lambda x: x["doc_id"]).alias("members"), prompt.alias("prompt")).withColumn("request_sha256", F.sha2("prompt", 256))


def synthesis(responses: DataFrame, statistics: DataFrame, instruction: str, most: int = 1000) -> DataFrame:
    """(prompt, request_sha256): one prompt from the batches' responses (batch, response) in order, below an instruction and
    the corpus' statistics (one row). More than ``most`` batches are an error: they would be one text."""
    if responses.limit(most + 1).count() > most:
        raise IntegrityError(f"more than {most} batches for one prompt")
    numbers = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in statistics.columns])
    part = F.concat(F.lit("Batch "), F.col("batch").cast("string"), F.lit("\n"), F.col("response"))
    parts = responses.agg(F.array_sort(F.collect_list(F.struct("batch", part.alias("p")))).alias("m"))  # at most ``most``
    text = F.concat_ws("\n\n", F.lit(instruction), F.col("numbers"), F.array_join(F.transform("m", lambda x: x["p"]), "\n\n"))
    rows = parts.join(F.broadcast(statistics.select(numbers.alias("numbers"))), F.lit(True))  # one row each
    return rows.select(text.alias("prompt")).withColumn("request_sha256", F.sha2("prompt", 256))
