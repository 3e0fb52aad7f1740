"""The registry of queries: each has a name, a DataFrame form and, where SQL can express it, SQL.

Fixtures - lexicon, stop words, surrogate topic weights - are derived from the
tables in the same way on both sides. Doubles are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import evidence as E
from inkstone.operators import tokens as K
from inkstone.storage import checkpointed, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# --- fixtures -----------------------------------------------------------------------------

#: Four categories; "and" stands in two, "of the" and "de la" are longer than a word.
LEXICON = {
    "platform": ["the", "of the", "idiot", "and"],
    "currency": ["der", "und", "token", "secret"],
    "offence": ["les", "de la", "que", "license"],
    "response": ["and", "con", "en", "password"],
}
RULES = E.Rules(weights={"offence": 3}, pairs=(("platform", "currency"), ("offence", "response")), primary=("offence", "currency", 15))
GROUPS = {"GA": ["the", "ing"], "GB": ["und", "ein"], "GC": ["que", "aux"], "GD": ["cion", "ado"]}
DIMENSIONS = [("n_platform", "GA"), ("n_currency", "GB"), ("n_offence", "GC"), ("n_response", "GD")]
STOP = ["the", "and", "that"]
TOKENIZER = K.Tokenizer(STOP, lemma=T.singular)
TOPICS = 11


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate weights: a vector is a unit of n tokens, four vectors a document; (doc_id, unit, n, label, topic, w)."""
    e = table(spark, sf_dir, "embeddings")
    raw = F.transform(F.slice("embedding", 1, TOPICS), lambda x: F.abs(x.cast("double")))
    rows = e.select(F.floor(F.col("vec_id") / 4).alias("doc_id"), (F.col("vec_id") % 4).cast("int").alias("unit"), (F.col("vec_id") % 7 + 1).alias("n"), "label", raw.alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rows.select("doc_id", "unit", "n", "label", F.posexplode(F.transform("x", lambda v: v / total)).alias("topic", "w"))


def document_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a document for each vector: (doc_id, label, topic, w)."""
    e = table(spark, sf_dir, "embeddings")
    raw = F.transform(F.slice("embedding", 1, TOPICS), lambda x: F.abs(x.cast("double")))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return e.select(F.col("vec_id").alias("doc_id"), "label", raw.alias("x")).select("doc_id", "label", F.posexplode(F.transform("x", lambda v: v / total)).alias("topic", "w"))


THETA = f"""
theta AS (
  SELECT vec_id // 4 AS doc_id, CAST(vec_id % 4 AS INT) AS unit, vec_id % 7 + 1 AS n, label, t.topic,
         abs(CAST(embedding[t.topic + 1] AS DOUBLE)) / list_sum(list_transform(embedding[1:{TOPICS}], lambda x: abs(CAST(x AS DOUBLE)))) AS w
  FROM embeddings, (SELECT unnest(range({TOPICS})) AS topic) t)"""
DOC_THETA = f"""
theta AS (
  SELECT vec_id AS doc_id, label, t.topic,
         abs(CAST(embedding[t.topic + 1] AS DOUBLE)) / list_sum(list_transform(embedding[1:{TOPICS}], lambda x: abs(CAST(x AS DOUBLE)))) AS w
  FROM embeddings, (SELECT unnest(range({TOPICS})) AS topic) t)"""

_LEMMA = """CASE WHEN contains(w, '_') OR length(w) <= 3 OR ends_with(w, 'ss') OR ends_with(w, 'us') OR ends_with(w, 'is') THEN w
    WHEN ends_with(w, 'ies') AND substr(w, length(w) - 3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN substr(w, 1, length(w) - 3) || 'y'
    WHEN ends_with(w, 'ches') OR ends_with(w, 'shes') OR ends_with(w, 'xes') OR ends_with(w, 'zes') OR ends_with(w, 'sses') THEN substr(w, 1, length(w) - 2)
    WHEN ends_with(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END"""


def raw_tokens(stop: bool = True, lemma: bool = True) -> str:
    """Tokens as the tokenizer makes them, before equal neighbours are collapsed."""
    in_stop = "w NOT IN ('the', 'and', 'that')"
    found = f"list_filter(regexp_extract_all(t, '[a-z][a-z0-9_]*'), lambda w: length(w) BETWEEN 3 AND 35{f' AND {in_stop}' if stop else ''})"
    if lemma:
        found = f"list_transform({found}, lambda w: {_LEMMA})"
        found = f"list_filter({found}, lambda w: {in_stop})" if stop else found
    return rf"""
cleaned AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
    'https?://\S+|www\.\S+|\b\S+@\S+\b', ' ', 'g'), '10\.\d{{4,9}}/\S+', ' ', 'g'), '[‐-―-]', ' ', 'g'), '[^a-z0-9_\s.]', ' ', 'g') AS t
  FROM documents),
found AS (SELECT doc_id, {found} AS w FROM cleaned),
raw_token AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM found)"""


RAW_TOKENS = raw_tokens()
#: The tokens with equal neighbours collapsed; pos counts from 0.
TOKENS = (
    RAW_TOKENS
    + """,
token AS (
  SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM (
    SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM raw_token)
  WHERE before IS NULL OR before <> token)"""
)


def texts(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(doc_id, ..., text), for the counts of ``operators.tokens``; a plan that needs several reads the texts for each, which
    costs less than to write tokens down."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.term_counts(texts(spark, sf_dir), TOKENIZER)


def token_lists(spark: SparkSession, sf_dir: str, reused: bool = True, *more: Column) -> DataFrame:
    """The documents' tokens, a list for each, with ``more`` columns; ``reused``: written once, for plans that read them
    several times."""
    lists = K.lists(texts(spark, sf_dir, *more), TOKENIZER)
    return written(lists, "tokens") if reused else lists


def token_rows(spark: SparkSession, sf_dir: str, reused: bool = True) -> DataFrame:
    """The same as rows; what is written are the lists."""
    from inkstone.operators import vocabulary as V

    return V.rows_of(token_lists(spark, sf_dir, reused))


def sql_count(term: str, low: str = "low") -> str:
    """Whole-word occurrences of a term in a text whose separators are doubled."""
    words = "[ ]{2}".join(term.split(" "))
    return rf"len(regexp_extract_all({low}, '[^\p{{L}}\p{{N}}_]{words}[^\p{{L}}\p{{N}}_]'))"


def doubled(text: str) -> str:
    return rf"' ' || regexp_replace(lower({text}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' '"


def sql_category(c: str, low: str = "low") -> str:
    return "(" + " + ".join(sql_count(t, low) for t in LEXICON[c]) + ")"


def source_topic() -> Column:
    return F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("topic")


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, term, n, tf, df): occurrences of each term in each source, as the number in its name, and in all; the term's
    documents. A document has one source, so they are the sum over sources."""
    counts = K.term_counts(texts(spark, sf_dir, source_topic()), TOKENIZER, "topic")
    whole = Window.partitionBy("term")  # as the counts are dealt, and no more rows than topics for each chunk
    return counts.select("topic", "term", "n", F.sum("n").over(whole).alias("tf"), F.sum("d").over(whole).alias("df"))


def phi(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """Surrogate topics: sources, with the words found in two documents or more; from ``topic_counts``, made unless given."""
    from inkstone.operators import topics as P

    kept = (topic_counts(spark, sf_dir) if counts is None else counts).filter("df >= 2").select("topic", "term", "n")
    return P.normalized_phi(checkpointed(kept) if counts is None else kept)


PHI = (
    TOKENS
    + r""",
kept AS (SELECT token FROM token GROUP BY token HAVING count(DISTINCT doc_id) >= 2),
phi_count AS (
  SELECT CAST(regexp_extract(d.source, '(\d+)', 1) AS INT) AS topic, t.token AS term, count(*) AS n
  FROM token t JOIN kept k ON k.token = t.token JOIN documents d ON d.doc_id = t.doc_id GROUP BY ALL),
phi AS (SELECT topic, term, n / sum(n) OVER (PARTITION BY topic) AS p FROM phi_count)"""
)


def load() -> None:
    """Imports the modules that register the queries."""
    from inkstone.plans import queries_corpus, queries_graph, queries_topics  # noqa: F401
