"""Lemmas of nouns by a dictionary in WordNet's file format.

A folder holds ``index.noun`` - a noun at the start of each line that does not
begin with a blank - and ``noun.exc`` - a form and the nouns it may come from.
A form with exceptions is one of these, or itself. Any other is itself, or what
the rules make of it; if neither is a noun, what they make of that, and so on. Of
the nouns found at the first step that finds any the shortest is the lemma, the
first of equally short ones; a form that leads to none stays as it is.

Each distinct token is looked up once, by joins with the dictionary; only tokens
whose lemma differs from them are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators.vocabulary import restopped
from inkstone.storage import written

#: Endings of nouns and what stands for them (fixed values).
ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def noun_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nouns (form), and exceptions (token, forms) of a folder. A missing file is an error."""
    first = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    nouns = spark.read.text(f"{path}/index.noun").filter(~F.col("value").startswith(" ") & (F.trim("value") != "")).select(first.alias("form")).distinct()
    words = F.split(F.trim("value"), r"\s+")
    exceptions = spark.read.text(f"{path}/noun.exc").filter(F.trim("value") != "").select(first.alias("token"), F.slice(words, 2, F.size(words)).alias("forms")).withColumn("n", F.monotonically_increasing_id())
    # a form that comes twice has the bases of its last line
    exceptions = exceptions.groupBy("token").agg(F.max(F.struct("n", "forms")).alias("x")).select("token", "x.forms")
    return nouns, exceptions


def steps(token: str) -> list[tuple[int, int, str]]:
    """(step, place, form): what a token may come from, step by step, until the rules apply no more."""
    out, forms, step = [(0, 0, token)], [token], 0
    while forms:
        forms = [f[: -len(old)] + new for f in forms for old, new in ENDINGS if f.endswith(old)]
        out += [(step, len(out) + k, f) for k, f in enumerate(forms)]
        step += 1
        if step > len(token):  # "men" comes from "man", which no rule changes; nothing is longer than the token
            break
    return out


def lemmas(tokens: DataFrame, dictionary: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(token, lemma) of the distinct tokens that differ from their lemma. Null and joined tokens are left out."""
    nouns, exceptions = dictionary
    words = tokens.select("token").filter("token IS NOT NULL AND NOT contains(token, '_')").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, *s) for t in b.column(0).to_pylist() for s in steps(t)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["token", "step", "place", "form"])

    ruled = words.join(exceptions, "token", "left_anti").mapInArrow(run, "token string, step int, place int, form string")
    odd = words.join(exceptions, "token").select("token", F.posexplode(F.concat(F.array("token"), "forms")).alias("place", "form")).select("token", F.lit(0).alias("step"), "place", "form")
    found = ruled.unionByName(odd).join(nouns, "form", "left_semi")
    best = found.groupBy("token").agg(F.min(F.struct("step", F.length("form").alias("length"), "place", "form")).alias("x"))
    return best.select("token", F.col("x.form").alias("lemma")).filter("token <> lemma")


def lemmatized(tokens: DataFrame, dictionary: tuple[DataFrame, DataFrame], stop: Sequence[str] = ()) -> DataFrame:
    """Token rows (doc_id, n, pos, token, next) with lemmas for tokens; stop words and repeats that come of it go."""
    changed = written(lemmas(tokens, dictionary), "lemmas")
    rows = tokens.join(changed, "token", "left").select("doc_id", "pos", F.coalesce("lemma", "token").alias("token"))
    return restopped(rows, stop)
