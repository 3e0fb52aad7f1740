"""Line dedup by winnowing over line hashes.

A text is its lines; blank ones take no part. Every ``window`` consecutive lines
select the smallest of their line hashes (the last of equal ones) as a
fingerprint, so two texts that share a run of at least ``window`` lines select
the same line of it; only these minima are written down. Positions of equal
fingerprints are joined, and a match is extended to both sides of the
fingerprint, over the windows that selected it, by comparing 128-bit digests of
the lines there: equal hashes of unlike lines match nothing. A longer run holds
further fingerprints, none more than ``window`` lines from the next, so the
extensions of all of them cover it whole and are united. Not every pair of
positions is formed: each is matched with the earliest one - by doc_id, then
text hash, then line - that agrees over the same lines, so it does not matter
which places a frequent line has in common with which others. A run found at an
earlier place is a repeat and goes; its first occurrence stays. A single line of
``long_words`` words or more is a run by itself.

Defined results: a null text stays null, with no lines; an empty text stays
empty. Rows equal in doc_id and text count as one place, so they get equal
results. A null doc_id comes before all others. Lines compare without blanks at
their ends. An empty table gives an empty result. Very long texts are handled
whole. Extra columns of any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import fresh, quoted, salted_join, written

WINDOW = 2
LONG_WORDS = 50
_BLANKS = " \t\r\x0b\x0c"
_PLACE = ("named", "did", "th")


def _key() -> dict[str, Column]:
    """A row's place in the order of texts: null ids first, then by id and by text hash."""
    return {"named": F.col("doc_id").isNotNull(), "did": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "th": F.xxhash64("text")}


def _lines() -> Column:
    """(at, line without outer blanks) for each line that isn't blank."""
    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_BLANKS)).alias("line")))
    return F.filter(each, lambda x: F.length(x["line"]) > 0)


def fingerprints(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(named, did, th, place, h, spans): the lines that windows select, with their hash and the windows around them.
    ``spans`` holds for each such window its first line ``at``, its lines ``n``, and a digest ``wh`` of all of them."""
    rows = docs.select(*[c.alias(k) for k, c in _key().items()], _lines().alias("lines")).filter(F.size("lines") > 0)
    rows = rows.withColumns({"h": F.transform("lines", lambda x: hashed(x["line"])), "d": F.transform("lines", lambda x: F.md5(x["line"]))})
    last = F.size("lines") - window
    hashes = lambda i: F.slice("h", i + 1, window)
    place = lambda i: i + window - F.array_position(F.reverse(hashes(i)), F.array_min(hashes(i))).cast("int")
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("runs", F.transform(starts, lambda i: F.struct(
        place(i).alias("place"), i.alias("at"), F.lit(window).alias("n"), F.unhex(F.md5(F.array_join(F.slice("d", i + 1, window), ""))).alias("wh"),
    )))
    around = lambda p: F.filter(F.slice("runs", F.greatest(p - window + 1, F.lit(0)) + 1, window), lambda r: r["place"] == p)
    span = lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), r["wh"].alias("wh"))
    found = F.transform(F.array_distinct(F.transform("runs", lambda r: r["place"])), lambda p: F.struct(
        p.alias("place"), F.element_at("h", p + 1).alias("h"), F.transform(around(p), span).alias("spans"),
    ))
    if window > 1:
        words = lambda x: F.when(F.length(x) >= 2 * long_words - 1, F.size(F.split(x, r"[ \t\r\x0b\x0c]+"))).otherwise(0)
        long = F.filter(F.transform("lines", lambda x, i: F.when(words(x["line"]) >= long_words, F.struct(
            i.alias("place"), hashed(x["line"]).alias("h"),
            F.array(F.struct(i.alias("at"), F.lit(1).alias("n"), F.unhex(F.md5(F.concat(F.lit("1"), x["line"]))).alias("wh"))).alias("spans"),
        ))), lambda x: x.isNotNull())
        found = F.concat(found, long)
    return rows.select(*_PLACE, F.explode(found).alias("f")).select(*_PLACE, "f.place", "f.h", "f.spans")


def repeats(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(named, did, th, gone): the numbers, among lines that aren't blank, of each text's lines in repeated runs."""
    marks = written(fingerprints(docs, window, long_words, hashed), "line-marks")
    spread = F.xxhash64("did", "th")
    shared = marks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")  # counts are combined before the shuffle
    met = salted_join(marks, shared, ["h"], "left_semi", spread=spread)
    near = written(met.select(*_PLACE, F.explode("spans").alias("s")).select(*_PLACE, "s.*"), "line-runs")
    here = F.struct(*_PLACE, "at")
    first = near.groupBy("wh").agg(F.min(here).alias("first"), F.count("*").alias("places")).filter("places > 1").select("wh", "first")
    later = salted_join(near, first, ["wh"], "inner", spread=spread).filter(here > F.col("first"))
    lines = later.select(*_PLACE, F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("line"))
    return lines.groupBy(*_PLACE).agg(F.sort_array(F.collect_set("line")).alias("gone"))  # at most a text's own lines


def _applied(docs: DataFrame, window: int, long_words: int, hashed: Callable[[Column], Column]) -> tuple[DataFrame, str, str]:
    """``docs`` with repeated runs taken out of ``text``, and the names of two more columns: lines, and those gone."""
    *key, gone, every, parts, keep = fresh(docs, *_PLACE, "gone", "every", "parts", "keep")
    keyed = docs.withColumns(dict(zip(key, _key().values(), strict=True)))
    found = repeats(docs, window, long_words, hashed).toDF(*key, gone)
    out = keyed.join(found, key, "left").withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    # lines and parts as columns of their own, as the functions below refer to them for each element
    out = out.withColumns({every: _lines(), parts: F.split("text", "\n", -1)})
    dropped = F.transform(gone, lambda i: F.element_at(every, i + 1)["at"])
    out = out.withColumn(keep, F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped))
    kept = F.transform(keep, lambda i: F.element_at(parts, i + 1))
    text = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.withColumn("text", text), every, gone


def deduplicated(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text, n_lines, gone) for each row of ``docs``: the text without repeated runs, its lines that weren't
    blank, and the numbers among them of those taken out, rising."""
    out, every, gone = _applied(docs, window, long_words, hashed)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.size(every).cast("long").alias("n_lines"), F.col(gone).alias("gone"))


def cleaned(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs``, all rows and columns, with repeated runs taken out of ``text``."""
    return _applied(docs, window, long_words, hashed)[0].select(*map(quoted, docs.columns))


def digest_columns(out: DataFrame) -> DataFrame:
    """A summary of ``deduplicated``: lines, lines taken out, and a digest of the text left (null: empty)."""
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
