"""Cleaning of paged texts: page ranges, covers, margins, references, gates.

Pages are rows (doc_id, page, text), lines rows (doc_id, page, line_no, line).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T


def as_pages(docs: DataFrame, lines_per_page: int = 8) -> DataFrame:
    """Texts cut into pages of so many lines, numbered from 1."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line"))
    rows = lines.groupBy("doc_id", (F.floor(F.col("k") / lines_per_page) + 1).cast("int").alias("page"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("m"))
    return rows.select("doc_id", "page", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("text"))


def page_range(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with whether a document's rule (doc_id, first_page, last_page; null: open) leaves them in."""
    low, high = F.coalesce("first_page", F.lit(1)), F.coalesce("last_page", F.col("page"))
    return pages.join(rules.select("doc_id", "first_page", "last_page"), "doc_id", "left").select(*pages.columns, F.col("page").between(low, high).alias("inside"))


def delivery_cover(text: Column, markers: Sequence[str], least: int = 2) -> Column:
    """Whether at least ``least`` of the markers occur in the text."""
    low = F.lower(text)
    return sum((F.when(low.contains(m.lower()), 1).otherwise(0) for m in markers), F.lit(0)) >= least


def as_lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", F.trim("line"))


def repeated_margins(pages: DataFrame, edge: int = 2, most: int = 150, least: int = 3, share: float = 0.4) -> DataFrame:
    """(doc_id, line, pages): lines among the first or last ``edge`` ones of enough of a document's pages."""
    rows = as_lines(pages).filter("line <> ''")
    up, down = Window.partitionBy("doc_id", "page").orderBy("line_no"), Window.partitionBy("doc_id", "page").orderBy(F.desc("line_no"))
    rows = rows.withColumns({"u": F.row_number().over(up), "d": F.row_number().over(down)})
    rows = rows.filter(((F.col("u") <= edge) | (F.col("d") <= edge)) & (F.length("line") < most))
    seen = rows.groupBy("doc_id", "line").agg(F.countDistinct("page").alias("pages"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    return seen.join(total, "doc_id").filter(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("n") * share))).select("doc_id", "line", "pages")


def without_margins(pages: DataFrame, **limits) -> DataFrame:
    """Lines without repeated margins and bare page numbers."""
    gone = repeated_margins(pages, **limits).select("doc_id", "line")
    return as_lines(pages).join(gone, ["doc_id", "line"], "left_anti").filter(~F.col("line").rlike(r"^\d{1,5}$")).select("doc_id", "page", "line_no", "line")


# The numbering that may stand before a heading.
_NUMBERING = r"^[\dIVXivx.\s]+"


def heading_key(line: Column) -> Column:
    """A heading without numbering, white space and a colon at its end."""
    bare = F.regexp_replace(F.trim(line), _NUMBERING, "")
    return F.rtrim(F.lower(F.regexp_replace(bare, r"\s+", "")), F.lit(":"))


def reference_cut(lines: DataFrame, headings: Sequence[str], fraction: float = 0.4) -> DataFrame:
    """Lines before the first reference heading that stands after ``fraction`` of a document's characters."""
    order = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)))
    whole = lines.groupBy("doc_id").agg(F.greatest(F.sum("chars") if "chars" in lines.columns else F.sum(F.length("line") + 1), F.lit(1)).alias("total"))
    at = rows.filter(heading_key(F.col("line")).isin(*headings)).join(whole, "doc_id").filter(F.col("before") / F.col("total") >= fraction)
    at = at.groupBy("doc_id").agg(F.min(F.struct("page", "line_no")).alias("cut"))
    keep = F.col("cut").isNull() | (F.struct("page", "line_no") < F.col("cut"))
    return lines.join(at, "doc_id", "left").filter(keep).drop("cut")


def reference_start(text: Column, headings: Sequence[str], fraction: float = 0.45) -> Column:
    """The place, from 0, of the first line that is a reference heading after ``fraction`` of the text; null: none."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("cut"))

    def step(acc: Column, line: Column) -> Column:
        hit = acc["cut"].isNull() & F.lower(F.trim(line)).isin(*headings) & (acc["at"] > F.length(text) * fraction)
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(hit, acc["at"]).otherwise(acc["cut"]).alias("cut"))

    return F.aggregate(lines, start, step, lambda a: a["cut"])


def low_text_flags(docs: DataFrame, words: int = 30, page_chars: int = 100, doc_chars: int = 1000, images: Column | None = None, image_share: float = 0.5) -> DataFrame:
    """Whether a text has few words - with ``images``, the share of its area that is pictures, only where that is
    ``image_share`` or more -, and whether it is a short page or document."""
    n = T.count_words(F.col("text"))
    few = n < words if images is None else (n < words) & (images >= image_share)
    return docs.select("doc_id", few.alias("few_words"), (F.length("text") < page_chars).alias("short_page"), (F.length("text") < doc_chars).alias("short_document"))


def long_documents(pages: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Documents with their pages, and whether those exceed the quantile over all documents (linear interpolation)."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    limit = sizes.agg(F.percentile("pages", F.lit(quantile)).alias("p")).first()
    return sizes.withColumn("is_long", F.col("pages") > F.lit(limit["p"]))


def token_gate(docs: DataFrame, least: int = 100) -> DataFrame:
    """Each document's token count and status: too short is an error, not a silent loss."""
    n = F.size(T.tokens(F.col("text")))
    return docs.select("doc_id", n.alias("n_tokens"), F.when(n < least, "error").otherwise("ok").alias("status"))


def cleaned(pages: DataFrame, headings: Sequence[str], markers: Sequence[str], rules: DataFrame | None = None, **limits) -> DataFrame:
    """Pages through range rules, covers, margins and reference cut: (doc_id, page, line_no, line)."""
    if rules is not None:
        pages = page_range(pages, rules).filter("inside").drop("inside")
    pages = pages.filter(~delivery_cover(F.col("text"), markers))
    return reference_cut(without_margins(pages, **limits), headings)
