"""Fill-in-middle transformation by a two-pass streaming matcher.

A text is a sequence of units, the matches of a pattern from left to right (code
points, unless another pattern is given). Two ranks among the units cut it: the
prefix ends where the unit of the lower rank ends, the middle where that of the
higher one does, and the suffix is the rest; what stands between units belongs
to the part that follows it. The first pass counts the units. The second is a
lazy match iterator, advanced to the lower rank and on to the higher one. No
list of units is ever made: beside the text and its result a document takes
constant memory, however long it is.

The ranks are drawn from a hash of the document's id and a seed, so a document is
cut alike in every run and on every cluster. Parts are written with sentinels
before each, in the order prefix, suffix, middle (``psm``) or suffix, prefix,
middle (``spm``); a text that is empty, holds a sentinel, or is drawn to stay, is
left as it is (``plain``). ``restored`` puts the text together again.

Defined results: a null text counts as empty and gives an empty plain output. A
null doc_id hashes as an empty id. Equal rows get equal results. An empty table
gives an empty result. Very long texts are handled whole. Extra columns are not
read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import tune

SEED = "1"
#: Out of a hundred documents, those that are transformed, and of these the ones written suffix first.
RATE = 90
SPM_RATE = 20
UNIT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def units(unit: re.Pattern, text: str) -> int:
    """The first pass: how many units there are."""
    number = count()
    deque(zip(unit.finditer(text), number, strict=False), maxlen=0)  # keeps nothing
    return next(number)


def cuts(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: where the units of two ranks end, low <= high; rank 0 is the text's beginning."""
    matches = unit.finditer(text)
    at = [0, 0]
    for k, ahead in enumerate((low, high - low)):
        last = next(islice(matches, ahead - 1, None), None) if ahead else None
        at[k] = last.end() if last else at[0]
    return at[0], at[1]


def _drawn(seed: str) -> list[Column]:
    """Four numbers under 2 ** 32 from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, unit: str = UNIT, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text): its units, its form,
    the code points of its first two parts (null if plain), and the text as it is written."""
    tune(docs.sparkSession)
    h1, h2, h3, h4 = _drawn(seed)
    text = F.coalesce("text", F.lit(""))
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((F.length(text) == 0) | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = re.compile(unit)
        for b in batches:
            sizes, prefixes, middles, outputs = [], [], [], []
            for text, form, *h in zip(*b.columns[1:], strict=True):
                text, form = text.as_py(), form.as_py()
                n = units(matcher, text)
                sizes.append(n)
                if form == "plain":
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                x, y = cuts(matcher, text, *sorted(v.as_py() % (n + 1) for v in h))
                prefixes.append(x)
                middles.append(y - x)
                parts = {PREFIX: text[:x], SUFFIX: text[y:], MIDDLE: text[x:y]}
                order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
                outputs.append("".join(s + parts[s] for s in order))
            longs = [pa.array(v, pa.int64()) for v in (sizes, prefixes, middles)]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([b.column(0), longs[0], b.column(2), *longs[1:], pa.array(outputs, pa.string())], names)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from what was written, whose parts hold no sentinel."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.element_at(parts, k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def digest_columns(out: DataFrame) -> DataFrame:
    """The result's columns from ``transformed``'s."""
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
