"""Quality rules: compression bands.

A text is kept when it has enough words, does not consist of repeated eight-word
windows, and its zstandard ratios lie inside bands. The ratio (compressed bytes
over bytes, checksum and size fields off) is taken over the whole text and over
fixed chunks; both have limits that depend on the length compressed, as short
inputs compress less. Below the band a text is repetitive, above it
incompressible.

Defined results: a null, empty or blank text has no words, so it fails the base
rule. Ties on a limit are inside the band. Equal rows get equal results. An
empty table gives an empty result. Very long texts are compressed whole. Extra
columns of any name are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_rows, place_of, tune

_SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio by bytes compressed: (least bytes, lower limit, upper limit), by rising bytes.

    Natural-language text of n bytes lies well inside them in any language with
    an alphabet; the lower limits fall and the upper limits tighten as n grows.
    The upper limits stand between the largest ratios of clean text and the
    least of random letters and digits of the same length; every length has
    both limits (below 100 bytes the two kinds of text come close).
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.40, 1.25), (64, 0.40, 1.10), (100, 0.40, 1.02), (128, 0.40, 0.96), (160, 0.40, 0.935), (192, 0.40, 0.905), (224, 0.40, 0.87), (256, 0.40, 0.84), (320, 0.40, 0.82), (384, 0.40, 0.80), (448, 0.40, 0.78),
        (512, 0.36, 0.765), (640, 0.36, 0.75), (768, 0.36, 0.735), (1024, 0.33, 0.71), (1280, 0.33, 0.70), (1536, 0.33, 0.69), (2048, 0.33, 0.67), (4096, 0.28, 0.65), (16384, 0.24, 0.62), (65536, 0.20, 0.60),
    )
    chunk: tuple[tuple[int, float, float], ...] = (
        (0, 0.40, 1.25), (64, 0.40, 1.10), (100, 0.40, 1.02), (128, 0.40, 0.96), (160, 0.40, 0.935), (192, 0.40, 0.905), (224, 0.40, 0.87), (256, 0.38, 0.84), (320, 0.38, 0.82), (384, 0.38, 0.80), (448, 0.36, 0.78),
        (512, 0.34, 0.765), (640, 0.34, 0.75), (768, 0.34, 0.735), (1024, 0.32, 0.70), (1536, 0.32, 0.67), (2048, 0.30, 0.65),
    )
    chunk_bytes: int = 2048
    #: A last chunk of fewer bytes tells nothing by itself: it belongs to the one before.
    least_tail: int = 256
    #: Share of the chunks' bytes that must lie in chunks inside their band.
    chunk_share: float = 0.9
    level: int = 3
    min_words: int = 20
    #: Percent of words that may stand in eight-word windows found twice or more.
    max_repeat: int = 30
    window: int = 8


def limits(table: tuple[tuple[int, float, float], ...], n: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(table) if n >= least)


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words that stand in a window of ``window`` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code = seq[:n].copy()  # a window's number, exact: paired with the next word and renumbered
    for k in range(1, window):
        _, code = np.unique(code * len(ids) + seq[k : k + n], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Judge:
    """Features and verdict of one text."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.pack = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(self.pack(data)) / max(1, len(data))

    def __call__(self, text: str | None) -> tuple[int, int, int, int, int, bool, bool, float, float]:
        text, bands = text or "", self.bands
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # splits at just the bytes \x20 and \x09-\x0D
        seen: set[str] = set()
        n_dup = 0
        if "\n" in text:
            for line in text.split("\n"):
                if line in seen:
                    n_dup += 1
                elif line.strip(" \t\n\r\x0b\x0c"):
                    seen.add(line)
        chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
        n_repeat = repeat_words(words, bands.window)
        failed = len(words) < bands.min_words or 100 * n_repeat > bands.max_repeat * len(words)
        whole = self.ratio(data)
        size = bands.chunk_bytes
        chunks = [data[k : k + size] for k in range(0, len(data), size)]
        if len(chunks) > 1 and len(chunks[-1]) < bands.least_tail:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        inside = sum(len(c) for c in chunks for low, high in [limits(bands.chunk, len(c))] if low <= self.ratio(c) <= high)
        share = inside / len(data) if data else 1.0
        low, high = limits(bands.whole, len(data))
        kept = not failed and low <= whole <= high and share >= bands.chunk_share
        return len(words), chars, len(_SYMBOLS.findall(text)), n_dup, n_repeat, failed, kept, whole, share


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_share double"


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Each row's doc_id with its features, its ratios and the verdict ``kept``."""
    tune(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for b in batches:
            found = list(zip(*[judge(t.as_py()) for t in b.column(1)], strict=True)) or [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(v), k) for v, k in zip(found, kinds, strict=True)]], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")


def filtered(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    tune(docs.sparkSession)
    at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands)
        for b in batches:
            yield b.filter(pa.array([judge(t.as_py())[6] for t in b.column(at)], pa.bool_()))

    return map_rows(docs, run)
