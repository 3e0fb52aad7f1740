"""Packing by cutting-stock column generation.

A document's tokens and an end token are cut into full sequences and one
remainder. Remainders are counted by length class (classes of ``GRAIN`` tokens:
a histogram of fixed size, whatever the corpus). A linear program over that
histogram picks patterns - which classes share a sequence, and how often; a
knapsack dynamic program prices new patterns until none improves it. Pattern
counts are rounded down; remainders are ranked in their class and dealt to the
patterns' copies by rank. What rounding leaves over, and patterns that fill too
little of a sequence, go to a stream instead: remainders laid end to end and cut
every ``size`` tokens, the tail into powers of two, without padding.

Defined results: a null or empty text is its end token alone. Equal rows are
packed separately. An empty table gives an empty result. Very long texts give
many full sequences.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.common import n_tasks, ranked, running_offsets, tune, written

SIZE = 2048
END = 1
#: Tokens in a length class.
GRAIN = 16
#: Least share of a sequence that a pattern must fill.
MIN_FILL = 0.98
KEPT_WORDS = 400_000
#: Bytes of text that are encoded together; a longer text by itself.
TOGETHER = 8 << 20
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters whose lower case, normal form and class are the same to all libraries, and stay single.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-įĲ-ňŊ-ž]+")


# --- tokens -------------------------------------------------------------------------------


class Kept(dict):
    """Words and their ids, made when first asked for; long words are made each time."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= 256:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a word-level BPE tokenizer (lower case, word ends, white space dropped). No token spans white
    space, so texts are cut at blanks and line ends, and the ids of words are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.tokenize = self.library.model.tokenize
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        self.letters = {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
        self.pieces_of = regex.compile(_PIECE).findall
        self.words, self.pieces = Kept(self.word), Kept(self.piece)

    def piece(self, s: str) -> bytes:
        mapped = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
        ids = [t.id for t in self.tokenize(mapped)]
        return pack(f"<{len(ids)}I", *ids)

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return self.pieces[w.lower()]  # one piece
        if not w:
            return b""
        if w[-1] in ".,;:!?" and w.isascii() and w[:-1].isalpha():
            return self.pieces[w[:-1].lower()] + self.pieces[w[-1]]
        if not _PLAIN.fullmatch(w) or "<|" in w and any(s in w for s in self.special):
            return np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.pieces_of(w.lower())))

    def __call__(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        for kept in (self.words, self.pieces):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


    def encode_batch(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids laid end to end, each text's followed by ``end``, and where each text begins (and the last one
        ends). Each distinct word of the batch is looked up once, and its ids are copied to its places."""
        for kept in (self.words, self.pieces):
            if len(kept) > KEPT_WORDS:
                kept.clear()
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        known = list(map(self.words.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        data, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        place = coded.indices.to_numpy()
        own = size[place]
        after = np.cumsum(own)
        ids = data[np.repeat(first[place] - (after - own), own) + np.arange(int(after[-1]) if len(after) else 0)]
        ends = np.concatenate(([0], after))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return np.insert(ids, ends[1:], end), ends + np.arange(len(ends))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(uid, doc_id, n, ids): each row's ids with the end token, and a number of its own for each row. The numbers
    hold for one run; callers write the table before they use them."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = encoder(path or vocabulary()).encode_batch, TaskContext.get().partitionId() << 40
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            bounds = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(bounds)) + 1).tolist(), b.num_rows]
            for k, m in zip(cuts, cuts[1:], strict=False):
                if m == k:
                    continue
                ids, at = encode(texts.slice(k, m - k), END)
                packed = pa.Array.from_buffers(pa.large_binary(), m - k, [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + m - k)), b.column(0).slice(k, m - k), pa.array(np.diff(at)), packed], ["uid", "doc_id", "n", "ids"])
                uid += m - k

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, n long, ids binary")


# --- the linear program -------------------------------------------------------------------


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack: how often to take each length within ``capacity`` for the largest sum of values."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, side="right"))  # lengths rise
        best[room] = best[room - 1]
        if n:
            got = best[room - lengths[:n]] + values[:n]
            k = int(got.argmax())
            if got[k] > best[room] + 1e-12:
                best[room], choice[room] = got[k], k
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if (k := choice[room]) < 0:
            room -= 1
        else:
            counts[k] += 1
            room -= int(lengths[k])
    return float(best[capacity]), counts


def patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and their whole counts, which need no more of any length than there is: the linear program's
    optimum to within ``gap``, rounded down. Starts from one length a pattern; each round prices a pattern against
    the dual prices and pivots it into the basis."""
    m = len(lengths)
    if not m:
        return []
    own = capacity // lengths
    columns = [np.where(np.arange(m) == k, own, 0) for k in range(m)]
    inverse = np.diag(1.0 / own)
    amount = demand / own
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, lengths, capacity)
        # prices over value are feasible duals, so their worth bounds the optimum from below
        if value <= 1 + 1e-9 or amount.sum() <= (1 + gap) * float(prices @ demand) / value:
            break
        step = inverse @ pattern
        ratio = np.full(m, np.inf)
        up = step > 1e-9
        ratio[up] = amount[up] / step[up]
        out = int(ratio.argmin())
        move = ratio[out]
        amount = np.maximum(amount - move * step, 0)
        amount[out] = move
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[out] = pattern
    counts = np.floor(amount + 1e-9).astype(np.int64)
    left = demand.copy()
    done = []
    for c, n in zip(columns, counts.tolist(), strict=True):
        n = min([n, *(left[c > 0] // c[c > 0]).tolist()])
        if n > 0:
            left = left - n * c
            done.append((c, int(n)))
    return done


# --- the assignment -----------------------------------------------------------------------


def assigned(lengths: DataFrame, size: int = SIZE, grain: int = GRAIN, min_fill: float = MIN_FILL) -> DataFrame:
    """(uid, full_base, parts) from (uid, n): the first sequence of a document's full pieces, and its remainder's
    parts, array<struct<start, length, sequence_id, offset>>, start counting from the remainder's."""
    spark = lengths.sparkSession
    tasks = n_tasks(spark)
    items = lengths.withColumns({"full": F.floor(F.col("n") / size), "rest": (F.col("n") % size).cast("int")}).withColumn("class", F.ceil(F.col("rest") / grain).cast("int"))
    histogram = dict(items.filter("rest > 0").groupBy("class").count().collect())  # at most size / grain rows
    classes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in classes.tolist()], np.int64)
    chosen = [(c, n) for c, n in patterns(classes, demand, size // grain) if int(c @ classes) * grain >= min_fill * size]
    # the ranks of a class that each pattern takes, the first of its sequences, and a place in the pattern
    taken = dict.fromkeys(range(len(classes)), 0)
    ranges, base = [], 0
    for c, n in chosen:
        for k in np.flatnonzero(c).tolist():
            each = int(c[k])
            ranges.append((int(classes[k]), taken[k], taken[k] + each * n, each, base))
            taken[k] += each * n
        base += n
    table = spark.createDataFrame(ranges, "class int, low long, high long, each int, base long")  # at most (size / grain) ** 2 rows
    limits = spark.createDataFrame([(int(classes[k]), v) for k, v in taken.items()], "class int, taken long")
    spread = F.xxhash64("uid")
    remainders = items.filter("rest > 0").select("uid", "class", "rest")
    by_rank = ranked(remainders, ["class"], ["uid"], "rank", tasks, spread).join(F.broadcast(limits), "class")
    placed = by_rank.filter("rank < taken").join(F.broadcast(table), "class").filter("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1)  # at most ``size`` rows
    part = lambda start, length, sequence, offset: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    placed = placed.withColumn("offset", F.coalesce(F.sum("rest").over(before), F.lit(0)))
    placed = placed.select("uid", F.array(part(F.lit(0), F.col("rest"), F.col("sequence_id"), F.col("offset"))).alias("parts"))

    stream = by_rank.filter("rank >= taken").select("uid", "rest").withColumn("b", F.pmod(spread, F.lit(tasks)).cast("int")).withColumn("g", F.lit(0))
    total = stream.agg(F.sum("rest")).first()[0] or 0
    within = Window.partitionBy("b").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    stream = stream.join(F.broadcast(running_offsets(stream, ["g"], "b", F.col("rest"), "ahead").select("b", "ahead")), "b")  # a row for each bucket
    stream = stream.withColumn("at", F.col("ahead") + F.coalesce(F.sum("rest").over(within), F.lit(0)))
    stream = stream.select("uid", _cut(F.col("at"), F.col("rest"), total, size, base, part).alias("parts"))
    tail = total % size
    base += total // size + bin(tail).count("1")

    parts = placed.unionByName(stream)
    full = items.withColumn("b", F.pmod(spread, F.lit(tasks)).cast("int")).withColumn("g", F.lit(0))
    full = full.join(F.broadcast(running_offsets(full, ["g"], "b", F.col("full"), "ahead").select("b", "ahead")), "b")
    full = full.withColumn("full_base", F.col("ahead") + base + F.coalesce(F.sum("full").over(within), F.lit(0)))
    return full.select("uid", "full_base").join(parts, "uid", "left")


def _cut(at: Column, length: Column, total: int, size: int, base: int, part) -> Column:
    """The parts of a remainder that stands at ``at`` in the stream. The stream's sequences start at the multiples of
    ``size``; what is over ``size`` at its end is cut into powers of two, the largest first."""
    tail, start = total % size, total - total % size
    powers = [1 << k for k in reversed(range(size.bit_length())) if tail >> k & 1]
    cuts = [start + sum(powers[:k]) for k in range(len(powers))]
    end = at + length
    inner = F.filter(F.array((F.floor(at / size) + 1) * size, *[F.lit(c) for c in cuts[1:]]), lambda c: (c > at) & (c < end)).cast("array<long>")
    firsts = F.array_sort(F.array_distinct(F.concat(F.array(at.cast("long")), inner)))
    known = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")

    def one(x: Column, i: Column) -> Column:
        nth = F.size(F.filter(known, lambda c: c <= x))  # the tail's sequence, from 1
        in_tail = nth > 0
        sequence = F.when(in_tail, F.lit(base + total // size) + nth - 1).otherwise(F.lit(base) + F.floor(x / size))
        offset = F.when(in_tail, x - F.element_at(known, F.greatest(nth, F.lit(1)))).otherwise(x % size) if cuts else x % size
        stop = F.coalesce(F.try_element_at(firsts, i + 2), end)
        return part(x - at, stop - x, sequence, offset)

    return F.transform(firsts, one)


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces: (doc_id, start, length, ids, doc_tokens, sequence_id, offset), ids little-endian unsigned 32-bit."""
    tokens = written(tokenized(docs, path), "tokens")
    plan = assigned(tokens.select("uid", "n"), size)
    rows = tokens.join(plan.hint("shuffle_hash"), "uid")
    full = F.transform(
        F.when(F.col("n") >= size, F.sequence(F.lit(0), F.floor(F.col("n") / size).cast("int") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct((k * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), (F.col("full_base") + k).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )
    rest = F.transform(F.coalesce("parts", F.array().cast("array<struct<start: long, length: long, sequence_id: long, offset: long>>")), lambda p: F.struct(
        (p["start"] + F.col("n") - F.col("n") % size).alias("start"), p["length"].alias("length"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset"),
    ))
    pieces = rows.select("doc_id", "n", "ids", F.explode(F.concat(full, rest)).alias("p"))
    ids = F.substring("ids", (F.col("p.start") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return pieces.select("doc_id", "p.start", "p.length", ids.alias("ids"), F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")


def digest_columns(pieces: DataFrame) -> DataFrame:
    """The result's columns from ``packed``'s."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
