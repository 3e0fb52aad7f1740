"""Packing by best-two-fit.

A document's tokens and an end token are one piece, or, where they are more than
a sequence holds, a first piece with what is over whole sequences, and full
pieces. Full pieces are sequences by themselves. The others are counted by
length: a histogram of at most ``size`` - 1 numbers, whatever the corpus. Bins are
filled on it, one kind of bin at a time: greedily, always the longest piece that
fits; if a gap is left, the smallest piece of the bin is taken out again for the
two unpacked ones that fill the wider gap best, if they fill it better than that
piece. A kind of bin is repeated as long as there are pieces for it, as filling
one bin at a time would do. All pieces of a length are alike, so they are ranked
within their length and dealt to the bins by rank; a piece's place in its bin
follows from the rank too, and no bin is ever gathered.

Defined results: a null or empty text is its end token alone. Equal rows are
packed separately; a null id is an ordinary one. An empty table gives an empty
result. Very long texts give many full pieces. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import encoding
from inkstone.llm.common import n_tasks, ranked, tune, written

SIZE = 1024
END = 2
#: Bytes of text that are encoded together; a longer text by itself.
TOGETHER = 8 << 20
#: Code points above which a string without a blank is left to the library.
LONG = 1000
#: What may begin a word at which a text is cut: no white space, whatever an engine takes for that.
_BEGINS = re.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]")


# --- tokens -------------------------------------------------------------------------------


class Pieces:
    """Ids of a byte-level tokenizer. A blank before a character that is no white space always begins a token, so texts
    are cut there, and the distinct strings of a batch are encoded once, laid end to end. Strings of characters on which
    pattern engines agree are encoded by tiktoken, whose merges are the file's; all others by the file's own library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level tokenizer of the usual kind")
        import public_tokenizers

        letters = encoding._byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merged = [raw("".join(pair if isinstance(pair, list) else pair.split(" "))) for pair in spec["model"]["merges"]]
        order = list(dict.fromkeys([*(bytes((k,)) for k in range(256)), *merged]))  # by rank of merge
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        self.to_id = np.array([vocab[x] for x in order], np.uint32)
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: k for k, x in enumerate(order)}, special_tokens={})
        self.bytes_of = np.array(list(map(len, order)), np.int64)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.slow = re.compile("|".join([encoding._ODD.pattern, *special]))

    def _by_library(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(strings, add_special_tokens=False)]

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each string behind a blank, end to end, and how many each has."""
        slow = [k for k, s in enumerate(strings) if len(s) > LONG or self.slow.search(s)]
        texts = [" " + s for s in strings]
        for k in slow:
            texts[k] = ""
        ranks = self.fast.encode_to_numpy("".join(texts), disallowed_special=())
        # a token lies in one string: where each string ends, in bytes, gives its last token
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts)))
        upto = np.searchsorted(np.cumsum(self.bytes_of[ranks]), ends, side="right")
        size = np.diff(upto, prepend=0)
        ids = self.to_id[ranks]
        if slow:
            own = self._by_library([" " + strings[k] for k in slow])
            size[slow] = list(map(len, own))
            ids = np.insert(ids, np.repeat(upto[slow], size[slow]), np.concatenate(own))
        return ids, size

    def encode_batch(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids laid end to end, each text's followed by ``end``, and where each text begins (and the last one
        ends)."""
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        strings = coded.dictionary.to_pylist()
        place = coded.indices.to_numpy().astype(np.int64)
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        first = offsets[:-1]
        # texts with a blank before white space, or at the end, are encoded as a whole; of the others the first strings
        # stand behind no blank
        odd = np.array([not _BEGINS.match(s) for s in strings], bool)[place]
        odd[first] = False
        alone = [strings[k] for k in place[first].tolist()]
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist():
            alone[k] = texts[k].as_py()
            place[offsets[k] : offsets[k + 1]] = len(strings) + len(alone)  # nothing
        place[first] = len(strings) + np.arange(len(alone))
        data, size = self._encoded(strings)
        alone = self._by_library(alone)
        data = np.concatenate([data, *alone])
        size = np.concatenate((size, np.fromiter(map(len, alone), np.int64, len(alone)), [0]))
        begin = np.cumsum(size) - size
        own = size[place]
        after = np.cumsum(own)
        ids = data[np.repeat(begin[place] - (after - own), own) + np.arange(int(after[-1]) if len(after) else 0)]
        ends = np.concatenate(([0], after))[offsets]
        return np.insert(ids, ends[1:], end), ends + np.arange(len(ends))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def cut(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(uid, doc_id, piece, start, length, doc_tokens, ids): each row's pieces, and a number of its own for each. The
    numbers hold for one run; callers write the table before they use them."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = pieces_of(path or encoding.vocabulary()).encode_batch, TaskContext.get().partitionId() << 40
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            bounds = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(bounds)) + 1).tolist(), b.num_rows]
            for k, m in zip(cuts, cuts[1:], strict=False):
                if m == k:
                    continue
                ids, at = encode(texts.slice(k, m - k), end)
                n = np.diff(at)
                many = -(-n // size)
                row = np.repeat(np.arange(m - k), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                head = ((n - 1) % size + 1)[row]  # the first piece's length
                start = np.where(piece == 0, 0, head + (piece - 1) * size)
                length = np.where(piece == 0, head, size)
                at = np.append(at[:-1][row] + start, at[-1])
                packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                doc_id = b.column(0).slice(k, m - k).take(pa.array(row))
                longs = [pa.array(x.astype(np.int64)) for x in (piece, start, length, n[row])]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(row))), doc_id, *longs, packed], ["uid", "doc_id", "piece", "start", "length", "doc_tokens", "ids"])
                uid += len(row)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, piece long, start long, length long, doc_tokens long, ids binary")


# --- bins ---------------------------------------------------------------------------------


def best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths, of those that ``left`` counts, with the largest sum of at most ``room``; (0, 0) if there are none."""
    there = left[: room + 1] > 0
    there[0] = False
    below = np.maximum.accumulate(np.where(there, np.arange(len(there)), 0))  # the longest of at most each length
    x = np.flatnonzero(there)
    y = below[room - x]
    y = np.where((y == x) & (left[x] < 2), below[np.maximum(x - 1, 0)], y)
    total = np.where(y > 0, x + y, 0)
    if not len(x) or not total.any():
        return 0, 0
    k = int(total.argmax())
    return int(x[k]), int(y[k])


def bins(histogram: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of bins, as (length, how many) from the longest, and how often each is made; together they hold each piece
    of ``histogram`` once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done = []
    while left.any():
        rest, gap, taken = left.copy(), size, {}
        while gap and len(fits := np.flatnonzero(rest[: gap + 1])):
            length = int(fits[-1])
            n = min(gap // length, int(rest[length]))
            taken[length] = n
            rest[length] -= n
            gap -= n * length
        smallest = min(taken)
        if gap:
            pair = best_two(rest, gap + smallest)
            if sum(pair) > smallest:
                taken[smallest] -= 1
                for length in pair:
                    taken[length] = taken.get(length, 0) + 1
        kind = [(length, n) for length, n in sorted(taken.items(), reverse=True) if n]
        times = min(int(left[length]) // n for length, n in kind)
        for length, n in kind:
            left[length] -= n * times
        done.append((kind, times))
    return done


class Dealt:
    """Which bin and place the piece of a rank in its length gets."""

    def __init__(self, kinds: list[tuple[list[tuple[int, int]], int]], size: int):
        rows, taken, base = [], [0] * (size + 1), 0
        for kind, times in kinds:
            offset = 0
            for length, n in kind:
                rows.append((length, taken[length], n, base, offset))
                taken[length] += n * times
                offset += n * length
            base += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)  # a row for each length of each kind of bin
        self.key = table[:, 0] << 44 | table[:, 1]
        self.low, self.each, self.base, self.offset = table[:, 1:].T.copy()

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        own = rank - self.low[k]
        return self.base[k] + own // self.each[k], self.offset[k] + own % self.each[k] * length


def assigned(lengths: DataFrame, size: int = SIZE) -> DataFrame:
    """(uid, sequence_id, offset) of pieces (uid, length) shorter than ``size``."""
    histogram = dict(lengths.groupBy("length").count().collect())  # fewer than ``size`` rows
    dealt = Dealt(bins(histogram, size), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = dealt(*[b.column(k).to_numpy().astype(np.int64) for k in (1, 2)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence), pa.array(offset)], ["uid", "sequence_id", "offset"])

    by_rank = ranked(lengths, ["length"], ["uid"], "rank", n_tasks(lengths.sparkSession), F.xxhash64("uid"))
    return by_rank.select("uid", "length", "rank").mapInArrow(run, "uid long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces: (doc_id, piece, start, length, ids, doc_tokens, sequence_id, offset), ids little-endian unsigned 32-bit. The
    sequences of full pieces have negative numbers."""
    pieces = written(cut(docs, path, size, end), "pieces")
    columns = ["doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids", "doc_tokens"]
    full = pieces.filter(F.col("length") == size).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < size)
    places = assigned(short.select("uid", "length"), size)
    return full.unionByName(short.join(places, "uid").select(*columns, "sequence_id", "offset"))


def digest_columns(pieces: DataFrame) -> DataFrame:
    """The result's columns from ``packed``'s."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens")
