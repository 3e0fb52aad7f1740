"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of a string's byte-pair encoding, together with the encoding of
what stands before that token, is the whole encoding; and tokens a, b may stand
side by side in an encoding just if nothing merges across their boundary when
the two are encoded together. So each prefix of a word has one last token: the
token that ends the prefix and may follow the last token of what is before it.
Distinct words are put into a trie and the last-token states are propagated
depth first: a prefix that many words share is solved once. The trie is laid out
flat, as its words in order, each with the length of the prefix that it shares
with the one before; walking them in that order is the depth-first traversal. The
tokens that end a prefix are found by an automaton whose states are the beginnings
of tokens. A word's encoding is read off by stepping back from its end, a last
token at a time.

Texts are cut into words as the tokenizer's own pattern cuts them. Texts with
characters on which pattern engines may differ are cut by the library.

Defined results: a null text counts as empty and gives no tokens. Strings of
special tokens in a text are encoded as those tokens. Equal rows get equal
results. An empty table gives an empty result. Very long texts and very long
words are encoded whole; time per word is linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import tune

#: Words whose encodings a worker keeps, and the longest that it keeps.
KEPT_WORDS = 600_000
KEPT_LENGTH = 64
#: Characters on which all pattern engines agree: printable ASCII, tab, line ends, Latin letters and signs.
_PLAIN = ["\t", "\n", "\r", *map(chr, [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)])]
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]")
_NEVER = 1 << 60
#: Code points of text that are encoded together.
TOGETHER = 4_000_000
_BYTES = [bytes((k,)) for k in range(256)]


def plain_pattern(pattern: str) -> re.Pattern:
    """A tokenizer's pattern for the standard engine, its letters and numbers spelt out: those among ``_PLAIN``."""

    def spelt(kind: str) -> str:
        return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)

    out, inside = [], False
    for piece in re.split(r"(\\p\{[LN]\}|\\.|\[|\])", pattern):
        if piece in ("[", "]"):
            inside = piece == "["
        elif piece.startswith("\\p"):
            piece = spelt(piece[3]) if inside else f"[{spelt(piece[3])}]"
        out.append(piece)
    return re.compile("".join(out))


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others,
    by rising value, for the letters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary: encodes as its library does, and decodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.lengths = list(map(len, self.bytes))
        # the automaton: states are beginnings of tokens, met so far; by state the tokens that end there, longest first
        self.begins = {b[:k] for b in self.ids for k in range(1, len(b) + 1)}
        self.state_of: dict[bytes, int] = {b"": 0}
        self.string_of: list[bytes] = [b""]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        self.step: dict[int, int] = {}  # state * 256 + byte
        self.merge: dict[tuple[int, int], int] = {}  # rank of the merge of two tokens
        self.parts: dict[int, tuple[int, int, int]] = {}  # a merged token's two parts and rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = (self.ids[raw(s)] for s in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[x, y] = rank
            self.parts.setdefault(self.ids[self.bytes[x] + self.bytes[y]], (x, y, rank))
        self._spines: tuple[dict, dict] = ({}, {})
        self._beside: dict[int, bool] = {}  # first token << 32 | second
        self.library = Tokenizer.from_file(path)
        import public_tokenizers

        self.words_of = plain_pattern(public_tokenizers.PATTERN).findall
        self.kept: dict[str, bytes] = {}

    # --- which tokens may stand side by side --------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end (0: left, 1: right) of ``token`` as it is merged, from a byte up, with
        the rank at which each is merged into the next."""
        known = self._spines[side].get(token)
        if known is None:
            known = [(token, _NEVER)]
            while parts := self.parts.get(known[-1][0]):
                known.append((parts[side], parts[2]))
            known = self._spines[side][token] = known[::-1]
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether a, b stay apart when their bytes are encoded together. Merges happen by rising rank, and of one
        rank from the left: two neighbours across the boundary merge if their merge comes before both are merged
        into something else."""
        known = self._beside.get(a << 32 | b)
        if known is None:
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.merge.get((x, y), _NEVER)
                if rank < x_ends and rank <= y_ends and rank != _NEVER:
                    known = False
                    break
                if x_ends == y_ends == _NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self._beside) > 1_000_000:
                self._beside.clear()
            self._beside[a << 32 | b] = known
        return known

    # --- the trie -----------------------------------------------------------------------

    def _stepped(self, state: int, byte: int) -> int:
        """The state after a byte: the longest beginning of a token that ends there."""
        string = self.string_of[state] + _BYTES[byte]
        while string not in self.begins:
            string = string[1:]
        to = self.state_of.get(string)
        if to is None:
            to = self.state_of[string] = len(self.string_of)
            self.string_of.append(string)
            ends = (string[k:] for k in range(len(string)))
            self.ending.append(tuple((len(x), self.ids[x]) for x in ends if x in self.ids))
        self.step[state << 8 | byte] = to
        return to

    def solve(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The encoding of each distinct word, through a trie of them all."""
        out: dict[bytes, list[int]] = {}
        step, ending, known, lengths = self.step.get, self.ending, self._beside.get, self.lengths
        before = b""
        last, states = [-1], [0]  # by depth: the last token of the prefix, and the automaton's state
        for word in sorted(words):
            n, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                n = most
            else:
                while before[n] == word[n]:
                    n += 1
            del last[n + 1 :], states[n + 1 :]
            state = states[n]
            for depth in range(n + 1, len(word) + 1):
                byte = word[depth - 1]
                to = step(state << 8 | byte)
                state = self._stepped(state, byte) if to is None else to
                # tokens that end the prefix, from the longest: the one that may follow what is before it
                for size, token in ending[state]:
                    if size == depth:
                        break
                    left = last[depth - size]
                    fits = known(left << 32 | token)
                    if fits or fits is None and self.beside(left, token):
                        break
                last.append(token)
                states.append(state)
            found, at = [], len(word)
            while at:
                found.append(last[at])
                at -= lengths[last[at]]
            found.reverse()
            out[word] = found
            before = word
        return out

    # --- texts --------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """``text`` as the tokenizer cuts it."""
        if _ODD.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.words_of(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.special_split is None or "<|" not in text:
                cut.append(self.words(text))
            else:
                parts = self.special_split.split(text)
                cut.append([w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.words(part))])
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        if not kept:
            kept.update({s: i.to_bytes(4, "little") for s, i in self.special.items()})
        missing = set().union(*cut).difference(kept) if cut else set()
        new = dict(zip(missing, map(str.encode, missing), strict=True))
        solved = self.solve(new.values())
        for word, data in new.items():
            kept[word] = pack(f"<{len(solved[data])}I", *solved[data])
        out = [b"".join(map(kept.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > KEPT_LENGTH:
                del kept[word]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit integers."""
    return _run(docs, path, [("ids", "binary", pa.binary(), lambda c, ids: ids)])


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of ``tokens`` (doc_id, ids)."""
    tune(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or b"") for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each row's encoding and of what it decodes to, made in one pass."""
    return _run(docs, path, [
        ("n_tokens", "long", pa.int64(), lambda c, ids: len(ids) // 4),
        ("ids_sha256", "string", pa.string(), lambda c, ids: hashlib.sha256(ids).hexdigest()),
        ("decoded_sha256", "string", pa.string(), lambda c, ids: hashlib.sha256(c.decode(ids).encode()).hexdigest()),
    ])


def _run(docs: DataFrame, path: str | None, columns: list) -> DataFrame:
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or vocabulary())
        for b in batches:
            ids: list[bytes] = []
            texts: list[str] = []
            size = 0
            for text in b.column(1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > TOGETHER:
                    ids += c.encode_batch(texts)
                    texts, size = [], 0
            ids += c.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f(c, x) for x in ids], kind) for _, _, kind, f in columns]], ["doc_id", *[name for name, *_ in columns]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{name} {kind}" for name, kind, *_ in columns]]))
