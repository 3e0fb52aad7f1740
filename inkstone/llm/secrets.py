"""Secret scans: patterns of known kinds, and strings that a tokenizer cannot compress.

Base kinds are ``assign`` (a credential word, a separator, a value), ``access``
(key ids with a fixed prefix) and ``hex`` (long lower-case hexadecimal runs). The
token-efficiency test adds kind ``dense``: a run of key characters, or a part
of one, whose characters per token under a tiktoken vocabulary are few, as
random strings have no frequent substrings. Assigned values, known digests in
their usual notation and length and UUIDs are cut out first, and the rest of
the run is judged; numbers, paths, words and names in the usual cases have too
many characters a token. A key id or hexadecimal run that is only a part of a
random string is extended to the whole of it; what base spans cover by
themselves is not named twice.

Offsets count code points; ends are exclusive.

Defined results: a null or empty text has no spans. Equal rows get equal
results; spans of one start are ordered by kind as listed. An empty table gives
an empty result. Very long texts are scanned whole. Extra columns of any name
are kept as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import map_rows, place_of, tune

KINDS = ("assign", "access", "hex", "dense")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the token-efficiency test; a shorter string holds too few tokens to judge.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests and identifiers: UUIDs, digests with their algorithm's name before them, hexadecimal of a digest's length.
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_DIGEST_NAME = re.compile(r"(?:md5|sha-?1|sha-?224|sha-?256|sha-?384|sha-?512|crc32|etag|integrity)[-:=\s\"']*$", re.IGNORECASE)
_NAMED_DIGEST = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|crc32)[-_=]", re.IGNORECASE)
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
_DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
#: A digest where its name ends: hexadecimal or base64 of a digest's length.
_DIGEST = re.compile("|".join(rf"[0-9A-Fa-f]{{{n}}}(?![A-Za-z0-9+])" for n in sorted(_DIGEST_LENGTHS)) + "|" + "|".join(rf"[A-Za-z0-9+/]{{{n}}}{'=' * pad}(?![A-Za-z0-9+=])" for n, pad in ((22, 2), (27, 1), (38, 2), (43, 1), (64, 0), (86, 2))))
_SEPARATORS = "/_=-"
_PARTS = re.compile(r"[^/_=-]+")
#: Fewest code points for a token that ordinary text reaches.
RATIO = 2.2
#: The same for strings of letters alone, which may be words of any language: less than upper-case words reach.
LETTERS_RATIO = 1.7
#: Least code points of a judged string.
LEAST = 20
#: Shorter strings, of 16 code points or more, have no separator, letters of both cases and digits, and fewer for a token.
SHORT_RATIO = 1.9


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_looking(run: str, enc: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """Whether ``run`` has fewer than ``ratio`` characters a token and letters; without digits, fewer than LETTERS_RATIO."""
    if not any(c.isalpha() for c in run):
        return False
    if not any(c.isdigit() for c in run):
        ratio = min(ratio, LETTERS_RATIO)
    return len(run) < ratio * len(enc.encode_ordinary(run))


def known_parts(run: str, named: bool) -> list[tuple[int, int]]:
    """The spans of a run that are UUIDs or digests; ``named``: a digest's name stands before the run."""
    out = [m.span() for m in _UUID.finditer(run)]
    starts = [0] if named else []
    starts += [m.end() for m in _NAMED_DIGEST.finditer(run) if not m.start() or run[m.start() - 1] in _SEPARATORS]
    out += [(min(k, m.start()), m.end()) for k in starts if (m := _DIGEST.match(run, k))]
    return out + [m.span() for m in _PARTS.finditer(run) if _HEX_ONLY.fullmatch(m[0]) and len(m[0]) in _DIGEST_LENGTHS]


def dense(run: str, enc: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int]]:
    """The spans of a run that look random: the whole of a run without words, else its parts between separators, and
    windows of about LEAST code points with few separators, grown to whole parts."""
    if len(run) < LEAST:
        mixed = run.isalnum() and all(any(map(kind, run)) for kind in (str.isupper, str.islower, str.isdigit))
        return [(0, len(run))] if len(run) >= 16 and mixed and random_looking(run, enc, min(ratio, SHORT_RATIO)) else []
    parts = [m.span() for m in _PARTS.finditer(run)]
    whole = random_looking(run, enc, ratio)
    if whole and not any(b - a >= 5 and run[a:b].isalpha() for a, b in parts):
        return [(parts[0][0], len(run))]
    inside = [0] * len(run)
    for a, b in parts:
        if b - a >= LEAST and random_looking(run[a:b], enc, ratio):
            inside[a:b] = [1] * (b - a)
    ends = [0]
    for token in enc.encode_ordinary(run):
        ends.append(ends[-1] + len(enc.decode_single_token_bytes(token)))  # a run is ASCII
    j = 0
    for i, a in enumerate(ends):
        while j < len(ends) - 1 and ends[j] - a < LEAST:
            j += 1
        b = ends[j]
        if b - a < LEAST:
            break
        piece = run[a:b]
        mixed = any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece)
        few = sum(map(piece.count, _SEPARATORS)) * 10 <= len(piece)
        if few and not piece.isdigit() and len(piece) < (ratio if mixed else min(ratio, LETTERS_RATIO)) * (j - i):
            inside[a:b] = [1] * (b - a)
    out: list[list[int]] = []
    for a, b in parts:
        if any(inside[a:b]):
            if out and all(inside[out[-1][1] : a]):
                out[-1][1] = b
            else:
                out.append([a, b])
    begins = [a for a, _ in parts]
    for span in out:  # words at the ends stay
        own = parts[bisect_left(begins, span[0]) : bisect_left(begins, span[1])]
        word = lambda p: run[p[0] : p[1]].isalpha() and not random_looking(run[p[0] : p[1]], enc, ratio) and p[1] - p[0] >= 3
        while len(own) > 1 and word(own[0]):
            own.pop(0)
        while len(own) > 1 and word(own[-1]):
            own.pop()
        span[:] = own[0][0], own[-1][1]
    return [(a, b) for a, b in out] or [(0, len(run))] * whole


def grown(run: str, inner: list[tuple[int, int]], found: list[tuple[int, int]], enc: tiktoken.Encoding, ratio: float) -> list[tuple[int, int]]:
    """``found`` with the parts of which a span of ``inner`` is only a piece, if their rest looks random too; spans
    that overlap are one, those that ``inner`` covers go."""
    out = list(found)
    if not inner:
        return merged(out)
    k = 0
    for a, b in (m.span() for m in _PARTS.finditer(run)):
        while k < len(inner) and inner[k][1] <= a:
            k += 1
        j, at, rest, held = k, a, [], False
        while j < len(inner) and inner[j][0] < b:
            x, y = inner[j]
            if a < y:
                held = True
                rest.append(run[at:x])  # empty where spans overlap
                at = max(at, y)
            j += 1
        left = "".join([*rest, run[at:b]]) if held else ""
        if len(left) >= 4 and len(left) < ratio * len(enc.encode_ordinary(left)):
            out.append((a, b))
    begins, ends = [x for x, _ in inner], list(accumulate((y for _, y in inner), max))
    covered = lambda a, b: (n := bisect_right(begins, a)) and ends[n - 1] >= b
    return [(a, b) for a, b in merged(out) if not covered(a, b)]


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: str | None, enc: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in ``text``, by start and then kind."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    # runs and the base spans of one kind both stand in order, and are walked together
    base = [[x for x in found if x[2] == kind] for kind in KINDS[:-1]]
    first = [0] * len(base)
    for m in _RUN.finditer(text):
        start, end = m.span()
        met = []
        for k, own in enumerate(base):
            while first[k] < len(own) and own[first[k]][1] <= start:
                first[k] += 1
            j = first[k]
            while j < len(own) and own[j][0] < end:
                met.append((own[j][0] - start, own[j][1] - start, own[j][2]))
                j += 1
        cut = [(a, b) for a, b, kind in met if kind == "assign"]
        cut += known_parts(m[0], bool(_DIGEST_NAME.search(text[max(0, start - 16) : start])))
        others = sorted((x, y) for x, y, kind in met if kind != "assign")
        at = k = 0
        for a, b in sorted([*cut, (end - start, end - start)]):
            piece = m[0][at : max(at, a)]
            while k < len(others) and others[k][0] < at:
                k += 1
            j, inner = k, []
            while j < len(others) and others[j][0] < a:
                if others[j][1] <= a:
                    inner.append((others[j][0] - at, others[j][1] - at))
                j += 1
            found += [(start + at + x, start + at + y, "dense") for x, y in grown(piece, inner, dense(piece, enc, ratio), enc, ratio)]
            at = max(at, b)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not found:
        return text
    out, at, merged = [], 0, []
    for start, end, kind in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def scanned(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """Each row's doc_id and its spans, array<struct<start, end, kind>>."""
    tune(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path or vocabulary())
        for b in batches:
            found = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans(t.as_py(), enc, ratio)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def digest_columns(found: DataFrame) -> DataFrame:
    """The result's columns from ``scanned``'s."""
    joined = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(lambda s: s["kind"] != "dense")
    return found.select("doc_id", *map(count, KINDS[:-1]), F.sha2(base, 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"), count(KINDS[-1]))


def cleaned(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """``docs``, all rows and columns, with every secret in ``text`` redacted."""
    tune(docs.sparkSession)
    at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path or vocabulary())
        for b in batches:
            texts = [t.as_py() for t in b.column(at)]
            yield b.set_column(at, b.schema.field(at), pa.array([redacted(t, spans(t, enc, ratio)) for t in texts], b.schema.field(at).type))

    return map_rows(docs, run)


def sha256_of_base(found: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in found if k != "dense").encode()).hexdigest()
