import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import bestfit as X
from inkstone.llm import encoding

PIECES = X.pieces_of(encoding.vocabulary())
ODD = st.text("ab the \n\t'.!19é\x85\xa0　日<|>endoftxſ", max_size=50)


def ids_of(text):
    return PIECES.library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.text(max_size=50), ODD), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_library(texts):
    ids, at = PIECES.encode_batch(pa.array(texts, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*ids_of(t), 2] for t in texts]


def test_very_long_strings_and_special_tokens():
    texts = ["a" * 20_000, " <|endoftext|> x<|endoftext|>", "é" * 3000 + " b", " " * 5000 + "x", "x ", "word " * 5000]
    ids, at = PIECES.encode_batch(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*ids_of(t), 2] for t in texts]


def one_by_one(lengths, size):
    """Best-two-fit, a bin at a time, on a sorted list: how many bins of each content."""
    left = sorted(lengths)
    out = Counter()
    while left:
        own, gap = [], size
        for x in reversed(left[:]):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap:
            room = gap + own[-1]
            pairs = [p for p in itertools.combinations(left, 2) if own[-1] < sum(p) <= room]
            if pairs:
                best = max(sum(p) for p in pairs)
                pair = min(p for p in pairs if sum(p) == best)
                left = sorted([*left, own.pop()])
                for x in pair:
                    left.remove(x)
                own += pair
        out[tuple(sorted(own))] += 1
    return out


def test_bins_equal_one_at_a_time():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([10, 24, 50])
        lengths = [rng.randint(1, size - 1) for _ in range(rng.randint(0, 60))]
        got = Counter()
        for kind, times in X.bins(dict(Counter(lengths)), size):
            got[tuple(sorted(x for x, n in kind for _ in range(n)))] += times
        assert got == one_by_one(lengths, size)


def test_replacing_two_for_one_helps():
    # greedy fills 6 + 3 of 10 and leaves 2, 2, 6, 3; best-two-fit makes 6 + 2 + 2
    kinds = X.bins({6: 1, 3: 1, 2: 2}, 10)
    assert kinds[0] == ([(6, 1), (2, 2)], 1)


def least_bins(counts, size):
    """A lower bound: pieces over half a bin lie apart, and what is left beside them holds so much of the others."""
    best = 0
    for k in range(size // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > size - k)
        beside = {x: n for x, n in counts.items() if size / 2 < x <= size - k}
        room = sum((size - x) * n for x, n in beside.items())
        rest = sum(x * n for x, n in counts.items() if k <= x <= size / 2)
        best = max(best, alone + sum(beside.values()) + max(0, -(-(rest - room) // size)))
    return best


def test_few_more_bins_than_the_bound_at_any_size():
    rng = np.random.default_rng(5)
    for scale in (1, 1000, 10**6):
        counts = {int(x): int(n) for x, n in zip(rng.permutation(np.arange(1, 1024))[:700], rng.integers(1, 50, 700) * scale, strict=True)}
        kinds = X.bins(counts, 1024)
        used = Counter()
        for kind, times in kinds:
            assert sum(x * n for x, n in kind) <= 1024
            used.update({x: n * times for x, n in kind})
        assert used == counts and len(kinds) < 8000
        assert least_bins(counts, 1024) <= sum(t for _, t in kinds) <= 1.002 * least_bins(counts, 1024)


def checked(pieces, texts, size=X.SIZE):
    """Each piece as the contract has it, and sequences without gap or overlap; how many there are."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids, at = [*ids_of(texts[d] or ""), 2], 0
        for k, p in enumerate(sorted(ps, key=lambda p: p["start"])):
            assert (p["piece"], p["start"]) == (k, at) and 0 < p["length"] <= size and (k == 0 or p["length"] == size)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_documents_in_few_sequences(documents, texts):
    out = X.digest_columns(X.packed(documents)).collect()
    assert checked(out, texts) <= -(-sum(p["length"] for p in out) // X.SIZE) * 1.01 + 1


@pytest.mark.parametrize("size", [1, 2, 7])
def test_small_sequences(spark, size):
    rows = [(i, "word and word " * (i % 5)) for i in range(40)]
    out = X.digest_columns(X.packed(spark.createDataFrame(rows, "doc_id long, text string"), size=size)).collect()
    checked(out, dict(rows), size)


def test_odd_and_empty_tables(odd_docs, no_docs):
    alone = odd_docs.dropDuplicates(["doc_id"])
    checked(X.digest_columns(X.packed(alone)).collect(), {r["doc_id"]: r["TEXT"] for r in alone.collect()})
    assert X.packed(no_docs).count() == 0
    twice = X.packed(odd_docs.filter("doc_id = 3")).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
