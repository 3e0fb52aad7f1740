import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import packing as X

ENCODER = X.encoder(X.vocabulary())


def ids_of(text):
    return np.array(ENCODER.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.one_of(st.text(max_size=60), st.text("abth e\n\t'.!19éİΣſ<|>endoftx́", max_size=60)))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(text):
    assert ENCODER(text) == ids_of(text)


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 12, 4))
        values = rng.random(len(lengths))
        best = max(sum(c * v for c, v in zip(cs, values)) for cs in itertools.product(*[range(13 // n + 1) for n in lengths]) if sum(c * n for c, n in zip(cs, lengths)) <= 12)
        value, counts = X.best_pattern(values, lengths, 12)
        assert abs(value - best) < 1e-9 and counts @ lengths <= 12 and abs(counts @ values - best) < 1e-9


def test_patterns_fit_and_use_no_more_than_there_is():
    rng = np.random.default_rng(4)
    lengths = np.arange(1, 65)
    demand = rng.integers(0, 4000, 64) + 1
    found = X.patterns(lengths, demand, 64)
    used = sum(c * n for c, n in found)
    assert (used <= demand).all() and all(c @ lengths <= 64 for c, _ in found)
    sequences, left = sum(n for _, n in found), (demand - used) @ lengths
    assert (sequences + left / 64) * 64 <= 1.01 * (demand @ lengths)


def checked(pieces, texts):
    """Every id in one piece, pieces in sequences without gap or overlap; the padding's share."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids = ids_of(texts[d] or "") + b"\x01\0\0\0"
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids) // 4
            part = ids[4 * at : 4 * (at + p["length"])]
            assert p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids) // 4
    pad = total = 0
    for ps in by_sequence.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= X.SIZE
        pad += 0 if at & (at - 1) == 0 else X.SIZE - at
        total += at
    return pad / max(1, total)


def test_all_ids_are_packed_once_with_little_padding(documents, texts):
    assert checked(X.digest_columns(X.packed(documents)).collect(), texts) < 0.02


def test_odd_and_empty_tables(odd_docs, no_docs):
    alone = odd_docs.dropDuplicates(["doc_id"])
    checked(X.digest_columns(X.packed(alone)).collect(), {r["doc_id"]: r[1] for r in alone.collect()})
    assert X.packed(no_docs).count() == 0
    twice = odd_docs.filter("doc_id = 3")
    assert X.packed(twice).count() == 2
