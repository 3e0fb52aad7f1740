import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import encoding as X

CODEC = X.codec(X.vocabulary())


def ids_of(texts):
    return [np.array(e.ids, "<u4").tobytes() for e in CODEC.library.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.one_of(st.text(max_size=60), st.text("abth e\n\t'.!19é<|>endoftx", max_size=60)), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(texts):
    got = CODEC.encode_batch(texts)
    assert got == ids_of(texts)
    assert [CODEC.decode(g) for g in got] == texts


def test_odd_texts_equal_the_library():
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", " " * 3000, "ab" * 4000, "x" * 20000, "\x1c\x85 ​ é­", "😀" * 500, "don't I'LL 'S"]
    assert CODEC.encode_batch(texts) == ids_of(texts)


def test_shared_prefixes_are_solved_alike():
    words = [b"hello", b"hell", b"help", b"", b"helping", b"\xff\xfe"]
    together = CODEC.solve(words)
    assert together == {w: CODEC.solve([w])[w] for w in words}


def test_query_equals_the_library(documents, texts):
    want = dict(zip(texts, ids_of(list(texts.values())), strict=True))
    for r in X.round_trip(documents).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_and_empty_tables(odd_docs, no_docs):
    tokens = X.encoded(odd_docs)
    back = {r["doc_id"]: r["text"] for r in X.decoded(tokens).collect()}
    assert back == {r["doc_id"]: r[1] or "" for r in odd_docs.collect()}
    assert X.round_trip(no_docs).count() == 0 and X.round_trip(odd_docs).count() == odd_docs.count()
