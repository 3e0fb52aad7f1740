import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from inkstone.llm import queries
from inkstone.llm import runs as X


def plain_runs(words, least=X.LEAST):
    """Every period from the smallest on, every stretch of it."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng, n):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(n)]
    if kind < 0.4:
        return ["a"] * n
    if kind < 0.6:  # words of the Fibonacci kind have as many runs as can be
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    period = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
    words = [period[i % len(period)] for i in range(n)]
    for _ in range(rng.randint(0, 3)):
        if words:
            words[rng.randrange(n)] = rng.choice("abcd")
    return words


@pytest.mark.parametrize("least", [X.LEAST, 2, 5])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [made(rng, rng.randint(0, 70)) for _ in range(rng.randint(1, 6))]
        found, left = X.found(pa.array(list(map(" ".join, texts)), pa.string()), least)
        for words, own, collapsed in zip(texts, found, left.to_pylist(), strict=True):
            assert own == plain_runs(words, least) and collapsed == plain_collapsed(words, own)


def test_branching_repeats_equal_their_definition():
    rng = random.Random(9)
    for _ in range(100):
        words = made(rng, rng.randint(1, 50))
        _, bounds = X.split(pa.array([" ".join(words)]))
        numbers = pa.array(words).dictionary_encode().indices.to_numpy().astype("int64")
        place, period = X.Tree(numbers, bounds).branching()
        want = {(i, d) for d in range(1, len(words) // 2 + 1) for i in range(len(words) - 2 * d + 1) if words[i : i + d] == words[i + d : i + 2 * d] and words[i : i + 1] != words[i + 2 * d : i + 2 * d + 1]}
        got = list(zip(place.tolist(), period.tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == want


def test_words_are_what_the_pattern_finds():
    texts = ["", "  a b\x0b\x0cc\n", "\x1c \x85 x\xa0y　z", "a\x00b c", "\t\r\n", "naïve 日本 😀"]
    words, bounds = X.split(pa.array(texts))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] == [re.findall(X.WORD, t) for t in texts]


def test_long_texts():
    assert X.found(pa.array(["x " * 200_000]))[0] == [[(0, 200_000, 1)]]
    text = " ".join(str(i % 1000) for i in range(200_000))
    assert X.found(pa.array(["", text, "a"]))[0] == [[], [(0, 200_000, 1000)], []]


def plainly(doc_id, text):
    """A row of the query."""
    words = re.findall(X.WORD, text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(plain_collapsed(words, found))


def test_query_equals_brute_force(spark, data, texts):
    small = {d: t for d, t in texts.items() if len(t) < 12_000}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, data).collect()}
    assert set(got) == set(texts) and all(got[d] == plainly(d, t) for d, t in small.items())
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_odd_and_empty_tables(odd_docs, no_docs):
    got = sorted(map(str, X.digest_columns(X.repeated(X.planted(odd_docs.filter("doc_id <> 6 or doc_id is null")))).collect()))
    rows = [r for r in odd_docs.collect() if r["doc_id"] != 6]
    want = [plainly(r["doc_id"], r["TEXT"]) for r in rows]
    assert len(got) == len(want) and sorted(str(tuple(r)) for r in X.digest_columns(X.repeated(X.planted(odd_docs.filter("doc_id <> 6 or doc_id is null")))).collect()) == sorted(map(str, want))
    assert X.repeated(no_docs).count() == 0 and X.digest_columns(X.repeated(X.planted(no_docs))).count() == 0
