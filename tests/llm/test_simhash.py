import itertools
import random
import re

import numpy as np
import xxhash

from inkstone.llm import simhash as S


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, distance=3):
    """Brute-force components: fingerprint -> smallest index reachable."""
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= distance and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def test_fingerprints_equal_brute_force(texts):
    odd = ["", None, "A b", "É É É", "a\x0bb\x1cc\xa0d", "Ab " * 5000]
    for t in [*list(texts.values())[:60], *odd]:
        assert S.fingerprint(t) == brute(t)


def test_thresholds_leave_no_pair_out():
    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < rng.random(64)
    both = (bits.T.astype(float) @ bits).astype(float)
    for n in (10, 10_000, 10_000_000, 10**11):
        chosen = S.plan(n, both)
        taken = [b for g, _ in chosen for b in g]
        assert len(taken) == len(set(taken))
        assert sum(t + 1 for _, t in chosen) == S.DISTANCE + 1  # the pigeonhole condition
        masks = S.masks(chosen)
        for _ in range(300):
            flipped = sum(1 << int(b) for b in rng.choice(64, S.DISTANCE, replace=False))
            assert any(not flipped & m for _, m in masks)


def test_components_equal_brute_force(spark, documents, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(documents).collect()}
    ids = sorted(texts)
    fps = [brute(texts[i]) for i in ids]
    want = roots(fps)
    assert got == {d: (f"{f:016x}", ids[w]) for d, f, w in zip(ids, fps, want, strict=True)}


def test_links_in_a_crowd_equal_brute_force(spark):
    """Many fingerprints around a few centres, in blocks far smaller than their groups."""
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = set()
    while len(fps) < 700:
        f = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 9)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=32).collect()
    index = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        x, y = sorted((find(index[e["a"]]), find(index[e["b"]])))
        parent[y] = x
    assert [find(i) for i in range(len(fps))] == roots(fps)


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = {r["doc_id"]: r for r in rows if r["doc_id"] in (0, 1, 2)}
    assert {(r["fingerprint"], r["component_id"]) for r in blank.values()} == {("0" * 16, 0)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_first(no_docs).count() == 0


def test_one_row_of_each_component_stays(odd_docs):
    kept = S.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    assert got == sorted([(False, 0), *[(True, i) for i in (0, 3, 5, 6, 7, 8, 9, 10)]])
