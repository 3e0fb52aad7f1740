"""Greedy modularity communities against merging by full modularities."""

import itertools
import random

import pytest

from inkstone.operators.vocabulary import greedy_communities


def modularity(groups, edges):
    """Its definition: weight inside groups less what degrees make due."""
    total = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0.0) + w
        degree[b] = degree.get(b, 0.0) + w
    inside = sum(w for a, b, w in edges for g in groups if a in g and b in g)
    return inside / total - sum((sum(degree[n] for n in g) / (2 * total)) ** 2 for g in groups)


def plainly(edges):
    """At each step all pairs of groups are tried, and the whole modularity is worked out."""
    groups = [frozenset((n,)) for n in sorted({n for a, b, _ in edges for n in (a, b)})]
    while True:
        now = modularity(groups, edges)
        tries = []
        for x, y in itertools.combinations(groups, 2):
            if any((a in x and b in y) or (a in y and b in x) for a, b, _ in edges):
                rest = [g for g in groups if g not in (x, y)]
                tries.append((modularity([*rest, x | y], edges) - now, x, y))
        best = max((g for g, *_ in tries), default=0.0)
        if best <= 1e-12:
            return {frozenset(g) for g in groups}, now
        ties = [(x, y) for g, x, y in tries if g > best - 1e-12]
        if len(ties) > 1:
            return None, None  # merges of one gain: any order is right
        groups = [g for g in groups if g not in ties[0]] + [ties[0][0] | ties[0][1]]


@pytest.mark.parametrize("seed", range(40))
def test_groups_equal_exhaustive_merging(seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(rng.randint(3, 9))]
    pairs = [p for p in itertools.combinations(names, 2) if rng.random() < 0.5] or [("n0", "n1")]
    edges = [(a, b, round(rng.random() + 0.05, 6)) for a, b in pairs]
    found = greedy_communities(edges)
    groups = {frozenset(n for n, g in found.items() if g == k) for k in set(found.values())}
    want, _ = plainly(edges)
    if want is not None:
        assert groups == want
    sizes = [sum(g == k for g in found.values()) for k in sorted(set(found.values()))]
    assert sizes == sorted(sizes, reverse=True) and set(found) == {n for e in edges for n in e[:2]}


def test_no_merge_raises_the_result():
    rng = random.Random(7)
    edges = [(f"n{a}", f"n{b}", 1.0 + (a // 4 == b // 4) * 5 + rng.random() / 100) for a, b in itertools.combinations(range(12), 2)]
    found = greedy_communities(edges)
    assert len(set(found.values())) == 3 and all(len({found[f"n{k}"] for k in range(4 * g, 4 * g + 4)}) == 1 for g in range(3))
