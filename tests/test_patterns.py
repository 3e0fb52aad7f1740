"""Rules of several patterns: against trying every pattern on every page."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.operators import patterns as X

KNOWN = {
    r"significant public distrust": ("significant public distrust",),
    r"fraud and\s+cybercrime": ("cybercrime",),
    r"(?:cat|dogs)\b": ("cat", "dogs"),
    r"colou?rs": ("colo",),
    r"ab+cdef": ("bcdef",),
    r"(money)?laundering": ("laundering",),
    r"(ponzi){2,}x": ("ponzi",),
    r"one|two|\d+": None,
    r"\d{4}": None,
    r"[abc]def[^]x]ghij": ("ghij",),
    r"a\.b\.c": ("a.b.c",),
    r"(?=look)ahead": ("ahead",),
    r"(?!never)": None,
    r"(?<name>word)s?": ("word",),
    r"(?i)flag": None,
    r"\Qquoted\E": None,
    r"naïve approach": ("ve approach",),
    r"ab": None,
    r"": None,
    r"(": None,
    r"x)": None,
    r"WORD": ("word",),
}


@pytest.mark.parametrize("pattern", KNOWN)
def test_needed_strings(pattern):
    assert X.needed_strings(pattern) == KNOWN[pattern]


ATOM = st.one_of(st.sampled_from(["a", "b", "ab", "abc", "B", r"\.", ".", r"\w", "[ab]", "[^c]", " ", r"\s", "^", "$"]))
PART = st.recursive(ATOM, lambda x: st.one_of(st.builds("({})".format, x), st.builds("(?:{}|{})".format, x, x), st.builds("{}{}".format, x, x), st.builds("(?:{}){}".format, x, st.sampled_from(["?", "*", "+", "{2}", "{0,1}", "+?"]))), max_leaves=8)


@given(PART, st.text("abcAB. ", max_size=14))
@settings(max_examples=600, deadline=None)
def test_a_match_holds_a_needed_string(pattern, text):
    least, X.LEAST = X.LEAST, 1
    needs = X.needed_strings(pattern)
    X.LEAST = least
    if needs is not None and re.search(pattern, text, re.I | re.A):
        assert any(s in text.lower() for s in needs)


RULES = {
    "phrase": [r"significant\s+public distrust"], "both": [r"ponzi", r"scheme\b"], "branches": [r"(?:hacking|phishing) and", r"\bfraud"], "free": [r"\d{2}"],
    "mixed": [r"\d{2}", r"fraud"], "empty": [], "never": [r"absent words"], "odd": [r"(?i)ponzi"],
}
PAGES = [
    (1, 1, "A PONZI\n\n scheme of 20 tricks"), (1, 2, "ponzi schemes"), (1, 3, None), (2, 1, "significant \t public\ndistrust, phishing  and\nFraud 7"), (2, 2, ""), (3, 1, "hacking and frau d 99 fraud"), (3, 1, "hacking and frau d 99 fraud"),
    (4, 1, "x" * 100_000 + " ponzi " + "y" * 100_000 + " scheme"),
]


def plainly(text, patterns):
    flat = re.sub(r"\s+", " ", text or "")
    return [bool(re.search(p.removeprefix("(?i)"), flat, re.I | re.A)) for p in patterns]


def test_conjunctions_equal_every_pattern_on_every_page(spark):
    pages = spark.createDataFrame(PAGES, "doc_id long, page long, text string")
    got = sorted(map(tuple, X.conjunctions(pages, RULES, ["doc_id", "page"]).collect()))
    assert got == sorted((r, d, p) for r, ps in RULES.items() for d, p, t in PAGES if all(plainly(t, ps)))
    assert X.conjunctions(pages, {}).count() == 0 and X.conjunctions(pages.limit(0), RULES, ["doc_id", "page"]).count() == 0


def test_only_pages_with_the_strings_are_tried(spark):
    pages = spark.createDataFrame(PAGES, "doc_id long, page long, text string")
    met = {(r["doc_id"], r["page"]): r["rules"] for r in X.candidates(pages, {k: RULES[k] for k in ("phrase", "both", "never")}, ["doc_id", "page"]).collect()}
    assert met == {(1, 1): [1], (1, 2): [1], (2, 1): [0], (4, 1): [1]}  # "scheme" stands in "schemes" too


def test_cited_pages(spark):
    pages = spark.createDataFrame(PAGES[:6], "doc_id long, page long, text string")
    targets = [("a", 1, 1, ["ponzi", r"\d+ tricks"]), ("b", 1, 2, ["ponzi", "trick"]), ("c", 9, 9, ["x"]), ("d", 1, 3, []), ("e", 1, 1, ["scheme"])]
    out = X.cited(pages, spark.createDataFrame(targets, "target string, doc_id long, page long, patterns array<string>"), ["doc_id", "page"])
    assert {r["target"]: (r["hits"], r["all_found"]) for r in out.collect()} == {"a": ([True, True], True), "b": ([True, False], False), "c": ([False], False), "d": ([], True), "e": ([True], True)}
    assert out.select(F.count_if("all_found")).first()[0] == 3


@pytest.mark.parametrize(("pattern", "text"), [(r"\bund\b", "undöschpf"), (r"\bund\b", "rund"), (r"\bund\b", "éund"), (r"\Bund", "éund"), (r"a\\\\b", r"ca\\b"), (r"\bé", "é"), (r"\d\b\b.", "5ß")])
def test_word_edges_are_those_of_ascii(spark, pattern, text):
    """As in SQL's engine, where letters beyond ASCII are no parts of words."""
    want = bool(re.search(pattern, text, re.I | re.A))
    pages = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert X.conjunctions(pages, {"r": [pattern]}).count() == want
    assert X.cited(pages, spark.createDataFrame([(1, 1, [pattern])], "target int, doc_id long, patterns array<string>")).first()["hits"] == [want]
