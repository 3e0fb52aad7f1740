"""Lemmas by a dictionary: against a plain lookup, word by word."""

import random
import zipfile

import pytest

from inkstone.operators import lemmas as L
from inkstone.sources import tables as IO

INDEX = """  1 This text begins with a blank and is no entry.
  2 Nor is this.
bus n 4 5 @ ~ #p %p + 4 1 04146050
dog n 7 5 @ ~ #m #p %p 7 1 02084071
church n 3 4 @ ~ %p + 3 2 08081668
goose n 3 2 @ ~ 3 0 01855672
leaf n 3 4 @ ~ #p %p 3 2 13152742
man n 11 5 @ ~ #m %p + 11 5 10287213
fly n 5 4 @ ~ %p + 5 1 02190166
glass n 7 5 @ ~ %p + ; 7 3 14881303
glasses n 1 2 @ %p 1 0 04272054
as n 3 2 @ ~ 3 0 14660443
ax n 1 2 @ ~ 1 0 02764044
axis n 6 3 @ ~ %p 6 0 08378555
ss n 1 1 @ 1 0 08210670
s n 1 1 @ 1 0 00000001
ice_cream n 1 3 @ ~ #p 1 0 07614500
"""
EXCEPTIONS = "geese goose\naxes ax axis\nmen man\noddity unknown\nchildren child\n"
NOUNS = {line.split()[0] for line in INDEX.split("\n") if line and not line.startswith(" ")}
ODD = {line.split()[0]: line.split()[1:] for line in EXCEPTIONS.split("\n") if line}


def plainly(word):
    known = lambda forms: [f for f in dict.fromkeys(forms) if f in NOUNS]
    if word in ODD:
        found = known([word, *ODD[word]])
        return min(found, key=len) if found else word
    forms, first = [word], True
    while forms:
        forms = [f[: -len(old)] + new for f in forms for old, new in L.ENDINGS if f.endswith(old)]
        found = known([word, *forms] if first else forms)
        first = False
        if found:
            return min(found, key=len)
    return word


@pytest.fixture(scope="module")
def dictionary(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nouns")
    (folder / "index.noun").write_text(INDEX)
    (folder / "noun.exc").write_text(EXCEPTIONS)
    return L.noun_dictionary(spark, str(folder)), str(folder)


def test_lemmas_equal_a_plain_lookup(spark, dictionary):
    rng = random.Random(2)
    words = {"dogs", "buses", "churches", "geese", "leaves", "women", "men", "flies", "glasses", "axes", "oddity", "ass", "asses", "asss", "busess", "dogss", "children", "ice_cream", "x", "zzz", "sss", "ssssss", "axis"}
    words |= {rng.choice(sorted(NOUNS)) + rng.choice(["", "s", "es", "ses", "ss", "ies", "ves", "men"]) for _ in range(200)}
    rows = spark.createDataFrame([(w,) for w in words] + [("dogs",), (None,)], "token string")
    got = {r["token"]: r["lemma"] for r in L.lemmas(rows, dictionary[0]).collect()}
    assert got == {w: plainly(w) for w in words if plainly(w) != w and "_" not in w}
    assert got["dogs"] == "dog" and got["axes"] == "ax" and "children" not in got


def test_tokens_get_lemmas_and_lose_repeats_and_stop_words(spark, dictionary):
    words = ["dogs", "dog", "run", "geese", "flies", "fly", "men", "end"]
    tokens = spark.createDataFrame([(7, len(words), k, w, None) for k, w in enumerate(words)] + [(8, 1, 0, "men", None)], "doc_id long, n int, pos int, token string, next string")
    out = [tuple(r) for r in L.lemmatized(tokens, dictionary[0], ["man"]).orderBy("doc_id", "pos").collect()]
    assert out == [(7, 5, 0, "dog", "run"), (7, 5, 1, "run", "goose"), (7, 5, 2, "goose", "fly"), (7, 5, 3, "fly", "end"), (7, 5, 4, "end", None)]


def test_a_run_takes_a_dictionary(spark, dictionary):
    from inkstone import workflow as W

    docs = spark.createDataFrame([(k, "dogs and geese and churches stand by buses " * 3) for k in range(4)], "doc_id long, text string")
    base = W.Config(learned_phrases=False, chunk_size=100, min_tail=10)
    terms = lambda c: set(W.represent(docs, c).terms)
    assert {"geese", "buse"} & terms(base) and {"dog", "goose", "church", "bus"} <= terms(W.replace(base, lemma_dictionary=dictionary[1]))


def test_code_digests_from_folders_and_archives(tmp_path, monkeypatch):
    import sys

    (tmp_path / "plain" / "packed_code").mkdir(parents=True)
    (tmp_path / "plain" / "packed_code" / "__init__.py").write_text("x = 1\n")
    with zipfile.ZipFile(tmp_path / "code.zip", "w") as z:
        z.writestr("packed_code/__init__.py", "x = 1\n")
    found = []
    for place in (tmp_path / "plain", tmp_path / "code.zip"):
        monkeypatch.syspath_prepend(str(place))
        sys.modules.pop("packed_code", None)
        found.append(IO.code_digest("packed_code"))
        monkeypatch.undo()
    sys.modules.pop("packed_code", None)
    assert found[0] == found[1] and len(IO.code_digest()) == 64
