import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from inkstone.llm import quality as X
from tests.llm.conftest import extras_kept


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    in_repeat = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    failed = len(words) < 20 or 100 * len(in_repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(in_repeat), failed


def test_base_equals_brute_force(texts):
    judge = X.Judge(X.Bands())
    r = random.Random(1)
    odd = [None, "", " \x0b\x1c\xa0 ", "a\n\na\n a\na", *[" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(200)]]
    for t in [*list(texts.values())[:80], *odd]:
        assert judge(t)[:6] == brute(t)


def test_bands_reject_repetition_and_noise_and_keep_prose(documents, texts):
    judge = X.Judge(X.Bands())
    r = random.Random(3)
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(12)) for _ in range(900))
    varied = "\n".join(f"row {i} of the same {i} kind of {i} line" for i in range(300))
    assert not judge(noise)[6] and not judge(varied)[6] and not judge(varied)[5]
    assert judge("too short")[5] and not judge("too short")[6]


def random_words(r, n, width=12):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(width)) for _ in range(n // (width + 1) + 1))[:n]


def test_short_random_texts_are_rejected():
    judge, r = X.Judge(X.Bands()), random.Random(4)
    for n in (300, 600, 800, 1200, 2000, 3000, 4000):
        for _ in range(10):
            assert judge(random_words(r, n))[5:7] == (False, False)
    for _ in range(10):
        assert judge(random_words(r, 230, 10))[5:7] == (False, False)


def test_random_parts_of_long_texts_are_rejected(documents, data):
    judge, r = X.Judge(X.Bands()), random.Random(5)
    labels = documents.sparkSession.read.parquet(f"{data}/labels.parquet").filter("quality = 1")
    clean = [x["text"] for x in documents.join(labels, "doc_id").orderBy("doc_id").collect()]
    prose = max(clean, key=len)
    assert judge(prose)[6] and not judge(prose + " " + random_words(r, len(prose) * 3 // 4))[6]
    assert not judge(prose[:2048] + random_words(r, 900))[6]


def test_clean_documents_are_kept(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    good = X.judged(docs).join(labels.filter("quality = 1"), "doc_id")
    assert good.filter("NOT kept AND NOT base_failed").isEmpty()
    assert X.filtered(docs).count() == X.judged(docs).filter("kept").count()


def test_odd_and_empty_tables(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in X.judged(odd_docs).collect()}
    assert all(rows[i]["base_failed"] and not rows[i]["kept"] for i in (0, 1, 2, 3))
    assert X.judged(odd_docs).count() == odd_docs.count() and X.judged(no_docs).count() == 0
    assert X.filtered(odd_docs).columns == odd_docs.columns and extras_kept(X.filtered(odd_docs)) and X.filtered(no_docs).count() == 0


def verdict(text):
    """The verdict by the definition: words, repeats, the whole text's band, and nine tenths of the bytes in chunks inside theirs."""
    data = (text or "").encode()
    z = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    within = lambda part, table: (lambda r, row: row[1] <= r <= row[2])(len(z.compress(part)) / len(part), max(x for x in table if x[0] <= len(part)))
    if brute(text)[5] or not within(data, X.Bands().whole):
        return False
    cuts = list(range(0, len(data), 2048))
    if len(cuts) > 1 and len(data) - cuts[-1] < 256:
        cuts.pop()
    parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    return sum(len(x) for x in parts if within(x, X.Bands().chunk)) >= 0.9 * len(data)


def test_verdict_equals_definition(documents, texts):
    r = random.Random(8)
    made = [" ".join(r.choice(["ab", "cde", "x9Kq2", "the", "word"]) for _ in range(r.randint(15, 900))) for _ in range(150)]
    made += [random_words(r, r.randint(100, 5000), r.randint(4, 20)) for _ in range(100)]
    prose = max(texts.values(), key=len)
    made += [prose[: r.randint(50, 9000)] + random_words(r, r.randint(1, 900)) for _ in range(100)]
    table = documents.sparkSession.createDataFrame(list(enumerate([*made, *texts.values()])), "doc_id long, text string")
    got = {x["doc_id"]: x["kept"] for x in X.judged(table).collect()}
    want = {i: verdict(t) for i, t in enumerate([*made, *texts.values()])}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_short_texts_and_tails_have_bands():
    judge, r = X.Judge(X.Bands()), random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    for n in (200, 239, 255):
        words = ["".join(r.choice(alphabet) for _ in range(9)) for _ in range(40)]
        assert judge(" ".join(words)[:n])[5:7] == (False, False)
    assert not judge(("buy now " * 3 + "cheap ") * 8)[6]
    assert all(low > 0 and high < 2 for low, high in (X.limits(t, n) for t in (X.Bands().whole, X.Bands().chunk) for n in range(1, 4000)))


@pytest.mark.parametrize("n,least", [(0, 0.40), (255, 0.40), (256, 0.40), (70000, 0.20)])
def test_limits_by_length(n, least):
    assert X.limits(X.Bands().whole, n)[0] == least
