import zlib

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import langid as X


def test_gradients_equal_differences():
    s = X.Settings(window=8, dims=2, widths=(2, 3), filters=2)
    net = X.Network(["a", "b"], s)
    for k in ("emb", "conv", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(3)
    rows, labels, weights = rng.integers(1, 9, (5, 8)).astype(np.uint8), np.array([0, 1, 0, 1, 1]), np.ones(5)

    def loss():
        z = net.pooled(rows) @ net.out + net.out_bias
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -z[np.arange(5), labels].mean()

    found = net._gradients(rows, labels, weights)
    for name, at in (("conv", (0, 1)), ("emb", (3, 1)), ("emb", (5, 0)), ("out", (2, 1)), ("bias", (1,)), ("out_bias", (0,))):
        v = getattr(net, name)
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        assert np.isclose((up - loss()) / 2e-6, found[name][at], atol=1e-4)
        v[at] += 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    net = X.trained(docs.filter(~held).select("text", "lang"))
    truth = {r["doc_id"]: r["lang"] for r in docs.filter(held).collect()}
    rows = [r for r in X.predicted(docs, net).collect() if r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_odd_and_empty_tables(odd_docs, no_docs, spark):
    net = X.trained(spark.createDataFrame([("the the the " * 20, "en"), ("les les les " * 20, "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    rows = {r["doc_id"]: r for r in X.predicted(odd_docs, net).collect()}
    assert {rows[i]["lang_pred"] for i in (0, 1, 2)} == {"und"} and {r["lang_pred"] for r in rows.values()} <= {"en", "fr", "und"}
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and X.predicted(odd_docs, net).count() == odd_docs.count()
    assert X.predicted(no_docs, net).count() == 0
    none = X.trained(no_docs.select("text", "lang"))
    assert {r["lang_pred"] for r in X.predicted(odd_docs, none).collect()} == {"und"}


def test_whole_text_counts(spark):
    net = X.trained(spark.createDataFrame([("the thing is that " * 30, "en"), ("der und die das ist " * 30, "de")], "text string, lang string"))
    text = "the thing is that " * 5 + "der und die das ist " * 400
    got = X.predicted(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert got["lang_pred"] == "de"


def test_sample_takes_distinct_texts(spark):
    rows = [("ein und derselbe Text", "de")] * 3000 + [(f"Text nummer {i} von vielen", "de") for i in range(1500)] + [(f"text number {i}", "en") for i in range(40)] + [("12 34", "en")]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = X.sample(table).collect()
    assert sorted(r["lang"] for r in got) == ["de"] * 300 + ["en"] * 40 and len({(r["lang"], r["h"]) for r in got}) == 340
    h = {t: r for t, r in table.select("text", F.xxhash64("text")).distinct().collect()}
    low = sorted((h[t] % (1 << 30), h[t]) for t, lang in set(rows) if lang == "de")[:300]
    assert {r["h"] for r in got if r["lang"] == "de"} == {x for _, x in low}
    cut = X.windows_of("text number 7", 96)
    assert next(bytes(r["windows"]) for r in got if r["h"] == h["text number 7"]) == cut.tobytes()


def test_only_letters_make_a_text_known(spark):
    net = X.trained(spark.createDataFrame([("the the the " * 20, "en"), ("les les les " * 20, "fr")], "text string, lang string"))
    table = spark.createDataFrame(list(enumerate(["½ ² ٣ 12 _", "Ⅷ", "a", "語"])), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"] == "und", r["score"] == 0) for r in X.predicted(table, net).collect()}
    assert got == {0: (True, True), 1: (True, True), 2: (False, False), 3: (False, False)}


def test_forward_pass_equals_plain_loops(spark, documents):
    net = X.trained(documents.select("text", "lang"), X.Settings(epochs=1, texts_per_lang=20))
    s = net.s
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in X.predicted(documents, net).collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents.orderBy(F.length("text")).collect() if r["text"] and r["doc_id"] % 9 == 0][:12]
    for doc_id, text in texts:
        data = text.lower().encode()
        total, weight = np.zeros(len(net.langs)), 0.0
        for k in range(0, len(data), s.window):
            window = list(data[k : k + s.window])
            near = [0.0] * (s.filters * len(s.widths))
            padded = window + [0] * (s.window - len(window) + max(s.widths))
            for f in range(len(near)):
                width = s.widths[f // s.filters]
                best = max(sum(float(net.emb[padded[at + j]][d]) * float(net.conv[j * s.dims + d, f]) for j in range(width) for d in range(s.dims)) for at in range(s.window))
                near[f] = max(0.0, best + float(net.bias[f]))
            z = np.array([sum(near[f] * float(net.out[f, y]) for f in range(len(near))) + float(net.out_bias[y]) for y in range(len(net.langs))])
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            letters = sum(b >= 97 and b != 127 for b in window) + 1e-3
            total, weight = total + p * letters, weight + letters
        mean = total / weight
        assert rows[doc_id][0] == net.langs[int(mean.argmax())] and np.isclose(rows[doc_id][1], mean.max(), atol=1e-4)
