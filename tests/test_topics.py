from inkstone.plans import catalog

catalog.load()


def test_coherence_scores_every_topic(spark, data):
    topics = {r["topic"] for r in catalog.phi(spark, data).select("topic").distinct().collect()}
    got = catalog.QUERIES["topic_coherence"](spark, data).collect()
    assert len(topics) > 4 and sorted(r["topic"] for r in got) == sorted(topics)
    assert all(-1 <= r["c_npmi"] <= 1 and r["c_v"] <= 1 for r in got)
