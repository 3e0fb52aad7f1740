"""The concept graph's checks: none fails on a sound graph, and each finds its own fault."""

import pytest
from pyspark.sql import functions as F

from inkstone.operators import graph as H

CONCEPTS = H.Concepts(
    threats=[H.Threat("TA", "a", "L1", "S1", ["I1"]), H.Threat("TB", "b", "LH", "S1", ["I1", "I2"])], layers=[("L1", "one"), ("LH", "hub")], signals=[("S1", "s")],
    interventions=[("I1", "i"), ("I2", "j")], hub="LH", topics=[("T1", "x", 70.0, 2), ("T2", "y", 30.0, 1), ("T3", "z", 0.0, 0)],
)


@pytest.fixture(scope="module")
def graph(spark):
    scored = spark.createDataFrame([(1, "high", 10, 6, 4), (2, "context", 3, 3, 0)], "doc_id long, relevance string, total long, n_p long, n_q long")
    matches = spark.createDataFrame([(1, 1, "TA", 5), (1, 2, "TB", 2), (2, 1, "TB", 1)], "doc_id long, rank int, group string, n long")
    decisions = spark.createDataFrame([("T1", "TA", True, "q", "1; 2"), ("T2", "TB", True, "", "1"), ("T2", "TA", False, "", "")], "topic string, target string, retained boolean, qualifiers string, doc_ids string")
    nodes, edges = map(H.checkpointed, H.concept_graph(scored, matches, ["p", "q"], CONCEPTS, decisions))
    return nodes, edges, decisions, scored.select("doc_id")


def failing(nodes, edges, decisions, expected):
    rows = H.concept_validation(nodes, edges, CONCEPTS, decisions, expected, ["p", "q"], ["T3"]).collect()
    assert len({r["check"] for r in rows}) == len(rows) == 43
    return {r["check"] for r in rows if r["failures"]}


def test_a_sound_graph_passes(graph):
    assert failing(*graph) == set()
    nodes, edges, *_ = graph
    got = {r["threat"]: tuple(r) for r in H.threat_matrix(edges, CONCEPTS).collect()}
    assert got == {"a": ("a", "one", "s", "i", 2, "T1"), "b": ("b", "hub", "s", "i; j", 2, "T2")}
    assert {r["relation"]: r["n"] for r in H.histogram(edges, "relation").collect()} == {
        "threat-operates-through-layer": 2, "modelled-by-signal": 2, "intervention-point": 3, "feeds-detection-and-intervention": 1, "analytical-signal": 1, "converted-into-control": 2,
        "topic-threat": 2, "document-supports-evidence-dimension": 3, "document-keyword-matches-threat": 3, "high-score-keyword-anchor": 1,
    }


#: For each check an edge that breaks it.
FAULTS = [
    ("no edge is a loop", "LH", "LH", "feeds-detection-and-intervention", H.FIXED),
    ("edges end at nodes", "DOC_1", "GONE", "document-keyword-matches-threat", H.RULE),
    ("relations join their types", "DOC_1", "S1", "modelled-by-signal", H.RULE),
    ("origins are known", "DOC_1", "DIM_q", "unheard-of", "nobody"),
    ("topic-threat edges are approved", "T1", "TB", "topic-threat", H.REVIEWED),
    ("topic-threat edges are reviewed", "T1", "TB", "topic-threat", H.RULE),
    ("reviewed edges join topics to threats", "DOC_1", "TA", "document-keyword-matches-threat", H.REVIEWED),
    ("excluded pairs are no edges", "T2", "TA", "topic-threat", H.REVIEWED),
    ("excluded pairs are no edges the other way", "TA", "T2", "topic-threat", H.FIXED),
    ("no edge ends at a topic", "DOC_1", "T1", "topic-threat", H.RULE),
    ("topics reach threats only", "T1", "L1", "topic-threat", H.RULE),
    ("no edge joins document and topic", "T1", "DOC_1", "topic-threat", H.RULE),
    ("reviewed edges name documents", "T1", "TB", "topic-threat", H.REVIEWED),
    ("keyword edges start at documents", "L1", "TA", "document-keyword-matches-threat", H.RULE),
    ("rule edges touch documents", "L1", "LH", "again", H.RULE),
    ("fixed edges touch neither topics nor documents", "DOC_2", "TA", "modelled-by-signal", H.FIXED),
    ("several relations of a pair are a match and its anchor", "TA", "L1", "also", H.FIXED),
    ("anchors are best matches", "DOC_2", "TA", "high-score-keyword-anchor", H.RULE),
    ("fixed edges follow the definitions", "TA", "I2", "intervention-point", H.FIXED),
    ("topics have as many links as approved", "T3", "TA", "topic-threat", H.REVIEWED),
    ("only these topics stand alone", "T3", "TA", "topic-threat", H.REVIEWED),
]


def test_edges_too_many_are_found(spark, graph):
    nodes, edges, decisions, expected = graph
    more = spark.createDataFrame([(s, t, r, o, 1.0, "", None, None) for _, s, t, r, o in FAULTS], "source string, target string, relation string, origin string, weight double, evidence string, doc_ids string, qualifiers string")
    assert {check for check, *_ in FAULTS} <= failing(nodes, edges.unionByName(more, allowMissingColumns=True), decisions, expected)


def test_missing_edges_and_wrong_values_are_found(spark, graph):
    nodes, edges, decisions, expected = graph
    fewer = edges.filter("source <> 'T1' AND relation <> 'analytical-signal' AND NOT (source = 'DOC_2' AND relation = 'document-keyword-matches-threat')")
    assert {"approved pairs are edges", "every definition is an edge", "documents match one to three threats"} <= failing(nodes, fewer, decisions, expected.filter("doc_id = 1"))
    twice = edges.unionByName(edges.filter("source = 'T1'")).withColumns({"weight": F.lit(0.0), "qualifiers": F.lit("no"), "doc_ids": F.lit("1; 77")})
    wrong = {"edge keys are unique", "approved pairs are edges once", "weights are positive", "qualifiers are those of the decisions", "reviewed edges name known documents", "no pair is approved and excluded"}
    assert wrong <= failing(nodes, twice, decisions.union(decisions.withColumn("retained", ~F.col("retained"))), expected)
    other = nodes.withColumns({"prevalence": F.col("prevalence") / 2, "label": F.lit(" ")})
    assert {"topics' prevalence adds up to a hundred", "nodes have labels", "documents are all expected", "edges state their origin"} <= failing(other, edges.withColumn("origin", F.lit("")), decisions, expected.filter("doc_id = 1"))
    renamed = nodes.filter("type = 'document'").unionByName(nodes.filter("type <> 'document'").withColumn("id", F.concat("id", F.lit("x")))).unionByName(nodes.filter("id = 'DOC_1'"))
    due = {f"{kind} nodes are those defined" for kind in ("threat", "layer", "signal", "intervention", "dimension", "topic")} | {"node ids are unique", "no document is missing"}
    assert due <= failing(renamed, edges, decisions, spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"))


def test_exports_are_compared(graph):
    nodes, edges, *_ = graph
    sound = H.export_validation(nodes, edges, nodes, edges, "csv").collect()
    assert len(sound) == 11 and not any(r["failures"] for r in sound)
    found = {r["check"]: r["failures"] for r in H.export_validation(nodes, edges, nodes.filter("id <> 'I1'"), edges.union(edges.limit(1)), "csv").collect()}
    assert found["csv: nodes agree"] == found["csv: edges agree"] == found["csv: edge keys are unique"] == 1
