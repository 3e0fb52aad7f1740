"""Typed evidence graphs: building, merging reviewed edges, checks, components.

Nodes are rows (id, label, type, detail), edges rows (source, target, relation,
origin, weight, evidence). A graph is a directed multigraph keyed by source,
target and relation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import measures as M
from inkstone.functions import text as T
from inkstone.storage import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the pairs.

    Each round every node takes the least label around it, then its label's label; the rounds are checkpointed and
    end when no label changes. Aggregations combine before they shuffle, so a hub costs a row for each task."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = checkpointed(both.union(both.select("v", "u")).distinct())
    labels = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("n"))
        low = labels.join(near, "u").select("u", "c", F.least("c", "n").alias("n"))
        jump = low.join(labels.select(F.col("u").alias("n"), F.col("c").alias("j")), "n", "left").select("u", "c", F.coalesce(F.least("n", "j"), "n").alias("n"))
        new = checkpointed(jump)
        if new.filter("n <> c").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        labels = new.select("u", F.col("n").alias("c"))


# --- building ---------------------------------------------------------------------------------


def keyword_matches(docs: DataFrame, groups: Mapping[str, Sequence[str]], text: Column) -> DataFrame:
    """(doc_id, group, n): occurrences, inside words too, of each group's keywords in a text."""
    counts = [F.struct(F.lit(g).alias("group"), sum((T.substring_count(F.col("__low"), k) for k in keys), F.lit(0)).alias("n")) for g, keys in groups.items()]
    return docs.select("doc_id", F.lower(text).alias("__low")).select("doc_id", F.explode(F.filter(F.array(*counts), lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.*")


def top_groups(docs: DataFrame, matches: DataFrame, dimensions: Sequence[tuple[str, str]], limit: int = 3) -> DataFrame:
    """(doc_id, rank, group, n): the best-matched groups of each document, ties by name; a document without a match
    gets the group that stands for its largest dimension. ``dimensions``: (column of ``docs``, group), the first of
    equal ones wins."""
    packed = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "group"))).alias("g"))
    largest = F.greatest(*[F.col(c) for c, _ in dimensions], F.lit(0))
    fallback = None
    for c, g in dimensions:
        fallback = F.when(F.col(c) == largest, g) if fallback is None else fallback.when(F.col(c) == largest, g)
    rows = docs.join(packed, "doc_id", "left")
    alone = F.array(F.struct(F.lit(-1).alias("m"), fallback.alias("group")))
    chosen = F.coalesce(F.slice("g", 1, limit), alone.cast("array<struct<m: bigint, group: string>>"))
    return rows.select("doc_id", F.posexplode(chosen).alias("r", "x")).select("doc_id", (F.col("r") + 1).alias("rank"), "x.group", (-F.col("x.m")).alias("n"))


def node_rows(rows: DataFrame, id_: Column, label: Column, type_: str, detail: Column | None = None) -> DataFrame:
    return rows.select(id_.cast("string").alias("id"), label.cast("string").alias("label"), F.lit(type_).alias("type"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def edge_rows(rows: DataFrame, source: Column, target: Column, relation: str, origin: str, weight: Column, evidence: Column | None = None) -> DataFrame:
    return rows.select(
        source.cast("string").alias("source"), target.cast("string").alias("target"), F.lit(relation).alias("relation"), F.lit(origin).alias("origin"),
        F.round(weight, 4).alias("weight"), (evidence if evidence is not None else F.lit("")).cast("string").alias("evidence"),
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several frames with unlike columns, absent ones null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def evidence_graph(scored: DataFrame, groups: DataFrame, lexicon: Mapping[str, Sequence[str]], anchor_share: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from scored documents and their groups (``top_groups``): categories, their terms, groups and
    documents; documents of at least ``anchor_share`` of the largest score are anchored to their best group."""
    spark = scored.sparkSession
    cats = spark.createDataFrame([(c,) for c in lexicon], "c string")
    terms = spark.createDataFrame([(c, t) for c, ts in lexicon.items() for t in ts], "c string, t string")
    doc = F.concat(F.lit("DOC_"), F.col("doc_id").cast("string"))
    cat, term, group = F.concat(F.lit("CAT_"), F.upper("c")), F.concat(F.lit("TERM_"), T.slug(F.col("t"))), F.concat(F.lit("GRP_"), F.upper("group"))
    nodes = union_all([
        node_rows(cats, cat, F.col("c"), "category"), node_rows(terms, term, F.col("t"), "term").distinct(),
        node_rows(groups.select("group").distinct(), group, F.col("group"), "group"), node_rows(scored, doc, doc, "document", F.col("relevance")),
    ])
    top = scored.agg(F.greatest(F.max("total"), F.lit(1)).alias("t")).first()["t"] or 1
    best = groups.agg(F.max("n")).first()[0] or 1
    names = [F.struct(F.lit(c).alias("c"), F.col(f"n_{c}").alias("n")) for c in lexicon]
    hits = scored.select("doc_id", F.explode(F.filter(F.array(*names), lambda x: x["n"] > 0)).alias("x")).select("doc_id", "x.*")
    anchors = scored.filter(F.col("total") >= anchor_share * top).join(groups.filter("rank = 1"), "doc_id")
    edges = union_all([
        edge_rows(terms, term, cat, "member_of", "fixed", F.lit(1.0)),
        edge_rows(hits, doc, cat, "mentions", "rule", 1.0 + F.col("n"), F.col("n")),
        edge_rows(groups, doc, group, "matches", "rule", M.edge_weight(F.col("n"), F.lit(best)), F.col("n")),
        edge_rows(anchors, group, doc, "anchored_by", "rule", F.lit(2.0)),
    ])
    return nodes, edges


def merge_reviewed(rule_edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rule edges replaced by reviewed decisions (source, target, decision, retained): a reviewed edge keeps its place
    if retained and goes if not; edges nobody reviewed stay as they are; loops go."""
    rows = rule_edges.join(decisions.select("source", "target", "decision", "retained"), ["source", "target"], "left")
    origin = F.when(F.col("decision").isNotNull(), "reviewed").otherwise(F.col("origin"))
    return rows.filter("coalesce(retained, true) and source <> target").withColumn("origin", origin).drop("retained")


def classified(rule_edges: DataFrame, strongest: DataFrame, decisions: DataFrame) -> DataFrame:
    """(source, target, verdict): rule edges held against each source's strongest topic and the decisions on it."""
    rows = rule_edges.join(strongest, "source").join(decisions.select("topic", "target", "retained"), ["topic", "target"], "left")
    verdict = F.when(F.col("retained").isNull(), "not reviewed").when(F.col("retained"), "approved").otherwise("rejected")
    return rows.select("source", "target", verdict.alias("verdict"))


def intervention_matrix(edges: DataFrame) -> DataFrame:
    """(group, documents, anchors): for each group how many documents match it, and its anchors' ids in order."""
    matched = edges.filter("relation = 'matches'").groupBy(F.col("target").alias("group")).agg(F.countDistinct("source").alias("documents"))
    anchors = edges.filter("relation = 'anchored_by'").groupBy(F.col("source").alias("group")).agg(F.array_join(F.array_sort(F.collect_set("target")), "; ").alias("anchors"))
    return matched.join(anchors, "group", "left").fillna("", ["anchors"])


# --- checks -----------------------------------------------------------------------------------


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes.join(ends, "id", "left_anti").select("id")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no node."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def duplicate_keys(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "relation").agg(F.count("*").alias("n")).filter("n > 1")


def several_relations(edges: DataFrame) -> DataFrame:
    rows = edges.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.countDistinct("relation").alias("n"))
    return rows.filter("n > 1").drop("n")


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the types of both ends."""
    a = nodes.select(F.col("id").alias("source"), F.col("type").alias("source_type"))
    b = nodes.select(F.col("id").alias("target"), F.col("type").alias("target_type"))
    return edges.join(a, "source", "left").join(b, "target", "left")


def validation(nodes: DataFrame, edges: DataFrame, relations: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(check, failures) for each named invariant; a graph is valid if all are 0. ``relations``: the types that each
    relation may join."""
    typed = typed_edges(nodes, edges)
    allowed = F.lit(False)
    for name, (a, b) in relations.items():
        allowed = allowed | ((F.col("relation") == name) & (F.col("source_type") == a) & (F.col("target_type") == b))
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("failures"))
    return union_all([
        count("node ids are unique", duplicate_ids(nodes)),
        count("nodes have labels", nodes.filter("label IS NULL OR trim(label) = ''")),
        count("edge keys are unique", duplicate_keys(edges)),
        count("no edge is a loop", edges.filter("source = target")),
        count("edges end at nodes", dangling(nodes, edges)),
        count("weights are positive", edges.filter("weight IS NULL OR weight <= 0")),
        count("edges state their origin", edges.filter("origin IS NULL OR origin = ''")),
        count("relations join their types", typed.filter(~F.coalesce(allowed, F.lit(False)))),
    ])


# --- a model of concepts beside the documents -----------------------------------------------------


@dataclass(frozen=True)
class Threat:
    """A threat with the layer it works through, the signal that models it, and its interventions."""

    id: str
    label: str
    layer: str
    signal: str
    interventions: Sequence[str]


@dataclass(frozen=True)
class Concepts:
    """The fixed part of an evidence graph: lists of (id, label) and of threats, all short. ``hub`` is the layer that the
    others feed and that turns signals into interventions; ``topics`` are (id, label, prevalence in percent, documents)."""

    threats: Sequence[Threat]
    layers: Sequence[tuple[str, str]]
    signals: Sequence[tuple[str, str]]
    interventions: Sequence[tuple[str, str]]
    hub: str
    topics: Sequence[tuple[str, str, float, int]] = ()

    def fixed_edges(self) -> list[tuple[str, str, str, float]]:
        out = []
        for t in self.threats:
            out += [(t.id, t.layer, "threat-operates-through-layer", 2.0), (t.id, t.signal, "modelled-by-signal", 2.0)]
            out += [(t.id, i, "intervention-point", 2.0) for i in t.interventions]
        out += [(i, self.hub, "feeds-detection-and-intervention", 1.2) for i, _ in self.layers if i != self.hub]
        out += [(i, self.hub, "analytical-signal", 1.2) for i, _ in self.signals]
        return out + [(self.hub, i, "converted-into-control", 1.0) for i, _ in self.interventions]


#: The types that each relation of a concept graph may join; names of relations, and the weights and the anchor share used
#: here, are fixed values.
CONCEPT_RELATIONS = {
    "topic-threat": ("topic", "threat"), "threat-operates-through-layer": ("threat", "layer"), "modelled-by-signal": ("threat", "signal"),
    "intervention-point": ("threat", "intervention"), "feeds-detection-and-intervention": ("layer", "layer"), "analytical-signal": ("signal", "layer"),
    "converted-into-control": ("layer", "intervention"), "document-supports-evidence-dimension": ("document", "dimension"),
    "document-keyword-matches-threat": ("document", "threat"), "high-score-keyword-anchor": ("document", "threat"),
}
REVIEWED, RULE, FIXED = "reviewed", "rule", "fixed"


def concept_graph(scored: DataFrame, matches: DataFrame, dimensions: Sequence[str], concepts: Concepts, decisions: DataFrame, anchor_share: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type, detail, prevalence, documents, total) and edges (source, target, relation, origin, weight,
    evidence, count, qualifiers, doc_ids) of topics, threats, layers, signals, interventions, dimensions and documents.

    ``scored`` holds doc_id, relevance, total and n_DIMENSION columns, ``matches`` (``top_groups``) the threats of each
    document, ``decisions`` reviewed pairs (topic, target, retained, qualifiers, doc_ids): the retained ones are the only
    edges of topics. A document of at least ``anchor_share`` of the largest total is anchored to its best threat."""
    spark = scored.sparkSession
    kinds = [("threat", [(t.id, t.label) for t in concepts.threats]), ("layer", concepts.layers), ("signal", concepts.signals), ("intervention", concepts.interventions)]
    fixed = [(i, label, kind, "", None, None) for kind, rows in kinds for i, label in rows]
    fixed += [(f"DIM_{d}", d, "dimension", "", None, None) for d in dimensions]
    fixed += [(i, f"{i}: {label}", "topic", "", float(p), int(n)) for i, label, p, n in concepts.topics]
    nodes = spark.createDataFrame(fixed, "id string, label string, type string, detail string, prevalence double, documents long")
    doc = F.concat(F.lit("DOC_"), F.col("doc_id").cast("string"))
    nodes = nodes.unionByName(scored.select(doc.alias("id"), doc.alias("label"), F.lit("document").alias("type"), F.col("relevance").alias("detail"), F.col("total").cast("long").alias("total")), allowMissingColumns=True)
    made = spark.createDataFrame([(s, t, r, FIXED, w, "") for s, t, r, w in concepts.fixed_edges()], "source string, target string, relation string, origin string, weight double, evidence string")
    approved = decisions.filter("retained").select(
        F.col("topic").alias("source"), "target", F.lit("topic-threat").alias("relation"), F.lit(REVIEWED).alias("origin"), F.lit(1.0).alias("weight"),
        F.lit("").alias("evidence"), "qualifiers", "doc_ids",
    )
    largest = F.broadcast(scored.agg(F.greatest(F.max("total"), F.lit(1)).alias("__top"), F.greatest(*[F.max(f"n_{d}") for d in dimensions], F.lit(1)).alias("__dim")))  # one row
    rows = scored.join(largest, F.lit(True))
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"n_{d}").cast("long").alias("n")) for d in dimensions])
    hits = rows.select("doc_id", "__dim", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("x")).select("doc_id", "__dim", "x.*")
    anchors = rows.filter(F.col("total") >= anchor_share * F.col("__top")).join(matches.filter("rank = 1"), "doc_id")
    edge = lambda df, target, relation, weight, evidence, count: df.select(
        doc.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(RULE).alias("origin"), F.round(weight, 4).alias("weight"),
        evidence.cast("string").alias("evidence"), count.cast("long").alias("count"),
    )
    edges = union_all([
        made, approved,
        edge(hits, F.concat(F.lit("DIM_"), F.col("d")), "document-supports-evidence-dimension", 1 + F.col("n") / F.col("__dim") * 8, F.col("n"), F.col("n")),
        edge(matches, F.col("group"), "document-keyword-matches-threat", 1.0 + F.col("n"), F.col("n"), F.col("n")),
        edge(anchors, F.col("group"), "high-score-keyword-anchor", F.lit(4.0), F.col("total"), F.lit(None)),
    ])
    return nodes, edges


def threat_matrix(edges: DataFrame, concepts: Concepts) -> DataFrame:
    """(threat, layer, signal, interventions, documents, topics): each threat's concepts, how many document edges end at
    it, and the topics linked to it in order."""
    names = dict(concepts.layers) | dict(concepts.signals) | dict(concepts.interventions)
    fixed = [(t.id, t.label, names[t.layer], names[t.signal], "; ".join(names[i] for i in t.interventions)) for t in concepts.threats]
    rows = edges.sparkSession.createDataFrame(fixed, "target string, threat string, layer string, signal string, interventions string")
    docs = edges.filter(F.col("relation").isin("document-keyword-matches-threat", "high-score-keyword-anchor")).groupBy("target").agg(F.count("*").alias("documents"))
    topics = edges.filter("relation = 'topic-threat'").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("topics"))
    return rows.join(docs, "target", "left").join(topics, "target", "left").fillna(0, ["documents"]).fillna("", ["topics"]).drop("target")


def concept_validation(nodes: DataFrame, edges: DataFrame, concepts: Concepts, decisions: DataFrame, expected: DataFrame, dimensions: Sequence[str], isolated_topics: Sequence[str] = ()) -> DataFrame:
    """(check, failures) for each named invariant of a concept graph, the structural ones of ``validation`` included.
    ``expected`` (doc_id) are the documents that the graph must hold. Each check counts the rows that break it."""
    spark = nodes.sparkSession
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("failures"))
    typed = typed_edges(nodes.dropDuplicates(["id"]), edges)
    checks = [validation(nodes, edges, CONCEPT_RELATIONS)]
    defined = {"threat": [t.id for t in concepts.threats], "layer": [i for i, _ in concepts.layers], "signal": [i for i, _ in concepts.signals], "intervention": [i for i, _ in concepts.interventions], "dimension": [f"DIM_{d}" for d in dimensions], "topic": [t[0] for t in concepts.topics]}
    for kind, ids in defined.items():
        found, due = nodes.filter(F.col("type") == kind).select("id"), spark.createDataFrame([(i,) for i in ids], "id string")
        checks.append(count(f"{kind} nodes are those defined", found.join(due, "id", "left_anti").union(due.join(found, "id", "left_anti"))))
    ids = [i for group in (*defined.values(), [concepts.hub]) for i in group]
    known = set(ids)
    loose = [x for t in concepts.threats for x in (t.layer, t.signal, *t.interventions) if x not in known]
    checks.append(count("threats name defined concepts", spark.createDataFrame([(x,) for x in loose], "id string")))
    docs = nodes.filter("type = 'document'").select("id")
    due = expected.select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("id"))
    checks += [count("documents are all expected", docs.join(due, "id", "left_anti")), count("no document is missing", due.join(docs, "id", "left_anti"))]
    approved = decisions.filter("retained").select(F.col("topic").alias("source"), "target")
    excluded = decisions.filter("NOT retained").select(F.col("topic").alias("source"), "target")
    pairs = typed.filter("source_type = 'topic' AND target_type = 'threat'")
    turned = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    checks += [
        count("topic-threat edges are approved", pairs.join(approved, ["source", "target"], "left_anti")),
        count("approved pairs are edges", approved.join(pairs, ["source", "target"], "left_anti")),
        count("approved pairs are edges once", pairs.groupBy("source", "target").count().filter("count > 1")),
        count("topic-threat edges are reviewed", pairs.filter(F.col("origin") != REVIEWED)),
        count("reviewed edges join topics to threats", typed.filter(F.col("origin") == REVIEWED).filter("NOT (coalesce(source_type, '') = 'topic' AND coalesce(target_type, '') = 'threat')")),
        count("excluded pairs are no edges", edges.join(excluded, ["source", "target"], "left_semi")),
        count("excluded pairs are no edges the other way", turned.join(excluded, ["source", "target"], "left_semi")),
        count("no pair is approved and excluded", approved.join(excluded, ["source", "target"], "left_semi")),
        count("no edge ends at a topic", typed.filter("target_type = 'topic'")),
        count("topics reach threats only", typed.filter("source_type = 'topic' AND coalesce(target_type, '') <> 'threat'")),
        count("no edge joins document and topic", typed.filter("(source_type = 'document' AND target_type = 'topic') OR (source_type = 'topic' AND target_type = 'document')")),
        count("reviewed edges name known documents", pairs.select(F.explode(F.filter(F.split("doc_ids", "; "), lambda x: x != "")).alias("x")).select(F.concat(F.lit("DOC_"), "x").alias("id")).join(due, "id", "left_anti")),
        count("reviewed edges name documents", pairs.filter("coalesce(doc_ids, '') = ''")),
        count("qualifiers are those of the decisions", pairs.join(decisions.select(F.col("topic").alias("source"), "target", F.col("qualifiers").alias("__q")), ["source", "target"]).filter(~F.col("qualifiers").eqNullSafe(F.col("__q")))),
        count("keyword edges start at documents", typed.filter(F.col("relation").isin("document-keyword-matches-threat", "high-score-keyword-anchor") & (F.coalesce("source_type", F.lit("")) != "document"))),
        count("rule edges touch documents", typed.filter(F.col("origin") == RULE).filter("coalesce(source_type, '') <> 'document' AND coalesce(target_type, '') <> 'document'")),
        count("fixed edges touch neither topics nor documents", typed.filter(F.col("origin") == FIXED).filter("source_type IN ('topic', 'document') OR target_type IN ('topic', 'document')")),
        count("origins are known", edges.filter(~F.coalesce(F.col("origin").isin(REVIEWED, RULE, FIXED), F.lit(False)))),
        count("several relations of a pair are a match and its anchor", several_relations(edges).filter("relations <> 'document-keyword-matches-threat,high-score-keyword-anchor'")),
        count("anchors are best matches", edges.filter("relation = 'high-score-keyword-anchor'").join(edges.filter("relation = 'document-keyword-matches-threat'").select("source", "target"), ["source", "target"], "left_anti")),
        count("documents match one to three threats", docs.join(edges.filter("relation = 'document-keyword-matches-threat'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")), "id", "left").filter("coalesce(n, 0) NOT BETWEEN 1 AND 3")),
        count("only these topics stand alone", _unlike(isolated(nodes, edges), spark.createDataFrame([(i,) for i in isolated_topics], "id string"))),
    ]
    definitions = spark.createDataFrame(concepts.fixed_edges(), "source string, target string, relation string, weight double").select("source", "target", "relation")
    made = edges.filter(F.col("origin") == FIXED).select("source", "target", "relation")
    checks += [count("fixed edges follow the definitions", made.join(definitions, ["source", "target", "relation"], "left_anti")), count("every definition is an edge", definitions.join(made, ["source", "target", "relation"], "left_anti"))]
    share = nodes.filter("type = 'topic'").agg(F.sum("prevalence").alias("s")).filter("s IS NOT NULL AND abs(s - 100) >= 0.06")
    checks.append(count("topics' prevalence adds up to a hundred", share))
    links = dict.fromkeys(defined["topic"], 0)
    for r in approved.groupBy("source").count().collect():  # a row for each topic
        links[r["source"]] = r["count"]
    due_links = spark.createDataFrame(list(links.items()), "source string, due long")
    got = pairs.groupBy("source").agg(F.count("*").alias("n"))
    checks.append(count("topics have as many links as approved", due_links.join(got, "source", "left").filter("coalesce(n, 0) <> due")))
    return union_all(checks)


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti"))


def export_validation(nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame, name: str) -> DataFrame:
    """(check, failures): whether an exported graph, read back, has the same nodes and edges, each as often, as many of
    each origin, and the same attributes. An empty text counts as none, and numbers as their text."""
    key, ends = ["source", "target", "relation"], ["source", "target"]
    differ = lambda a, b, c: a.select(*c).exceptAll(b.select(*c)).unionAll(b.select(*c).exceptAll(a.select(*c)))
    count = lambda what, df: df.agg(F.lit(f"{name}: {what}").alias("check"), F.count("*").alias("failures"))
    plain = lambda df, c: df.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in c])
    same = lambda what, a, b, c: count(what, differ(plain(a, c), plain(b, c), c))
    known = lambda a, b: [c for c in a.columns if c in b.columns]
    lost = lambda a, b: nodes.sparkSession.createDataFrame([(c,) for c in a.columns if c not in b.columns], "c string")
    origins = lambda df: df.groupBy("origin").agg(F.count("*").alias("n"))
    return union_all([
        count("nodes agree", differ(nodes, other_nodes, ["id"])), count("edges agree", differ(edges, other_edges, key)),
        count("ends of edges are nodes", dangling(other_nodes, other_edges)), count("node ids are unique", duplicate_ids(other_nodes)), count("edge keys are unique", duplicate_keys(other_edges)),
        count("origins agree", differ(origins(edges), origins(other_edges), ["origin", "n"])),
        same("node attributes agree", nodes, other_nodes, known(nodes, other_nodes)), same("edge attributes agree", edges, other_edges, known(edges, other_edges)),
        count("no node attribute is missing", lost(nodes, other_nodes)), count("no edge attribute is missing", lost(edges, other_edges)),
        count("numbers of nodes and edges agree", nodes.agg(F.count("*").alias("n")).join(other_nodes.agg(F.count("*").alias("m")), F.lit(True)).filter("n <> m").select("n").union(
            edges.select(*ends).agg(F.count("*").alias("n")).join(other_edges.agg(F.count("*").alias("m")), F.lit(True)).filter("n <> m").select("n"))),
    ])


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def content_hash(rows: DataFrame, name: str) -> DataFrame:
    """(name, rows, hash): a digest of a table that does not depend on the order of its rows."""
    h = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash"))


def reruns_agree(build, names: Sequence[str]) -> DataFrame:
    """(name, rows, agree): whether two runs of ``build`` - which returns a frame for each name - give equal tables."""
    first, second = build(), build()
    rows = [content_hash(a, n).join(content_hash(b, n).withColumnsRenamed({"rows": "rows2", "hash": "hash2"}), "name") for n, a, b in zip(names, first, second, strict=True)]
    return union_all(rows).select("name", "rows", ((F.col("rows") == F.col("rows2")) & (F.col("hash") == F.col("hash2"))).alias("agree"))
