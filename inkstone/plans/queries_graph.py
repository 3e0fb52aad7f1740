"""Queries on joins, sets, ranks, evidence graphs, duplicates, records and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import evidence as E
from inkstone.operators import graph as H
from inkstone.operators import patterns as X
from inkstone.operators import relational as R
from inkstone.operators import similarity as S
from inkstone.plans.catalog import DIMENSIONS, GROUPS, LEXICON, RULES, query, r6, table
from inkstone.plans.queries_corpus import GROUPED, SCORED
from inkstone.sources import tables as IO
from inkstone.storage import scratch
from inkstone.streaming import evidence as ST

# --- joins ------------------------------------------------------------------------------------


@query("""SELECT o.o_orderkey, count(l.l_orderkey) AS lines, coalesce(round(sum(l.l_extendedprice), 2), 0) AS price FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("price", F.lit(0.0)).alias("price"))


@query("""SELECT c.c_custkey, n.n_name, r.r_name, coalesce(o.orders, 0) AS orders FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def left_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return rows.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), R.require_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])
    return R.one_to_one(docs.select("doc_id", "lang"), labels, ["doc_id"])


@query("SELECT a.doc_id, a.quality AS x, b.toxic AS y FROM labels a JOIN labels b ON a.doc_id = b.doc_id")
def rater_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return R.same_keys(labels.select("doc_id", F.col("quality").alias("x")), labels.select("doc_id", F.col("toxic").alias("y")), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""SELECT doc_id, 'left' AS side FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def anti_join_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.only_in_one(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only right' WHEN b.doc_id IS NULL THEN 'only left' WHEN a.lang IS DISTINCT FROM b.lang OR a.n_chars IS DISTINCT FROM b.n_chars THEN 'differs' ELSE 'equal' END AS status,
  CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN concat_ws(',', CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END) ELSE '' END AS mismatches
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    other = docs.filter("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    return R.reconcile(docs.filter("doc_id % 7 <> 0"), other, "doc_id", ["lang", "n_chars"])


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS name FROM documents")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.broadcast_lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), {"en": "English", "de": "German"}, "lang", "name").select("doc_id", "name")


# --- sets -------------------------------------------------------------------------------------


@query("""(SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.symmetric_difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("""SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS subset, true AS same""")
def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return spark.createDataFrame([(R.is_subset(labels, docs), R.same_multiset(labels, labels.repartition(3)))], "subset boolean, same boolean")


@query("""SELECT 'document' AS kind, doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages""")
def row_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return H.union_all([a, table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")])


@query("""SELECT source, count(DISTINCT lang) AS langs, array_to_string(list_sort(list_distinct(list(lang))), ',') AS names FROM documents GROUP BY source""")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))


@query("""WITH s AS (SELECT source, list_distinct(list(n_chars % 50)) AS w FROM documents GROUP BY source)
SELECT a.source AS a, b.source AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM s a JOIN s b ON a.source < b.source""")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set(F.col("n_chars") % 50).alias("w"))
    a, b = s.select(F.col("source").alias("a"), F.col("w").alias("x")), s.select(F.col("source").alias("b"), F.col("w").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r6(R.list_jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


# --- ranks --------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY n_chars DESC) AS rank FROM documents")
def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.competition_rank(table(spark, sf_dir, "documents"), "n_chars", by=["lang"]).select("doc_id", "lang", "rank")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, lang, doc_id LIMIT 1")
def best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_row(table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.asc("lang"), F.asc("doc_id")]).select("doc_id", "n_chars")


@query("SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, doc_id FROM documents QUALIFY rank <= 8")
def top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 8).select("source", "rank", "doc_id")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, string_agg(CAST(doc_id AS VARCHAR), '; ' ORDER BY doc_id) AS ids FROM r WHERE k <= 3 GROUP BY source""")
def ordered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_join(table(spark, sf_dir, "documents"), "source", "doc_id", "doc_id", "ids", 3)


@query("""SELECT source, coalesce(sum(n_chars) FILTER (lang = 'en'), 0) AS en, coalesce(sum(n_chars) FILTER (lang = 'fr'), 0) AS fr, coalesce(sum(n_chars) FILTER (lang = 'de'), 0) AS de FROM documents GROUP BY source""")
def pivoted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivoted(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de"], "n_chars")


@query("""WITH e AS (SELECT DISTINCT source, lang AS target FROM documents), p AS (SELECT source, row_number() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT source FROM documents)),
c AS (SELECT target, avg(place) AS centre FROM e JOIN p ON p.source = e.source GROUP BY target)
SELECT target, round(centre, 6) AS centre, row_number() OVER (ORDER BY centre, target) AS place FROM c""")
def barycentre_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    places = docs.select("source").distinct().withColumn("place", F.row_number().over(Window.orderBy("source")))
    return R.barycentre(docs.select("source", F.col("lang").alias("target")).distinct(), places).withColumn("centre", r6(F.col("centre")))


# --- graphs -------------------------------------------------------------------------------------

_TERMS = " UNION ALL ".join(f"SELECT '{c}' AS c, '{t}' AS t" for c, ts in LEXICON.items() for t in ts)
_DIMS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS c, n_{c} AS n FROM scored WHERE n_{c} > 0" for c in LEXICON)
_SLUG = "substr(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80)"
GRAPH = f"""{SCORED}, {GROUPED},
term AS ({_TERMS}), dim AS ({_DIMS}),
node AS (
  SELECT DISTINCT 'CAT_' || upper(c) AS id, c AS label, 'category' AS type, '' AS detail FROM term
  UNION ALL SELECT DISTINCT 'TERM_' || {_SLUG}, t, 'term', '' FROM term
  UNION ALL SELECT DISTINCT 'GRP_' || upper("group"), "group", 'group', '' FROM grouped
  UNION ALL SELECT 'DOC_' || doc_id, 'DOC_' || doc_id, 'document', relevance FROM scored),
edge AS (
  SELECT 'TERM_' || {_SLUG} AS source, 'CAT_' || upper(c) AS target, 'member_of' AS relation, 'fixed' AS origin, 1.0::DOUBLE AS weight, '' AS evidence FROM term
  UNION ALL SELECT 'DOC_' || doc_id, 'CAT_' || upper(c), 'mentions', 'rule', 1.0 + n, CAST(n AS VARCHAR) FROM dim
  UNION ALL SELECT 'DOC_' || doc_id, 'GRP_' || upper("group"), 'matches', 'rule', round(1 + n / (SELECT max(n) FROM grouped) * 8, 4), CAST(n AS VARCHAR) FROM grouped
  UNION ALL SELECT 'GRP_' || upper(g."group"), 'DOC_' || g.doc_id, 'anchored_by', 'rule', 2.0, '' FROM grouped g JOIN scored s ON s.doc_id = g.doc_id
    WHERE g.rank = 1 AND s.total >= 0.55 * (SELECT greatest(max(total), 1) FROM scored))"""
RELATIONS = {"member_of": ("term", "category"), "mentions": ("document", "category"), "matches": ("document", "group"), "anchored_by": ("group", "document")}


def evidence_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    scored = H.checkpointed(E.scores(docs, LEXICON, RULES))
    groups = H.checkpointed(H.top_groups(scored, H.keyword_matches(docs, GROUPS, F.col("text")), DIMENSIONS))
    return H.evidence_graph(scored, groups, LEXICON)


@query(f"WITH {GRAPH} SELECT id, label, type, detail FROM node")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_graph(spark, sf_dir)[0]


@query(f"WITH {GRAPH} SELECT source, target, relation, origin, round(weight, 4) AS weight, evidence FROM edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_graph(spark, sf_dir)[1]


@query(f"WITH {GRAPH} SELECT relation, origin, count(*) AS n FROM edge GROUP BY ALL")
def graph_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.histogram(evidence_graph(spark, sf_dir)[1], "relation", "origin")


@query(f"WITH {GRAPH}, e AS (SELECT source AS id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, 0, 1 FROM edge) SELECT id, sum(o) AS out_degree, sum(i) AS in_degree FROM e GROUP BY id")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.degrees(evidence_graph(spark, sf_dir)[1])


@query(f"WITH {GRAPH} SELECT id FROM node WHERE id NOT IN (SELECT source FROM edge UNION SELECT target FROM edge)")
def graph_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.isolated(*evidence_graph(spark, sf_dir))


@query(f"""WITH {GRAPH} SELECT a.type AS source_type, e.relation, b.type AS target_type, count(*) AS n FROM edge e LEFT JOIN node a ON a.id = e.source LEFT JOIN node b ON b.id = e.target GROUP BY ALL""")
def graph_edge_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.histogram(H.typed_edges(*evidence_graph(spark, sf_dir)), "source_type", "relation", "target_type")


@query("""WITH e AS (SELECT 'U' || user_id AS source, event_type AS target, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS relation FROM events)
SELECT source, target, relation, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1""")
def duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.duplicate_keys(_event_edges(spark, sf_dir))


@query("""WITH e AS (SELECT 'U' || user_id AS source, event_type AS target, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS relation FROM events)
SELECT source, target, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM e GROUP BY ALL HAVING count(DISTINCT relation) > 1""")
def several_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.several_relations(_event_edges(spark, sf_dir))


def _event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("target"), F.when(F.col("value") > 50, "high").otherwise("low").alias("relation"))


@query(f"""WITH {GRAPH}, m AS (SELECT target AS "group", count(DISTINCT source) AS documents FROM edge WHERE relation = 'matches' GROUP BY target),
a AS (SELECT source AS "group", string_agg(DISTINCT target, '; ' ORDER BY target) AS anchors FROM edge WHERE relation = 'anchored_by' GROUP BY source)
SELECT m."group", m.documents, coalesce(a.anchors, '') AS anchors FROM m LEFT JOIN a ON a."group" = m."group\"""")
def intervention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.intervention_matrix(evidence_graph(spark, sf_dir)[1])


@query(f"""WITH {GRAPH}, d AS (SELECT source, target, 'reviewed' AS decision, CAST(substr(source, 5) AS BIGINT) % 3 <> 0 AS retained FROM edge WHERE relation = 'matches' AND CAST(substr(source, 5) AS BIGINT) % 2 = 0)
SELECT e.source, e.target, e.relation, CASE WHEN d.decision IS NOT NULL THEN 'reviewed' ELSE e.origin END AS origin FROM edge e LEFT JOIN d ON d.source = e.source AND d.target = e.target WHERE coalesce(d.retained, true) AND e.source <> e.target""")
def reviewed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = H.checkpointed(evidence_graph(spark, sf_dir)[1])
    number = F.substring("source", 5, 20).try_cast("bigint")
    d = edges.filter("relation = 'matches'").filter(number % 2 == 0).select("source", "target", F.lit("reviewed").alias("decision"), (number % 3 != 0).alias("retained"))
    return H.merge_reviewed(edges, d).select("source", "target", "relation", "origin")


@query(f"""WITH {GRAPH}, r AS (SELECT source, target, CAST(substr(source, 5) AS BIGINT) AS n FROM edge WHERE relation = 'matches'),
k AS (SELECT r.source, r.target, d.retained FROM r LEFT JOIN (SELECT * FROM (VALUES (0, 'GRP_GA', true), (1, 'GRP_GA', false), (1, 'GRP_GB', true)) v(topic, target, retained)) d ON d.topic = r.n % 4 AND d.target = r.target)
SELECT source, target, CASE WHEN retained IS NULL THEN 'not reviewed' WHEN retained THEN 'approved' ELSE 'rejected' END AS verdict FROM k""")
def classified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = evidence_graph(spark, sf_dir)[1].filter("relation = 'matches'").select("source", "target")
    strongest = table(spark, sf_dir, "documents").select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("source"), (F.col("doc_id") % 4).alias("topic"))
    decisions = spark.createDataFrame([(0, "GRP_GA", True), (1, "GRP_GA", False), (1, "GRP_GB", True)], "topic long, target string, retained boolean")
    return H.classified(edges, strongest, decisions)


#: The graph with faults of each kind put in: a second node for each category, without a label; loops; anchors that end
#: nowhere and weigh nothing; memberships twice, without an origin.
_FAULTY = """
node2 AS (SELECT id, label, type FROM node UNION ALL SELECT id, '', type FROM node WHERE type = 'category'),
edge2 AS (
  SELECT source, target, relation, origin, weight FROM edge
  UNION ALL SELECT id, id, 'mentions', 'rule', 1.0 FROM node WHERE type = 'group'
  UNION ALL SELECT source, 'GONE', relation, origin, 0.0 FROM edge WHERE relation = 'anchored_by'
  UNION ALL SELECT source, target, relation, '', weight FROM edge WHERE relation = 'member_of'),
typed AS (SELECT e.relation, a.type AS s, b.type AS t FROM edge2 e LEFT JOIN node2 a ON a.id = e.source LEFT JOIN node2 b ON b.id = e.target)"""
_TYPES = " OR ".join(f"(relation = '{r}' AND s = '{a}' AND t = '{b}')" for r, (a, b) in RELATIONS.items())


@query(f"""WITH {GRAPH}, {_FAULTY}
SELECT 'node ids are unique' AS "check", (SELECT count(*) FROM (SELECT id FROM node2 GROUP BY id HAVING count(*) > 1)) AS failures
UNION ALL SELECT 'nodes have labels', (SELECT count(*) FROM node2 WHERE label IS NULL OR trim(label) = '')
UNION ALL SELECT 'edge keys are unique', (SELECT count(*) FROM (SELECT source FROM edge2 GROUP BY source, target, relation HAVING count(*) > 1))
UNION ALL SELECT 'no edge is a loop', (SELECT count(*) FROM edge2 WHERE source = target)
UNION ALL SELECT 'edges end at nodes', (SELECT count(*) FROM (SELECT source AS id FROM edge2 UNION SELECT target FROM edge2) WHERE id NOT IN (SELECT id FROM node2))
UNION ALL SELECT 'weights are positive', (SELECT count(*) FROM edge2 WHERE weight IS NULL OR weight <= 0)
UNION ALL SELECT 'edges state their origin', (SELECT count(*) FROM edge2 WHERE origin IS NULL OR origin = '')
UNION ALL SELECT 'relations join their types', (SELECT count(*) FROM typed WHERE NOT coalesce({_TYPES}, false))""")
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each check on a graph with faults for it to find."""
    nodes, edges = map(H.checkpointed, evidence_graph(spark, sf_dir))
    again = nodes.filter("type = 'category'").withColumn("label", F.lit(""))
    loops = nodes.filter("type = 'group'").select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("mentions").alias("relation"), F.lit("rule").alias("origin"), F.lit(1.0).alias("weight"))
    gone = edges.filter("relation = 'anchored_by'").withColumns({"target": F.lit("GONE"), "weight": F.lit(0.0)})
    twice = edges.filter("relation = 'member_of'").withColumn("origin", F.lit(""))
    return H.validation(nodes.unionByName(again), H.union_all([edges, loops, gone, twice]), RELATIONS)


@query(f"WITH {GRAPH} SELECT 'nodes' AS name, (SELECT count(*) FROM node) AS rows, true AS agree UNION ALL SELECT 'edges', (SELECT count(*) FROM edge), true UNION ALL SELECT 'counted', 1, false")
def graph_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of the graph, and a table that differs between them."""
    runs = iter(range(2))

    def build() -> list[DataFrame]:
        return [*evidence_graph(spark, sf_dir), spark.createDataFrame([(next(runs),)], "run int")]

    return H.reruns_agree(build, ["nodes", "edges", "counted"])


#: A small model of concepts: threats are the keyword groups, topics the groups of languages.
CONCEPTS = H.Concepts(
    threats=[H.Threat("GA", "first", "LY_A", "SG_A", ["IN_A", "IN_B"]), H.Threat("GB", "second", "LY_B", "SG_A", ["IN_B"]), H.Threat("GC", "third", "LY_B", "SG_B", ["IN_A"]), H.Threat("GD", "fourth", "LY_H", "SG_B", ["IN_C", "IN_A"])],
    layers=[("LY_A", "layer a"), ("LY_B", "layer b"), ("LY_H", "hub")], signals=[("SG_A", "signal a"), ("SG_B", "signal b")],
    interventions=[("IN_A", "control a"), ("IN_B", "control b"), ("IN_C", "control c")], hub="LY_H",
    topics=[("T01", "one", 60.0, 3), ("T02", "two", 40.0, 2), ("T03", "three", 0.0, 0)],
)
_DECISIONS = [("T01", "GA", True, "perception", "0; 1"), ("T01", "GB", True, "", "1"), ("T02", "GC", True, "potential", "0"), ("T02", "GA", False, "", "")]


def concept_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and decisions."""
    docs = table(spark, sf_dir, "documents")
    scored = H.checkpointed(E.scores(docs, LEXICON, RULES))
    matches = H.checkpointed(H.top_groups(scored, H.keyword_matches(docs, GROUPS, F.col("text")), DIMENSIONS))
    decisions = spark.createDataFrame(_DECISIONS, "topic string, target string, retained boolean, qualifiers string, doc_ids string")
    return *map(H.checkpointed, H.concept_graph(scored, matches, list(LEXICON), CONCEPTS, decisions)), decisions


_FIXED_SQL = " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, '{r}' AS relation, {w}::DOUBLE AS weight" for a, b, r, w in CONCEPTS.fixed_edges())
CONCEPT_EDGES = f"""{SCORED}, {GROUPED}, cdim AS ({_DIMS}),
concept AS (
  SELECT source, target, relation, weight, 'fixed' AS origin FROM ({_FIXED_SQL})
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{t}', '{g}', 'topic-threat', 1.0::DOUBLE, 'reviewed')" for t, g, kept, _, _ in _DECISIONS if kept)})
  UNION ALL SELECT 'DOC_' || doc_id, 'DIM_' || c, 'document-supports-evidence-dimension', round(1 + n / (SELECT greatest(max(n), 1) FROM cdim) * 8, 4), 'rule' FROM cdim
  UNION ALL SELECT 'DOC_' || doc_id, "group", 'document-keyword-matches-threat', 1.0 + n, 'rule' FROM grouped
  UNION ALL SELECT 'DOC_' || g.doc_id, g."group", 'high-score-keyword-anchor', 4.0, 'rule' FROM grouped g JOIN scored s ON s.doc_id = g.doc_id
    WHERE g.rank = 1 AND s.total >= 0.55 * (SELECT greatest(max(total), 1) FROM scored))"""


@query(f"WITH {CONCEPT_EDGES} SELECT source, target, relation, origin, weight FROM concept")
def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concept_graph(spark, sf_dir)[1].select("source", "target", "relation", "origin", "weight")


@query(f"""WITH {CONCEPT_EDGES}, name AS (SELECT * FROM (VALUES {', '.join(f"('{t.id}', '{t.label}', '{dict(CONCEPTS.layers)[t.layer]}', '{dict(CONCEPTS.signals)[t.signal]}', '{'; '.join(dict(CONCEPTS.interventions)[i] for i in t.interventions)}')" for t in CONCEPTS.threats)}) v(id, threat, layer, signal, interventions))
SELECT threat, layer, signal, interventions, (SELECT count(*) FROM concept c WHERE c.target = name.id AND c.relation IN ('document-keyword-matches-threat', 'high-score-keyword-anchor')) AS documents,
  coalesce((SELECT string_agg(DISTINCT source, '; ' ORDER BY source) FROM concept c WHERE c.target = name.id AND c.relation = 'topic-threat'), '') AS topics FROM name""")
def threat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.threat_matrix(concept_graph(spark, sf_dir)[1], CONCEPTS)


@query()
def concept_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the concept graph as it is built; a test gives each a graph to fail on."""
    nodes, edges, decisions = concept_graph(spark, sf_dir)
    return H.concept_validation(nodes, edges, CONCEPTS, decisions, table(spark, sf_dir, "documents").select("doc_id"), list(LEXICON), ["T03"])


@query("""WITH RECURSIVE line AS (SELECT doc_id, string_split(text, chr(10))[1] AS a, string_split(text, chr(10))[-1] AS b FROM documents),
e0 AS (SELECT doc_id AS x, min(doc_id) OVER (PARTITION BY a) AS y FROM line UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY b) FROM line),
e AS (SELECT x, y FROM e0 WHERE x <> y UNION SELECT y, x FROM e0 WHERE x <> y),
reach AS (SELECT x AS node, x AS root FROM e UNION SELECT e.x, r.root FROM reach r JOIN e ON e.y = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by a common first or last line."""
    lines = F.split("text", "\n", -1)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(lines, 1).alias("a"), F.element_at(lines, -1).alias("b"))
    star = lambda c: rows.join(rows.groupBy(c).agg(F.min("doc_id").alias("first")), c).select(F.col("doc_id").alias("x"), F.col("first").alias("y"))
    return H.connected_components(star("a").union(star("b")), "x", "y")


@query(f"""WITH {GRAPH}, n AS (SELECT row_number() OVER (ORDER BY id) AS n, id FROM node), e AS (SELECT row_number() OVER (ORDER BY source, target, relation) AS n, source, target FROM edge)
SELECT 1 AS part, n, '<node id="' || id || '">' AS head FROM n UNION ALL SELECT 2, n, '<edge id="e' || n || '" source="' || source || '" target="' || target || '">' FROM e""")
def graphml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = IO.graphml(*evidence_graph(spark, sf_dir))
    return rows.select("part", "n", F.regexp_extract("value", "^<[^>]*>", 0).alias("head"))


def exported_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, tuple[DataFrame, DataFrame]]]:
    """The concept graph, and its GraphML and CSV exports read back."""
    nodes, edges, _ = concept_graph(spark, sf_dir)
    path = scratch(spark, "exports")
    IO.write_graphml(nodes, edges, f"{path}/graph.graphml")
    IO.write_csv(nodes, f"{path}/nodes")
    IO.write_csv(edges, f"{path}/edges")
    return nodes, edges, {"graphml": IO.read_graphml(spark, f"{path}/graph.graphml"), "csv": (IO.csv_table(spark, f"{path}/nodes"), IO.csv_table(spark, f"{path}/edges"))}


@query(f"WITH {CONCEPT_EDGES} SELECT x.export, relation, origin, count(*) AS n, round(sum(weight), 4) AS weight FROM concept, (VALUES ('csv'), ('graphml')) x(export) GROUP BY ALL")
def graph_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exports of the graph hold, by relation."""
    found = exported_graphs(spark, sf_dir)[2]
    return H.union_all([e.groupBy(F.lit(name).alias("export"), "relation", "origin").agg(F.count("*").alias("n"), F.round(F.sum(F.col("weight").cast("double")), 4).alias("weight")) for name, (_, e) in found.items()])


@query(f"""WITH {CONCEPT_EDGES} SELECT 'edges in all' AS "check", (SELECT count(*) FROM concept) AS failures UNION ALL SELECT x.name || ': ' || c.what, 0 FROM (VALUES ('csv'), ('graphml')) x(name),
  (VALUES ('nodes agree'), ('edges agree'), ('ends of edges are nodes'), ('node ids are unique'), ('edge keys are unique'), ('origins agree'), ('node attributes agree'), ('edge attributes agree'), ('no node attribute is missing'),
   ('no edge attribute is missing'), ('numbers of nodes and edges agree')) c(what)""")
def export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exports held against the graph; a test gives each check an export to fail on."""
    nodes, edges, found = exported_graphs(spark, sf_dir)
    every = edges.agg(F.lit("edges in all").alias("check"), F.count("*").alias("failures"))
    return H.union_all([every, *[H.export_validation(nodes, edges, n, e, name) for name, (n, e) in found.items()]])


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS total FROM documents),
l AS (SELECT CAST(k * 8 // total AS INT) AS part, k, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' || chr(10) AS line FROM o)
SELECT part, sum(length(line)) AS bytes, sha256(string_agg(line, '' ORDER BY k)) AS sha256 FROM l GROUP BY part""")
def canonical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the bytes of a table's files, which follow from its rows alone."""
    path = scratch(spark, "canonical")
    IO.write_canonical(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang"), ["doc_id"], path)
    return IO.file_digests(spark, path)


@query(r"""WITH t AS (SELECT conv_id, turn % 10 + 1 AS k, conv_id % 7 AS m, string_split(text, ' ') AS w FROM conversations),
r AS (SELECT conv_id, string_agg(CASE WHEN k % 2 = 0 THEN '## ' ELSE '' END || k || '. ' || w[1] || chr(10) || 'see ' || (conv_id + k % 3) || ' and ' || m, chr(10) ORDER BY k) AS response FROM t GROUP BY conv_id),
f AS (SELECT conv_id, response, list_distinct(regexp_extract_all(response, '\b(\d+)\b', 1)) AS named, list_transform([conv_id, conv_id + 1], lambda x: CAST(x AS VARCHAR)) AS members FROM r)
SELECT conv_id AS batch, CAST(len(list_intersect(named, members)) AS INT) AS own, CAST(len(list_filter(named, lambda x: NOT list_contains(members, x))) AS INT) AS foreign,
  len(list_filter(regexp_split_to_array(response, '\s+'), lambda x: x <> '')) AS words, len(regexp_extract_all(response, '(?m)^[ \t]*(?:#+[ \t]*)?\d\.\s')) AS headings FROM f""")
def response_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as responses with numbered headings that name ids, their own and others."""
    t = table(spark, sf_dir, "conversations").withColumn("k", F.col("turn") % 10 + 1)
    head = F.concat(F.when(F.col("k") % 2 == 0, "## ").otherwise(""), F.col("k").cast("string"), F.lit(". "), F.element_at(F.split("text", " ", -1), 1))
    line = F.concat(head, F.lit("\nsee "), (F.col("conv_id") + F.col("k") % 3).cast("string"), F.lit(" and "), (F.col("conv_id") % 7).cast("string"))
    rows = t.groupBy(F.col("conv_id").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))  # the turns of a conversation
    responses = rows.select("batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("response"))
    return IO.response_audit(responses, rows.select("batch", F.array(F.col("batch"), F.col("batch") + 1).alias("members")))


# --- rules of several patterns ------------------------------------------------------------------------

#: Rules of one to three patterns; some need no string, or one of several.
PATTERN_RULES = {
    "license": ["license", "permission|copyright"], "secret": [r"(?:password|token|secret)s?\s*[:=]", r"[0-9]"], "numbers": [r"[0-9]{3}", r"[a-z]{12}"],
    "german": [r"\bund\b", r"\bder\b", "die"], "sentence": [r"the\s+of"], "absent": ["no such phrase", "the"],
}
_FLAT = r"regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')"


@query("WITH flat AS (SELECT doc_id, " + _FLAT + " AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, doc_id FROM flat WHERE " + " AND ".join(f"regexp_matches(t, '{p}', 'i')" for p in patterns) for name, patterns in PATTERN_RULES.items()
))
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of which every pattern matches a document."""
    return X.conjunctions(table(spark, sf_dir, "documents"), PATTERN_RULES)


@query(rf"""WITH flat AS (SELECT doc_id, {_FLAT} AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract(t, '[a-z]{{4,}}') AS a, regexp_extract(t, '[A-Z][a-z]+') AS b FROM flat)
SELECT doc_id, regexp_matches(t, a || '\S*\s', 'i') AS first, regexp_matches(t, ' ' || b || '[^0-9]', 'i') AS second, regexp_matches(t, 'the\s+of', 'i') AS third,
  regexp_matches(t, a || '\S*\s', 'i') AND regexp_matches(t, ' ' || b || '[^0-9]', 'i') AND regexp_matches(t, 'the\s+of', 'i') AS all_found FROM w""")
def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against patterns made of its own words: its first of four letters, its first capitalized one, and a phrase."""
    docs = table(spark, sf_dir, "documents")
    flat = X.flattened(F.col("text"))
    patterns = F.array(F.concat(F.regexp_extract(flat, "[a-z]{4,}", 0), F.lit(r"\S*\s")), F.concat(F.lit(" "), F.regexp_extract(flat, "[A-Z][a-z]+", 0), F.lit("[^0-9]")), F.lit(r"the\s+of"))
    found = X.cited(docs, docs.select(F.col("doc_id").alias("target"), "doc_id", patterns.alias("patterns")))
    return found.select("doc_id", *[F.col("hits")[k].alias(n) for k, n in enumerate(("first", "second", "third"))], "all_found")


# --- duplicates, records, events ------------------------------------------------------------------


@query()
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query(r"""SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(text, '\s+', '', 'g')) AS first_id FROM documents""")
def body_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact_classes(table(spark, sf_dir, "documents")).select("doc_id", "first_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_copies(table(spark, sf_dir, "documents")).select("doc_id")


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS filename, CAST(n_chars % 40 AS INT) AS pages,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, sha256(trim(text)) AS body FROM documents WHERE trim(text) <> ''""")
def header_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as header blocks and parsed again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), (F.col("n_chars") % 40).cast("int").alias("pages"), "text")
    back = IO.parse_records(IO.checked_record_text(docs, docs.select("doc_id", "pages")).select("value"))
    body = F.trim(F.regexp_replace("text", r"^=+\n", ""))
    return back.select("doc_id", "filename", "pages", "words", F.sha2(body, 256).alias("body"))


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS filename, CAST(n_chars % 40 AS INT) AS pages,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS body FROM documents WHERE trim(text) <> ''""")
def header_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of header blocks, and read again by ranges of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), (F.col("n_chars") % 40).cast("int").alias("pages"), "text")
    path = scratch(spark, "records")
    IO.write_records(docs, path)
    rulers = F.regexp_replace(F.regexp_replace("text", r"^=+\n", ""), r"\n=+$", "")  # its own, and the next record's
    body = F.btrim(rulers, F.lit(" \t\n\r\x0b\x0c"))
    return IO.read_records(spark, path).select("doc_id", "filename", "pages", "words", F.sha2(body, 256).alias("body"))


@query("""SELECT CASE WHEN doc_id % 3 <> 0 THEN 'X' || doc_id ELSE 'D' || substr(sha256(text), 1, 12) END AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || '.pdf' ELSE '' END AS filename,
  sha256(text) AS sha256, length(text) AS n FROM documents""")
def json_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines, ids and names left out of some, and read again."""
    docs = table(spark, sf_dir, "documents")
    ids, names = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("X"), "doc_id")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), "doc_id", F.lit(".pdf")))
    path = scratch(spark, "json-lines")
    docs.select(F.to_json(F.struct(ids.alias("doc_id"), names.alias("filename"), "text"))).write.option("compression", "gzip").text(path)
    return IO.json_lines(spark, path).select("doc_id", "filename", "sha256", F.length("text").cast("long").alias("n"))


@query("""SELECT 'Sources' AS heading, CAST(row_number() OVER (ORDER BY source) AS INT) AS row, source AS a, CAST(count(*) AS VARCHAR) AS b FROM documents GROUP BY source""")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each source as a Markdown table, and read again without its header."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    body = n.select((F.row_number().over(Window.orderBy("source")) + 2).alias("n"), F.concat(F.lit("| **"), F.col("source"), F.lit("** | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))
    head = spark.createDataFrame([(0, "## Sources"), (1, "| source | documents |"), (2, "|---|---:|")], "n int, line string")
    rows = IO.markdown_rows(head.unionByName(body)).filter("row > 0")
    return rows.select("heading", "row", F.element_at("cells", 1).alias("a"), F.element_at("cells", 2).alias("b"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.event_counts(table(spark, sf_dir, "events"))


@query("""SELECT conv_id, CAST(count(*) AS INT) AS turns, array_to_string(list(role ORDER BY turn), ',') AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS request_sha256 FROM conversations GROUP BY conv_id""")
def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.size("m").alias("turns"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.sha2(F.array_join(F.transform("m", lambda x: x["text"]), "\n"), 256).alias("request_sha256"))


@query("""WITH r AS (SELECT conv_id AS batch, sha256(string_agg(text, chr(10) ORDER BY turn)) AS s FROM conversations GROUP BY conv_id)
SELECT count(*) AS requests, count(*) FILTER (batch % 9 <> 0) AS complete, count(*) FILTER (batch % 9 = 0) = 0 AS open FROM r""")
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered by a stub that leaves every ninth one unfinished."""
    req = conversation_requests(spark, sf_dir).select(F.col("conv_id").alias("batch"), "request_sha256", F.col("roles").alias("prompt"))
    got = req.select("batch", "request_sha256", (F.col("batch") % 9 != 0).alias("done"), F.lit("stop").alias("done_reason"), F.lit("text").alias("response"))
    return IO.completion_gate(req, got)


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.squeeze(F.regexp_replace("html", "<[^>]*>", " ")).alias("body"))
