"""Queries on texts, pages, vocabularies and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import evidence as E
from inkstone.operators import pages as G
from inkstone.operators import relational as R
from inkstone.operators import tokens as K
from inkstone.operators import vocabulary as V
from inkstone.storage import checkpointed, written
from inkstone.plans.catalog import (
    DIMENSIONS, GROUPS, LEXICON, RAW_TOKENS, RULES, STOP, TOKENIZER, TOKENS, doubled, query, r6, raw_tokens, sql_category, sql_count, table, term_counts, texts, token_lists, token_rows,
)

# --- evidence -------------------------------------------------------------------------------

_TOTAL = " + ".join(f"n_{c}" for c in LEXICON)
_TIER = f"CASE WHEN n_offence >= 15 AND n_currency >= 15 THEN 'primary' WHEN {_TOTAL} >= 80 THEN 'high' WHEN {_TOTAL} >= 25 THEN 'context' ELSE 'peripheral' END"
SCORED = f"""
low AS (SELECT doc_id, {doubled('text')} AS low FROM documents),
counted AS (SELECT doc_id, {', '.join(f'{sql_category(c)} AS n_{c}' for c in LEXICON)} FROM low),
scored AS (SELECT *, {_TOTAL} AS total, {_TIER} AS relevance FROM counted)"""
_SENTENCES = rf"""
piece AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), '\n{{2,}}', chr(31), 'g'), chr(31)) AS s FROM documents),
squeezed AS (
  SELECT doc_id, list_filter(list_transform(s, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 70) AS s FROM piece),
sentence AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM squeezed)"""


@query(f"WITH {SCORED} SELECT * FROM scored")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scores(table(spark, sf_dir, "documents"), LEXICON, RULES)


@query(f"""WITH {SCORED}
SELECT count(*) AS documents, {', '.join(f'sum(n_{c}) AS n_{c}' for c in LEXICON)},
  {', '.join(f"count(*) FILTER (relevance = '{t}') AS tier_{t}" for t in ('primary', 'high', 'context', 'peripheral'))} FROM scored""")
def evidence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corpus_statistics(E.scores(table(spark, sf_dir, "documents"), LEXICON, RULES), LEXICON)


_HITS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {i} AS ord, '{t}' AS term, {sql_count(t)} AS n FROM low" for c, ts in LEXICON.items() for i, t in enumerate(ts))


@query(f"""WITH low AS (SELECT doc_id, {doubled('text')} AS low FROM documents), hit AS ({_HITS})
SELECT doc_id, category, term, n, row_number() OVER (PARTITION BY doc_id, category ORDER BY n DESC, ord) AS rank FROM hit WHERE n > 0 QUALIFY rank <= 8""")
def evidence_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_terms(table(spark, sf_dir, "documents"), LEXICON)


_SCORE = " + ".join(f"{sql_category(c)} * {RULES.weights.get(c, 2)} + CASE WHEN {sql_category(c)} > 0 THEN 2 ELSE 0 END" for c in LEXICON)
_SCORE += "".join(f" + CASE WHEN {sql_category(a)} > 0 AND {sql_category(b)} > 0 THEN 3 ELSE 0 END" for a, b in RULES.pairs)


@query(f"""WITH {_SENTENCES},
low AS (SELECT doc_id, pos, substr(sentence, 1, 700) AS excerpt, {doubled('sentence')} AS low FROM sentence),
scored AS (SELECT doc_id, pos, excerpt, {_SCORE} AS score FROM low),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(substr(excerpt, 1, 120)) ORDER BY score DESC, pos) AS k FROM scored WHERE score > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank, score, excerpt FROM best WHERE k = 1 QUALIFY rank <= 7""")
def evidence_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.excerpts(table(spark, sf_dir, "documents"), LEXICON, RULES)


@query(f"WITH {SCORED} SELECT * FROM scored ORDER BY total DESC, doc_id LIMIT 20")
def evidence_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_documents(E.scores(table(spark, sf_dir, "documents"), LEXICON, RULES))


_PATTERNS = {"licence": "licensed? under", "credential": "(token|password|secret)", "year": "19[0-9]{2}|20[0-9]{2}"}
_PATTERN_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, len(regexp_extract_all(text, '(?i){p}')) AS n FROM documents" for k, p in _PATTERNS.items())


@query(f"""WITH hit AS ({_PATTERN_SQL}), few AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM hit WHERE n > 0)
SELECT label, count(*) AS documents, sum(n) AS occurrences, string_agg(CAST(doc_id AS VARCHAR), '; ' ORDER BY doc_id) FILTER (r <= 3) AS examples FROM few GROUP BY label""")
def pattern_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pattern_frequency(table(spark, sf_dir, "documents"), _PATTERNS)


@query()
def evidence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return E.digests(E.scores(docs, LEXICON, RULES), E.top_terms(docs, LEXICON), E.excerpts(docs, LEXICON, RULES), LEXICON)


@query("""SELECT floor((row_number() OVER (ORDER BY doc_id) - 1) / 5) AS batch, doc_id FROM documents""")
def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5).select("batch", "doc_id")


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, (row_number() OVER (ORDER BY doc_id) - 1) // 5 AS batch FROM documents),
p AS (SELECT batch, list(doc_id ORDER BY doc_id) AS members, 'Summarize.' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY doc_id) AS prompt FROM (SELECT batch, doc_id, substr(t, 1, 220) AS t FROM d) GROUP BY batch)
SELECT batch, array_to_string(members, ',') AS members, sha256(prompt) AS request_sha256, ceil(length(prompt) / 2.8) AS budget FROM p""")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.batches(table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("t")), "doc_id", 5)
    out = E.prompts(rows, "t", "Summarize.")
    return out.select("batch", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "request_sha256", T.token_budget(F.col("prompt")).alias("budget"))


@query(r"""WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS response FROM conversations GROUP BY conv_id)
SELECT conv_id, (length(trim(coalesce(response, ''))) > 0) AS complete, CASE WHEN trim(regexp_replace(coalesce(response, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(response, '\s+', ' ', 'g')), ' ')) END AS words FROM t""")
def conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("role") == "assistant", F.col("text")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("turn", "said")))).alias("m"))
    rows = rows.select("conv_id", F.array_join(F.transform("m", lambda x: x["said"]), " ").alias("response"))
    return rows.select("conv_id", T.complete_response(F.lit(True), F.lit("stop"), F.col("response")).alias("complete"), T.count_words(F.col("response")).alias("words"))


# --- scalars --------------------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(text) AS text_hash, sha256(regexp_replace(text, '\s+', '', 'g')) AS body_hash, 'D' || substr(sha256(text), 1, 12) AS key FROM documents""")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("text_hash"), T.body_hash(t).alias("body_hash"), T.document_key(t).alias("key"))


@query(r"""WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM documents)
SELECT doc_id, substr(q, 1, 220) AS preview, substr(trim(regexp_replace(lower(q), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80) AS slug,
  trim(regexp_replace(regexp_replace(regexp_replace(substr(q, 1, 60) || '.pdf', '(?i)\.(pdf|txt|html)$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS title,
  CASE WHEN length(q) <= 40 THEN q ELSE rtrim(CASE WHEN contains(substr(q, 1, 37), ' ') THEN regexp_extract(substr(q, 1, 37), '^(.*) ', 1) ELSE substr(q, 1, 37) END) || '...' END AS label
FROM s""")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.squeeze(F.col("text"))
    title = T.clean_title(F.concat(F.substring(q, 1, 60), F.lit(".pdf")))
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.slug(q).alias("slug"), title.alias("title"), T.short_label(q).alias("label"))


@query(r"""WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS words, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+')) AS alphabetic,
  round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: length(x) > 12)) / len(w) END, 6) AS long_fraction, ceil(length(text) / 2.8) AS budget,
  coalesce(try_cast(trunc(try_cast(regexp_extract(text, '[0-9]+(\.[0-9]+)?') AS DOUBLE)) AS INT), 0) AS first_number
FROM s""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.count_words(t).alias("words"), T.count_alphabetic(t).alias("alphabetic"), r6(T.long_word_fraction(t, 12)).alias("long_fraction"),
        T.token_budget(t).alias("budget"), T.forgiving_int(F.regexp_extract(t, r"[0-9]+(\.[0-9]+)?", 0)).alias("first_number"),
    )


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
  length(replace(html, '</script', '<\/script')) AS safe_length, md5(regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS xml_safe FROM pages""")
def page_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_escape(h)).alias("escaped"), F.length(T.script_safe(h)).alias("safe_length"), F.md5(T.xml_safe(h)).alias("xml_safe"))


@query(f"WITH {_SENTENCES} SELECT doc_id, count(*) AS sentences, sum(length(sentence)) AS characters FROM sentence GROUP BY doc_id")
def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.long_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("characters"))


@query(f"""WITH {RAW_TOKENS}, kept AS (SELECT doc_id, list(token ORDER BY k) AS w FROM raw_token GROUP BY doc_id)
SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS distinct_n, md5(array_to_string(w, ' ')) AS digest FROM kept""")
def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas, stop words gone before and after."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), STOP, lemma=T.noun_lemma()).alias("w")).filter(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct_n"), F.md5(F.array_join("w", " ")).alias("digest"))


_FIRST_SQL = "regexp_replace(lower(text), '[^\\x00-\\x7f]', ' ', 'g')"
for _pattern, _to in (
    (r"\bof\s+the\b", " of_the "), (r"https?://\S+|www\.\S+", " "), (r"\bdoi\s*:\s*\S+", " "), (r"\b[a-z]\s*/\s?[a-z]\b", " "),
    (r"\b\d+(?:\.\d+)?\b", " "), (r"[^a-z_\s''-]", " "),
):
    _FIRST_SQL = f"regexp_replace({_FIRST_SQL}, '{_pattern}', '{_to}', 'g')"


@query(rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all({_FIRST_SQL}, '[a-z][a-z_''-]{{2,}}'), lambda w: trim(w, '_''-')) AS w FROM documents),
n AS (SELECT doc_id, list_transform(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that')), lambda x: trim(replace(x, '-', '_'), '_''')) AS w FROM t),
e AS (SELECT doc_id, list_transform(w, lambda x: CASE x WHEN 'was' THEN 'be' WHEN 'les' THEN 'article' ELSE x END) AS w FROM n),
k AS (SELECT doc_id, list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that')) AS w FROM e)
SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM k""")
def tokenized_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-generation tokenizer with a repair and two entries; what isn't ASCII is a blank first, as word edges of
    the two engines differ beyond it."""
    ascii_only = F.regexp_replace(F.lower("text"), r"[^\x00-\x7f]", " ")
    words = T.tokens_with_aliases(ascii_only, [(r"\bof\s+the\b", " of_the ")], {"was": "be", "les": "article"}, STOP)
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query()
def wrapped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.wrapped(T.preview(F.col("text")), 40), "\n").alias("lines"))


#: Texts with words broken over line ends and soft hyphens, of which the tables have few.
_BROKEN = r"regexp_replace(text, '([A-Za-z]{4})([a-z]{4})', '\1-' || chr(10) || '\2' || chr(173), 'g')"
_JOINED = r"regexp_replace(replace(%s, chr(173), ''), '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g')"


@query(f"SELECT doc_id, {_JOINED % 'text'} AS text, md5({_JOINED % _BROKEN}) AS mended FROM documents")
def joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.regexp_replace("text", "([A-Za-z]{4})([a-z]{4})", "$1-\n$2­")
    return table(spark, sf_dir, "documents").select("doc_id", T.join_hyphens(F.col("text")).alias("text"), F.md5(T.join_hyphens(broken)).alias("mended"))


@query(f"SELECT doc_id, md5({_JOINED % 'text'} || 'fi A 1' || chr(8260) || '2') AS digest FROM documents")
def unicode_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility composition, on texts with a ligature, a wide letter and a fraction put to their end."""
    text = F.concat("text", F.lit("ﬁ Ａ ½"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_unicode(text)).alias("digest"))


_MARKED = r"chr(1) || regexp_replace(lower(text), '([^a-z0-9_])', chr(1) || '\1' || chr(1), 'g') || chr(1)"
_ALIAS = "replace(%s, chr(1) || '%s' || chr(1) || ' ' || chr(1) || 'the' || chr(1), chr(1) || '%s' || chr(1))"


@query(f"SELECT doc_id, md5(replace({_ALIAS % (_ALIAS % (_MARKED, 'of', 'OF_THE'), 'in', 'IN_THE')}, chr(1), '')) AS digest FROM documents")
def alias_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(R.replace_aliases(F.lower("text"), {"of the": "OF_THE", "in the": "IN_THE"})).alias("digest"))


#: Rules and maps for shown terms, each with something in the tables to act on.
_SHOWN = T.DisplayRules(fragments=["zz"], exact=["license"], noise=["page"], stop=["with", "from"], known=["les"], hidden_single=["token"], canonical={"der": "Der", "license": "licence"})
_FAMILIES = {"und": "and", "der": "article", "les": "article"}


@query(f"""WITH {TOKENS}, term AS (SELECT DISTINCT token AS term, trim(replace(token, '_', ' ')) AS raw FROM token),
shown AS (SELECT term, raw, CASE raw WHEN 'der' THEN 'Der' WHEN 'license' THEN 'licence' ELSE raw END AS shown FROM term),
keyed AS (SELECT *, lower(shown) AS key FROM shown)
SELECT term, shown, CASE key WHEN 'und' THEN 'and' WHEN 'der' THEN 'article' WHEN 'les' THEN 'article' ELSE key END AS family,
  NOT (key = '' OR contains(raw, 'zz') OR contains(key, 'zz') OR key = 'license' OR raw = 'license' OR list_contains(string_split(key, ' '), 'page') OR list_contains(string_split(raw, ' '), 'page')
    OR term IN ('with', 'from') OR key IN ('with', 'from') OR len(list_filter(string_split(key, ' '), lambda x: x NOT IN ('with', 'from'))) = 0
    OR (length(key) <= 3 AND key <> 'les') OR (NOT contains(key, ' ') AND key = 'token')) AS displayable
FROM keyed""")
def displayed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = token_rows(spark, sf_dir, False).select(F.col("token").alias("term")).distinct()
    t = F.col("term")
    return terms.select("term", T.readable_term(t, _SHOWN.canonical).alias("shown"), T.family_key(t, _SHOWN.canonical, _FAMILIES).alias("family"), T.displayable(t, _SHOWN).alias("displayable"))


# --- pages ----------------------------------------------------------------------------------

PAGES = """
all_lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
page_line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM all_lines),
page AS (SELECT doc_id, CAST(k // 8 + 1 AS INT) AS page, string_agg(line, chr(10) ORDER BY k) AS text FROM page_line GROUP BY ALL),
line AS (SELECT doc_id, CAST(k // 8 + 1 AS INT) AS page, CAST(k % 8 AS INT) AS line_no, trim(line) AS line FROM page_line)"""
_MARGINS = """
edge AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS u, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS d
  FROM line WHERE line <> ''),
margin AS (
  SELECT e.doc_id, e.line, count(DISTINCT e.page) AS pages FROM edge e JOIN (SELECT doc_id, count(*) AS n FROM page GROUP BY doc_id) t ON t.doc_id = e.doc_id
  WHERE (u <= 2 OR d <= 2) AND length(line) < 150 GROUP BY e.doc_id, e.line, t.n HAVING count(DISTINCT e.page) >= greatest(2, ceil(t.n * 0.4)))"""
_HEADINGS = ("les.", "of.", "un.", "to.")


@query(f"WITH {PAGES} SELECT doc_id, page, CASE WHEN doc_id % 10 = 0 THEN page BETWEEN 2 AND 3 ELSE true END AS inside FROM page")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = docs.filter("doc_id % 10 = 0").select("doc_id", F.lit(2).alias("first_page"), F.lit(3).alias("last_page"))
    return G.page_range(G.as_pages(docs), rules).select("doc_id", "page", "inside")


@query(f"WITH {PAGES} SELECT doc_id, page FROM page WHERE (contains(lower(text), 'thth'))::INT + (contains(lower(text), 'licensed'))::INT + (contains(lower(text), 'und'))::INT + (contains(lower(text), 'que'))::INT >= 2")
def delivery_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = G.as_pages(table(spark, sf_dir, "documents"))
    return pages.filter(G.delivery_cover(F.col("text"), ["thth", "Licensed", "und", "que"])).select("doc_id", "page")


@query(f"WITH {PAGES}, {_MARGINS} SELECT doc_id, line, pages FROM margin")
def repeated_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repeated_margins(G.as_pages(table(spark, sf_dir, "documents")), least=2)


@query(rf"""WITH {PAGES}, {_MARGINS} SELECT l.doc_id, l.page, l.line_no, l.line FROM line l
WHERE NOT EXISTS (SELECT 1 FROM margin m WHERE m.doc_id = l.doc_id AND m.line = l.line) AND NOT regexp_full_match(l.line, '\d{{1,5}}')""")
def without_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.without_margins(G.as_pages(table(spark, sf_dir, "documents")), least=2)


_HEAD_SQL = r"rtrim(lower(regexp_replace(regexp_replace(trim(line), '^[\dIVXivx.\s]+', ''), '\s+', '', 'g')), ':')"


@query(f"""WITH {PAGES},
placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total FROM line),
cut AS (SELECT doc_id, min(page * 100 + line_no) AS place FROM placed WHERE {_HEAD_SQL} IN {_HEADINGS} AND before / greatest(total, 1) >= 0.4 GROUP BY doc_id)
SELECT l.doc_id, count(*) AS lines, sum(length(l.line)) AS characters FROM line l LEFT JOIN cut c ON c.doc_id = l.doc_id WHERE c.place IS NULL OR l.page * 100 + l.line_no < c.place GROUP BY l.doc_id""")
def reference_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.reference_cut(G.as_lines(G.as_pages(table(spark, sf_dir, "documents"))), _HEADINGS)
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query(f"""WITH {PAGES},
begins AS (SELECT p.doc_id, p.line, coalesce(sum(length(p.line) + 1) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM page_line p)
SELECT d.doc_id, min(a.start) FILTER (lower(trim(a.line)) IN {_HEADINGS} AND a.start > length(d.text) * 0.45) AS cut FROM documents d JOIN begins a ON a.doc_id = d.doc_id GROUP BY d.doc_id""")
def reference_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", G.reference_start(F.col("text"), _HEADINGS).alias("cut"))


@query(r"""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN true ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) < 30 END AS few_words,
  length(text) < 100 AS short_page, length(text) < 1000 AS short_document FROM documents""")
def low_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.low_text_flags(table(spark, sf_dir, "documents"))


@query(f"WITH {PAGES}, n AS (SELECT doc_id, count(*) AS pages FROM page GROUP BY doc_id) SELECT doc_id, pages, pages > (SELECT quantile_cont(pages, 0.9) FROM n) AS is_long FROM n")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.long_documents(G.as_pages(table(spark, sf_dir, "documents")))


@query(f"""WITH {raw_tokens(False, False)}
SELECT d.doc_id, count(t.token) AS n_tokens, CASE WHEN count(t.token) < 100 THEN 'error' ELSE 'ok' END AS status FROM documents d LEFT JOIN raw_token t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def token_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.token_gate(table(spark, sf_dir, "documents"))


# --- vocabulary -----------------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT token AS term, count(*) AS tf, count(DISTINCT doc_id) AS df, round(count(*) / (SELECT count(*) FROM token), 6) AS share FROM token GROUP BY token")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.term_frequency(term_counts(spark, sf_dir)).withColumn("share", r6(F.col("share")))


_RATES = """
per_doc AS (SELECT doc_id, token AS term, count(*) AS n FROM token GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS size FROM token GROUP BY doc_id),
rate AS (
  SELECT p.term, sum(p.n) AS total, count(*) AS df, sum(p.n) * 10000 / (SELECT sum(size) FROM size) AS per_10k,
         sum(p.n / s.size) * 10000 / (SELECT count(*) FROM documents) AS mean_per_10k
  FROM per_doc p JOIN size s ON s.doc_id = p.doc_id GROUP BY p.term)"""


@query(f"WITH {TOKENS}, {_RATES} SELECT term, total, df, round(per_10k, 6) AS per_10k, round(mean_per_10k, 6) AS mean_per_10k FROM rate")
def normalized_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.normalized_frequency(term_counts(spark, sf_dir), table(spark, sf_dir, "documents").count())
    return rows.withColumns({c: r6(F.col(c)) for c in ("per_10k", "mean_per_10k")})


_VOCAB = """
vocab AS (
  SELECT token AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM token GROUP BY token HAVING count(DISTINCT doc_id) BETWEEN 2 AND 0.5 * (SELECT count(*) FROM documents)
  ORDER BY df DESC, term LIMIT 500)"""


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vocabulary(term_counts(spark, sf_dir), table(spark, sf_dir, "documents").count(), 2, 0.5, 500)


@query(f"WITH {TOKENS}, {_VOCAB} SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id, tf, df FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


@query(f"WITH {TOKENS}, {_VOCAB} SELECT t.doc_id, count(*) AS tokens, count(v.term) AS known, round(1 - count(v.term) / count(*), 6) AS oov FROM token t LEFT JOIN vocab v ON v.term = t.token GROUP BY t.doc_id")
def vocabulary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [r["term"] for r in _vocab(spark, sf_dir).collect()]  # at most 500
    return K.coverage(texts(spark, sf_dir), TOKENIZER, known).withColumn("oov", r6(F.col("oov")))


_UNITS = """
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM token),
placed AS (SELECT *, pos // 100 AS raw, (n - 1) // 100 AS last FROM sized),
unit AS (SELECT doc_id, pos, token, CAST(least(raw, last - CASE WHEN last > 0 AND n - last * 100 < 30 THEN 1 ELSE 0 END) AS INT) AS unit FROM placed)"""


@query(f"WITH {TOKENS}, {_UNITS} SELECT doc_id, unit, min(pos) AS start_token, max(pos) + 1 AS end_token, count(*) AS tokens FROM unit GROUP BY ALL")
def unit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unit_manifest(V.units(token_rows(spark, sf_dir, False), 100, 30))


@query(f"""WITH {TOKENS}, {_UNITS}, {_VOCAB}, v AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id FROM vocab)
SELECT u.doc_id, u.unit, v.term_id, count(*) AS n FROM unit u JOIN v ON v.term = u.token GROUP BY ALL""")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = checkpointed(_vocab(spark, sf_dir))
    known = [r["term"] for r in vocab.collect()]  # at most 500
    return V.bag_of_words(K.document_counts(texts(spark, sf_dir), TOKENIZER, 100, 30, known), vocab)


@query(f"""WITH {raw_tokens(False, False)},
w AS (SELECT doc_id, w FROM found WHERE len(w) > 0),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS start FROM w)
SELECT doc_id, CAST(start // 80 AS INT) AS unit, len(w[start + 1:start + 90]) AS tokens, md5(array_to_string(w[start + 1:start + 90], ' ')) AS digest FROM s WHERE len(w[start + 1:start + 90]) >= 15""")
def overlapping_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.overlapping_units(table(spark, sf_dir, "documents"), 90, 10, 15)
    return rows.select("doc_id", "unit", F.size("tokens").alias("tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""WITH {PAGES}, numbered AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM page)
SELECT doc_id, page FROM numbered WHERE n <= 3 OR r IN (SELECT unnest([0, (n - 1) // 2, n - 1]))""")
def evenly_spaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.evenly_spaced(G.as_pages(table(spark, sf_dir, "documents")), "doc_id", "page", 3).select("doc_id", "page")


@query(f"""WITH {PAGES} SELECT doc_id, page FROM page QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5('42|' || doc_id || '|' || page), doc_id, page) <= 2""")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hash_sample(G.as_pages(table(spark, sf_dir, "documents")), "doc_id", ["doc_id", "page"], 2).select("doc_id", "page")


_PHRASES = """
pair AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM token),
counted_pair AS (SELECT a, b, count(*) AS n FROM pair WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
single AS (SELECT token, count(*) AS c FROM token GROUP BY token),
phrase AS (
  SELECT p.a, p.b, p.n, (p.n - 5) * (SELECT count(*) FROM single) / (x.c * y.c) AS score
  FROM counted_pair p JOIN single x ON x.token = p.a JOIN single y ON y.token = p.b)"""


@query(f"WITH {TOKENS}, {_PHRASES} SELECT a, b, n, round(score, 6) AS score FROM phrase WHERE score > 2")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.phrase_scores(token_rows(spark, sf_dir), 5, 2.0).withColumn("score", r6(F.col("score")))


def _phrases(n: int, rows: str) -> str:
    """The phrases among the tokens of a table, numbered; and that table with them merged."""
    return f"""
pair{n} AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {rows}),
counted_pair{n} AS (SELECT a, b, count(*) AS n FROM pair{n} WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
single{n} AS (SELECT token, count(*) AS c FROM {rows} GROUP BY token),
phrase{n} AS (
  SELECT p.a, p.b, p.n, (p.n - 5) * (SELECT count(*) FROM single{n}) / (x.c * y.c) AS score
  FROM counted_pair{n} p JOIN single{n} x ON x.token = p.a JOIN single{n} y ON y.token = p.b),
beside{n} AS (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM {rows}),
hit{n} AS (SELECT s.*, p.a IS NOT NULL AS hit FROM beside{n} s LEFT JOIN phrase{n} p ON p.a = s.token AND p.b = s.b AND p.score > 2),
run{n} AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hit{n}),
first{n} AS (SELECT *, hit AND row_number() OVER (PARTITION BY doc_id, hit, run ORDER BY pos) % 2 = 1 AS opens FROM run{n}),
second{n} AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id ORDER BY pos), false) AS closes FROM first{n}),
merged{n} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, CASE WHEN opens THEN token || '_' || b ELSE token END AS token FROM second{n} WHERE NOT closes)"""


@query(f"WITH {TOKENS}, {_phrases(1, 'token')}, {_phrases(2, 'merged1')} SELECT token, count(*) AS n FROM merged2 WHERE contains(token, '_') GROUP BY token")
def merged_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes: pairs, then triples and fours."""
    lists = token_lists(spark, sf_dir)
    bigrams = written(V.merge_lists(lists, V.phrase_scores(V.rows_of(lists), 5, 2.0)), "bigrams")
    merged = V.merge_lists(bigrams, V.phrase_scores(V.rows_of(bigrams), 5, 2.0))
    return merged.select(F.explode("words").alias("token")).filter(F.col("token").contains("_")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS}, {_RATES},
top AS (SELECT term, df FROM rate WHERE df BETWEEN 3 AND 0.9 * (SELECT count(*) FROM documents) ORDER BY round(mean_per_10k, 9) DESC, term LIMIT 40),
has AS (SELECT DISTINCT t.doc_id, t.token FROM token t JOIN top ON top.term = t.token),
joint AS (SELECT x.token AS source, y.token AS target, count(*) AS joint FROM has x JOIN has y ON x.doc_id = y.doc_id AND x.token < y.token GROUP BY ALL),
edge AS (
  SELECT j.source, j.target, j.joint, j.joint / (a.df + b.df - j.joint) AS jaccard, d.n, a.df AS da, b.df AS db
  FROM joint j JOIN top a ON a.term = j.source JOIN top b ON b.term = j.target, (SELECT count(*) AS n FROM documents) d),
rated AS (SELECT *, CASE WHEN joint > 0 AND joint < n THEN ln((joint / n) / ((da / n) * (db / n))) / -ln(joint / n) ELSE 0.0 END AS npmi FROM edge)
SELECT source, target, joint, round(jaccard, 6) AS jaccard, round(npmi, 6) AS npmi FROM rated WHERE joint >= 3 AND jaccard >= 0.05 AND npmi >= 0.05
ORDER BY jaccard DESC, joint DESC, source, target LIMIT 150""")
def keyword_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.keyword_network(token_rows(spark, sf_dir), table(spark, sf_dir, "documents").count())
    return rows.withColumns({"jaccard": r6(F.col("jaccard")), "npmi": r6(F.col("npmi"))})


@query(f"""WITH {TOKENS}, {_UNITS},
top AS (SELECT token FROM token GROUP BY token ORDER BY count(DISTINCT doc_id) DESC, token LIMIT 30),
has AS (SELECT DISTINCT u.doc_id, u.unit, u.token FROM unit u JOIN top ON top.token = u.token)
SELECT x.token AS source, y.token AS target, count(*) AS joint FROM has x JOIN has y ON x.doc_id = y.doc_id AND x.unit = y.unit AND x.token < y.token GROUP BY ALL HAVING count(*) >= 2""")
def unit_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = checkpointed(V.term_frequency(term_counts(spark, sf_dir)).orderBy(F.desc("df"), "term").limit(30).select("term"))
    counts = K.document_counts(texts(spark, sf_dir), TOKENIZER, 100, 30, [r["term"] for r in top.collect()])
    keyed = counts.select(F.struct("doc_id", "unit").alias("key"), "term")
    return V.pair_counts(keyed, "key", top).filter("joint >= 2")


@query()
def keyword_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = V.keyword_network(token_rows(spark, sf_dir), table(spark, sf_dir, "documents").count()).select("source", "target", "jaccard").collect()  # at most 150 rows
    found = V.greedy_communities([tuple(r) for r in edges])
    return spark.createDataFrame(sorted(found.items()), "term string, community int")


# --- groups ---------------------------------------------------------------------------------

_GROUP_HITS = " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS \"group\", " + " + ".join(f"(length(low) - length(replace(low, '{k}', ''))) // {len(k)}" for k in ks) + " AS n FROM (SELECT doc_id, lower(text) AS low FROM documents)"
    for g, ks in GROUPS.items()
)
_FALLBACK = "CASE " + " ".join(f"WHEN {c} = greatest({', '.join(x for x, _ in DIMENSIONS)}) THEN '{g}'" for c, g in DIMENSIONS) + " END"
GROUPED = f"""
matched AS ({_GROUP_HITS}),
ranked AS (SELECT doc_id, "group", n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, "group") AS rank FROM matched WHERE n > 0),
grouped AS (
  SELECT doc_id, rank, "group", n FROM ranked WHERE rank <= 3
  UNION ALL SELECT doc_id, 1, {_FALLBACK}, 1 FROM scored WHERE doc_id NOT IN (SELECT doc_id FROM ranked))"""


@query(f"WITH {SCORED}, {GROUPED} SELECT doc_id, rank, \"group\", n FROM grouped")
def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkstone.operators import graph as H

    docs = table(spark, sf_dir, "documents")
    return H.top_groups(E.scores(docs, LEXICON, RULES), H.keyword_matches(docs, GROUPS, F.col("text")), DIMENSIONS)


@query("""SELECT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)""")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))  # combined before the shuffle, so copies cost a row for each task
    return docs.join(first, "h").select("doc_id", "first_id")
