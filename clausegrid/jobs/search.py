"""Registered queries of the hybrid search and of what is made from its hits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import deliverables, retrieval
from . import derived as D
from .queries import ROW_TEXT, WORD_GRAMS, table
from .registry import query

SETTINGS = replace(retrieval.Settings(), threshold=0.1)
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
QUERY_TEXT = "'IP6' || (s_suppkey % 10) || ' ' || ['ring', 'widget', 'steel gear'][s_suppkey % 3 + 1] || CASE WHEN s_suppkey % 10 = 0 THEN ' LT-' || (s_suppkey % 20 + 101) ELSE '' END"


def ordered_grams(text: str) -> str:
    return f"flatten(list_transform({WORDS.format(text)}, lambda w: {WORD_GRAMS}))"


#: All of the search: semantic pool, both trigram similarities over every run of every text, exact tokens.
POOLS = f"""
WITH c AS (SELECT p_partkey AS chunk_id, p_partkey // 10 + 1000000000 AS parent_id, p_partkey % 5 AS document_id, CASE WHEN p_size % 2 = 0 THEN 'catalog' ELSE 'qa' END AS doc_kind,
    {ROW_TEXT} AS content, 'Catalog > ' || p_type || ' > ' || p_brand AS section_path, p_type || ' ' || p_brand AS location, 'LT-' || (p_size + 100) AS tag, p_size % 10 AS grade, embedding AS e
  FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
q AS (SELECT s_suppkey AS query_id, {QUERY_TEXT} AS text, CASE WHEN s_suppkey % 10 = 0 THEN 'LT-' || (s_suppkey % 20 + 101) WHEN s_suppkey % 10 > 1 THEN 'LT-' || (s_suppkey % 50 + 101) END AS model,
    s_suppkey % 10 AS grade, embedding AS e FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey),
sem AS (SELECT query_id, chunk_id, greatest(0.0, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[]))) AS x FROM q JOIN c ON q.e IS NOT NULL AND c.e IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) <= 40),
asked AS (SELECT text AS probe, len(g) AS n, unnest(g) AS gram FROM (SELECT DISTINCT text, list_distinct({ordered_grams("text")}) AS g FROM q)),
listed AS (SELECT chunk_id, unnest(t) AS gram, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT chunk_id, {ordered_grams("content || ' ' || section_path")} AS t FROM c)),
placed AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY chunk_id, gram ORDER BY pos), 0) AS prev FROM listed),
sizes AS (SELECT chunk_id, count(DISTINCT gram) AS m FROM listed GROUP BY 1),
alike AS (SELECT probe, chunk_id, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS similarity FROM asked JOIN placed USING (gram) JOIN sizes USING (chunk_id) WHERE prev = 0 GROUP BY 1, 2),
extents AS (SELECT b.probe, b.n, b.chunk_id, b.s, p.pos, (p.prev < b.s)::INTEGER AS fresh, (p.prev < b.s AND h.gram IS NOT NULL)::INTEGER AS hit
  FROM (SELECT probe, n, chunk_id, pos AS s FROM asked JOIN placed USING (gram)) b JOIN placed p ON p.chunk_id = b.chunk_id AND p.pos >= b.s LEFT JOIN asked h ON h.probe = b.probe AND h.gram = p.gram),
grown AS (SELECT probe, chunk_id, n, sum(fresh) OVER w AS d, sum(hit) OVER w AS shared FROM extents WINDOW w AS (PARTITION BY probe, chunk_id, s ORDER BY pos ROWS UNBOUNDED PRECEDING)),
word AS (SELECT probe, chunk_id, max(shared::DOUBLE / (n + d - shared)) AS extent FROM grown GROUP BY 1, 2),
kw AS (SELECT probe, chunk_id, greatest(similarity, extent) AS keyword FROM alike JOIN word USING (probe, chunk_id) QUALIFY row_number() OVER (PARTITION BY probe ORDER BY keyword DESC, chunk_id) <= 40),
keys AS (SELECT query_id, chunk_id, max(keyword) AS keyword FROM (SELECT query_id, chunk_id, keyword FROM q JOIN kw ON probe = text UNION ALL SELECT query_id, chunk_id, 1.0 FROM q JOIN c USING (grade)) GROUP BY 1, 2),
fused AS (SELECT query_id, chunk_id, coalesce(x, 0)::DOUBLE AS semantic, coalesce(keyword, 0)::DOUBLE AS keyword, 0.6::DOUBLE * coalesce(x, 0) + 0.4::DOUBLE * coalesce(keyword, 0) AS fused FROM sem FULL JOIN keys USING (query_id, chunk_id)),
"""


def ranked(name: str, model: str = "model", keep: str = "true", fused: str = "fused", threshold: float = 0.1) -> str:
    """The ranked hits as one more common table."""
    return f"""{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
    SELECT query_id, chunk_id, parent_id AS parent_key, document_id, content, location, tag, semantic, keyword,
      round((CASE WHEN {model} IS NULL THEN {fused} WHEN {model} = tag THEN {fused} + 0.1::DOUBLE ELSE ({fused}) * 0.3::DOUBLE END)::DOUBLE, 6) AS score
    FROM fused JOIN c USING (chunk_id) JOIN (SELECT query_id, model FROM q) USING (query_id)
    WHERE {keep} AND score >= {threshold} QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, chunk_id) <= 2)
  QUALIFY rank <= 5)"""


HITS = "query_id, rank, chunk_id, parent_key, score, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword"
PARENTS = f"parents AS (SELECT p_partkey // 10 + 1000000000 AS parent_key, string_agg({ROW_TEXT}, chr(10) ORDER BY p_partkey) AS parent_text FROM part GROUP BY 1 HAVING parent_key % 7 <> 0)"
SNAPSHOT = f"""{ranked("h")}, {PARENTS},
snapshot AS (SELECT query_id, rank, chunk_id, parent_key, r_name AS doc_title, 'R-' || document_id AS doc_no, location, content AS quote, coalesce(parent_text, content) AS parent_content, tag, score,
  round(semantic, 6) AS semantic, round(keyword, 6) AS keyword FROM h LEFT JOIN parents USING (parent_key) LEFT JOIN region ON r_regionkey = document_id)"""


def _hits(spark, sf, doc_kinds=None) -> DataFrame:
    chunks, queries = D.embedded(D.part_chunks(spark, sf), "chunk_id", spark, sf), D.supplier_queries(spark, sf)
    vectors = D.embedded(queries.select("query_id"), "query_id", spark, sf)
    return retrieval.search(queries, chunks, vectors, SETTINGS, doc_kinds)


def _snapshot(spark, sf) -> DataFrame:
    return retrieval.evidence(_hits(spark, sf), D.part_parents(spark, sf), D.region_documents(spark, sf))


@query("hybrid_search", f"{POOLS}{ranked('h')} SELECT {HITS} FROM h")
def hybrid_search(spark, sf):
    """Best evidence rows for every supplier's requirement: vectors, trigrams, exact tokens, models."""
    return _hits(spark, sf).select("query_id", "rank", "chunk_id", "parent_key", "score", "semantic", "keyword")


@query("kind_search", f"{POOLS}{ranked('h', keep=chr(39).join(('doc_kind = ', 'catalog', '')))} SELECT {HITS} FROM h")
def kind_search(spark, sf):
    return _hits(spark, sf, ["catalog"]).select("query_id", "rank", "chunk_id", "parent_key", "score", "semantic", "keyword")


@query("settings_compared", f"""{POOLS}{ranked("a", "NULL")}, {ranked("b")}
SELECT query_id, chunk_id, a.rank AS rank_a, a.score AS score_a, b.rank AS rank_b, b.score AS score_b FROM a FULL JOIN b USING (query_id, chunk_id)""")
def settings_compared(spark, sf):
    """The search without and with its model filters, the pools made once."""
    return retrieval.compared(_settings(spark, sf, {"a": (SETTINGS, False), "b": (SETTINGS, True)}), ["a", "b"])


def _settings(spark, sf, settings) -> DataFrame:
    chunks, queries = D.embedded(D.part_chunks(spark, sf), "chunk_id", spark, sf), D.supplier_queries(spark, sf)
    return retrieval.search_settings(queries, chunks, D.embedded(queries.select("query_id"), "query_id", spark, sf), settings)


KEYWORD_FIRST = "0.3::DOUBLE * semantic + 0.7::DOUBLE * keyword"


@query("weights_compared", f"""{POOLS}{ranked("a")}, {ranked("b", fused=KEYWORD_FIRST, threshold=0.5)}, {ranked("z", "NULL", fused="semantic", threshold=0.2)},
every AS (SELECT 'a' AS setting, * FROM a UNION ALL SELECT 'b', * FROM b UNION ALL SELECT 'c', * FROM z)
SELECT query_id, chunk_id, max(rank) FILTER (setting = 'a') AS rank_a, max(score) FILTER (setting = 'a') AS score_a, max(rank) FILTER (setting = 'b') AS rank_b, max(score) FILTER (setting = 'b') AS score_b,
  max(rank) FILTER (setting = 'c') AS rank_c, max(score) FILTER (setting = 'c') AS score_c FROM every GROUP BY 1, 2""")
def weights_compared(spark, sf):
    """Three settings: the usual one, keywords first under a higher threshold, and vectors alone without models."""
    keyword_first = replace(SETTINGS, semantic_weight=0.3, keyword_weight=0.7, threshold=0.5)
    vectors = replace(SETTINGS, semantic_weight=1.0, keyword_weight=0.0, threshold=0.2)
    return retrieval.compared(_settings(spark, sf, {"a": (SETTINGS, True), "b": (keyword_first, True), "c": (vectors, False)}), ["a", "b", "c"])


@query("evidence_snapshot", f"{POOLS}{SNAPSHOT} SELECT query_id, rank, chunk_id, parent_key, doc_title, doc_no, location, quote, parent_content, tag AS models, score, semantic, keyword FROM snapshot")
def evidence_snapshot(spark, sf):
    return _snapshot(spark, sf).withColumn("models", F.array_join("model_tags", ", ")).drop("model_tags")


@query("judgement_input", f"""{POOLS}{SNAPSHOT},
first AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_key ORDER BY rank) AS n FROM snapshot),
blocks AS (SELECT query_id, count(*) AS k, string_agg('[근거 ' || rank || '] 점수 ' || CAST(CAST(round(CAST(score AS DECIMAL(12, 6)), 2) AS DECIMAL(12, 2)) AS VARCHAR) || ' (의미 ' || CAST(CAST(round(CAST(semantic AS DECIMAL(12, 6)), 2) AS DECIMAL(12, 2)) AS VARCHAR)
  || ' / 키워드 ' || CAST(CAST(round(CAST(keyword AS DECIMAL(12, 6)), 2) AS DECIMAL(12, 2)) AS VARCHAR) || ')' || chr(10) || '문서: ' || doc_title || ' (' || doc_no || ')' || chr(10) || '위치: ' || location || chr(10) || '모델: ' || tag
  || chr(10) || '내용:' || chr(10) || parent_content, chr(10) || chr(10) ORDER BY rank) AS evidence_blocks FROM first WHERE n = 1 GROUP BY 1)
SELECT s_suppkey AS requirement_id, coalesce(k, 0) AS evidence_count, coalesce(evidence_blocks, '') AS evidence_blocks FROM supplier LEFT JOIN blocks ON query_id = s_suppkey""")
def judgement_input(spark, sf):
    return retrieval.judgement_input(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("requirement_id")), _snapshot(spark, sf))


#: The same pools for texts alone: no vectors, no model but one that a text names, and no search for every seventh supplier.
TEXT_POOLS = POOLS.replace("embedding AS e FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey", "CAST(NULL AS FLOAT[]) AS e FROM supplier WHERE s_suppkey % 7 > 0")
TEXT_POOLS = TEXT_POOLS.replace(" WHEN s_suppkey % 10 > 1 THEN 'LT-' || (s_suppkey % 50 + 101) END AS model", " END AS model")
FIRST_QUOTE = f"{TEXT_POOLS}{ranked('h')}, best AS (SELECT query_id, content AS quote FROM h WHERE rank = 1)"


def _asked(spark, sf) -> DataFrame:
    """A named document or clause for each supplier, ten in a project; every seventh is one that no knowledge base holds."""
    k = F.col("s_suppkey")
    name = F.when(k % 7 == 0, "사업자등록증 사본").otherwise(F.col("text"))
    texts = D.supplier_queries(spark, sf).select(F.col("query_id").alias("s_suppkey"), "text")
    return texts.select(F.expr("s_suppkey div 10").alias("project_id"), k.alias("run_id"), k.alias("seq"), name.alias("name"), F.when(k % 3 == 1, "기술사양서 제3장 전체").otherwise("").alias("note"))


@query("searched_submissions", f"""{FIRST_QUOTE}
SELECT s_suppkey // 10 AS project_id, s_suppkey AS seq, CASE WHEN s_suppkey % 7 = 0 THEN 'need' WHEN quote IS NULL OR s_suppkey % 3 = 1 THEN 'uncertain' ELSE 'have' END AS status, quote AS evidence_text
FROM supplier LEFT JOIN best ON query_id = s_suppkey""")
def searched_submissions(spark, sf):
    """The submission list with one search for each item that a knowledge base can hold."""
    items = _asked(spark, sf)
    hits = deliverables.search_each(items, "name", D.part_chunks(spark, sf), SETTINGS)
    return deliverables.submission_checklist(items, hits, D.part_assessments(spark, sf)).select("project_id", "seq", "status", "evidence_text")


@query("searched_eligibility", f"""{FIRST_QUOTE}
SELECT s_suppkey // 10 AS project_id, s_suppkey AS seq, CASE WHEN quote IS NULL THEN 'uncertain' ELSE 'have' END AS status, quote AS evidence_text FROM supplier LEFT JOIN best ON query_id = s_suppkey""")
def searched_eligibility(spark, sf):
    clauses = _asked(spark, sf).select("project_id", "seq", F.col("name").alias("text"))
    hits = deliverables.search_each(clauses, "text", D.part_chunks(spark, sf), SETTINGS)
    return deliverables.eligibility_checklist(clauses, hits).select("project_id", "seq", "status", "evidence_text")


# Evidence of orders: a line item is a hit, its part the chunk, its supplier the parent.
LINE_HITS = """
WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id, l_suppkey AS parent_key, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank FROM lineitem)
"""


def _line_hits(spark, sf) -> DataFrame:
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_suppkey").alias("parent_key"), F.row_number().over(by_line).alias("rank"))


@query("unique_parents", LINE_HITS + "SELECT query_id, parent_key, min(rank) AS best_rank FROM h GROUP BY 1, 2")
def unique_parents(spark, sf):
    return retrieval.unique_parents(_line_hits(spark, sf))


@query("relinked_evidence", LINE_HITS + "SELECT query_id, rank, parent_key, p_partkey AS chunk_id FROM h LEFT JOIN (SELECT p_partkey FROM part WHERE p_size % 3 > 0) ON p_partkey = chunk_id")
def relinked_evidence(spark, sf):
    """Evidence after its chunks were indexed anew without every third size."""
    chunks = table(spark, sf, "part").filter("p_size % 3 > 0").select(F.col("p_partkey").alias("chunk_id"))
    return retrieval.relink(_line_hits(spark, sf), chunks).select("query_id", "rank", "parent_key", "chunk_id")


@query("requirement_probes", """
WITH r AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 = 1 THEN '내' ELSE '' END || p_name || CASE WHEN p_size % 5 = 0 THEN ' LT-' || (p_size + 100) ELSE '' END AS item, p_type AS text, p_size FROM part WHERE p_size % 7 > 0 AND p_size % 11 > 0)
SELECT query_id, item AS text, array_to_string(list_filter([item, item || ' ' || text, CASE WHEN starts_with(item, '내') THEN substr(item, 2) END], lambda x: x IS NOT NULL), ' / ') AS probes,
  CASE WHEN p_size % 3 > 0 THEN 'LT-200' WHEN p_size % 5 = 0 THEN 'LT-' || (p_size + 100) END AS model_filter FROM r""")
def requirement_probes(spark, sf):
    """A requirement for each part; some are inactive or blank, a third are of a category without models."""
    size, k = F.col("p_size"), F.col("p_partkey")
    item = F.concat(F.when(k % 4 == 1, T.RESISTANCE_PREFIX).otherwise(""), "p_name", F.when(size % 5 == 0, F.concat(F.lit(" LT-"), D.s(size + 100))).otherwise(""))
    rows = table(spark, sf, "part").select(k.alias("requirement_id"), F.when(size % 11 == 0, " ").otherwise(item).alias("item"), F.col("p_type").alias("requirement_text"), F.when(size % 3 == 0, "track_record").otherwise("material").alias("category"), (size % 7 > 0).alias("is_active"))
    return retrieval.requirement_queries(rows, "LT-200").withColumn("probes", F.array_join("probes", " / "))
