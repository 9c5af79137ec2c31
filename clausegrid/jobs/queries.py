"""Registered queries of the matching library, each with the DuckDB text that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectorized import group_sentences
from ..operators import admission, chunking, conflicts, deliverables, embedding, evaluation, markdown, page_checks, requirements, retrieval, verdicts
from ..sources import io
from . import derived as D
from .registry import query

table = io.table

# Texts that several SQL forms share.
ROW_TEXT = "p_name || ' — IP6' || (p_size % 10) || ', ' || p_size || ' kg, LT-' || (p_size + 100)"
WORD_GRAMS = "list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS BIGINT), 3))"


def grams(text: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: {WORD_GRAMS})))"


# --- Documents into sections, tables and chunks -------------------------------------------------------------------


@query("md_sections", """
WITH d AS (SELECT p_partkey // 10 AS document_id, count(*) AS n FROM part GROUP BY 1), s AS (
  SELECT document_id, 1 AS section_id, 'Catalog ' || document_id AS heading, 1 AS level, 'Catalog ' || document_id AS path,
         '문서 번호: PC-2025-' || document_id || chr(10) || '기준일: 2025-01-' || lpad(CAST(document_id % 28 + 1 AS VARCHAR), 2, '0') AS text FROM d
  UNION ALL SELECT document_id, 2, 'Models of ' || document_id, 2, 'Catalog ' || document_id || ' > Models of ' || document_id, '' FROM d
  UNION ALL SELECT document_id, 3, 'Notes', 3, 'Catalog ' || document_id || ' > Models of ' || document_id || ' > Notes', 'Ask for prices. Sizes in ' || n || ' rows.' FROM d
) SELECT * FROM s""")  # fmt: skip
def md_sections(spark, sf):
    rows = markdown.with_sections(markdown.document_lines(D.part_documents(spark, sf)))
    return markdown.sections(rows).select("document_id", F.col("section_id").cast("int").alias("section_id"), "heading", "level", chunking.joined_path(F.col("heading_path")).alias("path"), "text")


@query("md_table_rows", """
SELECT p_partkey // 10 AS document_id, 0 AS table_index, CAST(row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS INTEGER) AS row_no,
       p_name AS item, p_brand AS brand, p_size || ' kg' AS weight, 'LT-' || (p_size + 100) AS model FROM part""")
def md_table_rows(spark, sf):
    t = markdown.tables(markdown.with_sections(markdown.document_lines(D.part_documents(spark, sf))))
    rows = t.select("document_id", "table_index", F.posexplode("rows").alias("row_no", "c")).filter("row_no > 0")
    return rows.select("document_id", "table_index", "row_no", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("item", "brand", "weight", "model"))])


@query("md_table_markdown", """
SELECT p_partkey // 10 AS document_id, '| item | brand | weight | model |' || chr(10) || '|---|---|---|---|' || chr(10) ||
  string_agg('| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' kg | LT-' || (p_size + 100) || ' |', chr(10) ORDER BY p_partkey) AS md FROM part GROUP BY 1""")
def md_table_markdown(spark, sf):
    t = markdown.tables(markdown.with_sections(markdown.document_lines(D.part_documents(spark, sf))))
    return t.select("document_id", markdown.table_markdown(F.col("rows")).alias("md"))


@query("md_metadata", """
SELECT DISTINCT p_partkey // 10 AS document_id, 'Catalog ' || p_partkey // 10 AS title, 'PC-2025-' || p_partkey // 10 AS doc_no,
       CAST('2025-01-' || lpad(CAST((p_partkey // 10) % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS revision_date FROM part""")
def md_metadata(spark, sf):
    docs = D.part_documents(spark, sf)
    return markdown.metadata(docs, markdown.document_lines(docs))


def _chunks(spark, sf):
    rows = markdown.with_sections(markdown.document_lines(D.part_documents(spark, sf)))
    return chunking.build_chunks(markdown.sections(rows), markdown.tables(rows))


@query("chunk_rows", """
SELECT document_id, row_no, 'Models of ' || document_id || ' — item: ' || p_name || ', brand: ' || p_brand || ', weight: ' || p_size || ' kg, model: LT-' || (p_size + 100) AS content,
       'Catalog ' || document_id || ' > Models of ' || document_id AS section_path, 'LT-' || (p_size + 100) || ',' || p_size || 'KG' AS keywords, 'LT-' || (p_size + 100) AS model_tags
FROM (SELECT *, p_partkey // 10 AS document_id, CAST(row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS INTEGER) AS row_no FROM part)""")
def chunk_rows(spark, sf):
    rows = _chunks(spark, sf).filter("chunk_type = 'table_row'")
    return rows.select("document_id", "row_no", "content", "section_path", F.array_join("keywords", ",").alias("keywords"), F.array_join("model_tags", ",").alias("model_tags"))


@query("chunk_counts", "SELECT p_partkey // 10 AS document_id, CAST(3 AS BIGINT) AS parents, count(*) + 2 AS children FROM part GROUP BY 1")
def chunk_counts(spark, sf):
    return chunking.chunk_counts(_chunks(spark, sf))


@query("chunk_reindex", "SELECT p_partkey // 10 AS document_id, CAST(count(*) + 5 AS BIGINT) AS n FROM part GROUP BY 1")
def chunk_reindex(spark, sf):
    chunks = _chunks(spark, sf)
    return io.reindexed(chunks, chunks.filter("document_id % 3 = 0")).groupBy("document_id").agg(F.count("*").alias("n"))


@query("index_status", """
SELECT p_partkey // 10 AS document_id, CASE WHEN p_partkey // 10 % 7 = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN p_partkey // 10 % 7 = 0 THEN 0 ELSE count(*) + 5 END AS chunk_count,
  CASE WHEN p_partkey // 10 % 7 = 0 THEN '' ELSE 'hashed' END AS embedding_model, CASE WHEN p_partkey // 10 % 7 = 0 THEN 'no chunks: the document is empty' ELSE '' END AS error_message FROM part GROUP BY 1""")
def index_status(spark, sf):
    return io.index_status(D.part_documents(spark, sf), _chunks(spark, sf).filter("document_id % 7 <> 0"), "hashed")


@query("load_by_doc_no", """
WITH d AS (SELECT DISTINCT p_partkey // 10 AS document_id FROM part)
SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'rejected' ELSE 'loaded' END AS outcome FROM d WHERE document_id % 2 = 0""")
def load_by_doc_no(spark, sf):
    d = D.part_documents(spark, sf).select("document_id", F.concat(F.lit("PC-"), D.s("document_id")).alias("doc_no"))
    new = d.filter("document_id % 2 = 0")
    _, rejected = io.admit_numbers(d.filter("document_id % 4 = 0"), new)
    r = rejected.select("document_id", F.lit(True).alias("r"))
    return new.join(r, "document_id", "left").select("document_id", F.when(F.col("r"), "rejected").otherwise("loaded").alias("outcome"))


@query("child_vectors")
def child_vectors(spark, sf):
    return embedding.embed_children(_chunks(spark, sf), dim=64)


@query("keyword_tokens", f"""
SELECT p_partkey, 'LT-' || (p_size + 100) || ',IP6' || (p_size % 10) || ',' || p_size || 'KG' AS tokens, {ROW_TEXT} AS content FROM part""")
def keyword_tokens(spark, sf):
    return table(spark, sf, "part").withColumn("content", D.row_text()).select("p_partkey", F.array_join(T.keywords(F.col("content")), ",").alias("tokens"), "content")


@query("sentence_counts", r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, sum(CASE WHEN trim(line) = '' THEN 0 ELSE length(regexp_replace(trim(line), '[.!?]\s+', chr(1), 'g')) - length(replace(regexp_replace(trim(line), '[.!?]\s+', chr(1), 'g'), chr(1), '')) + 1 END) AS n FROM l GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, CAST(greatest(1, floor(length(text) / 1.5)) AS INTEGER) AS tokens FROM documents JOIN s USING (doc_id)""")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), T.token_estimate(F.col("text")).alias("tokens"))


@query("sentence_groups")
def sentence_groups(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(group_sentences(T.sentences(F.col("text")))).alias("no", "content"))
    return rows.withColumn("tokens", T.token_estimate(F.col("content")))


@query("admission", """
SELECT page_id, CASE WHEN contains(lower(url || ' ' || substr(html, 1, 500)), 'catalog') THEN 'catalog' ELSE 'other' END AS doc_kind,
       CASE WHEN page_id % 3 = 0 THEN 'suffix' WHEN strlen(html) > 20971520 THEN 'size' WHEN page_id % 3 = 1 THEN 'bid document' END AS reason FROM pages""")
def admission_query(spark, sf):
    p = table(spark, sf, "pages").withColumns({"name": F.concat("url", F.element_at(F.array(F.lit(".html"), F.lit(" 공고 .md"), F.lit(".md")), (F.col("page_id") % 3 + 1).cast("int"))), "text": F.col("html"), "bytes": F.octet_length("html")})
    return admission.admit(p).select("page_id", "doc_kind", "reason")


# --- Checks of extracted tables -----------------------------------------------------------------------------------

CLAUSES = """
WITH p AS (SELECT *, p_partkey // 10 AS document_id, CAST(p_partkey % 10 AS INTEGER) AS k FROM part WHERE p_partkey % 7 <> 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k) AS INTEGER) AS row_no, lag(k) OVER (PARTITION BY document_id ORDER BY k) AS before,
             (document_id % 9 + 1) || '.' || (k + 1) AS clause FROM p)
"""


@query("table_warnings", CLAUSES + """
SELECT document_id, 1 AS page_no, 0 AS table_index, row_no, NULL AS clause_no, 'width' AS kind, 'row has 2 cells, header has 3' AS message FROM r WHERE p_partkey % 13 = 6
UNION ALL SELECT document_id, 1, 0, row_no, clause, 'blank', 'blank cell in limit' FROM r WHERE p_partkey % 11 = 5 AND p_partkey % 13 <> 6
UNION ALL SELECT document_id, 1, 0, row_no, clause, 'gap', (document_id % 9 + 1) || '.' || (before + 1) || ' is followed by ' || clause FROM r WHERE k <> before + 1""")
def table_warnings(spark, sf):
    return page_checks.table_warnings(D.part_tables(spark, sf))


PAGES = """
WITH p AS (SELECT doc_id // 10 AS document_id, 'Notes ' || doc_id // 10 AS title, CAST(doc_id % 10 + 1 AS INTEGER) AS page_no, CASE WHEN doc_id % 10 = 4 THEN ' ' ELSE text END AS text,
  lang, n_chars, doc_id % 3 > 0 AS has_table, doc_id % 3 = 2 AS ragged FROM documents),
m AS (SELECT *, '| lang | chars |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |' || CASE WHEN ragged THEN chr(10) || '| a\\|b |   |' ELSE '' END AS md FROM p)
"""
PAGE_CHARS = "length(replace(text, ' ', '')) + CASE WHEN has_table THEN 9 + length(lang) + length(CAST(n_chars AS VARCHAR)) ELSE 0 END + CASE WHEN ragged THEN 3 ELSE 0 END"


@query("page_stats", PAGES + f"""
SELECT document_id, count(*) AS page_count, count(*) FILTER (has_table) AS table_count, CAST(sum({PAGE_CHARS}) AS BIGINT) AS chars,
       CASE WHEN sum({PAGE_CHARS}) < 50 THEN 'no text' END AS reason FROM p GROUP BY 1""")
def page_stats(spark, sf):
    return page_checks.document_stats(D.document_pages(spark, sf))


@query("page_tables", PAGES + """
SELECT title, CAST(page_no AS BIGINT) AS section_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_no) - 1 AS INTEGER) AS table_index, title || ' > p.' || page_no AS path, md FROM m WHERE has_table""")
def page_tables(spark, sf):
    t = markdown.page_sections(D.document_pages(spark, sf))[1]
    return t.select(F.get("heading_path", F.lit(0)).alias("title"), F.col("section_id").cast("long").alias("section_id"), "table_index", chunking.joined_path(F.col("heading_path")).alias("path"), markdown.table_markdown(F.col("rows")).alias("md"))


@query("page_sections", PAGES + "SELECT document_id, CAST(page_no AS BIGINT) AS section_id, 'p.' || page_no AS heading, 2 AS level, title || ' > p.' || page_no AS path, text FROM p")
def page_sections(spark, sf):
    rows = markdown.page_sections(D.document_pages(spark, sf))[0]
    return rows.select("document_id", F.col("section_id").cast("long").alias("section_id"), "heading", "level", chunking.joined_path(F.col("heading_path")).alias("path"), "text")


@query("prompt_rows", PAGES + """
SELECT document_id, 'note' AS doc_type_label, CASE WHEN document_id % 4 = 0 THEN '(없음)' ELSE 'N-' || document_id END AS doc_no,
  sha256(coalesce(string_agg('[p.' || page_no || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) FILTER (regexp_matches(text, '\\S')), '(표 밖 본문 없음)')) AS body_hash,
  sha256(coalesce(string_agg('[p.' || page_no || ' 표 1]' || chr(10) || md, chr(10) || chr(10) ORDER BY page_no) FILTER (has_table), '(표 없음)')) AS tables_hash FROM m GROUP BY document_id""")
def prompt_rows(spark, sf):
    pages = D.document_pages(spark, sf)
    number = F.when(F.col("document_id") % 4 == 0, "").otherwise(F.concat(F.lit("N-"), D.s("document_id")))
    documents = pages.select("document_id", F.lit("note").alias("doc_type_label"), number.alias("doc_no")).distinct()
    return markdown.prompt_rows(pages, documents).select("document_id", "doc_type_label", "doc_no", F.sha2("body_text", 256).alias("body_hash"), F.sha2("tables_markdown", 256).alias("tables_hash"))


# --- Retrieval ----------------------------------------------------------------------------------------------------


@query("semantic_pool", """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT query_id, vec_id AS chunk_id, greatest(0.0, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x FROM q, embeddings)
SELECT query_id, chunk_id, round(x, 6) AS semantic FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) <= 40""")
def semantic_pool(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.semantic_top(q, c, 40).withColumn("semantic", F.round("semantic", 6))


@query("trigram_pool", f"""
WITH c AS (SELECT p_partkey AS chunk_id, {grams(f"({ROW_TEXT} || ' Catalog > ' || p_type || ' > ' || p_brand)")} AS g FROM part),
q AS (SELECT DISTINCT p_type || ' ' || p_name AS probe FROM part), p AS (SELECT probe, {grams("probe")} AS g FROM q),
cu AS (SELECT chunk_id, len(g) AS n, unnest(g) AS t FROM c), pu AS (SELECT probe, len(g) AS n, unnest(g) AS t FROM p),
s AS (SELECT probe, chunk_id, count(*)::DOUBLE / (any_value(pu.n) + any_value(cu.n) - count(*)) AS similarity FROM pu JOIN cu USING (t) GROUP BY ALL)
SELECT probe, chunk_id, round(similarity, 9) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY probe ORDER BY round(similarity, 12) DESC, chunk_id) <= 40""")
def trigram_pool(spark, sf):
    probes = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("probe")).distinct().withColumn("query_id", F.lit(0))
    return retrieval.trigram_top(probes, D.part_chunks(spark, sf), 40).select("probe", "chunk_id", F.round("similarity", 9).alias("similarity"))


@query("keyword_pool")
def keyword_pool(spark, sf):
    probes = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("probe")).distinct().withColumn("query_id", F.lit(0))
    return retrieval.keyword_top(probes, D.part_chunks(spark, sf), 40)


@query("exact_tokens", "SELECT s_suppkey AS query_id, p_partkey AS chunk_id, 1.0::DOUBLE AS keyword FROM supplier JOIN part ON s_suppkey % 10 = p_size % 10")
def exact_tokens(spark, sf):
    return retrieval.exact_token_hits(D.supplier_queries(spark, sf), D.part_chunks(spark, sf))


def _order_candidates(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tags = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("LT-"), D.s(F.col("p_size") % 4 + 100))))
    model = F.when(F.col("l_orderkey") % 5 > 0, F.concat(F.lit("LT-"), D.s(F.col("l_orderkey") % 4 + 100)))
    score = retrieval.rerank(F.col("l_quantity") / 50, tags, model, retrieval.Settings())
    best = rows.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.col("p_brand").alias("parent_id")).agg(F.max(score).alias("score"))
    return best.withColumn("parent_id", F.expr("CAST(regexp_extract(parent_id, '([0-9]+)', 1) AS LONG)"))


@query("ranked_evidence", """
WITH s AS (
  SELECT l_orderkey AS query_id, l_partkey AS chunk_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS parent_key,
         round(max(CASE WHEN l_orderkey % 5 = 0 OR p_size % 3 = 0 THEN l_quantity / 50 WHEN l_orderkey % 4 = p_size % 4 THEN l_quantity / 50 + 0.1 ELSE l_quantity / 50 * 0.3 END), 6) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
c AS (SELECT * FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id, parent_key ORDER BY score DESC, chunk_id) <= 2)
SELECT query_id, chunk_id, parent_key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5""")
def ranked_evidence(spark, sf):
    return retrieval.diverse_top(_order_candidates(spark, sf), retrieval.Settings()).select("query_id", "chunk_id", "parent_key", "score", "rank")


@query("fused_scores", """
WITH a AS (SELECT doc_id AS chunk_id, quality / 2.0 AS semantic FROM labels), b AS (SELECT doc_id AS chunk_id, toxic * 0.75 AS keyword FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT vec_id + 1000000, 0.25 FROM embeddings)
SELECT CAST(1 AS BIGINT) AS query_id, chunk_id, coalesce(semantic, 0)::DOUBLE AS semantic, coalesce(keyword, 0)::DOUBLE AS keyword, round((0.6 * coalesce(semantic, 0) + 0.4 * coalesce(keyword, 0))::DOUBLE, 6) AS score
FROM (SELECT * FROM a WHERE chunk_id % 3 = 0) a FULL JOIN b USING (chunk_id)""")
def fused_scores(spark, sf):
    lab = table(spark, sf, "labels").select(F.lit(1).cast("long").alias("query_id"), F.col("doc_id").alias("chunk_id"), "quality", "toxic")
    a = lab.filter("chunk_id % 3 = 0").select("query_id", "chunk_id", (F.col("quality") / 2).alias("semantic"))
    b = lab.filter("chunk_id % 2 = 0").select("query_id", "chunk_id", (F.col("toxic") * 0.75).alias("keyword"))
    b = b.unionByName(table(spark, sf, "embeddings").select(F.lit(1).cast("long").alias("query_id"), (F.col("vec_id") + 1000000).alias("chunk_id"), F.lit(0.25).alias("keyword")))
    return retrieval.fuse(a, b, retrieval.Settings()).withColumn("score", F.round("score", 6))


@query("locations", "SELECT p_partkey AS chunk_id, p_type || ' ' || p_brand AS location FROM part")
def locations(spark, sf):
    return D.part_chunks(spark, sf).select("chunk_id", T.location(F.col("section_path")).alias("location"))


@query("tag_filters", "SELECT p_partkey AS chunk_id FROM part WHERE p_size = 7")
def tag_filters(spark, sf):
    return retrieval.tagged(D.part_chunks(spark, sf), has="LT-107", lacks="LT-108").select("chunk_id")


@query("model_hints", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 60 BETWEEN 1 AND 50 THEN 'LT-' || (o_orderkey % 60 + 100) END AS model FROM orders")
def model_hints(spark, sf):
    names = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("LED lamp "), D.s(F.col("o_orderkey") % 60 + 100), F.lit("W class")).alias("item_name"))
    return retrieval.model_hint(names, D.part_chunks(spark, sf))


# --- Requirements -------------------------------------------------------------------------------------------------

RESPONSES = """
WITH e AS (SELECT user_id // 3 AS project_id, event_id AS document_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 2 AS doc_order FROM events WHERE event_id % 97 <> 0),
r AS (SELECT *, (k % 5 + 1) || '.' || (document_id % 12) AS clause_no, event_type AS item FROM e),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY project_id, clause_no, item ORDER BY doc_order, document_id) = 1)
"""
CATEGORY_SQL = "CASE WHEN k % 2 = 0 THEN 'delivery' ELSE 'other' END"


@query("clean_requirements", RESPONSES + f"""
SELECT project_id, document_id, clause_no, item, {CATEGORY_SQL} AS category, CASE WHEN k % 10 = 0 THEN '' ELSE k || ' kg 이하' END AS requirement_text, CASE WHEN k % 3 > 0 THEN k END AS source_page,
       CAST(row_number() OVER (PARTITION BY project_id ORDER BY CAST(split_part(clause_no, '.', 1) AS INTEGER), CAST(split_part(clause_no, '.', 2) AS INTEGER), doc_order, document_id) AS INTEGER) AS "order" FROM u""")
def clean_requirements(spark, sf):
    parsed, _ = requirements.parse_responses(D.event_responses(spark, sf))
    made, _ = requirements.save_requirements(requirements.requirement_rows(parsed))
    return requirements.number_clauses(made).select("project_id", "document_id", "clause_no", "item", "category", "requirement_text", "source_page", "order")


@query("requirement_warnings", RESPONSES + """
SELECT project_id, clause_no, item, 'duplicate' AS kind FROM r QUALIFY row_number() OVER (PARTITION BY project_id, clause_no, item ORDER BY doc_order, document_id) > 1
UNION ALL SELECT project_id, clause_no, item, 'no text' FROM u WHERE k % 10 = 0""")
def requirement_warnings(spark, sf):
    parsed, _ = requirements.parse_responses(D.event_responses(spark, sf))
    return requirements.save_requirements(requirements.requirement_rows(parsed))[1]


@query("rejected_responses", "SELECT user_id // 3 AS project_id, event_id AS document_id, 'not json' AS response FROM events WHERE event_id % 97 = 0")
def rejected_responses(spark, sf):
    return requirements.parse_responses(D.event_responses(spark, sf))[1]


@query("ill_typed_responses", """
WITH e AS (SELECT event_id, user_id // 3 AS project_id, event_id % 8 AS k FROM events WHERE event_id % 97 <> 0)
SELECT event_id AS document_id, CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS requirements, CASE WHEN k = 3 THEN 0 ELSE 1 END AS warnings, CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN '7' ELSE 'T' END AS title,
  CASE WHEN k IN (1, 6) THEN NULL ELSE 3 END AS source_page, CASE WHEN k = 1 THEN NULL WHEN k = 7 THEN '2.5' ELSE 'c' END AS clause_no FROM e""")
def ill_typed_responses(spark, sf):
    """Responses with one field of the wrong type each; all other fields stand."""
    e = D.odd_responses(spark, sf)
    parsed, _ = requirements.parse_responses(e)
    rows = requirements.requirement_rows(parsed)
    first = rows.groupBy("document_id").agg(F.count("*").cast("int").alias("requirements"), F.min_by("source_page", "pos").alias("source_page"), F.min_by("clause_no", "pos").alias("clause_no"))
    said = requirements.document_warnings(e.select("project_id", "document_id", D.s("document_id").alias("original_name")), e.select("document_id"), parsed)
    said = said.groupBy(F.split("message", ":")[0].cast("long").alias("document_id")).agg(F.count("*").cast("int").alias("warnings"))
    title = requirements.scalar(F.try_element_at("r.bid_info", F.lit("title")))
    out = parsed.select("document_id", title.alias("title")).join(first, "document_id", "left").join(said, "document_id", "left")
    return out.fillna(0, ["requirements", "warnings"]).select("document_id", "requirements", "warnings", "title", "source_page", "clause_no")


@query("requirement_counts", RESPONSES + "SELECT project_id, count(*) AS total, count(*) AS active, CAST(0 AS BIGINT) AS graded FROM u GROUP BY 1")
def requirement_counts(spark, sf):
    parsed, _ = requirements.parse_responses(D.event_responses(spark, sf))
    return evaluation.requirement_counts(requirements.save_requirements(requirements.requirement_rows(parsed))[0])


@query("submission_items", """
SELECT user_id // 3 AS project_id, CAST(json_extract(props, '$.k') AS INTEGER) AS seq, event_type AS name FROM events WHERE event_id % 2 = 0 AND event_id % 97 <> 0 AND CAST(json_extract(props, '$.k') AS INTEGER) % 3 > 0
QUALIFY row_number() OVER (PARTITION BY user_id // 3, CAST(json_extract(props, '$.k') AS INTEGER) ORDER BY event_id) = 1""")
def submission_items(spark, sf):
    return requirements.save_submissions(requirements.parse_responses(D.event_responses(spark, sf))[0])[0].select("project_id", "seq", "name")


@query("participation", """
SELECT user_id // 3 AS project_id, 'p' || CAST(json_extract(props, '$.k') AS INTEGER) % 7 AS seq, event_type AS text FROM events WHERE event_id % 2 = 0 AND event_id % 97 <> 0
QUALIFY row_number() OVER (PARTITION BY user_id // 3, CAST(json_extract(props, '$.k') AS INTEGER) % 7 ORDER BY event_id) = 1""")
def participation(spark, sf):
    return requirements.save_participation(requirements.parse_responses(D.event_responses(spark, sf))[0])


FIRST_HEADERS = """
WITH e AS (SELECT user_id // 3 AS project_id, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 97 <> 0),
f AS (SELECT project_id, k FROM e WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY event_id) = 1),
d AS (SELECT project_id, k FROM e WHERE event_id % 2 = 0 AND k % 4 = 1 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY event_id) = 1),
n AS (SELECT project_id, event_id FROM e WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY event_id) = 1)
"""


@query("project_headers", FIRST_HEADERS + """
SELECT c_custkey AS project_id, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE coalesce('T' || f.k, '') END AS title, CASE WHEN f.k IS NOT NULL THEN make_date(2025, 1, CAST(f.k % 28 + 1 AS INTEGER)) END AS announced_on,
  CASE WHEN c_custkey % 3 = 0 THEN make_timestamp(2025, 3, 1, 0, 0, 0) WHEN d.k IS NOT NULL THEN make_timestamp(2025, 2, CAST(d.k % 28 + 1 AS INTEGER), 9, 30, 0) END AS bid_due_at, coalesce('S-' || n.event_id, '') AS spec_doc_no
FROM customer LEFT JOIN f ON f.project_id = c_custkey LEFT JOIN d ON d.project_id = c_custkey LEFT JOIN n ON n.project_id = c_custkey""")
def project_headers(spark, sf):
    parsed, _ = requirements.parse_responses(D.event_responses(spark, sf))
    return requirements.fill_header(D.customer_projects(spark, sf), parsed)[0].select("project_id", "title", "announced_on", "bid_due_at", "spec_doc_no")


@query("header_warnings", """
WITH e AS (SELECT user_id // 3 AS project_id, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 97 <> 0 AND event_id % 2 = 0),
g AS (SELECT project_id, min(event_id) AS since FROM e WHERE k % 4 = 1 GROUP BY 1)
SELECT project_id, 'bid_due_at' AS field, 'soon' AS value FROM e LEFT JOIN g USING (project_id) JOIN customer ON c_custkey = project_id WHERE k % 4 <> 1 AND (since IS NULL OR event_id < since) AND c_custkey % 3 <> 0""")
def header_warnings(spark, sf):
    return requirements.fill_header(D.customer_projects(spark, sf), requirements.parse_responses(D.event_responses(spark, sf))[0])[1]


@query("model_warnings", "SELECT user_id // 3 AS project_id, 'f' || event_id || ': w' || CAST(json_extract(props, '$.k') AS INTEGER) AS message FROM events WHERE event_id % 97 <> 0")
def model_warnings(spark, sf):
    responses = D.event_responses(spark, sf)
    documents = responses.select("project_id", "document_id", F.concat(F.lit("f"), D.s("document_id")).alias("original_name"))
    return requirements.document_warnings(documents, responses.select("document_id"), requirements.parse_responses(responses)[0])


@query("key_audit", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_audit(spark, sf):
    return requirements.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("strict_dates", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 9 HOUR + INTERVAL 5 MINUTE WHEN 2 THEN o_orderdate + INTERVAL 9 HOUR + INTERVAL 5 MINUTE + INTERVAL 7 SECOND END AS parsed FROM orders""")
def strict_dates(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-M-d")
    text = F.element_at(F.array(day, F.concat(day, F.lit(" 9:5")), F.concat(day, F.lit(" 09:05:07")), F.date_format("o_orderdate", "yyyy.MM.dd")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", requirements.strict_time(text).alias("parsed"))


@query("graded_clauses", "SELECT s_suppkey % 9 || '.' || s_suppkey AS clause_no, s_suppkey % 3 = 0 AS is_graded FROM supplier")
def graded_clauses(spark, sf):
    r = table(spark, sf, "supplier").withColumn("clause_no", F.concat(D.s(F.col("s_suppkey") % 9), F.lit("."), D.s("s_suppkey")))
    return requirements.mark_graded(r.select("clause_no"), r.filter("s_suppkey % 3 = 0").select("clause_no"))[0]


@query("edited_requirements", """
SELECT p_partkey AS requirement_id, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_name END AS item, p_partkey % 4 = 0 AND p_type <> p_name AS is_edited, p_name AS ai_item FROM part""")
def edited_requirements(spark, sf):
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("requirement_id"), F.col("p_name").alias("item"), F.lit("").alias("requirement_text"), F.lit("other").alias("category"), F.lit(True).alias("is_active"), F.lit(False).alias("is_edited"), F.col("p_name").alias("ai_item"))
    e = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("requirement_id"), F.col("p_type").alias("item"), F.lit(None).cast("string").alias("requirement_text"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("boolean").alias("is_active"))
    return requirements.overlay_edits(r, e).select("requirement_id", "item", "is_edited", "ai_item")


# --- Verdicts and conflicts ---------------------------------------------------------------------------------------

REPAIRED = """
WITH a AS (SELECT *, doc_id // 50 AS run_id, CASE WHEN doc_id % 17 = 0 THEN 'CHECK' WHEN quality = 1 THEN 'MEET' ELSE 'GAP' END AS v, doc_id % 7 <> 0 AS has_hits FROM labels),
b AS (SELECT *, v = 'MEET' AND NOT has_hits AS bare FROM a)
"""


def _hit_counts(spark, sf):
    return table(spark, sf, "labels").filter("doc_id % 7 <> 0").select(F.expr("doc_id div 50").alias("run_id"), F.col("doc_id").alias("requirement_id"), F.lit(3).alias("hits"))


@query("repaired_verdicts", REPAIRED + """
SELECT run_id, doc_id AS requirement_id, CASE WHEN bare OR doc_id % 13 = 0 OR (v = 'MEET' AND doc_id % 5 = 0) THEN 'CHECK' ELSE v END AS ai_verdict,
       CASE WHEN bare OR doc_id % 13 = 0 THEN 'not_found' ELSE 'found_sufficient' END AS evidence_state,
       CASE WHEN bare THEN '[자동 보정] 근거가 없어 확인 필요로 조정함. why' ELSE 'why' END AS rationale, CASE WHEN doc_id % 15 <= 10 THEN (doc_id % 15) / 10.0::DOUBLE END AS confidence FROM b""")
def repaired_verdicts(spark, sf):
    return verdicts.repair(D.label_assessments(spark, sf), _hit_counts(spark, sf)).select("run_id", "requirement_id", "ai_verdict", "evidence_state", "rationale", "confidence")


@query("cited_evidence", REPAIRED + """
, f AS (SELECT run_id, doc_id AS requirement_id, CASE WHEN bare OR doc_id % 13 = 0 OR (v = 'MEET' AND doc_id % 5 = 0) THEN 'CHECK' ELSE v END AS fv FROM b)
SELECT run_id, requirement_id, CAST(rank AS INTEGER) AS rank FROM f, range(1, 4) t(rank) WHERE requirement_id % 7 <> 0
  AND CASE WHEN requirement_id % 5 = 0 THEN fv <> 'CHECK' AND rank = 1 ELSE rank = 1 OR rank = requirement_id % 3 + 1 END""")
def cited_evidence(spark, sf):
    fixed = verdicts.repair(D.label_assessments(spark, sf), _hit_counts(spark, sf))
    hits = _hit_counts(spark, sf).select("run_id", "requirement_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))
    return verdicts.cited_evidence(fixed, hits)


@query("bare_meets", "SELECT doc_id // 50 AS run_id, doc_id AS requirement_id FROM labels WHERE quality = 1 AND doc_id % 17 <> 0 AND doc_id % 7 = 0")
def bare_meets(spark, sf):
    return verdicts.meet_without_evidence(D.label_assessments(spark, sf), _hit_counts(spark, sf)).select("run_id", "requirement_id")


@query("run_status", "SELECT doc_id // 50 AS run_id, avg((doc_id % 19 = 0)::INTEGER)::DOUBLE AS failed_share, CASE WHEN avg((doc_id % 19 = 0)::INTEGER) > 0.3 THEN 'failed' ELSE 'done' END AS status FROM labels GROUP BY 1")
def run_status(spark, sf):
    return verdicts.run_status(D.label_assessments(spark, sf))


@query("scoped_records", """
WITH n AS (SELECT c_mktsegment AS sector, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT s_suppkey AS requirement_id, sector, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= s_suppkey * 200 THEN 'MEET' ELSE 'GAP' END AS verdict
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 'NONE' ELSE c_mktsegment END AS sector FROM supplier JOIN customer ON c_custkey = s_suppkey) LEFT JOIN n USING (sector)""")
def scoped_records(spark, sf):
    c = table(spark, sf, "customer")
    records = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("Records > "), "c_mktsegment").alias("section_path"))
    wanted = table(spark, sf, "supplier").join(c, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("requirement_id"), (F.col("s_suppkey") * 200).alias("minimum"), F.when(F.col("s_suppkey") % 10 == 9, "NONE").otherwise(F.col("c_mktsegment")).alias("sector"))
    return verdicts.scoped_counts(records, wanted).select("requirement_id", "sector", "n", "verdict")


@query("parsed_limits", """
SELECT p_partkey, p_size * 1000.5::DOUBLE AS value, 'kg' AS unit, CASE p_size % 5 WHEN 0 THEN '<=' WHEN 1 THEN '>=' WHEN 2 THEN '<' WHEN 3 THEN '>' ELSE 'range' END AS op,
       CASE p_size % 5 WHEN 1 THEN p_size WHEN 3 THEN p_size WHEN 4 THEN p_size END::DOUBLE AS lo, CASE p_size % 5 WHEN 0 THEN p_size WHEN 2 THEN p_size WHEN 4 THEN p_size + 10 END::DOUBLE AS hi,
       CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS violated FROM part""")
def parsed_limits(spark, sf):
    n = D.s("p_size")
    limit = F.element_at(F.array(F.concat(n, F.lit(" kg 이하")), F.concat(n, F.lit(" kg 이상")), F.concat(n, F.lit("kg 미만")), F.concat(n, F.lit("kg 초과")), F.concat(n, F.lit(" ~ "), D.s(F.col("p_size") + 10), F.lit(" kg"))), F.col("p_size") % 5 + 1)
    value = F.concat(F.format_number(F.col("p_size") * 1000.5, 1), F.lit(" kg"))
    rows = table(spark, sf, "part").select("p_partkey", conflicts.parse_value(value).alias("v"), conflicts.parse_constraint(limit).alias("c"))
    return rows.select("p_partkey", "v.value", "v.unit", "c.op", "c.lo", "c.hi", conflicts.violates(F.col("v.value"), F.col("c")).alias("violated"))


@query("limit_intervals", """
WITH x AS (SELECT p_partkey, p_size AS n, CAST(p_partkey % 3 AS INTEGER) AS k FROM part)
SELECT p_partkey, 'kg' AS unit, '<=' AS op, NULL::DOUBLE AS lo, (n % 7 + 20)::DOUBLE AS hi, 25 > n % 7 + 20 AS broken FROM x WHERE k = 0
UNION ALL SELECT p_partkey, '℃', 'range', n::DOUBLE, (n + 30)::DOUBLE, 25 < n OR 25 >= n + 30 FROM x WHERE k = 0
UNION ALL SELECT p_partkey, '℃', 'range', -n::DOUBLE, 20::DOUBLE, true FROM x WHERE k = 1
UNION ALL SELECT p_partkey, '주', '>', n::DOUBLE, NULL, 25 <= n FROM x WHERE k = 2""")
def limit_intervals(spark, sf):
    """Texts that name several numbers: limits of two units, one unit limited from both sides, a span below zero."""
    n, k = D.s("p_size"), F.col("p_partkey") % 3
    two = F.concat(F.lit("50 W 등기구, 무게 "), D.s(F.col("p_size") % 7 + 20), F.lit(" kg 이하, "), n, F.lit("℃ 이상 "), D.s(F.col("p_size") + 30), F.lit("℃ 미만"))
    text = F.when(k == 0, two).when(k == 1, F.concat(F.lit("영하 "), n, F.lit(" ~ 20℃, 100 W"))).otherwise(F.concat(F.lit("5 kg 기준 "), n, F.lit("주 초과")))
    units = F.when(k == 0, F.array(F.lit("kg"), F.lit("℃"))).when(k == 1, F.array(F.lit("℃"))).otherwise(F.array(F.lit("주")))
    rows = table(spark, sf, "part").select("p_partkey", text.alias("text"), F.explode(units).alias("unit"))
    rows = rows.withColumn("c", conflicts.parse_constraint(F.col("text"), F.col("unit")))
    return rows.select("p_partkey", "c.unit", "c.op", "c.lo", "c.hi", conflicts.violates(F.lit(25.0), F.col("c")).alias("broken"))


@query("side_effect_issues", """
SELECT p_partkey AS run_id, ['3.1', '3.2'] AS clause_nos, 'high' AS severity, 'housing → 3.2' AS title, (p_size + p_size % 5)::DOUBLE AS value FROM part
WHERE p_size % 10 <> 0 AND p_size + p_size % 5 > p_size % 7 + 20""")
def side_effect_issues(spark, sf):
    return conflicts.side_effect_issues(D.part_assessments(spark, sf))[0].select("run_id", "clause_nos", "severity", "title", "value")


@query("effects_for_review", "SELECT p_partkey AS run_id, '3.1' AS from_clause, '3.2' AS clause_no, 'weight' AS field, 'kg' AS unit FROM part WHERE p_size % 10 = 0")
def effects_for_review(spark, sf):
    return conflicts.side_effect_issues(D.part_assessments(spark, sf))[1]


@query("lead_time_issues", """
SELECT p_partkey AS run_id, ['3.1'] AS clause_nos, CASE WHEN 45 + p_size % 4 * 7 > 60 THEN 'high' ELSE 'medium' END AS severity, (45 + p_size % 4 * 7)::DOUBLE AS total FROM part""")
def lead_time_issues(spark, sf):
    terms = table(spark, sf, "part").select(F.col("p_partkey").alias("run_id"), F.lit("45일").alias("base_text"), F.lit("계약체결일로부터 60일 이내").alias("limit_text"))
    return conflicts.lead_time_issues(D.part_assessments(spark, sf), terms).select("run_id", "clause_nos", "severity", "total")


# --- Scores and deliverables --------------------------------------------------------------------------------------


@query("verdict_summary", """
SELECT doc_id // 50 AS run_id, count(*) FILTER (quality = 1 AND doc_id % 17 <> 0) AS "MEET", count(*) FILTER (quality = 0 AND doc_id % 17 <> 0) AS "GAP", CAST(0 AS BIGINT) AS "CHECK", count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS graded_total FROM labels GROUP BY 1""")
def verdict_summary(spark, sf):
    rows = D.label_assessments(spark, sf).withColumns({"is_active": F.lit(True), "is_graded": F.col("requirement_id") % 3 == 0})
    return evaluation.run_summary(rows)


@query("token_usage", "SELECT user_id AS run_id, event_id // 8 AS part, CAST(count(*) AS INTEGER) AS calls, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 7) AS BIGINT) AS completion_tokens FROM events GROUP BY 1, 2")
def token_usage(spark, sf):
    call = F.struct(F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    part = F.floor(F.col("event_id") / 8).alias("part")  # eight events at most, so that no array grows with the table
    runs = table(spark, sf, "events").groupBy(F.col("user_id").alias("user"), part).agg(F.collect_list(call).alias("llm_calls"))
    return evaluation.token_usage(runs.withColumn("run_id", F.struct("user", "part"))).select("run_id.user", "run_id.part", "calls", "prompt_tokens", "completion_tokens").withColumnRenamed("user", "run_id")


@query("project_list", """
WITH r AS (SELECT o_custkey AS project_id, count(*) AS document_count, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS last, bool_or(o_orderstatus = 'P') AS has_active FROM orders GROUP BY 1)
SELECT c_custkey AS project_id, coalesce(document_count, 0) AS document_count, coalesce(document_count, 0) AS requirement_count, last.k AS latest_run, coalesce(has_active, false) AS has_active FROM customer LEFT JOIN r ON c_custkey = project_id""")
def project_list(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"))
    return evaluation.project_list(p, o, o, o).select("project_id", "document_count", "requirement_count", "latest_run", "has_active")


@query("run_durations", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 9 > 0 THEN CAST((o_orderkey % 100) * 1000 AS BIGINT) END AS duration_ms FROM orders")
def run_durations(spark, sf):
    started = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate"))
    later = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 100 * 1000)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), evaluation.elapsed_ms(started, F.when(F.col("o_orderkey") % 2 == 0, later), later).alias("duration_ms"))


def _graded(spark, sf):
    lab = table(spark, sf, "labels")
    code = lambda c: F.when(F.col(c) == 1, "MEET").otherwise("GAP")
    key = lab.select(D.s("doc_id").alias("clause_no"), code("quality").alias("expected_verdict"))
    got = lab.filter("doc_id % 10 <> 0").select(D.s("doc_id").alias("clause_no"), F.when(F.col("toxic") == 1, "GAP").otherwise("MEET").alias("ai_verdict"))
    return evaluation.graded(key, got)


@query("accuracy", "SELECT count(*) FILTER (doc_id % 10 <> 0 AND quality = 1 - toxic) AS correct, count(*) AS total, count(*) FILTER (doc_id % 10 <> 0 AND quality = 1 - toxic)::DOUBLE / count(*) AS ratio FROM labels")
def accuracy(spark, sf):
    return evaluation.accuracy(_graded(spark, sf))


RUN_GRADES = """
WITH a AS (SELECT doc_id, doc_id // 50 AS run_id, doc_id % 10 AS item, quality FROM labels),
k AS (SELECT DISTINCT item, CASE WHEN item % 2 = 0 THEN 'MEET' ELSE 'GAP' END AS expected_verdict FROM a),
g AS (SELECT run_id, item, min(CASE WHEN quality = 1 THEN 'MEET' ELSE 'GAP' END) AS actual FROM a GROUP BY 1, 2),
x AS (SELECT run_id, item, expected_verdict, coalesce(actual, 'missing') AS actual, coalesce(actual = expected_verdict, false) AS is_match
  FROM (SELECT DISTINCT run_id FROM a) JOIN k ON true LEFT JOIN g USING (run_id, item))
"""


def _run_grades(spark, sf):
    """A key of ten clauses without runs, and the verdicts of every run on some of them."""
    lab, item = table(spark, sf, "labels"), F.col("doc_id") % 10
    key = lab.select(item.alias("item")).distinct().select(D.s("item").alias("clause_no"), F.when(F.col("item") % 2 == 0, "MEET").otherwise("GAP").alias("expected_verdict"))
    got = lab.select(F.expr("doc_id div 50").alias("run_id"), D.s(item).alias("clause_no"), F.when(F.col("quality") == 1, "MEET").otherwise("GAP").alias("ai_verdict"))
    return evaluation.graded(key, got)


@query("run_accuracy", RUN_GRADES + "SELECT run_id, count(*) FILTER (is_match) AS correct, count(*) AS total, count(*) FILTER (is_match)::DOUBLE / count(*) AS ratio FROM x GROUP BY 1")
def run_accuracy(spark, sf):
    return evaluation.accuracy(_run_grades(spark, sf))


@query("run_confusion", RUN_GRADES + "SELECT run_id, expected_verdict, actual, count(*) AS n FROM x WHERE NOT is_match GROUP BY ALL")
def run_confusion(spark, sf):
    return evaluation.confusion(_run_grades(spark, sf))


@query("accuracy_per_verdict", "SELECT CASE WHEN quality = 1 THEN 'MEET' ELSE 'GAP' END AS expected_verdict, count(*) AS expected, count(*) FILTER (doc_id % 10 <> 0 AND quality = 1 - toxic) AS correct FROM labels GROUP BY 1")
def accuracy_per_verdict(spark, sf):
    return evaluation.per_verdict(_graded(spark, sf))


@query("confusion", """
SELECT CASE WHEN quality = 1 THEN 'MEET' ELSE 'GAP' END AS expected_verdict, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN toxic = 1 THEN 'GAP' ELSE 'MEET' END AS actual, count(*) AS n
FROM labels WHERE doc_id % 10 = 0 OR quality <> 1 - toxic GROUP BY 1, 2""")
def confusion(spark, sf):
    return evaluation.confusion(_graded(spark, sf))


@query("evidence_rate", """
SELECT doc_id // 50 AS run_id, avg((doc_id % 7 <> 0)::INTEGER)::DOUBLE AS evidence_rate, count(*) FILTER (quality = 1 AND doc_id % 7 = 0) AS bare_meets FROM labels WHERE doc_id % 17 <> 0 GROUP BY 1""")
def evidence_rate(spark, sf):
    return evaluation.evidence_rate(D.label_assessments(spark, sf), _hit_counts(spark, sf))


@query("value_checks", "SELECT p_partkey, true AS has_any, p_size <> 7 AS has_none FROM part")
def value_checks(spark, sf):
    value = F.concat(F.format_number(F.col("p_size") * 1000, 0), F.lit(" lm"))
    return table(spark, sf, "part").select("p_partkey", evaluation.contains_any(value, F.array(F.lit("nothing"), D.s(F.col("p_size") * 1000))).alias("has_any"), evaluation.contains_none(F.concat(F.lit("="), value), F.array(F.lit("=7,000"))).alias("has_none"))


@query("compliance_matrix", """
WITH a AS (SELECT p_partkey AS run_id, p_size, p_type, p_brand, p_name, '3.1' AS clause_no, CAST(1 AS INTEGER) AS no, '등급' AS category, 'IP65' AS our_value, CASE WHEN p_size % 3 = 0 THEN '확인 필요' ELSE '보완 필요' END AS verdict, 'one grade short' AS reason,
    'housing (무게 +' || (p_size % 5) || 'kg, 납기 +' || (p_size % 4) || '주)' AS remedy FROM part
  UNION ALL SELECT p_partkey, p_size, p_type, p_brand, p_name, '3.2', 2, '제품 치수', p_size || CASE WHEN p_size % 10 = 0 THEN ' mm' ELSE ' kg' END, '충족', 'fits', '' FROM part)
SELECT run_id, no, clause_no, category, our_value, verdict, reason, remedy, CASE WHEN p_size % 4 = 0 OR clause_no = '3.2' THEN '-' WHEN p_size % 2 = 0 THEN 'Catalog ' || p_type ELSE 'Catalog ' || p_type || ' (' || p_brand || ')' END AS evidence_document,
  CASE WHEN p_size % 4 = 0 OR clause_no = '3.2' THEN '-' ELSE p_name END AS evidence_location, CASE WHEN p_size % 10 <> 0 AND p_size + p_size % 5 > p_size % 7 + 20 THEN '이슈 1' ELSE '' END AS notes FROM a""")
def compliance_matrix(spark, sf):
    a = D.part_assessments(spark, sf)
    issues = conflicts.side_effect_issues(a)[0].withColumn("is_dismissed", F.lit(False))
    req = a.select("requirement_id", "clause_no", "chapter", "category", "item", "requirement_text").withColumns({"is_active": F.lit(True), "is_edited": F.lit(False)})
    rows = a.select("run_id", "requirement_id", "our_value", "verdict", "gap_detail", "rationale", "remedy", "side_effects")
    return deliverables.compliance_matrix(req, rows, D.part_evidences(spark, sf), issues).select("run_id", "no", "clause_no", "category", "our_value", "verdict", "reason", "remedy", "evidence_document", "evidence_location", "notes")


@query("issue_block", """
SELECT p_partkey AS run_id, 1 AS no, '[1] 조항 3.1, 3.2 — housing → 3.2' AS head FROM part WHERE p_size % 10 <> 0 AND p_size + p_size % 5 > p_size % 7 + 20""")
def issue_block(spark, sf):
    issues = conflicts.side_effect_issues(D.part_assessments(spark, sf))[0].withColumn("is_dismissed", F.lit(False))
    return deliverables.issue_block(issues).select("run_id", "no", F.element_at(F.split("line", "\n"), 1).alias("head"))


@query("submission_checklist", """
SELECT CAST(1 AS BIGINT) AS project_id, p_partkey AS run_id, p_partkey % 3 AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'need' WHEN p_partkey % 3 = 1 THEN 'uncertain' ELSE 'have' END AS status FROM part""")
def submission_checklist(spark, sf):
    k = F.col("p_partkey")
    names = F.array(F.lit("사업자등록증 사본"), F.lit("시험성적서"), F.lit("제품 카탈로그"))
    items = table(spark, sf, "part").select(F.lit(1).cast("long").alias("project_id"), k.alias("run_id"), (k % 3).alias("seq"), F.element_at(names, (k % 3 + 1).cast("int")).alias("name"), F.when(k % 3 == 1, "기술사양서 제3장 전체").otherwise("").alias("note"))
    hits = items.select("project_id", "seq").distinct().withColumns({"rank": F.lit(1), "quote": F.lit("q")})
    return deliverables.submission_checklist(items, hits, D.part_assessments(spark, sf)).select("project_id", "run_id", "seq", "status")


@query("inconsistent_pairs", "SELECT p_partkey AS run_id, '3.1' AS clause_a, '3.2' AS clause_b, CASE WHEN p_size % 3 = 0 THEN 'CHECK' ELSE 'GAP' END AS verdict_a, 'MEET' AS verdict_b FROM part")
def inconsistent_pairs(spark, sf):
    a = D.part_assessments(spark, sf)
    pairs = a.groupBy("run_id").agg(F.min("clause_no").alias("clause_a"), F.max("clause_no").alias("clause_b")).select("clause_a", "clause_b").distinct()
    return evaluation.inconsistent_pairs(a, pairs).select("run_id", "clause_a", "clause_b", "verdict_a", "verdict_b")


@query("inquiries", """
WITH i AS (SELECT p_partkey, p_size, p_size % 10 <> 0 AND p_size + p_size % 5 > p_size % 7 + 20 AS clash FROM part)
SELECT p_partkey AS run_id, 1 AS seq, ['3.1'] AS clause_refs, 'check' AS source_kind FROM i WHERE p_size % 3 = 0 AND NOT clash
UNION ALL SELECT p_partkey, 1, ['3.1', '3.2'], 'cross_clause' FROM i WHERE clash
UNION ALL SELECT p_partkey, 1, ['3.1'], 'gap_remedy' FROM i WHERE p_size % 3 <> 0 AND NOT clash""")
def inquiries(spark, sf):
    a = D.part_assessments(spark, sf)
    issues = conflicts.side_effect_issues(a)[0].withColumn("is_dismissed", F.lit(False))
    return deliverables.inquiries(a, issues).select("run_id", "seq", "clause_refs", "source_kind")


@query("schedule", """
SELECT o_orderkey AS project_id, 'bid_due_at' AS event, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-01-01' THEN '마감' ELSE 'D-' || date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) END AS "left" FROM orders""")
def schedule(spark, sf):
    none = F.lit(None).cast("timestamp")
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"), none.alias("inquiry_due_at"), F.col("o_orderdate").alias("bid_due_at"), none.alias("opening_at"))
    return deliverables.schedule(p, F.lit("1998-01-01").cast("date")).select("project_id", "event", "left")


@query("prompt_versions", "SELECT doc_id, 'sha1:' || substr(sha1(text), 1, 12) AS version FROM documents")
def prompt_versions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", deliverables.prompt_version(F.col("text")).alias("version"))
