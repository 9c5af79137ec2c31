"""Registered queries of single steps on documents, chunks and their tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import admission, chunking, embedding, markdown, page_checks
from ..sources import index, io, store
from . import derived as D
from .queries import _chunks, table
from .registry import query

DOCUMENTS = """
WITH d AS (SELECT p_partkey // 10 AS document_id, count(*) AS n, '| item | brand | weight | model |' || chr(10) || '|---|---|---|---|' || chr(10) ||
  string_agg('| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' kg | LT-' || (p_size + 100) || ' |', chr(10) ORDER BY p_partkey) AS md FROM part GROUP BY 1),
t AS (SELECT document_id, 1 AS section_id, 'text' AS chunk_type, 'Catalog ' || document_id AS path, 'Catalog ' || document_id AS heading,
         '문서 번호: PC-2025-' || document_id || chr(10) || '기준일: 2025-01-' || lpad(CAST(document_id % 28 + 1 AS VARCHAR), 2, '0') AS content FROM d
  UNION ALL SELECT document_id, 2, 'table', 'Catalog ' || document_id || ' > Models of ' || document_id, 'Models of ' || document_id, md FROM d
  UNION ALL SELECT document_id, 3, 'text', 'Catalog ' || document_id || ' > Models of ' || document_id || ' > Notes', 'Notes', 'Ask for prices. Sizes in ' || n || ' rows.' FROM d)
"""


@query("parent_chunks", DOCUMENTS + """
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_id) AS INTEGER) AS place, chunk_type, path AS section_path, heading, content, CAST(greatest(1, floor(length(content) / 1.5)) AS INTEGER) AS token_count FROM t""")
def parent_chunks(spark, sf):
    """Parents of all documents in their order."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section_id", "kind_order", "table_index", "part"))
    return _chunks(spark, sf).filter("is_parent").select("document_id", place.alias("place"), "chunk_type", "section_path", "heading", "content", "token_count")


@query("text_chunks", DOCUMENTS + """
SELECT document_id, section_path, replace(content, chr(10), ' ') AS content, content AS parent_content FROM (SELECT document_id, path AS section_path, content FROM t WHERE chunk_type = 'text')""")
def text_chunks(spark, sf):
    """Text children next to their parents' texts."""
    chunks = _chunks(spark, sf)
    parents = chunks.filter("is_parent").select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    return chunks.filter("NOT is_parent AND row_no > 0 AND chunk_type = 'text'").join(parents, "parent_id").select("document_id", "section_path", "content", "parent_content")


@query("embedding_inputs", """
SELECT p_partkey AS chunk_id, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || chr(10) END || p_name AS input FROM part""")
def embedding_inputs(spark, sf):
    path = F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, "")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), chunking.embedding_input(path, F.col("p_name")).alias("input"))


@query("wrong_vectors", "SELECT vec_id AS chunk_id FROM embeddings WHERE (vec_id % 5 > 0 AND (vec_id % 7 = 0 OR vec_id % 11 = 0)) OR (vec_id % 5 = 0 AND vec_id % 7 > 0)")
def wrong_vectors(spark, sf):
    """Parents with a vector, children without one or with one that is too short."""
    k = F.col("vec_id")
    vector = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    rows = table(spark, sf, "embeddings").select(k.alias("chunk_id"), (k % 5 == 0).alias("is_parent"), vector.alias("embedding"))
    return embedding.wrong_vectors(rows, 64).select("chunk_id")


@query("long_sections", r"""
WITH s AS (SELECT doc_id AS document_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents WHERE text <> ''),
p AS (SELECT *, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '\S')) AS ps FROM s),
h AS (SELECT *, floor(length(text) / 1.5) > 1200 AND len(ps) > 1 AS halved FROM p)
SELECT document_id, 0 AS part, 'S' || CASE WHEN halved THEN ' (1/2)' ELSE '' END AS section_path, md5(CASE WHEN halved THEN array_to_string(ps[1:len(ps) // 2], chr(10) || chr(10)) ELSE text END) AS content FROM h
UNION ALL SELECT document_id, 1, 'S (2/2)', md5(array_to_string(ps[len(ps) // 2 + 1:], chr(10) || chr(10))) FROM h WHERE halved""")
def long_sections(spark, sf):
    """Every document as one section whose sentences are paragraphs; over-long ones in halves."""
    text = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("section_id"), F.lit("S").alias("heading"), F.array(F.lit("S")).alias("heading_path"), text.alias("text"))
    return chunking.text_parents(rows).select("document_id", "part", "section_path", F.md5("content").alias("content"))


@query("chunk_listing", "SELECT p_partkey // 10 AS document_id, count(*) AS rows, count(*) + 2 AS children, 3 AS parents FROM part WHERE p_partkey // 10 = 3 GROUP BY 1")
def chunk_listing(spark, sf):
    """One document's chunks, listed by kind."""
    chunks = _chunks(spark, sf)
    kids = io.chunk_listing(chunks, 3, is_parent=False).groupBy("document_id").agg(F.count_if(F.col("chunk_type") == "table_row").alias("rows"), F.count("*").alias("children"))
    return kids.join(io.chunk_listing(chunks, 3, is_parent=True).groupBy("document_id").agg(F.count("*").cast("int").alias("parents")), "document_id")


@query("replaced_numbers", """
WITH d AS (SELECT DISTINCT p_partkey // 10 AS document_id FROM part)
SELECT 'PC-' || document_id AS doc_no, CASE WHEN document_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM d WHERE document_id % 2 = 0 OR document_id % 3 = 0""")
def replaced_numbers(spark, sf):
    """Every third document is there; every second is loaded and replaces what has its number."""
    d = D.part_documents(spark, sf).select("document_id", F.concat(F.lit("PC-"), D.s("document_id")).alias("doc_no"))
    old, new = (d.filter(f"document_id % {n} = 0").withColumn("version", F.lit(v)) for n, v in ((3, "old"), (2, "new")))
    return io.admit_numbers(old, new, replace=True)[0].select("doc_no", "version")


@query("batch_numbers", """
WITH d AS (SELECT DISTINCT p_partkey // 10 AS document_id FROM part), n AS (SELECT document_id, 'PC-' || document_id // 3 AS doc_no FROM d)
SELECT 'once' AS form, doc_no, min(document_id) AS document_id FROM n GROUP BY 2 UNION ALL SELECT 'replace', doc_no, max(document_id) FROM n GROUP BY 2""")
def batch_numbers(spark, sf):
    """Batches in which three documents have one number: the first stays, or, where each replaces, the last."""
    new = D.part_documents(spark, sf).select("document_id", F.concat(F.lit("PC-"), D.s(F.expr("document_id div 3"))).alias("doc_no"))
    made = [io.admit_numbers(new.limit(0), new, replace)[0].select(F.lit(form).alias("form"), "doc_no", "document_id") for form, replace in (("once", False), ("replace", True))]
    return made[0].unionByName(made[1])


@query("index_updates", """
WITH d AS (SELECT p_partkey // 10 AS document_id, count(*) AS n FROM part GROUP BY 1)
SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 2 ELSE 1 END AS version, n, n AS chunk_count, CASE WHEN document_id % 6 = 3 THEN 'failed' ELSE 'indexed' END AS status,
  CASE WHEN document_id % 6 = 0 THEN 'm2' ELSE 'm1' END AS embedding_model FROM d""")
def index_updates(spark, sf):
    """All documents are indexed, then every third anew; of those every second yields no chunk and keeps its old ones."""
    path = f"{store.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    rows = D.part_chunks(spark, sf).withColumns({"document_id": F.expr("chunk_id div 10"), "is_parent": F.lit(False)})
    documents = rows.select("document_id").distinct()
    index.update_index(spark, path, documents, rows.withColumn("version", F.lit(1)), "m1")
    index.update_index(spark, path, documents.filter("document_id % 3 = 0"), rows.filter("document_id % 6 = 0").withColumn("version", F.lit(2)), "m2")
    now = index.open_index(spark, path)
    return now.chunks.groupBy("document_id", "version").agg(F.count("*").alias("n")).join(now.status, "document_id").select("document_id", "version", "n", "chunk_count", "status", "embedding_model")


@query("file_kinds", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'catalog' WHEN 2 THEN 'qa' ELSE 'other' END AS kind, p_size % 5 = 0 OR p_size % 7 = 0 AS is_bid, p_name || '.v' || p_size AS stem FROM part""")
def file_kinds(spark, sf):
    size = F.col("p_size")
    name = F.concat("p_name", F.lit(".v"), D.s(size), F.lit(".md"))
    text = F.element_at(F.array(F.lit("성적서"), F.lit("Product CATALOG"), F.lit("납품 실적"), F.lit("notes")), size % 4 + 1)
    spoken = F.concat(name, F.when(size % 5 == 0, "  RFP ").otherwise(""))
    head = F.concat(text, F.when(size % 7 == 0, " 입찰공고 ").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", admission.guess_kind(name, text).alias("kind"), admission.is_bid_document(spoken, head).alias("is_bid"), admission.stem(name).alias("stem"))


@query("filled_metadata", """
SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'own' WHEN document_id % 5 = 0 THEN 'file-' || document_id ELSE 'Catalog ' || document_id END AS title,
  CASE WHEN document_id % 4 = 0 THEN 'X-1' ELSE 'PC-2025-' || document_id END AS doc_no, CAST('2025-01-' || lpad(CAST(document_id % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS revision_date FROM (SELECT DISTINCT p_partkey // 10 AS document_id FROM part)""")
def filled_metadata(spark, sf):
    """Documents with some metadata of their own, the rest from their texts; a title may fall back to the file's name."""
    docs, k = D.part_documents(spark, sf), F.col("document_id")
    found = markdown.metadata(docs, markdown.document_lines(docs)).withColumn("title", F.when(k % 5 == 0, "").otherwise(F.col("title")))
    own = docs.select(k, F.when(k % 3 == 0, "own").otherwise("").alias("title"), F.when(k % 4 == 0, "X-1").otherwise("").alias("doc_no"), F.lit(None).cast("date").alias("revision_date"), admission.stem(F.concat(F.lit("file-"), D.s(k), F.lit(".md"))).alias("stem"))
    return markdown.fill_blank_metadata(own, found).select("document_id", "title", "doc_no", "revision_date")


@query("page_numbers", """
SELECT doc_id // 5 AS document_id, coalesce(min(CASE WHEN doc_id % 5 = 3 AND doc_id % 2 = 0 THEN 'AB-' || doc_id || '-X' END), min(CASE WHEN doc_id % 5 = 1 AND doc_id % 3 = 0 THEN 'T-' || doc_id END), '') AS doc_no FROM documents GROUP BY 1""")
def page_numbers(spark, sf):
    """Documents of five pages: a number in a text, else in a table, else none."""
    k = F.col("doc_id")
    text = F.when((k % 5 == 3) & (k % 2 == 0), F.concat(F.lit("공고번호 : AB-"), D.s(k), F.lit("-X."))).otherwise("no number")
    cells = F.when((k % 5 == 1) & (k % 3 == 0), F.array(F.lit("문서 번호"), F.concat(F.lit("T-"), D.s(k)))).otherwise(F.array(F.lit("a"), F.lit("b")))
    pages = table(spark, sf, "documents").select(F.floor(k / 5).alias("document_id"), (k % 5 + 1).cast("int").alias("page_no"), text.alias("text"), F.array(F.struct(F.lit(0).alias("index"), F.array(cells).alias("rows"))).alias("tables"))
    return markdown.page_doc_no(pages)


@query("tables_under", "SELECT DISTINCT p_partkey // 10 AS document_id, 0 AS table_index FROM part WHERE contains('Models of ' || p_partkey // 10, 'of 1')")
def tables_under(spark, sf):
    rows = markdown.with_sections(markdown.document_lines(D.part_documents(spark, sf)))
    return markdown.tables_under(markdown.tables(rows), "of 1").select("document_id", "table_index")


@query("first_sections", "SELECT DISTINCT p_partkey // 10 AS document_id, 2 AS section_id, 'Models of ' || p_partkey // 10 AS heading FROM part")
def first_sections(spark, sf):
    rows = markdown.with_sections(markdown.document_lines(D.part_documents(spark, sf)))
    return markdown.first_section(markdown.sections(rows), "e").select("document_id", F.col("section_id").cast("int").alias("section_id"), "heading")


@query("path_models", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'LT-' || (p_size + 100) ELSE 'LT-' || (p_size + 100) || ',LT-' || (p_size + 200) END AS in_path, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'LT-' || (p_size + 200) END AS in_text FROM part""")
def path_models(spark, sf):
    """Models in headings stand without word limits, those in texts with them."""
    one, two = F.concat(F.lit("xLT-"), D.s(F.col("p_size") + 100)), F.concat(F.lit("LT-"), D.s(F.col("p_size") + 200))
    second = F.when(F.col("p_size") % 3 == 0, one).otherwise(two)
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.path_models(F.array(one, second)), ",").alias("in_path"), F.array_join(T.models(F.concat_ws(" ", one, second)), ",").alias("in_text"))


@query("empty_tables", "SELECT DISTINCT p_partkey // 10 AS document_id, 'empty' AS kind, 'table has no rows' AS message FROM part WHERE p_partkey // 10 % 4 = 0 AND p_partkey % 7 <> 3")
def empty_tables(spark, sf):
    t = D.part_tables(spark, sf)
    emptied = t.withColumn("rows", F.when(F.col("document_id") % 4 == 0, F.filter("rows", lambda r: F.lit(False))).otherwise(F.col("rows")))
    return page_checks.empty_tables(emptied).select("document_id", "kind", "message")


@query("tables_at", "SELECT doc_id // 10 AS document_id, CAST(doc_id % 10 + 1 AS INTEGER) AS page_no, lang FROM documents WHERE doc_id % 3 > 0 AND doc_id % 10 = 1")
def tables_at(spark, sf):
    """The first table of every second page."""
    pages = D.document_pages(spark, sf).select("document_id", "page_no", F.explode("tables").alias("t")).select("document_id", "page_no", F.col("t.index").alias("table_index"), "t.rows")
    return page_checks.table_at(pages, 2, 0).select("document_id", "page_no", F.col("rows")[1][0].alias("lang"))
