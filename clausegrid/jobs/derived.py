"""The library's inputs derived from the given tables with plain expressions (integers only inside texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.requirements import HEADER_DATES, HEADER_TEXT, HEADER_TIMES
from ..sources.io import table

#: Parts of one derived document or table.
PARTS = 10


def s(c) -> F.Column:
    return c.cast("string") if not isinstance(c, str) else F.col(c).cast("string")


def row_text() -> F.Column:
    return F.concat("p_name", F.lit(" — IP6"), s(F.col("p_size") % 10), F.lit(", "), s("p_size"), F.lit(" kg, LT-"), s(F.col("p_size") + 100))


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One child chunk for each part; ten parts have one parent."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("chunk_id"), parent_of(F.col("p_partkey")).alias("parent_id"), (F.col("p_partkey") % 5).alias("document_id"), F.when(F.col("p_size") % 2 == 0, "catalog").otherwise("qa").alias("doc_kind"), row_text().alias("content"), F.concat(F.lit("Catalog > "), "p_type", F.lit(" > "), "p_brand").alias("section_path"))
    return rows.withColumns({"keywords": T.keywords(F.col("content")), "model_tags": T.models(F.col("content"))})


def parent_of(part: F.Column) -> F.Column:
    return F.floor(part / PARTS) + 1000000000


def part_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of ``part_chunks``, but for every seventh: chunk_id, content."""
    p = table(spark, sf_dir, "part").groupBy(parent_of(F.col("p_partkey")).alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row_text().alias("line")))).alias("rows"))
    return p.filter("chunk_id % 7 <> 0").select("chunk_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("content"))


def embedded(rows: DataFrame, key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with the vector of the same number, where there is one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), "embedding")
    return rows.join(e, key, "left")


def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, doc_title, doc_no."""
    k = F.col("r_regionkey").cast("long")
    return table(spark, sf_dir, "region").select(k.alias("document_id"), F.col("r_name").alias("doc_title"), F.concat(F.lit("R-"), s(k)).alias("doc_no"))


def supplier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query for each supplier. Of ten one names a model itself, one wants no filter, the others have one given."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("IP6"), s(k % 10), F.lit(" "), F.element_at(F.array(F.lit("ring"), F.lit("widget"), F.lit("steel gear")), (k % 3 + 1).cast("int")), F.when(k % 10 == 0, F.concat(F.lit(" LT-"), s(k % 20 + 101))).otherwise(""))
    model = F.when(k % 10 == 1, "").when(k % 10 > 1, F.concat(F.lit("LT-"), s(k % 50 + 101)))
    rows = table(spark, sf_dir, "supplier").select(k.alias("query_id"), text.alias("text"), model.alias("model_filter"))
    return rows.withColumn("probes", F.array("text"))


def part_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the first clause of ``part_assessments``: two ranks, some without a number, none for every fourth size."""
    p = table(spark, sf_dir, "part").filter("p_size % 4 <> 0").select("*", F.explode(F.array(F.lit(2), F.lit(3))).alias("rank"))
    first = F.col("rank") == 2
    return p.select(F.col("p_partkey").alias("run_id"), (F.col("p_partkey") * 2).alias("requirement_id"), F.when(first, F.concat(F.lit("Catalog "), "p_type")).otherwise("later").alias("doc_title"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("doc_no"), F.when(first, F.col("p_name")).otherwise("later").alias("location"), "rank")


def customer_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project for each customer: every fifth has a title, every third a due date; all other header fields are blank."""
    k = F.col("c_custkey")
    own = {"title": F.when(k % 5 == 0, F.col("c_name")).otherwise(""), "bid_due_at": F.when(k % 3 == 0, F.lit("2025-03-01").cast("timestamp"))}
    kinds = dict.fromkeys(HEADER_TEXT, F.lit("")) | dict.fromkeys(HEADER_DATES, F.lit(None).cast("date")) | dict.fromkeys(HEADER_TIMES, F.lit(None).cast("timestamp"))
    return table(spark, sf_dir, "customer").select(k.alias("project_id"), *[c.alias(f) for f, c in (kinds | own).items()])


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents of ten parts each: headings, one table, a note."""
    p = table(spark, sf_dir, "part").withColumn("document_id", F.floor(F.col("p_partkey") / PARTS))
    line = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | "), s("p_size"), F.lit(" kg | LT-"), s(F.col("p_size") + 100), F.lit(" |"))
    g = p.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("rows"))
    d = s("document_id")
    head = F.concat(F.lit("# Catalog "), d, F.lit("\n\n문서 번호: PC-2025-"), d, F.lit("\n기준일: 2025-01-"), F.lpad(s(F.col("document_id") % 28 + 1), 2, "0"), F.lit("\n\n## Models of "), d, F.lit("\n\n| item | brand | weight | model |\n|---|---|---|---|\n"))
    return g.select("document_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n\n### Notes\nAsk for prices. Sizes in "), s(F.size("rows")), F.lit(" rows.\n")).alias("text"))


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause tables of ten parts each, with parts missing, cells blank and rows short by rule."""
    p = table(spark, sf_dir, "part").withColumns({"document_id": F.floor(F.col("p_partkey") / PARTS), "k": (F.col("p_partkey") % PARTS).cast("int")})
    kept = p.filter("p_partkey % 7 <> 3")
    clause = F.concat(s(F.col("document_id") % 9 + 1), F.lit("."), s(F.col("k") + 1))
    text = F.when(F.col("p_partkey") % 11 == 5, "").otherwise(F.concat(s("p_size"), F.lit(" kg")))
    cells = F.when(F.col("p_partkey") % 13 == 6, F.array(clause, "p_name")).otherwise(F.array(clause, "p_name", text))
    g = kept.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("k", cells.alias("cells")))).alias("r"))
    header = F.array(F.lit("clause"), F.lit("item"), F.lit("limit"))
    return g.select("document_id", F.lit(1).alias("page_no"), F.lit(0).alias("table_index"), F.concat(F.array(header), F.transform("r", lambda x: x["cells"])).alias("rows"))


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model response for each event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    clause = F.concat(s(k % 5 + 1), F.lit("."), s(F.col("event_id") % 12))
    one = F.to_json(F.struct(clause.alias("clause_no"), F.when(k % 2 == 0, "delivery").otherwise(F.col("event_type")).alias("category"), F.col("event_type").alias("item"), F.when(k % 10 == 0, "").otherwise(F.concat(s(k), F.lit(" kg 이하"))).alias("requirement_text")))
    number = F.when(k % 3 == 0, F.concat(F.lit('"'), s(k), F.lit('"'))).otherwise(s(k))  # every third is a text
    one = F.concat(F.regexp_replace(one, r"\}$", ',"source_page":'), number, F.lit("}"))
    due = F.when(k % 4 == 1, F.concat(F.lit("2025-2-"), s(k % 28 + 1), F.lit(" 9:30"))).otherwise("soon")
    body = F.concat(F.lit('{"requirements":['), one, F.lit('],"warnings":["w'), s(k), F.lit('"],"submission_items":[{"seq":'), number, F.lit(',"name":"'), F.col("event_type"), F.lit('"},{"seq":"x","name":"y"}],"participation_reqs":[{"seq":"p'), s(k % 7), F.lit('","text":"'), F.col("event_type"), F.lit('"}],"bid_info":{"title":"T'), s(k), F.lit('","announced_on":"2025-1-'), s(k % 28 + 1), F.lit('","bid_due_at":"'), due, F.lit('","spec_doc_no":"'), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("S-"), s("event_id"))).otherwise(""), F.lit('"}}'))
    return e.select(F.expr("user_id div 3").alias("project_id"), F.col("event_id").alias("document_id"), F.when(F.col("event_id") % 2 == 0, "announcement").otherwise("techspec").alias("doc_type"), F.when(F.col("event_id") % 97 == 0, "not json").otherwise(body).alias("response"))


def odd_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model response for each event, seven of eight with one field of the wrong type."""
    good = {"requirements": '[{"clause_no":"c","item":"a","source_page":3},{"clause_no":"d","item":"b"}]', "warnings": '["w"]', "bid_info": '{"title":"T"}'}
    odd = [
        {}, {"requirements": '{"clause_no":"c"}'}, {"requirements": '["text",{"clause_no":"c","item":"a","source_page":3},null]'}, {"warnings": '"one text"'}, {"bid_info": '"none"'}, {"bid_info": '{"title":7}'},
        {"requirements": good["requirements"].replace("3}", '"3"}')}, {"requirements": good["requirements"].replace('"c"', "2.5")},
    ]
    texts = [F.lit("{" + ",".join(f'"{k}":{v}' for k, v in (good | x).items()) + "}") for x in odd]
    k = F.col("event_id")
    response = F.when(k % 97 == 0, "[]").otherwise(F.element_at(F.array(*texts), (k % 8 + 1).cast("int")))
    return table(spark, sf_dir, "events").select(F.expr("user_id div 3").alias("project_id"), k.alias("document_id"), F.lit("announcement").alias("doc_type"), response.alias("response"))


def part_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assessed clauses for each part: an option with side effects (3.1) and a weight limit (3.2)."""
    p = table(spark, sf_dir, "part")
    effect = "struct<field:string,op:string,value:double,unit:string,source:string>"
    e = lambda f, v, u: F.struct(F.lit(f).alias("field"), F.lit("add").alias("op"), v.cast("double").alias("value"), F.lit(u).alias("unit"), F.lit("c").alias("source"))
    size = F.col("p_size")
    option = p.select(F.col("p_partkey").alias("run_id"), (F.col("p_partkey") * 2).alias("requirement_id"), F.lit("3.1").alias("clause_no"), F.lit("3").alias("chapter"), F.lit("filter_grade").alias("category"), F.lit("grade").alias("item"), F.lit("IP66 이상").alias("requirement_text"), F.lit("IP65").alias("our_value"), F.when(size % 3 == 0, "CHECK").otherwise("GAP").alias("verdict"), F.lit("one grade short").alias("gap_detail"), F.lit("r").alias("rationale"), F.lit("housing").alias("remedy"), F.array(e("weight", size % 5, "kg"), e("lead_time", size % 4, "주")).cast(f"array<{effect}>").alias("side_effects"))
    weight = p.select(F.col("p_partkey").alias("run_id"), (F.col("p_partkey") * 2 + 1).alias("requirement_id"), F.lit("3.2").alias("clause_no"), F.lit("3").alias("chapter"), F.lit("dimension").alias("category"), F.lit("무게").alias("item"), F.concat(s(size % 7 + 20), F.lit(" kg 이하")).alias("requirement_text"), F.concat(s(size), F.when(size % 10 == 0, " mm").otherwise(" kg")).alias("our_value"), F.lit("MEET").alias("verdict"), F.lit("").alias("gap_detail"), F.lit("fits").alias("rationale"), F.lit("").alias("remedy"), F.array().cast(f"array<{effect}>").alias("side_effects"))
    return option.unionByName(weight)


def label_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw verdicts made from labels: unknown values, missing citations and contradictions by rule."""
    lab = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    return lab.select(F.expr("doc_id div 50").alias("run_id"), k.alias("requirement_id"), F.when(k % 17 == 0, "MAYBE").when(F.col("quality") == 1, "MEET").otherwise("GAP").alias("verdict"), F.when(k % 13 == 0, "not_found").otherwise("found_sufficient").alias("evidence_state"), F.lit("why").alias("rationale"), s(k).alias("our_value"), F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), (k % 3 + 1).cast("int"))).alias("cited_ranks"), (k % 15 / F.lit(10.0)).alias("confidence"), F.when(k % 19 == 0, "timeout").alias("error"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ten pages each. Every tenth page has no text; of three pages one has a table, one a table with a
    short row, a cell with a pipe and a blank row, and one none."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = F.array(F.array(F.lit("lang"), F.lit("chars")), F.array("lang", s("n_chars")))
    more = F.when(k % 3 == 2, F.concat(rows, F.array(F.array(F.lit(" "), F.lit("")), F.array(F.lit("a|b"))))).otherwise(rows)
    tables = F.when(k % 3 == 0, F.array().cast("array<struct<index:int,rows:array<array<string>>>>")).otherwise(F.array(F.struct(F.lit(0).alias("index"), more.alias("rows"))))
    text = F.when(k % 10 == 4, " ").otherwise(F.col("text"))
    return d.select(F.floor(k / PARTS).alias("document_id"), F.concat(F.lit("Notes "), s(F.floor(k / PARTS))).alias("title"), (k % PARTS + 1).cast("int").alias("page_no"), text.alias("text"), tables.alias("tables"))
