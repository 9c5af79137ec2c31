"""Parsing, chunking, checks and sources on small documents."""

from pyspark.sql import functions as F

from clausegrid.operators import admission, chunking, markdown, page_checks
from clausegrid.sources import io

DOC = """# 제품 카탈로그

문서번호: HB-CAT-2025-02
개정일: 2025-05-10

## 2. LT-150 사양
서술이다. 둘째 문장이다.

### 2.2 구조

| 항목 | 사양 |
|---|---|
| 방수·방진 등급 | IP65 |
| 무게 |  7.2 kg |
| | |

---

## 4. 공통
보증 2년.
"""


def parsed(spark, text=DOC):
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    rows = markdown.with_sections(markdown.document_lines(docs))
    return docs, rows, markdown.sections(rows), markdown.tables(rows)


def test_metadata_and_sections(spark):
    docs, rows, sections, tables = parsed(spark)
    m = markdown.metadata(docs, rows).first()
    assert (m["title"], m["doc_no"], str(m["revision_date"])) == ("제품 카탈로그", "HB-CAT-2025-02", "2025-05-10")
    got = {r["heading"]: r["heading_path"] for r in sections.collect()}
    assert got["2.2 구조"] == ["제품 카탈로그", "2. LT-150 사양", "2.2 구조"]
    assert got["4. 공통"] == ["제품 카탈로그", "4. 공통"]
    assert [r["rows"] for r in tables.collect()] == [[["항목", "사양"], ["방수·방진 등급", "IP65"], ["무게", "7.2 kg"], ["", ""]]]
    assert markdown.tables_under(tables, "LT-150").count() == 1


def test_chunks(spark):
    _, _, sections, tables = parsed(spark)
    chunks = chunking.build_chunks(sections, tables)
    rows = {r["content"]: r for r in chunks.filter("chunk_type = 'table_row'").collect()}
    assert set(rows) == {"2.2 구조 — 항목: 방수·방진 등급, 사양: IP65", "2.2 구조 — 항목: 무게, 사양: 7.2 kg"}
    assert all(r["model_tags"] == ["LT-150"] for r in rows.values())
    parents = {r["chunk_id"] for r in chunks.filter("is_parent").collect()}
    assert {r["parent_id"] for r in chunks.filter("NOT is_parent").collect()} <= parents
    common = chunks.filter("section_path LIKE '%공통%' AND NOT is_parent").first()
    assert common["model_tags"] == [] and common["keywords"] == ["2년"]
    again = io.reindexed(chunks, chunks)
    assert sorted(r["chunk_id"] for r in again.collect()) == sorted(r["chunk_id"] for r in chunks.collect())


def test_long_text_is_halved(spark):
    half = "문장이다. " * 200
    _, _, sections, tables = parsed(spark, f"# t\n\n## s\n{half}\n\n{half}")
    p = chunking.build_chunks(sections, tables).filter("is_parent").orderBy("section_path").collect()
    assert [r["section_path"] for r in p] == ["t > s (1/2)", "t > s (2/2)"]


def test_empty_documents(spark):
    _, rows, sections, tables = parsed(spark, None)
    assert sections.count() == 0 and tables.count() == 0
    status = io.index_status(rows.select("document_id").distinct(), chunking.build_chunks(sections, tables), "m").collect()
    assert all(r["status"] == "failed" for r in status)


def test_table_markdown(spark):
    df = spark.createDataFrame([([["a", "b"], ["x|y"], ["", ""]],)], "rows array<array<string>>")
    assert df.select(markdown.table_markdown(F.col("rows"))).first()[0] == "| a | b |\n|---|---|\n| x\\|y |   |"


def test_checks(spark):
    h = ["조항", "항목", "기준"]
    cases = [(1, [h, ["2.1", "a", ""], ["2.2", "b", "c"]]), (2, [h, ["2.1", "a", "x"], ["2.3", "b", "y"]]), (3, [h, ["2.1", "a"]]), (4, [["구분", "비고"], ["x", ""]]), (5, []), (6, [h, ["2.1", "a", "x"]])]
    t = spark.createDataFrame([(i, 1, 0, r) for i, r in cases], "document_id long, page_no int, table_index int, rows array<array<string>>")
    got = {(r["document_id"], r["kind"]) for r in page_checks.table_warnings(t).collect()}
    assert got == {(1, "blank"), (2, "gap"), (3, "width"), (5, "empty")}


def test_page_numbers_and_texts(spark):
    pages = spark.createDataFrame([(1, "t", 1, "참조 기술사양서(KPG-2025-TS-0417)", [(0, [["문서번호", "KPG-2025-EQ-0417"]])]), (2, "u", 1, "", [])], io.PAGES)
    assert {r["document_id"]: r["doc_no"] for r in markdown.page_doc_no(pages).collect()} == {1: "KPG-2025-EQ-0417", 2: ""}
    assert {r["document_id"]: r["reason"] for r in page_checks.document_stats(pages).collect()} == {1: "no text", 2: "no text"}


def test_admission(spark):
    rows = [("입찰공고문.md", ""), ("기술 사양서.md", ""), ("RFP_2025.md", ""), ("a.md", "공고번호 1"), ("제품카탈로그.md", ""), ("인증현황.md", "")]
    f = spark.createDataFrame([(n, 10, t) for n, t in rows], "name string, bytes long, text string")
    got = {r["name"]: (r["reason"], r["doc_kind"]) for r in admission.admit(f).collect()}
    assert [got[n][0] for n, _ in rows] == ["bid document"] * 4 + [None] * 2
    assert got["제품카탈로그.md"][1] == "catalog" and got["인증현황.md"][1] == "qa"


def test_numbers_already_loaded(spark):
    old = spark.createDataFrame([(1, "A")], "document_id long, doc_no string")
    new = spark.createDataFrame([(2, "A"), (3, "B"), (4, "")], "document_id long, doc_no string")
    kept, rejected = io.admit_numbers(old, new)
    assert {r["document_id"] for r in kept.collect()} == {1, 3, 4} and [r["document_id"] for r in rejected.collect()] == [2]
    kept, _ = io.admit_numbers(old, new, replace=True)
    assert {r["document_id"] for r in kept.collect()} == {2, 3, 4}


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text(DOC)
    (tmp_path / "b.xlsx").write_text("x")
    good, bad = io.read_texts(spark, f"file://{tmp_path}")
    assert [r["name"] for r in good.collect()] == ["a.md"] and [r["suffix"] for r in bad.collect()] == [".xlsx"]
