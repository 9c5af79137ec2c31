"""Exact dedup by distributed MSD radix partitioning.

Every document starts in one group. A round splits each group by its documents' next
bytes and keeps on only with groups of two or more whose texts go on; the rest is
finished: a group of one is unique, a group whose texts have ended holds equal texts.
Chunks of bytes grow by a constant factor, so a text of n bytes takes O(log n) rounds.
Equality comes from the bytes themselves, never from a digest.

Shuffles carry (group, chunk) and are summed before they leave a task, so a group of
copies with a third of all rows costs one row per task in the counting step; joining
the counts back is a plain equi-join that adaptive execution splits where a key is hot.

Defined results: null text is the empty text; a null id is a row like any other but
stays only if all ids of its group are null; of repeated rows (same id and text) one stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, digest, release, save, without

FIRST_CHUNK, GROWTH = 64, 4


def normalized(text):
    """White-space runs as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _split(rows: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """One radix pass: adds ``n`` and the new ``grp`` (both null for a group of one)."""
    cut = rows.withColumns({"chunk": F.substring("rest", 1, length), "ended": F.octet_length("rest") <= length})
    # Written before the join: adaptive execution splits a hot key only where both sides come straight from a shuffle.
    counts = save(cut.groupBy(*keys, "chunk", "ended").agg(F.min("rid").alias("first"), F.count("*").alias("n")).filter("n > 1"), "counts")
    out = cut.join(counts.hint("shuffle_hash"), [*keys, "chunk", "ended"], "left")
    again = F.col("n").isNotNull() & ~F.col("ended")
    return out.select("rid", "doc_id", "sha", F.col("first").alias("grp"), "n", again.alias("active"), F.when(again, F.expr(f"substring(rest, {length + 1}, octet_length(rest))")).alias("rest"))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = FIRST_CHUNK, growth: int = GROWTH) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, keep_id, group_size, kept, sha) and the stored tables that it reads.

    Rows are numbered while they are scanned. The first round's two scans may number them differently, as when
    executors come or go, so its labels can clash with later rounds' ones and a group is named by (round, label)."""
    text = normalized(F.col(text_col).cast("string"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("sha"), text.cast("binary").alias("rest"))
    finished, keys, stored = [], [], []
    while True:
        done = save(_split(rows, chunk, keys), "radix")
        stored.append(done)
        finished.append(done.filter("not active").drop("rest", "active").withColumn("round", F.lit(len(finished))))
        rows = done.filter("active").select("rid", "doc_id", "sha", "grp", "rest")
        if rows.isEmpty():
            break
        chunk, keys = chunk * growth, ["grp"]
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    heads = save(every.filter("n > 1").groupBy("round", "grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("head")), "heads")
    out = every.join(heads.hint("shuffle_hash"), ["round", "grp"], "left")
    single = F.col("head").isNull()
    out = out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("head.rid") == F.col("rid"))).alias("kept"),
        "sha",
    )
    return out, [*stored, heads]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    classes, _ = duplicate_classes(docs, id_col, text_col)
    return classes.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that repeat another text.

    A row is known again by its id and the digest of its normalised text; of rows that agree in both, one stays."""
    classes, stored = duplicate_classes(docs, id_col, text_col)
    decided = save(classes.groupBy("doc_id", F.col("sha").alias("digest")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"), "classes")
    release(*stored)
    return without(docs, decided, docs[id_col].cast("long"), digest(normalized(docs[text_col].cast("string"))))
