"""Which files may enter the knowledge base, and what kind they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Words that mark a buyer's document, a catalogue, a certificate or record.
BID_NAME_HINTS = ("공고", "사양서", "규격서", "rfp", "입찰")
BID_TEXT_HINTS = ("공고번호", "입찰공고", "기술사양서")
CATALOG_HINTS = ("카탈로그",)
CATALOG_HINTS_ANY_CASE = ("catalog",)
QA_HINTS = ("인증", "시험", "실적", "성적서")
# End of fixed values.
SUFFIXES, MAX_BYTES, HEAD_CHARS, KIND_CHARS = (".md", ".pdf"), 20 << 20, 4000, 500


def _holds(c: Column, hints: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(h) for h in hints])


def is_bid_document(name: Column, head: Column) -> Column:
    """Whether a file looks like a buyer's announcement or specification."""
    return _holds(F.lower(T.cell(name)), BID_NAME_HINTS) | _holds(F.coalesce(head, F.lit("")), BID_TEXT_HINTS)


def guess_kind(name: Column, text: Column) -> Column:
    """catalog, qa or other, from the name and the head of the text."""
    head = F.concat(name, F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, KIND_CHARS))
    return F.when(_holds(head, CATALOG_HINTS) | _holds(F.lower(head), CATALOG_HINTS_ANY_CASE), "catalog").when(_holds(head, QA_HINTS), "qa").otherwise("other")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def admit(files: DataFrame, allow: bool = False) -> DataFrame:
    """``files`` (name, bytes, text) with suffix, stem, doc_kind and reason (null: admitted)."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    bid = is_bid_document(F.col("name"), F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS)) & ~F.lit(allow)
    reason = F.when(~suffix.isin(*SUFFIXES), "suffix").when(F.col("bytes") > MAX_BYTES, "size").when(bid, "bid document")
    return files.withColumns({"suffix": suffix, "stem": stem(F.col("name")), "doc_kind": guess_kind(F.col("name"), F.col("text")), "reason": reason})
