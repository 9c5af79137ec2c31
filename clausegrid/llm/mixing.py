"""Mixing sources to target weights as a time-varying curriculum (DataFrame functions only).

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating; a target stops
at ``max_repeats`` times its source's size and the excess is shared again by weight. With
sources ordered by cap / weight the fill level is a closed form over running sums.

Curriculum: a source's weight at training time t in [0, 1] is its overall weight times the
line from ``a`` (t = 0) to ``2 - a`` (t = 1), whose integral g(t) = a t + (1 - a) t^2 is 1 at
the end. Cumulative demand is target * g(t); inverting it at the words that the source has
given before a document yields the document's training position.

A source's stream is its documents in hash order, again and again. Running sums over a
stream never gather a source in one task: documents are dealt to hash ranges of about
``range_rows`` documents, ranges are summed first, and only documents of one range meet.

Defined results: null text has size 0; documents of size 0 are never taken; an empty table
gives an empty result; a null source is a source of its own; other columns are ignored.
A very long text has its place and is never cut. Rows of one id are documents of their own: they follow one another in the stream by text hash, and
null ids, which share one place in it, are dealt to ranges by that hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WHITE, save

RANGE_ROWS = 4096
#: Opening level ``a`` of the curriculum's lines for weights 1, 2, 3: light sources early, heavy ones late.
OPENING = (1.5, 1.0, 0.5)


def words(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = 3, opening: tuple[float, ...] = OPENING) -> DataFrame:
    """One row per source: source_size, target, opening, ranges. ``sizes``: source, key, size.

    The windows run over sources, after summing: as many rows as there are sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % len(opening) + 1).cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    per = per.withColumn("fill", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("open"), F.col("weight") * F.col("fill")).otherwise(F.col("cap").cast("double"))
    a = F.element_at(F.array(*[F.lit(float(x)) for x in opening]), F.col("weight").cast("int"))
    return per.select("source", "source_size", target.cast("double").alias("target"), a.alias("opening"), F.ceil(F.col("n") / RANGE_ROWS).cast("long").alias("ranges"))


def _position(before: Column, target: Column, a: Column) -> Column:
    """The time at which cumulative demand target * g(t) reaches ``before``."""
    y = before / target
    return 2 * y / (a + F.sqrt(a * a + 4 * (1 - a) * y))


def _mark(docs: DataFrame, text_col: str, source_col: str) -> Column:
    """With the id it names rows that the mix cannot tell apart."""
    return F.xxhash64(docs[source_col].isNull(), docs[source_col], F.coalesce(docs[text_col], F.lit("")))


def _stream(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_repeats: int, opening: tuple[float, ...]) -> DataFrame:
    """doc_id, source, size, mark, source_size, target, opening, before (words that the source gives before the row)."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), _mark(docs, text_col, source_col).alias("mark"))
    place = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    sized = sized.withColumn("key", place(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = save(sized, "sizes")  # texts are read once
    per = source_targets(sized, max_repeats, opening)
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    dealt = sized.alias("d").join(per.alias("p"), same).select("d.*", "p.source_size", "p.target", "p.opening", "p.ranges")
    # Null ids share a key; their range holds three parts, before, of and behind them, and theirs is dealt again by mark.
    part = F.when(F.col("doc_id").isNull(), 1).when(F.col("key") <= place(F.lit("")), 0).otherwise(2)
    sub = F.when(F.col("doc_id").isNull(), F.floor(F.shiftrightunsigned("mark", 32) * F.col("ranges") / F.lit(2**32))).otherwise(0)
    coarse = F.floor(F.col("key") * F.col("ranges") / F.lit(2**32))
    dealt = dealt.withColumn("range", ((coarse * 3 + part) * F.col("ranges") + sub).cast("long"))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offset = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    sums = sums.select("source", "range", offset.alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("upto", F.sum("size").over(inside))
    run = run.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    return run.select("d.doc_id", "d.source", "d.size", "d.mark", "d.source_size", "d.target", "d.opening", (F.col("s.offset") + F.col("d.upto") - F.col("d.size")).alias("before"))


def _taken(run: DataFrame, max_repeats: int) -> DataFrame:
    """Adds copies, taken and positions."""
    # A copy counts if the middle of it lies before the target: the source ends within half a document of it.
    fits = F.floor(F.try_divide(F.col("target") - F.col("before") - F.col("size") / 2, F.col("source_size"))) + 1
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.greatest(fits, F.lit(0)), F.lit(max_repeats)))
    out = run.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    at = lambda i: _position(F.least(F.col("before") + i * F.col("source_size"), F.col("target")), F.col("target"), F.col("opening"))
    return out.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies").cast("int") - 1), at)).otherwise(F.array().cast("array<double>")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, opening: tuple[float, ...] = OPENING) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, positions (array of double, one for each copy), range-sorted by first position."""
    out = _taken(_stream(docs, id_col, text_col, source_col, max_repeats, opening), max_repeats)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "positions").orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, opening: tuple[float, ...] = OPENING) -> DataFrame:
    """``docs`` with all its columns, each row as often as the mix takes it, range-sorted by training position.

    Rows of equal id, source and text follow one another in the stream: the first one's place and a row's
    number among them give its own."""
    key = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit(0)).alias("id"))
    run = _stream(docs, id_col, text_col, source_col, max_repeats, opening)
    facts = ["size", "source_size", "target", "opening"]
    first = run.groupBy(key(F.col("doc_id")).alias("__key__"), F.col("mark").alias("__mark__")).agg(F.min(F.struct("before", *facts)).alias("__mix__"))
    rows = docs.withColumns({"__key__": key(docs[id_col].cast("long")), "__mark__": _mark(docs, text_col, source_col)})
    number = F.row_number().over(Window.partitionBy("__key__", "__mark__").orderBy("__mark__")) - 1
    out = rows.join(first, ["__key__", "__mark__"]).withColumn("__n__", number)
    mine = _taken(out.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc__"), (F.col("__mix__.before") + F.col("__n__") * F.col("__mix__.size")).alias("before"), *[F.col(f"__mix__.{c}").alias(c) for c in facts]), max_repeats)
    return mine.select("__doc__", F.explode("positions").alias("__at__")).orderBy("__at__", f"__doc__.{id_col}").select("__doc__.*")
