"""Requirements that cannot hold together: side effects of options against other clauses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Units (lm/W before lm, since the first that fits is taken), words of constraints, and the clauses that a side effect touches.
UNITS = "lm/W|lm|W|K|kg|mm|시간|℃|%|주|일|년|건|대"
AT_MOST, AT_LEAST, LESS, MORE = "이하|이내", "이상", "미만", "초과"
BELOW_ZERO = "영하"
TOUCHES = (("weight", "dimension", "무게"), ("lead_time", "delivery", "납기"), ("temperature", None, "온도"))
FIELD_LABELS = {"weight": "무게", "price": "단가", "lead_time": "납기", "temperature": "온도", "other": "기타"}
DAY, WEEK, DAYS_IN_WEEK = "일", "주", 7
# End of fixed values.
_NUMBER = r"-?[\d,]*\d(?:\.\d+)?"


def worked_out_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` stands once in the expression, however often ``use`` takes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def parse_value(c: Column) -> Column:
    """struct(value, unit) of the first number with a unit."""
    got = lambda i: F.regexp_extract(c, rf"({_NUMBER})\s*({UNITS})", i)
    return F.struct(number(got(1)).alias("value"), F.nullif(got(2), F.lit("")).alias("unit"))


#: A range, or a number with its unit and the nearest constraint word behind it.
_LIMIT = rf"({BELOW_ZERO}\s*)?({_NUMBER})\s*(?:{UNITS})?\s*~\s*({BELOW_ZERO}\s*)?({_NUMBER})\s*({UNITS})|({BELOW_ZERO}\s*)?({_NUMBER})\s*({UNITS})[^\d~]*?({AT_MOST}|{AT_LEAST}|{LESS}|{MORE})"


def limits(c: Column) -> Column:
    """array(struct(unit, lo, lo_open, hi, hi_open)): every limit that a text names, in order.

    Each constraint word takes the number before it, whatever other numbers stand in the text."""

    def one(groups: Column) -> Column:
        part = lambda i: F.get(groups, F.lit(i - 1))
        signed = lambda sign, digits: F.when(part(sign) != "", -number(part(digits))).otherwise(number(part(digits)))
        ranged, word, value = part(5) != "", part(9), signed(6, 7)
        upper, lower = word.rlike(f"{AT_MOST}|{LESS}"), word.rlike(f"{AT_LEAST}|{MORE}")
        return F.struct(
            F.when(ranged, part(5)).otherwise(part(8)).alias("unit"),
            F.when(ranged, signed(1, 2)).when(lower, value).alias("lo"),
            F.coalesce(word.rlike(MORE), F.lit(False)).alias("lo_open"),
            F.when(ranged, signed(3, 4)).when(upper, value).alias("hi"),
            F.coalesce(word.rlike(LESS), F.lit(False)).alias("hi_open"),
        )

    # a limit's nine groups from one match; none of them can hold the separator
    match = lambda piece: F.split(F.regexp_replace(piece, _LIMIT, "\x01".join(f"${i}" for i in range(1, 10))), "\x01")
    return F.transform(F.regexp_extract_all(c, F.lit(_LIMIT), F.lit(0)), lambda piece: worked_out_once(match(piece), one))


def parse_constraint(c: Column, unit: Column | None = None) -> Column:
    """struct(op, lo, hi, unit, lo_open, hi_open): what a text's limits of one unit leave together; op is <=, >=, <, > or
    range, and null where the text holds none. ``unit``: the one asked for; without it, or where the text has no limit of
    it, the unit of the first limit."""

    def of_unit(every: Column) -> Column:
        first = F.get(every, F.lit(0))["unit"]
        chosen = first if unit is None else F.when(F.exists(every, lambda x: x["unit"] == unit), unit).otherwise(first)
        mine = lambda u: F.filter(every, lambda x: x["unit"] == u)
        return worked_out_once(chosen, lambda u: worked_out_once(F.struct(u.alias("unit"), mine(u).alias("mine")), ends))

    def ends(of: Column) -> Column:
        mine = of["mine"]
        lo, hi = F.array_max(F.transform(mine, lambda x: x["lo"])), F.array_min(F.transform(mine, lambda x: x["hi"]))
        return worked_out_once(F.struct(of["unit"].alias("unit"), mine.alias("mine"), lo.alias("lo"), hi.alias("hi")), together)

    def together(of: Column) -> Column:
        lo, hi = of["lo"], of["hi"]
        lo_open = F.exists(of["mine"], lambda x: (x["lo"] == lo) & x["lo_open"])
        hi_open = F.exists(of["mine"], lambda x: (x["hi"] == hi) & x["hi_open"])
        op = F.when(lo.isNotNull() & hi.isNotNull(), "range").when(hi.isNotNull(), F.when(hi_open, "<").otherwise("<=")).when(lo.isNotNull(), F.when(lo_open, ">").otherwise(">="))
        return F.struct(op.alias("op"), lo.alias("lo"), hi.alias("hi"), of["unit"].alias("unit"), F.coalesce(lo_open, F.lit(False)).alias("lo_open"), F.coalesce(hi_open, F.lit(False)).alias("hi_open"))

    return worked_out_once(limits(c), of_unit)


def violates(value: Column, constraint: Column) -> Column:
    """Whether a value breaks a constraint of the same unit; null without a constraint."""
    lo, hi = constraint["lo"], constraint["hi"]
    under = F.coalesce((value < lo) | (constraint["lo_open"] & (value == lo)), F.lit(False))
    over = F.coalesce((value > hi) | (constraint["hi_open"] & (value == hi)), F.lit(False))
    return F.when(constraint["op"].isNotNull() & value.isNotNull(), under | over)


def apply_effect(value: Column, op: Column, effect: Column) -> Column:
    return F.when(op == "add", value + effect).when(op == "multiply", value * effect).when(op == "replace", effect)


def effects(assessments: DataFrame) -> DataFrame:
    """One row for each side effect: run_id, from_clause, option, field, op, effect, unit."""
    rows = assessments.select("run_id", F.col("clause_no").alias("from_clause"), F.col("remedy").alias("option"), F.explode("side_effects").alias("e"))
    return rows.select("run_id", "from_clause", "option", "e.field", "e.op", F.col("e.value").alias("effect"), "e.unit")


def touched(assessments: DataFrame) -> DataFrame:
    """Clauses by the field that touches them, so effects join on (run, field) and not on the run alone."""
    hit = [F.when((F.col("category") == category if category else F.lit(False)) | F.col("item").contains(word), F.lit(field)) for field, category, word in TOUCHES]
    rows = assessments.withColumn("field", F.explode(F.array_compact(F.array(*hit))))
    rows = rows.select("run_id", "field", "clause_no", "item", "requirement_text", parse_value(F.col("our_value")).alias("v"))
    return rows.withColumn("c", parse_constraint(F.col("requirement_text"), F.col("v.unit")))


def side_effect_issues(assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, rows for review: units that differ or texts that do not parse). Units are never converted.

    ``assessments``: run_id, clause_no, category, item, requirement_text, our_value, remedy, side_effects."""
    rows = effects(assessments).join(touched(assessments), ["run_id", "field"]).filter("from_clause <> clause_no AND field <> 'lead_time'")
    fits = F.col("c.op").isNotNull() & F.col("v.value").isNotNull() & (F.col("v.unit") == F.col("c.unit")) & ((F.col("unit") == F.col("v.unit")) | (F.col("op") == "multiply"))
    rows = rows.withColumns({"fits": F.coalesce(fits, F.lit(False)), "after": apply_effect(F.col("v.value"), F.col("op"), F.col("effect"))})
    broken = rows.filter(F.col("fits") & violates(F.col("after"), F.col("c")))
    sign = F.when(F.col("op") == "add", "+").when(F.col("op") == "multiply", "×").otherwise("→")
    description = F.concat(T.short_number(F.col("v.value")), F.lit(" "), sign, F.lit(" "), T.short_number(F.col("effect")), F.lit(" = "), T.short_number(F.col("after")), F.lit(" "), F.col("c.unit"), F.lit(" / "), F.col("requirement_text"))
    issues = broken.select("run_id", F.array_sort(F.array("from_clause", "clause_no")).alias("clause_nos"), F.lit("option_side_effect").alias("kind"), F.lit("high").alias("severity"), F.concat("option", F.lit(" → "), F.col("clause_no")).alias("title"), description.alias("description"), F.round("after", 6).alias("value"))
    return unique_issues(issues), rows.filter("NOT fits").select("run_id", "from_clause", "clause_no", "field", "unit")


def unique_issues(issues: DataFrame) -> DataFrame:
    """One issue for a set of clauses and a kind."""
    return issues.withColumn("clause_nos", F.array_sort("clause_nos")).groupBy("run_id", "clause_nos", "kind").agg(*[F.min_by(c, F.struct("title", "description")).alias(c) for c in issues.columns if c not in ("run_id", "clause_nos", "kind")])


def days(value: Column, unit: Column) -> Column:
    return F.when(unit == WEEK, value * DAYS_IN_WEEK).when(unit == DAY, value)


def lead_time_issues(assessments: DataFrame, terms: DataFrame) -> DataFrame:
    """Standard lead time and options' effects against a tender's limit, per option and all together.

    ``terms``: run_id, base_text, limit_text. A violation is high; an option that fits is reported as medium."""
    t = terms.select("run_id", days(parse_value(F.col("base_text"))["value"], parse_value(F.col("base_text"))["unit"]).alias("base"), days(parse_constraint(F.col("limit_text"))["hi"], parse_constraint(F.col("limit_text"))["unit"]).alias("limit"))
    e = effects(assessments).filter("field = 'lead_time' AND op = 'add'").withColumn("d", days(F.col("effect"), F.col("unit"))).filter("d IS NOT NULL")
    single = e.select("run_id", F.array("from_clause").alias("clause_nos"), "d")
    every = e.groupBy("run_id").agg(F.array_sort(F.collect_set("from_clause")).alias("clause_nos"), F.sum("d").alias("d"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = single.unionByName(every).join(t, "run_id").withColumn("total", F.col("base") + F.col("d"))
    return rows.select("run_id", "clause_nos", F.lit("option_side_effect").alias("kind"), F.when(F.col("total") > F.col("limit"), "high").otherwise("medium").alias("severity"), "base", F.col("d").alias("added"), "total", "limit")
