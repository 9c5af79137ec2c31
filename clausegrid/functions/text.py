"""Text expressions: cells, lines, sentences, tokens, models, clause numbers, trigrams. All Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns in the order in which they are tried. (?U) makes \d, \s and \b Unicode-aware.
TOKEN_PATTERNS = (
    r"(?U)\bLT-\d{3}\b",
    r"(?U)\bIP\d{2}\b",
    r"(?U)\b[A-Z]{2,4}(?:-[A-Z]{1,3})?-\d{4}-\d{2,4}\b",
    r"(?U)\bKS\s?[A-Z]\s?\d{4}\b",
    r"(?U)\bISO\s?\d{4,5}(?::\d{4})?\b",
    r"(?U)[\d,]+(?:\.\d+)?\s?(?:lm/W|lm|W|K|kg|mm|시간|℃|MΩ|V|년|주|일|대|건|%)",
)
MODEL_IN_TEXT = r"(?U)\bLT-\d{3}\b"
MODEL_IN_PATH = r"(?U)LT-\d{3}"
RESISTANCE_PREFIX = "내"
CLAUSE_SEPARATORS = r" .·\-_()\[\]/:,"
# End of fixed values.

_SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def cell(c: Column) -> Column:
    """A table cell as one clean line; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){_SPACE}+", " "))


def lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def token_estimate(c: Column) -> Column:
    """Rough number of model tokens: one for 1.5 characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 1.5)).cast("int")


def token(c: Column) -> Column:
    """The form in which exact-match tokens are compared."""
    return F.upper(F.replace(F.regexp_replace(c, rf"(?U){_SPACE}+", ""), F.lit(","), F.lit("")))


def keywords(*texts: Column) -> Column:
    """Exact-match tokens of the texts, each once, by text and then by pattern."""
    found = [F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(0)) for t in texts for p in TOKEN_PATTERNS]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), token), lambda x: x != ""))


def models(c: Column) -> Column:
    """Product models named in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MODEL_IN_TEXT), F.lit(0)))


def path_models(path: Column) -> Column:
    """Product models named in any part of a heading path (array)."""
    return F.array_distinct(F.flatten(F.transform(path, lambda p: F.regexp_extract_all(p, F.lit(MODEL_IN_PATH), F.lit(0)))))


def model_tags(path: Column, content: Column) -> Column:
    """Models of the path, or else of the content; none means common to all models."""
    return F.when(F.size(path_models(path)) > 0, path_models(path)).otherwise(models(content))


def sentences(c: Column) -> Column:
    """Sentences of a text, line by line, without bullets."""
    bare = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    cut = F.transform(bare, lambda x: F.split(F.regexp_replace(x, r"(?U)^\s*[-*]\s+", ""), r"(?U)(?<=[.!?])\s+"))
    return F.filter(F.transform(F.flatten(cut), strip), lambda x: x != "")


def item_probes(item: Column) -> Column:
    """The item's name, and the name without the one-letter resistance prefix."""
    bare = strip(F.coalesce(item, F.lit("")))
    short = strip(F.substring(bare, 2, 1 << 30))
    both = F.array(bare, F.when(bare.startswith(RESISTANCE_PREFIX) & (F.length(bare) > 2), short))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def clause_key(c: Column) -> Column:
    """Sort key of a clause number: plain numbers, then prefixed ones, then those without digits; parts compare as numbers."""
    text = strip(F.coalesce(c, F.lit("")))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)"))
    prefix = F.regexp_replace(F.regexp_replace(text, r"(?U)\d+", ""), f"^[{CLAUSE_SEPARATORS}]+|[{CLAUSE_SEPARATORS}]+$", "")
    tier = F.when(F.size(numbers) == 0, 2).when(prefix == "", 0).otherwise(1)
    return F.struct(tier.alias("tier"), prefix.alias("prefix"), numbers.alias("numbers"))


def words(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigram_list(c: Column) -> Column:
    """Trigrams of a text in order: words padded with two spaces before and one behind."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(words(c), grams))


def trigram_set(c: Column) -> Column:
    return F.array_distinct(trigram_list(c))


def overlap_share(shared: Column, left: Column, right: Column) -> Column:
    """Set similarity from the number shared and both sizes."""
    return F.coalesce(F.try_divide(shared, left + right - shared), F.lit(0.0))


def set_similarity(a: Column, b: Column) -> Column:
    """Similarity of two trigram sets."""
    return overlap_share(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def location(path: Column) -> Column:
    """The last two parts of a section path."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), " > "), lambda x: x != "")
    return F.array_join(F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts), " ")


def short_number(c: Column) -> Column:
    """A number without trailing zeros, at most six decimals."""
    return F.regexp_replace(F.round(c, 6).cast("decimal(28,6)").cast("string"), r"\.?0+$", "")
