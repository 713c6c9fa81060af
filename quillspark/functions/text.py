"""Text normalisation as Column -> Column functions; all but nfc() stay inside code generation.

White space is Unicode white space. Java's \\s is ASCII only, so patterns carry (?U) and name the four
separators that it leaves out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)[\s\x1c-\x1f]"
SOFT_HYPHEN = "\u00ad"
#: Blanks that part a headword from its translation.
SEPARATORS = "\u2002\u2003\u2009\u202f"
#: Punctuation that may surround a whole expression.
EDGES = " \\t\\r\\n.,!?;:\"'“”‘’()\\[\\]{}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(c, f"(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def strip_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


def normalize_basic(c: Column) -> Column:
    """Null as empty; no-break blanks and dashes in plain form; zero-width marks dropped; white space collapsed."""
    return collapse(F.translate(F.coalesce(c, F.lit("")), "\u00a0–—−\u200b\ufeff", " ---"))


def normalize_forms(c: Column) -> Column:
    """normalize_basic with suffixes tied to their hyphens and one blank after each comma."""
    tied = F.regexp_replace(normalize_basic(c), r"-\s+(?=\p{L})", "-")
    return F.trim(F.regexp_replace(tied, r"\s*,\s*", ", "))


def drop_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit(SOFT_HYPHEN), F.lit(""))


def has_separator(c: Column) -> Column:
    return c.rlike(f"[{SEPARATORS}]")


def drop_separators(c: Column) -> Column:
    return F.translate(c, SEPARATORS, "")


def clean_output(c: Column) -> Column:
    """Separators vanish before white space is collapsed, so they never become blanks."""
    return normalize_basic(drop_soft_hyphens(drop_separators(F.coalesce(c, F.lit("")))))


def clean_field(c: Column) -> Column:
    """Soft hyphens and zero-width blanks dropped, ends stripped; null stays null."""
    return strip(F.translate(c, SOFT_HYPHEN + "\u200b", ""))


def match_key(c: Column) -> Column:
    """Key for equality without regard to case and spacing; null as empty."""
    return F.replace(F.lower(collapse(F.coalesce(c, F.lit("")))), F.lit("ß"), F.lit("ss"))


#: Rows and bytes that go to Python at once.
ARROW_ROWS, ARROW_BYTES = 1024, 4 << 20


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode composition; Spark has no builtin for it, so texts go through Python, in batches whose rows and bytes are bounded (settings of the session)."""
    spark = SparkSession.getActiveSession()
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark is not None and not 0 < _number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return _composed(c)


def _number(value: str) -> int:
    """A setting of rows or bytes; one with a unit counts as not set."""
    bare = value.removesuffix("b").removesuffix("B")
    return int(bare) if bare.lstrip("-").isdigit() else 0


def strip_inflection(c: Column) -> Column:
    """(text, removed): without parentheses that hold only letters, hyphens, commas and slashes, at least one a hyphen."""
    cleaned = lambda x: collapse(F.regexp_replace(x, r"(?U)\(\s*(?=[^)]*-)[A-Za-zÅÄÖåäöÉéÜüÆæØø\-\s,/]+\)", ""))
    return let(c, lambda x: let(cleaned(x), lambda t: F.struct(t.alias("text"), (t != x).alias("removed"))))


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{EDGES}]+|[{EDGES}]+$", "")


def lexicon_key(c: Column) -> Column:
    """(normalized, removed): a text composed, without inflections and edge punctuation, in small letters."""
    bare = strip_inflection(collapse(nfc(F.coalesce(c, F.lit("")))))
    return let(bare, lambda b: F.struct(F.lower(collapse(strip_edges(b["text"]))).alias("normalized"), b["removed"].alias("removed")))


def plain_key(c: Column) -> Column:
    """The older headword form: composed, edge punctuation off, small letters, parentheses kept inside."""
    return F.lower(strip_edges(collapse(nfc(F.coalesce(c, F.lit(""))))))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit(""))))


def string_list(values: Column, scalar: Column | None = None) -> Column:
    """Trimmed non-empty members of a list, or of the one-member list of a scalar; else an empty list."""
    whole = F.coalesce(values, F.array(scalar) if scalar is not None else F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(whole, strip), lambda x: x.isNotNull() & (x != ""))


def count_of(c: Column, mark: str) -> Column:
    """How often a single character stands in a text."""
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def ends_with_any(c: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | c.endswith(e)
    return out


def listed(values: Column, between: str = ", ") -> Column:
    """The non-empty members of a list on one line, or null."""
    return F.nullif(F.array_join(F.filter(values, lambda x: x != ""), between), F.lit(""))


def word_display(english: Column, pos: Column, article: Column, ipa: Column) -> Column:
    """One line for a word: meanings, the article or else the part of speech, and pronunciations between slashes."""
    kind = F.coalesce(F.nullif(article, F.lit("")), F.nullif(pos, F.lit("")))
    said = F.when(F.size(ipa) > 0, F.concat(F.lit("/"), F.array_join(ipa, "/, /"), F.lit("/")))
    return F.concat_ws(" • ", listed(english), kind, said)


def forms_display(noun: list[Column], verb: list[Column]) -> Column:
    """The forms of a word on one line: those of a noun, or else those of a verb; null if it has neither."""
    line = lambda parts: F.nullif(F.concat_ws(" • ", *(F.nullif(strip(p), F.lit("")) for p in parts)), F.lit(""))
    return F.coalesce(line(noun), line(verb))
