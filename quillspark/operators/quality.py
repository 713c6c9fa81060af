"""Data-quality rules as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import text as T

#: Marks that extraction leaves behind, and literals that stand for nothing.
BAD_CHARACTERS = {"\u00ad": "soft hyphen", "\u200b": "zero width space", "�": "replacement character", "\x00": "NULL character"}
LITERALS = ("null", "none", "nan", "undefined")
CEFR = ("A1", "A2", "B1", "B2", "C1", "C2")


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for each row and rule that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(F.col(id_col), F.explode(found).alias("rule"))


def has_residue(*columns: Column) -> Column:
    """Marks of extraction left in any of the texts."""
    return F.concat_ws("", *columns).rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in BAD_CHARACTERS) + "]")


def structure_counts(df: DataFrame, rules: dict[str, Column], id_col: str = "id", expected: int | None = None) -> DataFrame:
    """(rule, n): rows against each rule, ids that stand more than once, and how far the number of rows is from the expected one."""
    counted = df.agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules]))
    repeated = df.groupBy(id_col).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("DUPLICATE_ID").alias("rule"), "n")
    out = counted.select(pairs.alias("p")).select("p.rule", "p.n").unionByName(repeated)
    return out if expected is None else out.unionByName(df.agg(F.abs(F.count("*") - expected).alias("n")).select(F.lit("ROW_COUNT").alias("rule"), "n"))


def text_artifacts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, artifact): one row for each field and artifact in it."""
    cells = df.select(id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("x")).where("x.v IS NOT NULL")
    v = F.col("x.v")
    plain = {f"BAD_CHARACTER {name}": v.contains(ch) for ch, name in BAD_CHARACTERS.items()}
    plain |= {"WHITESPACE_ARTIFACT": v.rlike(r"[\n\r\t]"), "DOUBLE_SPACE": v.contains("  "), "TRAILING_HYPHEN": T.strip_end(v).rlike("[A-Za-zÅÄÖåäö]{3,}-$")}
    # all literals in one pass over the folded text
    words = F.regexp_extract_all(F.lower(v), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(LITERALS)})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    literals = F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("SUSPICIOUS_TEXT "), w))
    found = F.concat(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in plain.items()])), literals)
    return cells.select(id_col, F.col("x.field").alias("field"), F.explode(found).alias("artifact"))


def layout_rules(head: Column, translation: Column, page: Column) -> dict[str, Column]:
    """Signs that a page's furniture was read as a card, or that rows ran together."""
    low = F.lower(F.coalesce(head, F.lit("")))
    return {
        "NO_PAGE": page.isNull(),
        "LONG_HEAD": F.length(head) > 80,
        "LONG_TRANSLATION": F.length(translation) > 120,
        "PAGE_AS_WORD": low.startswith("sidan "),
        "CHAPTER_AS_WORD": low.startswith("kapitel "),
        "HEADER": low.contains("ordlista"),
    }


def run_rules(head: Column, translation: Column, chapter: Column, page: Column) -> dict[str, Column]:
    """What a parse run reports of its cards; a card may be reported for several reasons."""
    head, translation = F.coalesce(head, F.lit("")), F.coalesce(translation, F.lit(""))
    both = F.concat(head, F.lit(" "), translation)
    return {
        "PARENTHESES_LEFT": head.rlike("[()]"),
        "NO_PAGE": page.isNull(),
        "NO_CHAPTER": chapter.isNull(),
        "SOFT_HYPHEN": both.contains(T.SOFT_HYPHEN),
        "EMPTY_HEAD": T.strip(head) == "",
        "EMPTY_TRANSLATION": T.strip(translation) == "",
        "OPEN_TRANSLATION": T.strip_end(translation).rlike("[,/-]$"),
    }


#: Misspellings that must not come back.
FORBIDDEN = ("enrmous", "käntt", "spontanteous")


def final_violations(cards: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN, levels: tuple[str, ...] = ("B1-B2", "B1–B2"), id_col: str = "id") -> DataFrame:
    """(id, rule, severity) of final cards (head, translation, forms, level, chapters, occurrences): empty texts, missing lists, forbidden fragments, repeated ids and pairs are errors, unexpected levels warnings."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("head", "translation", "forms"))))
    rules = {"EMPTY_HEAD": T.strip(F.coalesce("head", F.lit(""))) == "", "EMPTY_TRANSLATION": T.strip(F.coalesce("translation", F.lit(""))) == "", "CHAPTERS_NO_LIST": F.col("chapters").isNull(), "OCCURRENCES_NO_LIST": F.col("occurrences").isNull()}
    rules |= {f"FORBIDDEN {w}": text.contains(w) for w in forbidden}
    rows = violations(cards, id_col, rules | {"UNEXPECTED_LEVEL": F.col("level").isNotNull() & ~F.col("level").isin(*levels)})
    twice = cards.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("DUPLICATE_ID").alias("rule"))
    keyed = cards.select(id_col, T.match_key(F.col("head")).alias("h"), T.match_key(F.col("translation")).alias("t"))
    pairs = keyed.groupBy("h", "t").agg(F.min(id_col).alias(id_col), F.count("*").alias("n")).where("n > 1").select(id_col, F.lit("DUPLICATE_PAIR").alias("rule"))
    out = rows.unionByName(twice).unionByName(pairs)
    return out.withColumn("severity", F.when(F.col("rule") == "UNEXPECTED_LEVEL", "WARNING").otherwise("ERROR"))


def reason_rules(head: Column, translation: Column, forms: Column, chapter: Column, page: Column) -> dict[str, Column]:
    """The reasons to look at a card again; HEAD and TRANSLATION name the sides of the entry in whatever languages."""
    none = F.lit("")
    head, translation, forms = F.coalesce(head, none), F.coalesce(translation, none), F.coalesce(forms, none)
    return {
        "NO_PAGE": page.isNull(),
        "NO_CHAPTER": chapter.isNull(),
        "FORMS_INSIDE_HEAD": head.rlike("[()]"),
        "BROKEN_PARENTHESES_HEAD": ~C.is_balanced(head),
        "BROKEN_PARENTHESES_TRANSLATION": ~C.is_balanced(translation),
        "EMPTY_HEAD": T.strip(head) == "",
        "EMPTY_TRANSLATION": T.strip(translation) == "",
        "VERY_SHORT_TRANSLATION": F.length(T.strip(translation)) <= 2,
        "POSSIBLY_CUT_TRANSLATION": T.ends_with_any(F.lower(T.strip(translation)), C.CUT_ENDINGS),
        "SOFT_HYPHEN": head.contains(T.SOFT_HYPHEN) | translation.contains(T.SOFT_HYPHEN),
        "TRANSLATION_ENDS_HYPHEN": translation.endswith("-"),
        "HEAD_ENDS_HYPHEN": head.endswith("-"),
        "PARENTHESES_INSIDE_FORMS": forms.rlike("[()]"),
        "VERY_LONG_FORMS": F.length(forms) > 80,
        "VERY_LONG_HEAD": F.length(head) > 120,
        "VERY_LONG_TRANSLATION": F.length(translation) > 180,
    }


def word_violations(df: DataFrame, id_col: str, head: str, meanings: str, level: str) -> DataFrame:
    """(id, rule): repeated ids, blank headwords, words without a meaning, levels outside the six."""
    level_ok = F.coalesce(F.col(level).isin(*CEFR), F.lit(False))
    rows = violations(df, id_col, {"BLANK_HEAD": T.strip(F.coalesce(head, F.lit(""))) == "", "NO_MEANING": F.coalesce(F.size(meanings), F.lit(0)) < 1, "BAD_LEVEL": ~level_ok})
    return rows.unionByName(df.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("DUPLICATE_ID").alias("rule")))


def json_violations(rows: DataFrame, id_col: str, raw: str, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """(id, field, problem, found): where raw JSON departs from the fields that each object must have.

    fields gives for each name its type (text, whole, number, flag, list, texts: a list of texts alone) and whether
    null may stand there. Problems: NO_JSON (not JSON, or no text at all) and NO_OBJECT for the row as a whole (field null), MISSING
    (no such field), NULL_VALUE, NUMBER_AS_TEXT (a text that reads as a number, where a number must stand), WRONG_TYPE.
    found is the type that was found. The text is parsed once, to VARIANT; one row may have several problems.
    """
    parsed = rows.select(id_col, F.try_parse_json(raw).alias("_v"))
    kind = F.schema_of_variant("_v")

    def checked(name: str, wanted: str, nullable: bool) -> Column:
        path = "$['" + name + "']"
        at = F.try_variant_get("_v", path, "variant")
        found = F.schema_of_variant(at)
        short = F.when(found.startswith("DECIMAL"), F.lit("DECIMAL")).otherwise(F.regexp_extract(found, "^[A-Z]+", 0))
        number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
        ok = {"text": found == "STRING", "whole": found == "BIGINT", "number": number, "flag": found == "BOOLEAN", "list": found.startswith("ARRAY<"), "texts": found.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.array_contains(F.transform(F.try_variant_get("_v", path, "array<variant>"), lambda x: F.is_variant_null(x)), True), F.lit(False))}[wanted]
        text = F.try_variant_get("_v", path, "string")
        as_text = (found == "STRING") & text.rlike(r"^\s*[-+]?[0-9]+(\.[0-9]+)?\s*$") if wanted in ("whole", "number") else F.lit(False)
        null = F.lit(None).cast("string") if nullable else F.lit("NULL_VALUE")
        problem = F.when(at.isNull(), F.lit("MISSING")).when(F.is_variant_null(at), null).when(ok, F.lit(None)).when(as_text, F.lit("NUMBER_AS_TEXT")).otherwise(F.lit("WRONG_TYPE"))
        return F.when(problem.isNotNull(), F.struct(F.lit(name).alias("field"), problem.alias("problem"), short.alias("found")))

    whole = lambda p, found: F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(p).alias("problem"), found.alias("found")))
    each = F.array_compact(F.array(*[checked(n, *f) for n, f in fields.items()]))
    problems = F.when(F.col("_v").isNull(), whole("NO_JSON", F.lit(None).cast("string"))).when(~kind.startswith("OBJECT<"), whole("NO_OBJECT", F.regexp_extract(kind, "^[A-Z]+", 0))).otherwise(each)
    return parsed.select(id_col, F.explode(problems).alias("_p")).select(id_col, "_p.*")


def gate(df: DataFrame, errors: DataFrame) -> DataFrame:
    """df if there are no errors; raises at once otherwise, as the sink must not be reached."""
    bad = errors.limit(5).collect()
    if bad:
        raise ValueError(f"not written: {[r.asDict() for r in bad]}")
    return df
