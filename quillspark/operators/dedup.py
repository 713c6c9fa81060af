"""Duplicate groups, survivorship and lineage. Rows of a group are small structs; whole cards are not gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import text as T

#: Places of missing chapters and pages in the order of occurrences.
NO_CHAPTER, NO_PAGE = 999, 999999


def keyed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds match keys: {key column: source column}."""
    return df.withColumns({k: T.match_key(F.col(c)) for k, c in columns.items()})


def duplicate_groups(df: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Groups of two or more rows that share keys: size and the ids in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(id_col)).alias("ids")).where("n > 1")


def duplicate_grouping_sets(df: DataFrame, key_sets: dict[str, list[str]]) -> DataFrame:
    """Groups of two or more rows for several key sets in one pass: (key_set, keys..., n)."""
    columns = list(dict.fromkeys(c for s in key_sets.values() for c in s))
    sets = [[F.col(c) for c in s] for s in key_sets.values()]
    out = df.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).where("n > 1")
    number = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): name for name, s in key_sets.items()}
    name = F.lit(None).cast("string")
    for g, label in number.items():
        name = F.when(F.col("gid") == g, label).otherwise(name)
    return out.select(name.alias("key_set"), *columns, "n")


def survivors(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Adds rank (1 survives) and group size, by an order that ends in a unique column."""
    w = Window.partitionBy(*keys)
    return df.withColumn("survivor_rank", F.row_number().over(w.orderBy(order))).withColumn("group_size", F.count("*").over(w))


def occurrence(chapter: str, page: str, pdf_page: str, id_col: str) -> Column:
    """Where a card stands."""
    return F.struct(F.col(chapter).alias("chapter"), F.col(page).alias("page"), F.col(pdf_page).alias("source_pdf_page"), F.col(id_col).alias("original_id"))


def merged_occurrences(lists: Column) -> Column:
    """A list of lists of occurrences as one: distinct, by chapter, page, PDF page and id, missing places last."""
    keyed_ = F.transform(F.array_distinct(F.flatten(lists)), lambda o: F.struct(F.coalesce(o["chapter"], F.lit(NO_CHAPTER)).alias("a"), F.coalesce(o["page"], F.lit(NO_PAGE)).alias("b"), F.coalesce(o["source_pdf_page"], F.lit(NO_PAGE)).alias("c"), o["original_id"].alias("d"), o.alias("o")))
    return F.transform(F.array_sort(keyed_), lambda k: k["o"])


def _rest(c: Column) -> Column:
    """A list without its first member."""
    return F.slice(c, F.lit(2), F.size(c))


def best_forms(forms: str) -> Column:
    """Aggregate: the most complete non-empty forms; empty if there are none."""
    c = F.col(forms)
    return F.coalesce(F.max(F.when(T.strip(c) != "", C.forms_rank(c)))["forms"], F.lit(""))


def merge_groups(df: DataFrame, keys: list[str], order: Column, id_col: str = "id", forms: str = "forms", chapter: str = "chapter", occurrences: Column | None = None, lineage: str | None = None, override: tuple[str, str] | None = None) -> DataFrame:
    """One row per key: the survivor's columns, best forms, merged occurrences, sorted chapters and lineage.

    order: struct that ranks the rows of a group and ends in a unique field. Rows with an empty key column
    are never merged. The lineage (deduplicated_from) lists the ids that earlier merges put into lineage, then
    the other ids of the group, each once and in that order, without the survivor's. override: (column, rule):
    a value of rule that is not null in the group takes the place of the survivor's column.
    """
    empty = F.lit(False)
    for k in keys:
        empty = empty | (F.coalesce(F.col(k), F.lit("")) == "")
    alone = F.when(empty, F.col(id_col).cast("string"))
    kept = [c for c in df.columns if c not in (*keys, forms, "occurrences", "chapters", "deduplicated_from", "group_size", *([override[1]] if override else []))]
    nothing = F.array().cast(f"array<{df.schema[id_col].dataType.simpleString()}>")
    earlier = F.coalesce(F.col(lineage), nothing) if lineage else nothing
    seen = occurrences if occurrences is not None else F.array(occurrence(chapter, "page", "source_pdf_page", id_col))
    rows = df.withColumns({"_alone": alone, "_order": order, "_seen": seen})
    out = rows.groupBy(*keys, "_alone").agg(
        F.min(F.struct("_order", *kept)).alias("keeper"),
        best_forms(forms).alias(forms),
        merged_occurrences(F.collect_list("_seen")).alias("occurrences"),
        F.array_sort(F.collect_list(F.struct("_order", F.col(id_col).alias("id"), earlier.alias("earlier")))).alias("_members"),
        F.count("*").alias("group_size"),
        *([F.max(override[1]).alias("_override")] if override else []),
    )
    removed = F.concat(F.flatten(F.transform("_members", lambda x: x["earlier"])), _rest(F.transform("_members", lambda x: x["id"])))
    chapters = F.array_sort(F.array_compact(F.array_distinct(F.transform("occurrences", lambda o: o["chapter"]))))
    value = lambda c: F.coalesce("_override", F.col("keeper")[c]) if override and c == override[0] else F.col("keeper")[c]
    return out.select(*[value(c).alias(c) for c in kept], forms, "occurrences", chapters.alias("chapters"), F.filter(F.array_distinct(removed), lambda x: x != F.col("keeper")[id_col]).alias("deduplicated_from"), "group_size")


def normalize_final(cards: DataFrame, chapter: str = "chapter", id_col: str = "id") -> DataFrame:
    """Final cards: texts without white space at the ends, chapters and occurrences filled where a card was never merged."""
    own = F.array(occurrence(chapter, "page", "source_pdf_page", id_col))
    chapters = F.coalesce("chapters", F.array_compact(F.array(chapter))) if "chapters" in cards.columns else F.array_compact(F.array(chapter))
    seen = F.coalesce("occurrences", own) if "occurrences" in cards.columns else own
    return cards.withColumns({"chapters": chapters, "occurrences": seen, **{c: T.strip(F.coalesce(c, F.lit(""))) for c in ("head", "translation", "forms")}})


def conflicting_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two or more rows that hold more than one value."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(value).alias("n_values"), F.array_sort(F.collect_set(value)).alias("values")).where("n > 1 AND n_values > 1")


def surviving_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of the promise that no key stands twice."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
