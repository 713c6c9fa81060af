"""Page layout: columns, visual rows, boundaries between headword and translation, and the parse DAG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import text as T
from quillspark.operators.rules import numbered
from quillspark.operators.sequence import carry_over_ranges, continues_across, continues_below
from quillspark.sources import files

#: Ends of the left column and start of the right one, distance of words in a row, and samples of a boundary.
LEFT_END, RIGHT_START, ROW_DISTANCE, BOUNDARY_SAMPLES = 280.0, 300.0, 1.8, 3
#: Least gap and least ratio to the second gap of a split.
GAP, GAP_RATIO = 10.0, 1.35


def column_of(x0: Column) -> Column:
    """left, right, or null for the gutter between."""
    return F.when(x0 < LEFT_END, "left").when(x0 >= RIGHT_START, "right")


def reading_order(column: Column, y: Column) -> Column:
    """Order within a page: the left column before the right one, then down."""
    return F.struct(F.when(column == "left", 0).otherwise(1).alias("c"), y.alias("y"))


def layout_dump(boxes: DataFrame, page: list[str], only: Column | None = None) -> DataFrame:
    """(page columns, line, value): words (x0, y0, x1, y1, text) as lines of a fixed-width listing, down and then across each page; blank words are left out. only: the pages to list."""
    rows = (boxes if only is None else boxes.where(only)).where(T.strip(F.col("text")) != "")
    line = F.row_number().over(Window.partitionBy(*page).orderBy("y0", "x0", "text"))
    return rows.select(*page, line.alias("line"), F.format_string("%8.1f %8.1f %8.1f %8.1f  %s", "x0", "y0", "x1", "y1", "text").alias("value"))


def visual_rows(tokens: DataFrame, page: list[str]) -> DataFrame:
    """Words (x0, y0, text) of each page column in rows: (page, column, row, y, raw, words).

    A word joins the current row if it is near that row's running mean height. The mean drifts with every
    word, so this is a fold over the sorted words of one page column; it notes only where rows begin.
    """
    words = tokens.withColumn("column", column_of(F.col("x0"))).where("column IS NOT NULL")
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"), "text")))
    grouped = words.groupBy(*page, "column").agg(sorted_.alias("ws"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, w: Column) -> Column:
        near = (acc["n"] > 0) & (F.abs(w["y0"] - acc["mean"]) <= ROW_DISTANCE)
        n = F.when(near, acc["n"] + 1).otherwise(1)
        mean = F.when(near, (acc["mean"] * acc["n"] + w["y0"]) / (acc["n"] + 1)).otherwise(w["y0"])
        begins = F.when(near, acc["begins"]).otherwise(F.concat(acc["begins"], F.array(acc["at"])))
        return F.struct((acc["at"] + 1).alias("at"), mean.alias("mean"), n.alias("n"), begins.alias("begins"))

    cut = grouped.withColumn("begins", F.aggregate("ws", start, step, lambda a: F.concat(a["begins"], F.array(a["at"]))))
    ends = F.transform(F.slice("begins", F.lit(1), F.size("begins") - 1), lambda b, i: F.slice("ws", b + 1, F.get("begins", i + 1) - b))
    rows = cut.select(*page, "column", F.posexplode(ends).alias("row", "ws"))
    y = F.aggregate("ws", F.lit(0.0), lambda a, w: a + w["y0"]) / F.size("ws")
    out = rows.select(*page, "column", "row", y.alias("y"), F.array_sort(F.transform("ws", lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text")))).alias("words"))
    return out.withColumn("raw", F.array_join(F.transform("words", lambda x: x["text"]), " "))


def boundaries(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median place of the first word of translations in each page column, with at least three samples."""
    return rows.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("samples"), F.median(x).alias("_m")).withColumn("boundary", F.when(F.col("samples") >= BOUNDARY_SAMPLES, F.col("_m"))).drop("_m")


def split_at_boundary(words: Column, boundary: Column, slack: float = 3.0) -> Column:
    """(head, translation): words left of the boundary, and the rest; null unless both hold something."""
    side = lambda keep: F.array_join(F.transform(F.filter(words, keep), lambda w: w["text"]), " ")
    both = F.struct(side(lambda w: w["x0"] < boundary - slack).alias("head"), side(lambda w: w["x0"] >= boundary - slack).alias("translation"))
    return F.when(boundary.isNotNull(), T.let(both, lambda p: F.when((T.strip(p["head"]) != "") & (T.strip(p["translation"]) != ""), p)))


def split_at_gap(words: Column) -> Column:
    """(head, translation, gap): the row parted at its one large gap; null if none stands out or a side is unsafe.

    words: structs (x0, x1, text), by x0.
    """
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct((F.get(words, i)["x0"] - F.get(words, i - 1)["x1"]).alias("gap"), (-i).alias("at")))
    ranked = F.sort_array(F.filter(gaps, lambda g: g["gap"] > 0), asc=False)
    first, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1))["gap"], F.lit(0.0))
    at = -first["at"]
    text = lambda part: F.array_join(F.transform(part, lambda w: w["text"]), " ")
    head, rest = text(F.slice(words, F.lit(1), F.greatest(at, F.lit(1)))), text(F.slice(words, at + 1, F.size(words)))
    wide = (first["gap"] >= GAP) & ((second <= 0) | (first["gap"] >= second * GAP_RATIO))
    safe = C.is_balanced(head) & C.is_balanced(rest) & ~T.strip(head).rlike("[(,/]$") & ~T.strip(rest).rlike("^-\\S*$") & (F.length(T.strip(head)) >= 2) & (F.length(T.strip(rest)) >= 2)
    return F.when((F.size(words) > 1) & F.coalesce(wide & safe, F.lit(False)), F.struct(head.alias("head"), rest.alias("translation"), first["gap"].alias("gap")))


def is_aligned(words: Column, boundary: Column, slack: float) -> Column:
    """The row's first word stands where translations begin; false without a boundary."""
    return F.coalesce(F.array_min(F.transform(words, lambda w: w["x0"])) >= boundary - slack, F.lit(False))


def parse_rows(rows: DataFrame, partition: list[str], order: list, raw: str = "raw", first_number: int = 1) -> DataFrame:
    """The parse DAG over repaired rows: every row with its kind (MARKER, NOISE, CARD, REVIEW, REJECT), parsed parts, carried chapter and page, and the card's id.

    Cards, rejects and review items are filters of the result. Parsed texts are cleaned once more; ids number the
    cards in the order of all rows.
    """
    t = F.col(raw)
    out = rows.withColumns({"_chapter": C.marker(t, "Kapitel"), "_page": C.marker(t, "Sidan"), "_noise": C.is_noise(t), "parsed": C.parse_row(t)})
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"chapter": F.last_value("_chapter", ignoreNulls=True).over(w), "page": F.last_value("_page", ignoreNulls=True).over(w)})
    odd = C.suspicious_fallback(F.col("parsed.method"), F.col("parsed.translation"))
    kind = F.when(F.col("_chapter").isNotNull() | F.col("_page").isNotNull(), "MARKER").when(F.col("_noise"), "NOISE").when(F.col("parsed").isNull(), "REJECT").when(odd, "REVIEW").otherwise("CARD")
    out = out.withColumn("kind", kind).drop("_chapter", "_page", "_noise")
    clean = F.struct(T.clean_output(F.col("parsed.head")).alias("head"), T.normalize_forms(F.col("parsed.forms")).alias("forms"), T.clean_output(F.col("parsed.translation")).alias("translation"), F.col("parsed.method").alias("method"))
    out = out.withColumn("parsed", F.when(F.col("parsed").isNotNull(), clean))
    cards = numbered(out, [*partition, *order], "_card", F.col("kind") == "CARD")
    return cards.withColumn("card_id", F.when(F.col("_card").isNotNull(), C.card_id(F.col("_card") + (first_number - 1)))).drop("_card")


def parse_pages(rows: DataFrame, doc: str, order: str, page: str = "page", side: str = "side", short: int | None = None) -> DataFrame:
    """The parse of rows with word places: by separator, by forms, else where translations begin on the page, else as the continuation of the card before.

    rows: (doc, order, page, side, y, words: array of (x0, text) by place, raw, ...). Where a separator parts a row, the word after it tells
    where translations begin; the median of at least BOUNDARY_SAMPLES of a page column parts that column's other rows, and tells
    which rows begin inside the translations. Such a row, if nothing parts it, is joined to the last card, if that
    card's translation goes on and its last row is just above, or at the foot of the column before. The translation as
    joined so far decides, so this is a fold, over the rows between two cards that lie on the first one's page; documents and page columns may be of any size.
    Adds kind (MARKER, NOISE, CARD, JOINED, REJECT), parsed (a card's with its whole translation), boundary, aligned and card, the order of
    the card that a row is part of. With short, only fragments of so many words are joined. Rows are read for the boundaries first,
    then parsed once and stored.
    """
    t = F.col("raw")
    after = lambda ws: T.let(F.array_position(F.transform(ws, lambda w: T.has_separator(w["text"])), True).cast("int"), lambda at: F.when(at > 0, F.get(ws, at)["x0"]))
    middle = F.when(F.count("_x") >= BOUNDARY_SAMPLES, F.median("_x"))
    edges = rows.withColumn("_x", T.let(F.col("words"), after)).groupBy(doc, page, side).agg(middle.alias("boundary")).where("boundary IS NOT NULL")
    edges = files.stored(edges, "boundaries")  # its size as stored decides about a broadcast
    edges = edges.withColumnsRenamed({doc: "_doc", page: "_on", side: "_side"})
    out = rows.withColumns({"_chapter": C.marker(t, "Kapitel"), "_page": C.marker(t, "Sidan"), "_noise": C.is_noise(t), "_parsed": C.parse_row(t)})
    out = out.join(edges, F.col(doc).eqNullSafe(F.col("_doc")) & F.col(page).eqNullSafe(F.col("_on")) & F.col(side).eqNullSafe(F.col("_side")), "left").drop("_doc", "_on", "_side")
    left = lambda p: T.let(C.extract_morphology(p["head"]), lambda m: F.struct(m["text"].alias("head"), m["forms"].alias("forms"), T.normalize_basic(p["translation"]).alias("translation"), F.lit("LAYOUT_FALLBACK").alias("method")))
    by_place = T.let(split_at_boundary(F.col("words"), F.col("boundary")), lambda p: F.when(p.isNotNull(), T.let(left(p), lambda x: F.when((x["head"] != "") & (x["translation"] != ""), x))))
    kind = F.when(F.col("_chapter").isNotNull() | F.col("_page").isNotNull(), "MARKER").when(F.col("_noise"), "NOISE").when(F.col("_parsed").isNotNull(), "CARD").otherwise("REJECT")
    out = out.withColumns({"aligned": is_aligned(F.col("words"), F.col("boundary"), 4.0), "kind": kind, "_parsed": F.coalesce("_parsed", by_place)})
    out = out.withColumn("kind", F.when((F.col("kind") == "REJECT") & F.col("_parsed").isNotNull(), "CARD").otherwise(F.col("kind"))).drop("_chapter", "_page", "_noise")
    out = files.stored(out, "parsed-rows")
    may = (F.col("kind") == "REJECT") & F.col("aligned")
    joins = _continuations(out, doc, order, page, side, may if short is None else may & C.is_short_fragment(t, short))
    out = out.join(joins, [doc, order], "left")
    card = F.when(F.col("kind") == "CARD", F.col("_parsed").withField("translation", F.coalesce("_whole", F.col("_parsed.translation"))))
    clean = F.struct(T.clean_output(card["head"]).alias("head"), T.normalize_forms(card["forms"]).alias("forms"), T.clean_output(card["translation"]).alias("translation"), card["method"].alias("method"))
    return out.withColumns({"parsed": F.when(card.isNotNull(), clean), "kind": F.when(F.col("card").isNotNull(), "JOINED").otherwise(F.col("kind")), "card": F.when(F.col("kind") == "CARD", F.col(order)).otherwise(F.col("card"))}).drop("_parsed", "_whole")


def _continuations(rows: DataFrame, doc: str, order: str, page: str, side: str, may: Column) -> DataFrame:
    """(doc, order, card, _whole): the rows that go on with a card, with its order, and the cards that go on, with their whole translation.

    A card begins anew whatever was before it, so each one is folded by itself, if its own translation goes on, with those
    rows up to the next card that a chain can reach from it: of its page, below it or in the next column.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    is_card = F.col("kind") == "CARD"
    text = F.when(is_card, F.col("_parsed.translation")).otherwise(T.normalize_basic(F.col("raw")))
    live = rows.where(is_card | may).select(F.col(doc).alias("doc"), F.col(order).alias("at"), is_card.alias("card"), text.alias("text"), F.col("y").cast("double").alias("y"), F.col(side).alias("side"), F.col(page).alias("page"))
    live = carry_over_ranges(live, ["doc"], ["at"], "of", F.when(F.col("card"), F.struct("at", "y", "side", "page", C.goes_on_strict(F.col("text")).alias("open"))))
    reached = (F.col("page") == F.col("of.page")) & (((F.col("side") == F.col("of.side")) & (F.col("y") > F.col("of.y"))) | ((F.col("of.side") == "left") & (F.col("side") == "right")))
    runs = live.where(F.col("of.open") & (F.col("card") | reached)).groupBy("doc", F.col("of.at").alias("card")).agg(F.array_sort(F.collect_list(F.struct("at", "text", "y", "side", "page"))).alias("ws"))
    first = F.get("ws", F.lit(0))
    start = F.struct(F.array().cast(f"array<{kinds[order]}>").alias("joins"), *(first[c].alias(c) for c in ("text", "y", "side", "page")))

    def step(acc: Column, w: Column) -> Column:
        place = (w["y"], w["side"], w["page"], acc["y"], acc["side"], acc["page"])
        more = (continues_below(*place) | continues_across(*place)) & C.goes_on_strict(acc["text"])
        joined = F.struct(F.concat(acc["joins"], F.array(w["at"])).alias("joins"), C.join_continuation(acc["text"], w["text"]).alias("text"), *(w[c].alias(c) for c in ("y", "side", "page")))
        return F.when(more, joined).otherwise(acc)

    folded = runs.where(F.size("ws") > 1).select("doc", "card", F.aggregate(F.slice("ws", F.lit(2), F.size("ws")), start, step).alias("f")).where(F.size("f.joins") > 0)
    no_card, no_text = F.lit(None).cast(kinds[order]).alias("card"), F.lit(None).cast("string").alias("whole")
    told = F.concat(F.array(F.struct(F.col("card").alias("at"), no_card, F.col("f.text").alias("whole"))), F.transform("f.joins", lambda j: F.struct(j.alias("at"), F.col("card").alias("card"), no_text)))
    return folded.select(F.col("doc").alias(doc), F.explode(told).alias("t")).select(doc, F.col("t.at").alias(order), F.col("t.card").alias("card"), F.col("t.whole").alias("_whole"))


def review_items(parsed: DataFrame, partition: list[str], order: list, raw: str = "raw") -> DataFrame:
    """What a reader needs to settle each REVIEW or REJECT row of parse_rows(): the row, the card before it, the row after it, and the attempted parse."""
    w = Window.partitionBy(*partition).orderBy(*order)
    card = F.when(F.col("kind") == "CARD", F.struct(F.col("card_id").alias("id"), F.col("parsed.head").alias("head"), F.col("parsed.translation").alias("translation"), "chapter", "page"))
    out = parsed.withColumns({"previous_card": F.last_value(card, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next_row": F.lead(raw).over(w)})
    reason = F.when(F.col("kind") == "REVIEW", "SUSPICIOUS_FALLBACK").otherwise("NO_SPLIT")
    return out.where("kind IN ('REVIEW', 'REJECT')").withColumns({"reason": reason, "attempted_parse": F.col("parsed")}).drop("parsed", "card_id", "kind")
