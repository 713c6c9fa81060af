"""Corrections, rule-driven merges and reconciliation; rules are tables supplied by the caller.

Where a rule has no target or no single best target, the case is a row of an error table: a lazy plan
cannot stop half-way, so gates belong to the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import dedup
from quillspark.sources import files


def apply_corrections(df: DataFrame, corrections: DataFrame, id_col: str = "id", columns: list[str] | None = None) -> DataFrame:
    """Replaces the columns that a correction states (not null) by id; adds corrected."""
    columns = columns or [c for c in corrections.columns if c != id_col]
    new = corrections.select(id_col, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = df.join(new, id_col, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns], F.coalesce("_hit", F.lit(False)).alias("corrected"))


def missing_targets(df: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """Rules whose target does not exist."""
    return rules.join(df.select(id_col), id_col, "left_anti")


def explode_merges(rules: DataFrame, ids: str = "ids", id_col: str = "id") -> DataFrame:
    """One row for each member of an id-list rule."""
    return rules.select(*[c for c in rules.columns if c != ids], F.posexplode(ids).alias("position", id_col))


def special_merge(df: DataFrame, rules: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """Collapses the rows of each id-list rule into the one of the smallest id, with the rule's value and the removed ids.

    rules: (rule_id, ids, value); an id belongs to at most one rule.
    """
    members = explode_merges(rules, "ids", id_col).select("rule_id", id_col, F.col(value).alias("_value"))
    rows = df.join(members, id_col, "left")
    w = Window.partitionBy("rule_id").orderBy(id_col)
    members = F.array_sort(F.collect_list(id_col).over(Window.partitionBy("rule_id")))  # as many as a rule lists
    led = rows.where("rule_id IS NOT NULL").withColumns({"_r": F.row_number().over(w), "_ids": members}).withColumn("removed_ids", F.slice("_ids", F.lit(2), F.size("_ids")))
    merged = led.where("_r = 1").select(*[F.coalesce("_value", value).alias(value) if c == value else F.col(c) for c in df.columns], "removed_ids")
    kept = rows.where("rule_id IS NULL").select(*df.columns, F.array().cast(merged.schema["removed_ids"].dataType).alias("removed_ids"))
    return kept.unionByName(merged)


def missing_members(df: DataFrame, rules: DataFrame, ids: str = "ids", id_col: str = "id") -> DataFrame:
    """(rule_id, id) of the members of id-list rules that do not exist."""
    return missing_targets(df, explode_merges(rules.select("rule_id", ids), ids, id_col), id_col).select("rule_id", id_col)


def finalize(cards: DataFrame, special: DataFrame, keep_separate: DataFrame, merges: DataFrame, order: Column, head_key: str = "head_key", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(final cards, decisions): id-list merges, then one decision for each headword, whose merges take the rule's translation.

    cards: (id, head, translation, forms, occurrences, deduplicated_from, ...); special: (rule_id, ids, translation);
    keep_separate: (head_key); merges: (head_key, translation). Lineage and occurrences add up over both steps.
    """
    members = explode_merges(special, "ids", id_col).select("rule_id", id_col, F.col("translation").alias("_by_rule"))
    rows = cards.join(members, id_col, "left").withColumn("_group", F.col("rule_id").cast("string")).drop("rule_id")
    step = lambda df: dedup.merge_groups(df, ["_group"], order, id_col, occurrences=F.col("occurrences"), lineage="deduplicated_from", override=("translation", "_by_rule")).drop("group_size")
    once = step(rows)
    groups = once.groupBy(head_key).agg(F.count("*").alias("n"))
    decided = decide_conflicts(groups, head_key, keep_separate, merges)
    by_head = decided.where("decision = 'MERGE'").select(head_key, F.col(head_key).alias("_group"), F.col("translation").alias("_by_rule"))
    return step(once.join(by_head, head_key, "left")), decided


def decide_conflicts(groups: DataFrame, key: str, keep_separate: DataFrame, merges: DataFrame) -> DataFrame:
    """Decision for each group of one headword: single, kept apart, merged by rule, or unresolved (kept and reported).

    groups: (key, n, ...); keep_separate: (key); merges: (key, translation).
    """
    apart = keep_separate.select(F.col(key), F.lit(True).alias("_apart")).distinct()
    out = groups.join(apart, key, "left").join(merges.select(key, F.col("translation").alias("_merged")), key, "left")
    decision = F.when(F.col("n") < 2, "SINGLE").when(F.col("_apart"), "KEEP_SEPARATE").when(F.col("_merged").isNotNull(), "MERGE").otherwise("UNRESOLVED")
    return out.withColumn("decision", decision).withColumn("translation", F.when(F.col("decision") == "MERGE", F.col("_merged"))).drop("_apart", "_merged")


#: Candidates of one key from which on best_match() counts by columns instead of pairing each with each wanted row.
CROWD = 4096


def best_match(wanted: DataFrame, candidates: DataFrame, key: str, scores: list[tuple[str, int, bool]], id_col: str = "id", wanted_id: str = "review", crowd: int = CROWD) -> DataFrame:
    """The candidate of each wanted row with the highest score among those of equal key.

    scores: (column, points above 0, needs a non-empty value). Result: (wanted_id, id, score, status), status OK,
    AMBIGUOUS where two share the best score (id is then null) or NONE without a candidate. Rows of an equal wanted_id are one.

    Keys of up to `crowd` candidates form pairs. In a crowded key candidates are counted by each subset of their columns
    instead, and wanted values are looked up in each subset: the points of the best subset that is met are
    the best score, since a candidate that met more columns would have more, and every candidate of that score meets exactly one such
    subset. Candidates and wanted rows of equal values go through this as one. So a key of m candidates and n wanted rows
    costs at most 2^columns * (m + n) rows, not m * n. Whether there is such a key is asked first (one small job); the
    result is the same either way. Both sides are shuffled: files of repeated values look small enough to be broadcast, but their rows are not.
    """
    w = wanted.select(wanted_id, key, *[F.col(c).alias(f"w_{c}") for c, *_ in scores])
    c = candidates.select(key, id_col, *[F.col(c).alias(f"c_{c}") for c, *_ in scores])
    score = F.lit(0)
    for column, points, filled in scores:
        same = F.col(f"w_{column}") == F.col(f"c_{column}")
        score = score + F.when(same & (F.col(f"w_{column}") != "") if filled else same, points).otherwise(0)
    full = c.groupBy(key).count().where(F.col("count") > crowd).where(F.col(key).isNotNull()).select(key)
    crowds = bool(full.take(1))
    few = lambda rows: rows.join(full, key, "left_anti") if crowds else rows
    met = few(w).join(few(c).hint("merge"), key, "left").withColumn("score", F.when(F.col(id_col).isNotNull(), score))
    pairs = met.groupBy(wanted_id, "score").agg(F.count(id_col).alias("ties"), F.min(id_col).alias("best"))

    if crowds:
        pairs = pairs.unionByName(_crowded_matches(w.join(full, key, "left_semi"), c.join(full, key, "left_semi"), key, scores, id_col, wanted_id))
    out = pairs.groupBy(wanted_id).agg(F.max(F.struct("score", "ties", "best")).alias("_b")).select(wanted_id, "_b.*")
    status = F.when(F.col("score").isNull(), "NONE").when(F.col("ties") > 1, "AMBIGUOUS").otherwise("OK")
    return out.select(wanted_id, F.when(status == "OK", F.col("best")).alias(id_col), "score", status.alias("status"))


def _subsets(rows: DataFrame, side: str, scores: list[tuple[str, int, bool]], key: str, keep: list[str]) -> DataFrame:
    """Each row under every subset of its columns (named side_column) that hold something to compare: (keep, key, mask, score, values)."""
    masks = []
    for mask in range(1 << len(scores)):
        inside = [s for k, s in enumerate(scores) if mask >> k & 1]
        fits = F.lit(True)
        for column, _, filled in inside:
            value = F.col(f"{side}_{column}")
            fits = fits & value.isNotNull() & ((value != "") if filled else F.lit(True))
        values = F.array(*[F.when(F.lit(bool(mask >> k & 1)), F.col(f"{side}_{column}").cast("string")) for k, (column, *_) in enumerate(scores)])
        masks.append(F.when(fits, F.struct(F.lit(mask).alias("mask"), F.lit(sum(points for _, points, _ in inside)).alias("score"), values.alias("values"))))
    return rows.select(*keep, key, F.explode(F.array_compact(F.array(*masks))).alias("_m")).select(*keep, key, "_m.*")


def _crowded_matches(w: DataFrame, c: DataFrame, key: str, scores: list[tuple[str, int, bool]], id_col: str, wanted_id: str) -> DataFrame:
    """(wanted_id, score, ties, best) by subsets of columns, for best_match(): the best score of each wanted row."""
    values = [f"w_{column}" for column, *_ in scores]
    classes = c.groupBy(key, *[f"c_{column}" for column, *_ in scores]).agg(F.count("*").alias("ties"), F.min(id_col).alias("best"))
    counted = _subsets(classes, "c", scores, key, ["ties", "best"]).groupBy(key, "mask", "values").agg(F.sum("ties").alias("ties"), F.min("best").alias("best"))
    met = _subsets(w.select(key, *values).distinct(), "w", scores, key, values).hint("merge").join(counted.hint("merge"), [key, "mask", "values"])
    best = met.groupBy(key, *values, "score").agg(F.sum("ties").alias("ties"), F.min("best").alias("best")).groupBy(key, *values).agg(F.max(F.struct("score", "ties", "best")).alias("_b"))
    same = F.lit(True)
    for column in (key, *values):
        same = same & F.col(f"w.{column}").eqNullSafe(F.col(f"b.{column}"))
    found = w.hint("merge").alias("w").join(best.hint("merge").alias("b"), same).select(F.col(f"w.{wanted_id}").alias(wanted_id), "b._b.*")
    return found.groupBy(wanted_id, "score").agg(F.sum("ties").alias("ties"), F.min("best").alias("best"))


def apply_fixes(cards: DataFrame, matched: DataFrame, fixes: DataFrame, columns: list[str], id_col: str = "id", prefix: str = "riv_b_manual_") -> DataFrame:
    """Updates matched cards and adds new ones: fixes (review, action, columns...) with UPDATE_PREVIOUS, ADD_CARD or SKIP.

    A null in a fix leaves the card's value; added cards get numbers in the order of reviews.
    """
    updates = fixes.where("action = 'UPDATE_PREVIOUS'").join(matched.where("status = 'OK'").select("review", id_col), "review")
    last = updates.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("review")))).where("_r = 1").select(id_col, *columns)
    updated = apply_corrections(cards, last, id_col, columns).withColumn("origin", F.when(F.col("corrected"), "FIXED").otherwise("PARSED")).drop("corrected")
    added = _added(fixes, cards, id_col, prefix).select(id_col, *columns, F.lit("MANUAL").alias("origin"))
    return updated.unionByName(added, allowMissingColumns=True)


def _added(fixes: DataFrame, cards: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """The fixes that add cards, with ids: the numbers from 1 that no card's id uses, in the order of reviews."""
    spark, adds = fixes.sparkSession, fixes.where("action = 'ADD_CARD'")
    used = cards.where(F.col(id_col).startswith(prefix)).select(F.col(id_col).alias("_name")).distinct()
    most = adds.count() + used.count()
    name = F.format_string(f"{prefix}%04d", F.col("id"))
    free = numbered(spark.range(1, most + 1).select("id", name.alias("_name")).join(used, "_name", "left_anti"), ["id"], "_number")
    return numbered(adds, ["review"], "_number").join(free.select("_number", F.col("_name").alias(id_col)), "_number").drop("_number")


def _histories(hits: DataFrame, pending: DataFrame, pool: DataFrame, columns: list[str], key: str, scored: list[str], id_col: str) -> DataFrame:
    """(review, _no, id, before_..., after_..., c_...): each hit with its card's texts before and after it, as all hits of the card leave them; c_ are the scored values that no fix changes."""
    fixed = hits.where("_no IS NOT NULL").select("review", "_no").join(pending.select("review", *[F.col(c).alias(f"_new_{c}") for c in columns]), "review")
    # Hits are fewer than cards, whose file may look small: the hits are the side that is hashed.
    rows = fixed.hint("shuffle_hash").join(pool.select("_no", id_col, *dict.fromkeys([key, *scored, *columns])), "_no")
    w = Window.partitionBy("_no").orderBy("review")
    upto = lambda c, last: F.coalesce(F.last_value(f"_new_{c}", ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, last)), c)
    told = [x for c in columns for x in (upto(c, -1).alias(f"before_{c}"), upto(c, 0).alias(f"after_{c}"))]
    return rows.select("review", "_no", id_col, *told, *[F.col(c).alias(f"c_{c}") for c in dict.fromkeys([key, *scored]) if c not in columns])


def _hits(asked: DataFrame, counted: DataFrame, added: DataFrame, told: DataFrame | None, columns: list[str], key: str, scores: list[tuple[str, int, bool]]) -> DataFrame:
    """(review, _no, ties) of each update that meets a card, if the cards were changed by the hits told (or none): what each meets just before it.

    Cards come and go as events of the subsets that hold them; the number of cards of a subset at a time is a running sum, and the
    exclusive or of their numbers names a card that is alone.
    """
    events = _subsets(added.select(F.col("review").alias("_at"), F.lit(1).alias("_n"), "_no", key, *[F.col(c).alias(f"c_{c}") for c, *_ in scores]), "c", scores, key, ["_at", "_n", "_no"])
    if told is not None:
        name = lambda c, when: F.col(f"{when}_{c}" if c in columns else f"c_{c}")
        for when, n in (("before", -1), ("after", 1)):
            moved = told.select(F.col("review").alias("_at"), F.lit(n).alias("_n"), "_no", name(key, when).alias(key), *[name(c, when).alias(f"c_{c}") for c, *_ in scores])
            events = events.unionByName(_subsets(moved, "c", scores, key, ["_at", "_n", "_no"]))
    lookups = asked.select(F.col("review").alias("_at"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_no"), key, "mask", "score", "values")
    rows = lookups.withColumn("_asks", F.lit(0)).unionByName(events.withColumn("_asks", F.lit(1))).unionByName(counted.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key, "mask", "values").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({"_ties": F.sum("_n").over(w), "_x": F.bit_xor("_no").over(w)}).where("_asks = 0 AND _ties > 0")
    best = found.groupBy("_at", "score").agg(F.sum("_ties").alias("ties"), F.bit_xor("_x").alias("_x")).groupBy("_at").agg(F.max(F.struct("score", "ties", "_x")).alias("_b"))
    return best.select(F.col("_at").alias("review"), F.when(F.col("_b.ties") == 1, F.col("_b._x")).alias("_no"), F.col("_b.ties").alias("ties"))


def fixes_in_order(cards: DataFrame, wanted: DataFrame, fixes: DataFrame, columns: list[str], key: str, scores: list[tuple[str, int, bool]], id_col: str = "id", prefix: str = "riv_b_manual_") -> tuple[DataFrame, DataFrame]:
    """(cards, log) after fixes that each see what earlier ones left, cards that they added included.

    cards: (id, columns and what is scored); wanted: (review, key, what is scored), the card that a fix means; fixes:
    (review, action, columns), where a null leaves a card's value. All fixes are matched at once against the cards as the hits of
    the round before would have left them just before each fix, until a round finds the hits of the one before. That is the result of the loop: the
    first fix that were wrong would have been matched with right earlier ones. A round puts right at least the fixes that depend on
    right ones alone, so there are as many as the longest chain of fixes that change each other's match, and one more; fixes that
    share a headword but not a card don't count. Cards whose keys no fix touches take no part.
    log: (review, action, id, status, before_..., after_...); status is that of best_match() for updates. Reviews are distinct.
    """
    scored = [c for c, *_ in scores]
    seen = wanted.select("review", *[F.col(c).alias(f"_wanted_{c}") for c in dict.fromkeys([key, *scored])])
    updates = F.col("action") == "UPDATE_PREVIOUS"
    pending = fixes.select("review", "action", *columns).join(seen, "review", "left")
    pending = files.stored(pending.withColumns({c: F.when(updates, F.col(c)) for c in pending.columns if c.startswith("_wanted_")}), "fixes")
    new_ids = files.stored(_added(fixes, cards, id_col, prefix).select("review", id_col), "new-ids")
    keys = pending.select(F.explode(F.array(f"_wanted_{key}", key)).alias(key)).where(F.col(key).isNotNull()).distinct()
    rest = cards.join(keys, key, "left_anti").withColumn("origin", F.lit("PARSED"))
    live = cards.join(keys, key, "left_semi").select(*cards.columns, F.lit("PARSED").alias("origin"))
    new = pending.where("action = 'ADD_CARD'").join(new_ids, "review").select("review", id_col, *columns, F.lit("MANUAL").alias("origin"))
    pool = files.stored(live.unionByName(new, allowMissingColumns=True).withColumn("_no", F.monotonically_increasing_id()), "pool")

    asked = pending.where(updates).select("review", F.col(f"_wanted_{key}").alias(key), *[F.col(f"_wanted_{c}").alias(f"w_{c}") for c in scored]).where(F.col(key).isNotNull())
    asked = files.stored(_subsets(asked, "w", scores, key, ["review"]), "asked")
    added = pool.where("origin = 'MANUAL'").where(F.col(key).isNotNull())
    classes = pool.where("origin = 'PARSED'").groupBy(key, *scored).agg(F.count("*").alias("_n"), F.bit_xor("_no").alias("_no"))
    classes = _subsets(classes.select("_n", "_no", key, *[F.col(c).alias(f"c_{c}") for c in scored]), "c", scores, key, ["_n", "_no"])
    counted = classes.hint("merge").join(asked.select(key, "mask", "values").distinct().hint("merge"), [key, "mask", "values"])
    counted = files.stored(counted.groupBy(key, "mask", "values").agg(F.sum("_n").alias("_n"), F.bit_xor("_no").alias("_no")), "counted")

    hits = told = None
    while True:
        last, hits = hits, files.stored(_hits(asked, counted, added, told, columns, key, scores), "hits")
        if last is not None:
            both = hits.join(last.select("review", F.col("_no").alias("_last"), F.col("ties").alias("_ties")), "review", "full")
            if both.where(~F.col("_no").eqNullSafe(F.col("_last")) | ~F.col("ties").eqNullSafe(F.col("_ties"))).isEmpty():
                break
        told = files.stored(_histories(hits, pending, pool, columns, key, scored, id_col), "told")

    status = F.when(F.col("ties").isNull(), "NONE").when(F.col("ties") > 1, "AMBIGUOUS").otherwise("OK")
    shown = [x for c in columns for x in (f"before_{c}", f"after_{c}")]
    log = pending.where(updates).select("review", "action").join(hits.select("review", "ties"), "review", "left").join(told.select("review", id_col, *shown), "review", "left").select("review", "action", id_col, status.alias("status"), *shown)
    log = log.unionByName(new.select("review", F.lit("ADD_CARD").alias("action"), id_col, *[F.col(c).alias(f"after_{c}") for c in columns]), allowMissingColumns=True)
    log = log.unionByName(pending.where("action NOT IN ('UPDATE_PREVIOUS', 'ADD_CARD')").select("review", "action"), allowMissingColumns=True)
    final = told.groupBy("_no").agg(F.max_by(F.struct(*[F.col(f"after_{c}").alias(c) for c in columns]), "review").alias("_f"))
    out = pool.join(final.hint("shuffle_hash"), "_no", "left")
    kept = [F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in cards.columns]
    return rest.unionByName(out.select(*kept, F.when(F.col("_f").isNotNull(), "FIXED").otherwise(F.col("origin")).alias("origin"))), log


def fix_log(cards: DataFrame, matched: DataFrame, fixes: DataFrame, columns: list[str], id_col: str = "id", prefix: str = "riv_b_manual_") -> DataFrame:
    """(review, action, id, before_..., after_...) of each fix: an update's card before and after it, an added card's texts after; a skipped or unmatched one has no id.

    Fixes of one card follow each other in the order of reviews: what one left is what the next found.
    """
    found = matched.where("status = 'OK'").select("review", id_col)
    updates = fixes.where("action = 'UPDATE_PREVIOUS'").join(found, "review", "left").join(cards.select(id_col, *[F.col(c).alias(f"_{c}") for c in columns]), id_col, "left")
    w = Window.partitionBy(id_col).orderBy("review")
    upto = lambda c, last: F.coalesce(F.last_value(c, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, last)), f"_{c}")
    told = [x for c in columns for x in (F.when(F.col(id_col).isNotNull(), upto(c, -1)).alias(f"before_{c}"), F.when(F.col(id_col).isNotNull(), upto(c, 0)).alias(f"after_{c}"))]
    out = updates.select("review", "action", id_col, *told)
    added = _added(fixes, cards, id_col, prefix).select("review", "action", id_col, *[F.col(c).alias(f"after_{c}") for c in columns])
    return out.unionByName(added, allowMissingColumns=True).unionByName(fixes.where("action = 'SKIP'").select("review", "action"), allowMissingColumns=True)


def fix_completeness(fixes: DataFrame, expected: int, number: str = "review", required: tuple[str, ...] = ()) -> DataFrame:
    """Violations (number, problem): missing, repeated or unexpected numbers, unknown actions, added cards without texts."""
    spark = fixes.sparkSession
    wanted = spark.range(1, expected + 1).select(F.col("id").cast(fixes.schema[number].dataType).alias(number))
    label = lambda df, what: df.select(F.col(number).alias("number"), F.lit(what).alias("problem"))
    empty = F.lit(False)
    for c in required:
        empty = empty | (F.coalesce(F.col(c), F.lit("")) == "")
    out = label(wanted.join(fixes.select(number), number, "left_anti"), "MISSING")
    out = out.unionByName(label(fixes.groupBy(number).count().where("count > 1"), "REPEATED"))
    out = out.unionByName(label(fixes.where(F.col(number).isNull() | ~F.col(number).between(1, expected)), "UNEXPECTED"))
    out = out.unionByName(label(fixes.where(~F.coalesce(F.col("action").isin("UPDATE_PREVIOUS", "ADD_CARD", "SKIP"), F.lit(False))), "BAD_ACTION"))
    return out.unionByName(label(fixes.where((F.col("action") == "ADD_CARD") & empty), "EMPTY_TEXT"))


#: Rows of a partition hold consecutive values below this in monotonically_increasing_id().
_ROW_BITS = 33


def numbered(df: DataFrame, order: list, name: str = "number", only: Column | None = None) -> DataFrame:
    """Adds 1, 2, ... in a total order without one task for all rows: rows are dealt by ranges of the order and each range is offset by those before it.

    Ranges come from a sample, so two plans of one exchange may part the rows differently. The ranged rows are
    therefore stored once, each with its range and its place within it, in the folder that the cluster shares, and both
    the counts and the result are read from what was stored. The order should be total: equal rows take their places
    as they come. With only, the rows that it holds for are numbered and the others get null.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)})
    stored = files.stored(ranged, "numbered")
    counts = stored.groupBy("_range").agg((F.count("*") if only is None else F.count_if(only)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    rows = stored.join(F.broadcast(before), "_range")
    if only is None:
        number = F.col("_before") + F.col("_place") + 1
    else:
        upto = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        number = F.when(only, F.col("_before") + F.count_if(only).over(upto))
    return rows.withColumn(name, number).select(*df.columns, name)
