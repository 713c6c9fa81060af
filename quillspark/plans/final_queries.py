"""Queries of the final list: merges by rule, final checks, fix logs, and the errors of rules without a target."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import text as T
from quillspark.operators import dedup, quality, rules
from quillspark.plans import duck as D
from quillspark.plans.card_queries import _BEST, _occurrences, joined
from quillspark.plans.rule_queries import _FIX, fixes
from quillspark.plans.views import Registry, cte, table, view

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: Ids of three kinds, so that their order is not that of their text.
_ID = "CASE WHEN id % 10 = 0 THEN printf('riv_b_manual_%04d', id) WHEN id % 17 = 0 THEN 'old_' || CAST(id AS STRING) ELSE printf('riv_b_%04d', id) END"
_ORDER = "{'kind': CASE WHEN id % 10 = 0 THEN 1 WHEN id % 17 = 0 THEN 2 ELSE 0 END, 'number': CASE WHEN id % 10 <> 0 AND id % 17 = 0 THEN 999999 ELSE id END, 'id': card}"
_OCC_STRUCT = "{'a': coalesce(chapter, 999), 'b': coalesce(page, 999999), 'c': source_pdf_page, 'd': card, 'o': {'c': chapter, 'p': page, 's': source_pdf_page, 'i': card}}"
_SPECIAL = "special AS (SELECT n_nationkey AS rule_id, 'merged ' || n_name AS by_rule, unnest([n_nationkey * 3 + 1, n_nationkey * 3 + 2, n_nationkey * 3 + 200]) AS id FROM nation)"


def _step(name, source, group, override):
    """One merge in SQL: rows (card, ok, head, ..., occ, lineage) of a group become one; a null group is left alone."""
    return f"""{name} AS (SELECT first(card ORDER BY ok) AS card, first(ok ORDER BY ok) AS ok, first(head ORDER BY ok) AS head, coalesce(max({override}), first(translation ORDER BY ok)) AS translation, {_BEST} AS forms, first(chapter ORDER BY ok) AS chapter, first(level ORDER BY ok) AS level,
  list_sort(list_distinct(flatten(list(occ)))) AS occ, flatten(list(lineage ORDER BY ok)) || (list(card ORDER BY ok))[2:] AS lineage, count(*) AS n
  FROM {source} GROUP BY {group}, CASE WHEN coalesce({group}, '') = '' THEN card END)"""


#: final: the cards after safe deduplication, id-list merges and one decision a headword; lineage may repeat ids.
FINAL = f"""{cte("cards")[:-1]}, {_SPECIAL},
c0 AS (SELECT *, {_ID.replace("STRING", "VARCHAR")} AS card FROM cards),
c1 AS (SELECT *, {_ORDER} AS ok, [{_OCC_STRUCT}] AS occ, CAST([] AS VARCHAR[]) AS lineage, CAST(NULL AS VARCHAR) AS nothing, {D.key("head")} || chr(1) || {D.key("translation")} AS pair, {D.key("head")} = '' OR {D.key("translation")} = '' AS blank FROM c0),
{_step("d1", "(SELECT * REPLACE (CASE WHEN NOT blank THEN pair END AS pair) FROM c1)", "pair", "nothing")},
d2 AS (SELECT d1.*, s.by_rule, CAST(s.rule_id AS VARCHAR) AS grp FROM d1 LEFT JOIN (SELECT rule_id, by_rule, {_ID.replace("STRING", "VARCHAR")} AS card FROM special) s USING (card)),
{_step("d3", "d2", "grp", "by_rule")},
d4 AS (SELECT *, {D.key("head")} AS hk, count(*) OVER (PARTITION BY {D.key("head")}) AS in_head FROM d3),
d5 AS (SELECT *, CASE WHEN in_head > 1 AND length(hk) % 4 IN (2, 3) THEN hk END AS grp, CASE WHEN in_head > 1 AND length(hk) % 4 IN (2, 3) THEN 'all of ' || hk END AS by_rule FROM d4),
{_step("d6", "d5", "grp", "by_rule")},
final AS (SELECT card AS id, {D.strip("head")} AS head, {D.strip("translation")} AS translation, {D.strip("forms")} AS forms, level, list_sort(list_distinct([o.o.c FOR o IN occ IF o.o.c IS NOT NULL])) AS chapters, [o.o FOR o IN occ] AS occurrences, [x FOR x, i IN lineage IF x <> card AND list_position(lineage, x) = i] AS removed FROM d6) """


def final(spark, sf):
    cards = view(spark, sf, "cards").withColumn("id", F.expr(_ID)).withColumn("head_key", T.match_key(F.col("head")))
    order = C.sort_key(F.col("id"))
    once = dedup.merge_groups(dedup.keyed(cards, {"translation_key": "translation"}).withColumn("pair_key", F.col("head_key")), ["pair_key", "translation_key"], order)
    k = F.col("n_nationkey").cast("long")
    ids = lambda *x: F.transform(F.array(*x), lambda i: F.when(i % 10 == 0, F.format_string("riv_b_manual_%04d", i)).when(i % 17 == 0, F.concat(F.lit("old_"), i.cast("string"))).otherwise(F.format_string("riv_b_%04d", i)))
    special = table(spark, sf, "nation").select(F.col("n_nationkey").alias("rule_id"), ids(k * 3 + 1, k * 3 + 2, k * 3 + 200).alias("ids"), F.concat(F.lit("merged "), "n_name").alias("translation"))
    heads = once.select("head_key").distinct()
    n = F.length("head_key") % 4
    merged, decided = rules.finalize(once.drop("group_size"), special, heads.where(n == 0), heads.where(n > 1).withColumn("translation", F.concat(F.lit("all of "), "head_key")), order)
    return dedup.normalize_final(merged), decided, special, once


@query(FINAL + "SELECT id, head, translation, forms, coalesce(list_aggregate(chapters, 'string_agg', '|'), '') AS chapters, list_aggregate([concat_ws('/', coalesce(CAST(o.c AS VARCHAR), '-'), coalesce(CAST(o.p AS VARCHAR), '-'), CAST(o.s AS VARCHAR), o.i) FOR o IN occurrences], 'string_agg', '|') AS occurrences, coalesce(list_aggregate(removed, 'string_agg', '|'), '') AS removed FROM final")
def final_cards(spark, sf):
    cards, *_ = final(spark, sf)
    return cards.select("id", "head", "translation", "forms", joined("chapters").alias("chapters"), _occurrences("occurrences").alias("occurrences"), joined("deduplicated_from").alias("removed"))


@query(FINAL + "SELECT decision, count(*) AS n_heads, CAST(sum(n) AS BIGINT) AS n_cards FROM (SELECT hk, count(*) AS n, CASE WHEN count(*) < 2 THEN 'SINGLE' WHEN length(hk) % 4 = 0 THEN 'KEEP_SEPARATE' WHEN length(hk) % 4 > 1 THEN 'MERGE' ELSE 'UNRESOLVED' END AS decision FROM d4 GROUP BY hk) GROUP BY decision")
def final_decisions(spark, sf):
    _, decided, *_ = final(spark, sf)
    return decided.groupBy("decision").agg(F.count("*").alias("n_heads"), F.sum("n").alias("n_cards"))


_WORDS = (*quality.FORBIDDEN, "thistle", "metallic")


@query(
    FINAL[:-1]
    + ", checks AS ("
    + " UNION ALL ".join(
        [
            "SELECT id, 'EMPTY_HEAD' AS rule FROM final WHERE head = ''",
            "SELECT id, 'EMPTY_TRANSLATION' FROM final WHERE translation = ''",
            "SELECT id, 'UNEXPECTED_LEVEL' FROM final WHERE level IS NOT NULL AND level NOT IN ('B1', 'B2')",
            f"SELECT min(id), 'DUPLICATE_PAIR' FROM final GROUP BY {D.key('head')}, {D.key('translation')} HAVING count(*) > 1",
            *(f"SELECT id, 'FORBIDDEN {w}' FROM final WHERE contains(lower(concat_ws(' ', head, translation, forms)), '{w}')" for w in _WORDS),
        ]
    )
    + ") SELECT id, rule, CASE WHEN rule = 'UNEXPECTED_LEVEL' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM checks"
)
def final_validate(spark, sf):
    cards, *_ = final(spark, sf)
    return quality.final_violations(cards, _WORDS, ("B1", "B2"))


@query(FINAL + f"SELECT rule_id, {_ID.replace('STRING', 'VARCHAR')} AS id FROM special WHERE {_ID.replace('STRING', 'VARCHAR')} NOT IN (SELECT card FROM d1)")
def special_merge_errors(spark, sf):
    *_, special, once = final(spark, sf)
    return rules.missing_members(once, special)


_ANALYZED = {
    "NO_PAGE": "page IS NULL",
    "LONG_HEAD": "length(head) > 80",
    "LONG_TRANSLATION": "length(translation) > 120",
    "PAGE_AS_WORD": "prefix(lower(head), 'sidan ')",
    "CHAPTER_AS_WORD": "prefix(lower(head), 'kapitel ')",
    "HEADER": "contains(lower(head), 'ordlista')",
}
#: Cards whose headwords are page furniture now and then, and now and then very long.
_FURNITURE = "CASE CAST(id % 8 AS INTEGER) WHEN 1 THEN 'Sidan ' || head WHEN 2 THEN 'KAPITEL ' || head WHEN 3 THEN head || ' ordlista' WHEN 4 THEN repeat(head || ' ', 4) ELSE head END"


@query(cte("cards")[:-1] + f", odd AS (SELECT id, page, {_FURNITURE} AS head, repeat(translation || ' ', 7) AS translation FROM cards) " + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM odd WHERE {r}" for n, r in _ANALYZED.items()))
def analyze_flags(spark, sf):
    rows = view(spark, sf, "cards").withColumns({"head": F.expr(_FURNITURE), "translation": F.repeat(F.concat("translation", F.lit(" ")), F.lit(7))})
    return quality.violations(rows, "id", quality.layout_rules(F.col("head"), F.col("translation"), F.col("page")))


_LOG = cte("cards")[:-1] + f", {_FIX}"


def _matched(spark, sf):
    cards = view(spark, sf, "cards").select(F.col("id").cast("string").alias("id"), "head", "translation")
    f = fixes(spark, sf).withColumn("target", F.expr("target DIV 14 * 14"))  # two fixes meet one card
    return cards, f, f.select("review", F.col("target").cast("string").alias("id"), F.lit("OK").alias("status")).join(cards.select("id"), "id", "left_semi")


@query(
    _LOG[:-1]
    + """, u AS (SELECT review, action, CAST(c.id AS VARCHAR) AS id, f.head AS new_head, f.translation AS new_translation, c.head, c.translation FROM fixes f LEFT JOIN cards c ON c.id = f.target // 14 * 14 WHERE action = 'UPDATE_PREVIOUS')
    SELECT review, action, id, CASE WHEN id IS NOT NULL THEN coalesce(last_value(new_head IGNORE NULLS) OVER b, head) END AS before_head, CASE WHEN id IS NOT NULL THEN coalesce(last_value(new_head IGNORE NULLS) OVER a, head) END AS after_head,
    CASE WHEN id IS NOT NULL THEN coalesce(last_value(new_translation IGNORE NULLS) OVER b, translation) END AS before_translation, CASE WHEN id IS NOT NULL THEN coalesce(last_value(new_translation IGNORE NULLS) OVER a, translation) END AS after_translation
    FROM u WINDOW b AS (PARTITION BY id ORDER BY review ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY id ORDER BY review ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT review, action, printf('riv_b_manual_%04d', row_number() OVER (ORDER BY review)), NULL, head, NULL, translation FROM fixes WHERE action = 'ADD_CARD'
    UNION ALL SELECT review, action, NULL, NULL, NULL, NULL, NULL FROM fixes WHERE action = 'SKIP'"""
)
def fix_log(spark, sf):
    cards, f, matched = _matched(spark, sf)
    return rules.fix_log(cards, matched, f.drop("target"), ["head", "translation"])


@query(_LOG + "SELECT CASE action WHEN 'UPDATE_PREVIOUS' THEN 'updated' WHEN 'ADD_CARD' THEN 'added' ELSE 'skipped' END AS outcome, count(*) AS n FROM fixes WHERE action <> 'UPDATE_PREVIOUS' OR target // 14 * 14 IN (SELECT id FROM cards) GROUP BY ALL")
def fix_stats(spark, sf):
    cards, f, matched = _matched(spark, sf)
    log = rules.fix_log(cards, matched, f.drop("target"), ["head", "translation"]).where("action = 'SKIP' OR id IS NOT NULL")
    outcome = F.when(F.col("action") == "UPDATE_PREVIOUS", "updated").when(F.col("action") == "ADD_CARD", "added").otherwise("skipped")
    return log.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: Every fifth fix means a card that no table holds.
_TARGET = "CASE WHEN review % 5 = 0 THEN target + 1000000007 ELSE target END"


@query(cte("cards")[:-1] + f", {_FIX}SELECT review, {_TARGET} AS target FROM fixes WHERE {_TARGET} NOT IN (SELECT id FROM cards)")
def correction_errors(spark, sf):
    wanted = fixes(spark, sf).selectExpr("review", f"{_TARGET} AS target")
    return rules.missing_targets(view(spark, sf, "cards").select(F.col("id").alias("target")), wanted, "target").select("review", "target")
