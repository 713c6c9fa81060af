"""Queries of corrections, merges and reconciliation; rules come from other provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dedup, rules
from quillspark.plans import duck as D
from quillspark.plans.views import ROLES, Registry, cte, table, view

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
CARDS = cte("cards")


_FIX = "fixes AS (SELECT s_suppkey + 1 AS review, CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN 'ADD_CARD' WHEN 1 THEN 'SKIP' ELSE 'UPDATE_PREVIOUS' END AS action, s_suppkey * 7 AS target, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS head, CASE WHEN s_suppkey % 5 <> 0 THEN 'tr ' || s_name END AS translation FROM supplier) "


def fixes(spark, sf):
    k = F.col("s_suppkey")
    action = F.when(k % 4 == 0, "ADD_CARD").when(k % 4 == 1, "SKIP").otherwise("UPDATE_PREVIOUS")
    return table(spark, sf, "supplier").select((k + 1).alias("review"), action.alias("action"), (k * 7).alias("target"), F.when(k % 3 == 0, F.col("s_name")).alias("head"), F.when(k % 5 != 0, F.concat(F.lit("tr "), "s_name")).alias("translation"))


@query(CARDS[:-1] + f", {_FIX}, c AS (SELECT target AS id, head, translation FROM fixes) SELECT cards.id, coalesce(c.head, cards.head) AS head, coalesce(c.translation, cards.translation) AS translation, c.id IS NOT NULL AS corrected FROM cards LEFT JOIN c ON c.id = cards.id")
def apply_corrections(spark, sf):
    corrections = fixes(spark, sf).select(F.col("target").alias("id"), "head", "translation")
    return rules.apply_corrections(view(spark, sf, "cards").select("id", "head", "translation"), corrections)


@query(CARDS[:-1] + ", r AS (SELECT n_nationkey AS rule_id, 'merged ' || n_name AS translation, unnest([n_nationkey * 3, n_nationkey * 3 + 1, n_nationkey * 3 + 200]) AS id FROM nation), m AS (SELECT rule_id, any_value(r.translation) AS translation, min(cards.id) AS kept, list_sort(list(cards.id)) AS ids FROM r JOIN cards USING (id) GROUP BY rule_id) SELECT cards.id, coalesce(m.translation, cards.translation) AS translation, coalesce(array_to_string(m.ids[2:], '|'), '') AS removed FROM cards LEFT JOIN m ON m.kept = cards.id WHERE cards.id NOT IN (SELECT unnest(ids[2:]) FROM m)")
def special_merge(spark, sf):
    k = F.col("n_nationkey").cast("long")
    rule = table(spark, sf, "nation").select(F.col("n_nationkey").alias("rule_id"), F.array(k * 3, k * 3 + 1, k * 3 + 200).alias("ids"), F.concat(F.lit("merged "), "n_name").alias("translation"))
    out = rules.special_merge(view(spark, sf, "cards").select("id", "translation"), rule, "translation")
    return out.select("id", "translation", F.array_join(F.transform("removed_ids", lambda x: x.cast("string")), "|").alias("removed"))


_HEADS = CARDS[:-1] + f", k AS (SELECT {D.key('head')} AS head_key, {D.key('translation')} AS tk FROM cards), g AS (SELECT head_key, count(*) AS n, count(DISTINCT tk) AS n_values FROM k GROUP BY head_key) "


@query(_HEADS + "SELECT head_key, n, CASE WHEN n_values < 2 THEN 'SINGLE' WHEN length(head_key) % 4 = 0 THEN 'KEEP_SEPARATE' WHEN length(head_key) % 4 <> 1 THEN 'MERGE' ELSE 'UNRESOLVED' END AS decision, CASE WHEN n_values >= 2 AND length(head_key) % 4 IN (2, 3) THEN 'all of ' || head_key END AS translation FROM g")
def semantic_finalize(spark, sf):
    keyed = dedup.keyed(view(spark, sf, "cards"), {"head_key": "head", "tk": "translation"})
    groups = keyed.groupBy("head_key").agg(F.count("*").alias("rows"), F.count_distinct("tk").alias("n"))
    heads = keyed.select("head_key").distinct()
    n = F.length("head_key") % 4
    decided = rules.decide_conflicts(groups, "head_key", heads.where(n == 0), heads.where(n > 1).withColumn("translation", F.concat(F.lit("all of "), "head_key")))
    return decided.select("head_key", F.col("rows").alias("n"), "decision", "translation")


@query(CARDS + f"SELECT id, {D.strip('head')} AS head, {D.strip('translation')} AS translation, coalesce(CAST(chapter AS VARCHAR), '') AS chapters, 1 AS n_occurrences FROM cards")
def normalize_final(spark, sf):
    cards = dedup.normalize_final(view(spark, sf, "cards"))
    return cards.select("id", "head", "translation", F.array_join(F.transform("chapters", lambda x: x.cast("string")), "|").alias("chapters"), F.size("occurrences").alias("n_occurrences"))


#: Every card as a review item: some headwords are none of a card, some places are off by one.
_REVIEW = {"review": "id", "head": "CASE WHEN id % 31 = 0 THEN head || '?' WHEN id % 7 = 0 THEN lower(head) ELSE head END", "chapter": "chapter + CAST(id % 2 AS INTEGER)", "page": "page", "source_pdf_page": "source_pdf_page", "forms": "forms", "translation": "translation"}
_WANTED = "wanted AS (SELECT {} FROM cards)".format(", ".join(f"{e} AS {c}" for c, e in _REVIEW.items()))
_SCORE = "CASE WHEN w.chapter = c.chapter THEN 10 ELSE 0 END + CASE WHEN w.page = c.page THEN 10 ELSE 0 END + CASE WHEN w.source_pdf_page = c.source_pdf_page THEN 20 ELSE 0 END + CASE WHEN w.forms = c.forms AND w.forms <> '' THEN 5 ELSE 0 END + CASE WHEN w.translation = c.translation AND w.translation <> '' THEN 5 ELSE 0 END"
_MATCH = CARDS[:-1] + f", {_WANTED}, s AS (SELECT w.review, c.id, CASE WHEN c.id IS NOT NULL THEN {_SCORE} END AS score FROM wanted w LEFT JOIN cards c ON w.head = c.head), t AS (SELECT review, max(score) AS score FROM s GROUP BY review), b AS (SELECT t.review, t.score, count(s.id) AS ties, min(s.id) AS id FROM t LEFT JOIN s ON s.review = t.review AND s.score = t.score GROUP BY t.review, t.score) "
SCORES = [("chapter", 10, False), ("page", 10, False), ("source_pdf_page", 20, False), ("forms", 5, True), ("translation", 5, True)]


@query(_MATCH + "SELECT review, CASE WHEN ties = 1 THEN id END AS id, score, CASE WHEN score IS NULL THEN 'NONE' WHEN ties > 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM b")
def best_match(spark, sf):
    cards = view(spark, sf, "cards")
    return rules.best_match(cards.selectExpr(*[f"{e} AS {c}" for c, e in _REVIEW.items()]), cards, "head", SCORES)


@query(CARDS[:-1] + f", {_FIX}, u AS (SELECT target AS id, head, translation FROM fixes WHERE action = 'UPDATE_PREVIOUS' AND target IN (SELECT id FROM cards)) SELECT CAST(cards.id AS VARCHAR) AS id, coalesce(u.head, cards.head) AS head, coalesce(u.translation, cards.translation) AS translation, CASE WHEN u.id IS NULL THEN 'PARSED' ELSE 'FIXED' END AS origin FROM cards LEFT JOIN u ON u.id = cards.id UNION ALL SELECT printf('riv_b_manual_%04d', row_number() OVER (ORDER BY review)), head, translation, 'MANUAL' FROM fixes WHERE action = 'ADD_CARD'")
def apply_fixes(spark, sf):
    cards = view(spark, sf, "cards").select(F.col("id").cast("string").alias("id"), "head", "translation")
    f = fixes(spark, sf)
    matched = f.select("review", F.col("target").cast("string").alias("id"), F.lit("OK").alias("status")).join(cards.select("id"), "id", "left_semi")
    return rules.apply_fixes(cards, matched, f.drop("target"), ["head", "translation"])


@query(f"WITH {_FIX[:-1]} SELECT n AS number, 'MISSING' AS problem FROM (SELECT unnest(range(1, 101)) AS n) WHERE n NOT IN (SELECT review FROM fixes) UNION ALL SELECT review, 'UNEXPECTED' FROM fixes WHERE review NOT BETWEEN 1 AND 100 UNION ALL SELECT review, 'EMPTY_TEXT' FROM fixes WHERE action = 'ADD_CARD' AND (coalesce(head, '') = '' OR coalesce(translation, '') = '')")
def fix_completeness(spark, sf):
    return rules.fix_completeness(fixes(spark, sf), 100, required=("head", "translation"))


#: Fixes that depend on earlier ones: pairs of them mean one card, and every sixth means the card that the one before it has renamed or added.
_SEEN = {"chapter": "c.chapter", "page": "c.page + CAST(s_suppkey % 2 AS INTEGER)", "source_pdf_page": "c.source_pdf_page", "forms": "c.forms", "translation": "c.translation"}
_HEAD = "CASE WHEN s.s_suppkey % 6 = 4 THEN p.s_name ELSE c.head END"


def ordered_fixes(spark, sf):
    """(cards, wanted, fixes) of the fixes that are applied in order."""
    cards = view(spark, sf, "cards").selectExpr("CASE WHEN id % 10 = 3 THEN printf('riv_b_manual_%04d', id DIV 10) ELSE CAST(id AS STRING) END AS id", "head", "translation", "forms", "chapter", "page", "source_pdf_page")
    by_number = view(spark, sf, "cards").alias("c").hint("merge")  # its file may look small enough to be broadcast
    s, p = table(spark, sf, "supplier").alias("s"), table(spark, sf, "supplier").alias("p")
    meant = s.join(p, F.expr("p.s_suppkey = s.s_suppkey - 1"), "left").join(by_number, F.expr("c.id = s.s_suppkey DIV 2 * 14"), "left")
    wanted = meant.selectExpr("s.s_suppkey + 1 AS review", f"{_HEAD} AS head", *[f"{e.replace('s_suppkey', 's.s_suppkey')} AS {c}" for c, e in _SEEN.items()])
    return cards, wanted, fixes(spark, sf).drop("target")


_STATE = "id, head, translation, forms, chapter, page, source_pdf_page, origin, born"
_IN_ORDER = f"""WITH RECURSIVE cards AS (SELECT {", ".join(f"{e} AS {c}" for c, e in ROLES["cards"][1].items())} FROM part), {_FIX[:-1]},
named AS (SELECT CASE WHEN id % 10 = 3 THEN printf('riv_b_manual_%04d', id // 10) ELSE CAST(id AS VARCHAR) END AS id, head, translation, forms, chapter, page, source_pdf_page FROM cards),
free AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT unnest(range(1, 1 + (SELECT count(*) FROM fixes) + (SELECT count(*) FROM named))) AS n) WHERE printf('riv_b_manual_%04d', n) NOT IN (SELECT id FROM named)),
adds AS (SELECT review, head, translation, row_number() OVER (ORDER BY review) AS k FROM fixes WHERE action = 'ADD_CARD'),
new AS (SELECT review, head, translation, printf('riv_b_manual_%04d', n) AS id FROM adds JOIN free USING (k)),
steps AS (SELECT row_number() OVER (ORDER BY f.review) AS step, f.*, {_HEAD} AS w_head, {", ".join(f"{e} AS w_{c}" for c, e in _SEEN.items()).replace("s_suppkey", "s.s_suppkey")} FROM fixes f JOIN supplier s ON f.review = s.s_suppkey + 1 LEFT JOIN supplier p ON p.s_suppkey = s.s_suppkey - 1 LEFT JOIN cards c ON c.id = s.s_suppkey // 2 * 14),
state AS (SELECT 0::BIGINT AS step, *, 'PARSED' AS origin, 0::BIGINT AS born, 0::BIGINT AS ties, false AS hit, NULL::BIGINT AS review, NULL::VARCHAR AS before_head, NULL::VARCHAR AS before_translation FROM named
  UNION ALL SELECT 0, id, head, translation, NULL, NULL, NULL, NULL, 'MANUAL', review, 0, false, NULL, NULL, NULL FROM new
  UNION ALL SELECT step, id, CASE WHEN h THEN coalesce(f_head, head) ELSE head END, CASE WHEN h THEN coalesce(f_translation, translation) ELSE translation END, forms, chapter, page, source_pdf_page, CASE WHEN h THEN 'FIXED' ELSE origin END, born, ties, h, f_review, head, translation
    FROM (SELECT *, coalesce(score = best AND ties = 1, false) AS h FROM (SELECT *, count(*) FILTER (score = best) OVER () AS ties FROM (SELECT *, max(score) OVER () AS best FROM (
      SELECT f.step, {", ".join("c." + x for x in _STATE.split(", "))}, f.review AS f_review, f.head AS f_head, f.translation AS f_translation, CASE WHEN f.action = 'UPDATE_PREVIOUS' AND c.born < f.review AND c.head = f.w_head THEN {" + ".join(f"CASE WHEN f.w_{c} = c.{c}{f" AND c.{c} <> ''" if filled else ""} THEN {n} ELSE 0 END" for c, n, filled in SCORES)} END AS score FROM state c JOIN steps f ON f.step = c.step + 1))))) """


@query(_IN_ORDER + "SELECT id, head, translation, origin FROM state WHERE step = (SELECT max(step) FROM steps)")
def fixes_in_order(spark, sf):
    cards, wanted, f = ordered_fixes(spark, sf)
    return rules.fixes_in_order(cards, wanted, f, ["head", "translation"], "head", SCORES)[0].select("id", "head", "translation", "origin")


@query(
    _IN_ORDER[:-1]
    + """, hits AS (SELECT review, id, before_head, head AS after_head, before_translation, translation AS after_translation FROM state WHERE hit), tied AS (SELECT review, max(ties) AS ties FROM state WHERE step > 0 GROUP BY review)
    SELECT f.review, f.action, coalesce(h.id, n.id) AS id, CASE WHEN f.action = 'UPDATE_PREVIOUS' THEN CASE WHEN h.id IS NOT NULL THEN 'OK' WHEN ties > 1 THEN 'AMBIGUOUS' ELSE 'NONE' END END AS status, before_head, coalesce(after_head, n.head) AS after_head, before_translation, coalesce(after_translation, n.translation) AS after_translation
    FROM fixes f LEFT JOIN hits h USING (review) LEFT JOIN tied USING (review) LEFT JOIN new n ON n.review = f.review"""
)
def fixes_in_order_log(spark, sf):
    cards, wanted, f = ordered_fixes(spark, sf)
    return rules.fixes_in_order(cards, wanted, f, ["head", "translation"], "head", SCORES)[1]
