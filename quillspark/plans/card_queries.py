"""Queries over cards: scans, duplicates, survivorship, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import text as T
from quillspark.operators import dedup, quality
from quillspark.plans import duck as D
from quillspark.plans.views import MESSY, ROW, Registry, cte, table, view

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


CARDS = cte("cards")
KEYED = f"{CARDS[:-1]}, keyed AS (SELECT *, {D.key('head')} AS head_key, {D.key('translation')} AS translation_key, {D.key('forms')} AS forms_key FROM cards) "


def keyed(spark, sf):
    return dedup.keyed(view(spark, sf, "cards"), {"head_key": "head", "translation_key": "translation", "forms_key": "forms"})


def joined(c, sep="|"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


@query(CARDS + "SELECT id, head, translation, forms, chapter, page, level FROM cards")
def scan_cards(spark, sf):
    return view(spark, sf, "cards").select("id", "head", "translation", "forms", "chapter", "page", "level")


def _dup(keys):
    listed = ", ".join(keys)
    return f"{KEYED}SELECT {listed}, count(*) AS n, list_aggregate(list_sort(list(id)), 'string_agg', '|') AS ids FROM keyed GROUP BY {listed} HAVING count(*) > 1"


def _dup_query(keys):
    return lambda spark, sf: dedup.duplicate_groups(keyed(spark, sf), keys).withColumn("ids", joined("ids"))


for _name, _keys in {"dup_exact": ["head_key", "forms_key", "translation_key"], "dup_pair": ["head_key", "translation_key"], "dup_head": ["head_key"]}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _dup_query(_keys), _dup(_keys)


@query(
    KEYED
    + """SELECT CASE grouping(head_key, translation_key, forms_key) WHEN 0 THEN 'exact' WHEN 1 THEN 'pair' ELSE 'head' END AS key_set,
    head_key, translation_key, forms_key, count(*) AS n FROM keyed
    GROUP BY GROUPING SETS ((head_key, translation_key, forms_key), (head_key, translation_key), (head_key)) HAVING count(*) > 1"""
)
def dup_grouping_sets(spark, sf):
    sets = {"exact": ["head_key", "translation_key", "forms_key"], "pair": ["head_key", "translation_key"], "head": ["head_key"]}
    return dedup.duplicate_grouping_sets(keyed(spark, sf), sets)


_CARD_ID = "CASE WHEN id % 10 = 0 THEN printf('riv_b_manual_%04d', id) WHEN id % 17 = 0 THEN 'old_' || id ELSE printf('riv_b_%04d', id) END"
_SORT = "CASE WHEN id % 10 = 0 THEN 1 WHEN id % 17 = 0 THEN 2 ELSE 0 END, CASE WHEN id % 10 <> 0 AND id % 17 = 0 THEN 999999 ELSE id END, " + _CARD_ID


@query(KEYED + f"SELECT id, head_key, row_number() OVER (PARTITION BY head_key, translation_key ORDER BY {_SORT}) AS survivor_rank, count(*) OVER (PARTITION BY head_key, translation_key) AS group_size FROM keyed")
def survivor_rank(spark, sf):
    cards = keyed(spark, sf).withColumn("card", F.expr(_CARD_ID))
    return dedup.survivors(cards, ["head_key", "translation_key"], C.sort_key(F.col("card"))).select("id", "head_key", "survivor_rank", "group_size")


_PARTS = f"len([x FOR x IN string_split(forms, ',') IF {D.strip('x')} <> ''])"
_BEST = f"coalesce(max({{'a': {_PARTS}, 'b': length(forms), 'c': {D.key('forms')}, 'd': forms}}) FILTER ({D.strip('forms')} <> ''), {{'a': 0, 'b': 0, 'c': '', 'd': ''}}).d"


@query(KEYED + f"SELECT head_key, {_BEST} AS best_forms FROM keyed GROUP BY head_key")
def best_forms(spark, sf):
    return keyed(spark, sf).groupBy("head_key").agg(dedup.best_forms("forms").alias("best_forms"))


_OCC = "list_aggregate([concat_ws('/', coalesce(CAST(o.c AS VARCHAR), '-'), coalesce(CAST(o.p AS VARCHAR), '-'), CAST(o.s AS VARCHAR), CAST(o.i AS VARCHAR)) FOR o IN [k.o FOR k IN list_sort(list({'a': coalesce(chapter, 999), 'b': coalesce(page, 999999), 'c': source_pdf_page, 'd': id, 'o': {'c': chapter, 'p': page, 's': source_pdf_page, 'i': id}}))]], 'string_agg', '|')"
_MERGE_KEY = "head_key, translation_key, CASE WHEN head_key = '' OR translation_key = '' THEN CAST(id AS VARCHAR) END"


def _occurrences(c):
    show = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    return F.array_join(F.transform(c, lambda o: F.concat_ws("/", show(o["chapter"]), show(o["page"]), show(o["source_pdf_page"]), show(o["original_id"]))), "|")


def _merged(spark, sf):
    return dedup.merge_groups(keyed(spark, sf), ["head_key", "translation_key"], F.struct("id"))


@query(KEYED + f"SELECT min(id) AS id, arg_min(head, id) AS head, arg_min(translation, id) AS translation, {_BEST} AS forms, list_aggregate(list_sort(list(DISTINCT chapter) FILTER (chapter IS NOT NULL)), 'string_agg', '|') AS chapters, count(*) AS group_size FROM keyed GROUP BY {_MERGE_KEY}")
def safe_dedup(spark, sf):
    chapters = F.when(F.size("chapters") > 0, joined("chapters"))
    return _merged(spark, sf).select("id", "head", "translation", "forms", chapters.alias("chapters"), "group_size")


@query(KEYED + f"SELECT min(id) AS id, {_OCC} AS occurrences FROM keyed GROUP BY {_MERGE_KEY}")
def merge_occurrences(spark, sf):
    return _merged(spark, sf).select("id", _occurrences("occurrences").alias("occurrences"))


@query(KEYED + f", g AS (SELECT min(id) AS kept_id, list(id) AS ids FROM keyed GROUP BY {_MERGE_KEY}) SELECT kept_id, removed_id FROM (SELECT kept_id, unnest(ids) AS removed_id FROM g) WHERE removed_id <> kept_id")
def dedup_lineage(spark, sf):
    return _merged(spark, sf).select(F.col("id").alias("kept_id"), F.explode("deduplicated_from").alias("removed_id"))


@query(KEYED + "SELECT head_key, count(*) AS n, count(DISTINCT translation_key) AS n_values, list_aggregate(list_sort(list(DISTINCT translation_key)), 'string_agg', '|') AS values FROM keyed GROUP BY head_key HAVING count(*) > 1 AND count(DISTINCT translation_key) > 1")
def semantic_review(spark, sf):
    return dedup.conflicting_groups(keyed(spark, sf), "head_key", "translation_key").withColumn("values", joined("values"))


@query(KEYED + f", m AS (SELECT min(id) AS id, any_value(head_key) AS h, any_value(translation_key) AS t FROM keyed GROUP BY {_MERGE_KEY}) SELECT h AS head_key, t AS translation_key, count(*) AS n FROM m WHERE h <> '' AND t <> '' GROUP BY h, t HAVING count(*) > 1")
def dedup_invariant(spark, sf):
    kept = dedup.keyed(_merged(spark, sf).select("id", "head", "translation"), {"head_key": "head", "translation_key": "translation"})
    return dedup.surviving_duplicates(kept.where("head_key <> '' AND translation_key <> ''"), ["head_key", "translation_key"])


def _rules():
    c = F.col
    return {"EMPTY_HEAD": T.strip(F.coalesce("head", F.lit(""))) == "", "EMPTY_TRANSLATION": T.strip(F.coalesce("translation", F.lit(""))) == "", "BAD_CHAPTER": ~F.coalesce(c("chapter").between(1, 18), F.lit(False)), "BAD_LEVEL": ~F.coalesce(c("level").isin(*quality.CEFR), F.lit(False)), "NO_PAGE": c("page").isNull(), "BAD_PDF_PAGE": ~F.coalesce(c("source_pdf_page") >= 0, F.lit(False)), "RESIDUE": quality.has_residue(c("head"), c("translation"))}


_RULE_SQL = {"EMPTY_HEAD": f"{D.strip('coalesce(head, chr(32))')} = ''", "EMPTY_TRANSLATION": f"{D.strip('coalesce(translation, chr(32))')} = ''", "BAD_CHAPTER": "NOT coalesce(chapter BETWEEN 1 AND 18, false)", "BAD_LEVEL": "NOT coalesce(level IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2'), false)", "NO_PAGE": "page IS NULL", "BAD_PDF_PAGE": "NOT coalesce(source_pdf_page >= 0, false)", "RESIDUE": " OR ".join(f"contains(concat_ws('', head, translation), chr({ord(ch)}))" for ch in quality.BAD_CHARACTERS)}

def _union(rules, select):
    return " UNION ALL ".join(select(n, r) for n, r in rules.items())


@query(CARDS + _union(_RULE_SQL, lambda n, r: f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS n FROM cards") + " UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM (SELECT id FROM cards GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'ROW_COUNT', abs(count(*) - 6164) FROM cards")
def quality_structure(spark, sf):
    return quality.structure_counts(view(spark, sf, "cards"), _rules(), expected=6164)


@query(CARDS + _union(_RULE_SQL | {"SHORT_HEAD": f"length({D.strip('head')}) = 1", "SHORT_TRANSLATION": f"length({D.strip('translation')}) = 1"}, lambda n, r: f"SELECT id, '{n}' AS rule FROM cards WHERE {r}"))
def quality_flags(spark, sf):
    return quality.violations(view(spark, sf, "cards"), "id", _rules() | {f"SHORT_{c.upper()}": F.length(T.strip(F.col(c))) == 1 for c in ("head", "translation")})


_CELLS = cte("texts", "entries")[:-1] + ", cells AS (SELECT texts.id, 'text' AS field, t AS v FROM texts UNION ALL SELECT id, 'raw', raw FROM entries) "
_ARTIFACTS = {f"BAD_CHARACTER {n}": f"contains(v, chr({ord(ch)}))" for ch, n in quality.BAD_CHARACTERS.items()}
_ARTIFACTS |= {"WHITESPACE_ARTIFACT": "regexp_matches(v, '[\\n\\r\\t]')", "DOUBLE_SPACE": "contains(v, '  ')", "TRAILING_HYPHEN": f"regexp_matches({D.strip('v')}, '[A-Za-zÅÄÖåäö]{{3,}}-$')"}
_ARTIFACTS |= {f"SUSPICIOUS_TEXT {w}": f"regexp_matches({D.key('v')}, '(^|{D.NOT_WORD}){w}($|{D.NOT_WORD})')" for w in quality.LITERALS}


@query(_CELLS + _union(_ARTIFACTS, lambda n, r: f"SELECT id, field, '{n}' AS artifact FROM cells WHERE {r}"))
def text_artifacts(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id AS id", f"{MESSY} AS text", f"{ROW['raw']} AS raw")
    return quality.text_artifacts(rows, "id", ["text", "raw"])


_REASONS = {
    "NO_PAGE": "page IS NULL",
    "NO_CHAPTER": "chapter IS NULL",
    "FORMS_INSIDE_HEAD": "regexp_matches(head, '[()]')",
    "BROKEN_PARENTHESES_HEAD": f"{D.count_of('head', '(')} <> {D.count_of('head', ')')}",
    "BROKEN_PARENTHESES_TRANSLATION": f"{D.count_of('translation', '(')} <> {D.count_of('translation', ')')}",
    "EMPTY_HEAD": f"{D.strip('head')} = ''",
    "EMPTY_TRANSLATION": f"{D.strip('translation')} = ''",
    "VERY_SHORT_TRANSLATION": f"length({D.strip('translation')}) <= 2",
    "POSSIBLY_CUT_TRANSLATION": D.ends(f"lower({D.strip('translation')})", C.CUT_ENDINGS),
    "SOFT_HYPHEN": f"contains(head || translation, '{T.SOFT_HYPHEN}')",
    "TRANSLATION_ENDS_HYPHEN": "suffix(translation, '-')",
    "HEAD_ENDS_HYPHEN": "suffix(head, '-')",
    "PARENTHESES_INSIDE_FORMS": "regexp_matches(forms, '[()]')",
    "VERY_LONG_FORMS": "length(forms) > 80",
    "VERY_LONG_HEAD": "length(head) > 120",
    "VERY_LONG_TRANSLATION": "length(translation) > 180",
}
_REASON_ROWS = CARDS[:-1] + ", reasons AS (" + _union(_REASONS, lambda n, r: f"SELECT id, '{n}' AS rule FROM cards WHERE {r}") + ") "


def _reasons(spark, sf):
    cards = view(spark, sf, "cards")
    return quality.violations(cards, "id", quality.reason_rules(*(F.col(c) for c in ("head", "translation", "forms", "chapter", "page"))))


@query(_REASON_ROWS + "SELECT id, rule FROM reasons")
def reason_flags(spark, sf):
    return _reasons(spark, sf)


@query(_REASON_ROWS + "SELECT rule, count(*) AS n FROM reasons GROUP BY rule")
def reason_counts(spark, sf):
    return _reasons(spark, sf).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


@query(CARDS + "SELECT method, count(*) AS n, method IN ('UNICODE_SEPARATOR', 'MORPHOLOGY_FALLBACK', 'MANUAL_REVIEW', 'MANUAL_REVIEW_FIXED') AS known FROM cards GROUP BY method")
def method_counts(spark, sf):
    known = F.col("method").isin("UNICODE_SEPARATOR", "MORPHOLOGY_FALLBACK", "MANUAL_REVIEW", "MANUAL_REVIEW_FIXED")
    return view(spark, sf, "cards").groupBy("method").agg(F.count("*").alias("n")).withColumn("known", known)


@query(CARDS + "SELECT count(*) FILTER (method = 'MANUAL_REVIEW_FIXED') AS n_fixed, count(*) FILTER (method = 'MANUAL_REVIEW') AS n_added, count(*) AS n_cards FROM cards")
def manual_counts(spark, sf):
    m = F.col("method")
    return view(spark, sf, "cards").agg(F.count_if(m == "MANUAL_REVIEW_FIXED").alias("n_fixed"), F.count_if(m == "MANUAL_REVIEW").alias("n_added"), F.count("*").alias("n_cards"))


@query(CARDS + "SELECT chapter, count(*) AS n FROM cards GROUP BY chapter")
def chapter_counts(spark, sf):
    return view(spark, sf, "cards").groupBy("chapter").agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("chapter"))


@query(CARDS + "SELECT chapter, min(page) AS first_page, max(page) AS last_page FROM cards GROUP BY chapter")
def chapter_ranges(spark, sf):
    return view(spark, sf, "cards").groupBy("chapter").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(CARDS + f"SELECT id, 'BLANK_HEAD' AS rule FROM cards WHERE {D.strip('head')} = '' UNION ALL SELECT id, 'NO_MEANING' FROM cards WHERE {D.strip('translation')} = '' UNION ALL SELECT id, 'BAD_LEVEL' FROM cards WHERE level NOT IN ('A1', 'A2', 'B1', 'B2', 'C1', 'C2') UNION ALL SELECT id, 'DUPLICATE_ID' FROM cards GROUP BY id HAVING count(*) > 1")
def word_validate(spark, sf):
    words = view(spark, sf, "cards").withColumn("meanings", T.string_list(F.lit(None).cast("array<string>"), F.col("translation")))
    return quality.word_violations(words, "id", "head", "meanings", "level")


@query(CARDS + f"SELECT id, {D.collapse('head')} AS head, CASE WHEN {D.strip('translation')} = '' THEN 0 ELSE 1 END AS n_meanings, level FROM cards")
def word_decode(spark, sf):
    raw = view(spark, sf, "cards").withColumn("json", F.to_json(F.struct("id", "head", F.array("translation").alias("english"), "level")))
    word = F.from_json("json", "id long, head string, english array<string>, level string", {"mode": "FAILFAST"})
    return raw.select(word.alias("w")).select("w.id", T.collapse(F.col("w.head")).alias("head"), F.size(T.string_list(F.col("w.english"))).alias("n_meanings"), "w.level")


@query(CARDS + f"SELECT id, concat_ws(' • ', nullif({D.strip('translation')}, ''), nullif(method, ''), '/' || level || '/') AS line FROM cards")
def word_display(spark, sf):
    meanings = T.string_list(F.lit(None).cast("array<string>"), F.col("translation"))
    return view(spark, sf, "cards").select("id", T.word_display(meanings, F.col("method"), F.lit(""), F.array("level")).alias("line"))


@query(CARDS + f"SELECT id, CASE WHEN concat_ws('', nullif({D.strip('forms')}, '')) <> '' THEN concat_ws(' • ', nullif({D.strip('forms')}, ''), level) WHEN true THEN nullif(concat_ws(' • ', nullif({D.strip('translation')}, ''), nullif(method, 'OTHER')), '') END AS line FROM cards")
def forms_display(spark, sf):
    noun = [F.col("forms"), F.when(T.strip(F.col("forms")) != "", F.col("level"))]
    return view(spark, sf, "cards").select("id", T.forms_display(noun, [F.col("translation"), F.nullif("method", F.lit("OTHER"))]).alias("line"))


@query(CARDS + f"SELECT id, CASE WHEN {D.strip('translation')} = '' THEN '' ELSE {D.strip('translation')} || '|' || method END AS listed FROM cards WHERE {D.strip('translation')} <> '' UNION ALL SELECT id, method FROM cards WHERE {D.strip('translation')} = ''")
def string_list(spark, sf):
    return view(spark, sf, "cards").select("id", F.array_join(T.string_list(F.array("translation", F.lit("  "), "method")), "|").alias("listed"))


@query(CARDS + "SELECT id, chapter, page, CAST(row_number() OVER (ORDER BY coalesce(chapter, 999), coalesce(page, -1), coalesce(source_pdf_page, -1), id) AS BIGINT) AS place FROM cards")
def clean_sorted(spark, sf):
    from quillspark.operators.rules import numbered

    cards = view(spark, sf, "cards").withColumns({"_c": F.coalesce("chapter", F.lit(999)), "_p": F.coalesce("page", F.lit(-1)), "_s": F.coalesce("source_pdf_page", F.lit(-1))})
    return numbered(cards, ["_c", "_p", "_s", "id"], "place").select("id", "chapter", "page", "place")


@query(CARDS + "SELECT id, printf('riv_b_%04d', row_number() OVER (ORDER BY source_pdf_page, head, id)) AS card_id FROM cards")
def assign_ids(spark, sf):
    from quillspark.operators.rules import numbered

    return numbered(view(spark, sf, "cards"), ["source_pdf_page", "head", "id"]).select("id", C.card_id(F.col("number")).alias("card_id"))


@query(_REASON_ROWS + "SELECT id, count(*) AS n_reasons FROM reasons GROUP BY id ORDER BY n_reasons DESC, id LIMIT 50")
def top_rejected(spark, sf):
    return _reasons(spark, sf).groupBy("id").agg(F.count("*").alias("n_reasons")).orderBy(F.desc("n_reasons"), "id").limit(50)
