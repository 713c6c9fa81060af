"""Queries of the text, entry and phonetic functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import phonetics as P
from quillspark.functions import text as T
from quillspark.operators import lexicon as L
from quillspark.plans import duck as D
from quillspark.plans.views import Registry, cte, table, view

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
TEXTS, ENTRIES = cte("texts"), cte("entries")


def _over(role, column, functions):
    return lambda spark, sf: view(spark, sf, role).select("id", *[f(F.col(column)).alias(n) for n, f in functions.items()])


def _sql(with_, role, column, functions):
    return f"{with_}SELECT id, {', '.join(f'{f(column)} AS {n}' for n, f in functions.items())} FROM {role}"


def _pair(name, role, column, spark_functions, sql_functions):
    QUERIES[name] = _over(role, column, spark_functions)
    if sql_functions:
        ORACLE_SQL[name] = _sql(cte(role), role, column, sql_functions)


_pair("normalize_text", "texts", "t", {"basic": T.normalize_basic, "output": T.clean_output, "hyphens": T.drop_soft_hyphens}, {"basic": D.norm, "output": D.clean_output, "hyphens": D.soft})
_pair("normalize_forms", "texts", "t", {"forms": T.normalize_forms}, {"forms": D.forms})
_pair("clean_fields", "texts", "t", {"cleaned": T.clean_field}, {"cleaned": D.clean_field})
_pair("match_key", "texts", "t", {"match_key": T.match_key}, {"match_key": D.key})
_pair("nfc_key", "texts", "t", {"composed": T.nfc}, {"composed": lambda x: f"nfc_normalize({x})"})
_pair("word_count", "texts", "t", {"n_words": T.word_count}, {"n_words": lambda x: f"CAST(len({D.tokens(x)}) AS INTEGER)"})
_pair("detect_markers", "entries", "raw", {"chapter": lambda c: C.marker(c, "Kapitel"), "page": lambda c: C.marker(c, "Sidan")}, {"chapter": lambda x: D.marker(x, "Kapitel"), "page": lambda x: D.marker(x, "Sidan")})
_pair("noise_filter", "entries", "raw", {"noise": C.is_noise}, {"noise": D.noise})
_pair("continuation_signal", "texts", "t", {"open": C.goes_on, "open_strict": C.goes_on_strict, "open_older": lambda c: C.goes_on_strict(c, C.OLDER_ENDINGS), "short": lambda c: T.word_count(c).between(1, 8)}, {"open": D.goes_on, "open_strict": D.goes_on_strict, "open_older": lambda x: D.goes_on_strict(x, C.OLDER_ENDINGS), "short": lambda x: f"len({D.tokens(x)}) BETWEEN 1 AND 8"})

_GROUP = "regexp_extract(t, '\\(([^()]*)\\)')"
_STRIP = f"""
{ENTRIES[:-1]}, s AS (SELECT id, {D.collapse('nfc_normalize(raw)')} AS t FROM entries),
b AS (SELECT id, t, {D.collapse("regexp_replace(t, '\\(\\s*[A-Za-zÅÄÖåäöÉéÜüÆæØø\\s,/]*-[A-Za-zÅÄÖåäöÉéÜüÆæØø\\-\\s,/]*\\)', '', 'g')")} AS c FROM s) """
_EDGE = "[ \\t\\r\\n.,!?;:\"''“”‘’()\\[\\]{}]"
_LEX = D.collapse(f"regexp_replace(c, '^{_EDGE}+|{_EDGE}+$', '', 'g')")


@query(_STRIP + "SELECT id, c AS stripped, c <> t AS removed FROM b")
def strip_inflection(spark, sf):
    s = T.strip_inflection(T.collapse(T.nfc(F.col("raw"))))
    return view(spark, sf, "entries").select("id", s["text"].alias("stripped"), s["removed"].alias("removed"))


@query(_STRIP + f"SELECT id, lower({_LEX}) AS normalized, lower(regexp_replace(t, '^{_EDGE}+|{_EDGE}+$', '', 'g')) AS plain FROM b")
def lexicon_key(spark, sf):
    return view(spark, sf, "entries").select("id", T.lexicon_key(F.col("raw"))["normalized"].alias("normalized"), T.plain_key(F.col("raw")).alias("plain"))


_FORMS_OK = f"({D.norm('{g}')} <> '' AND (contains({D.norm('{g}')}, ',') OR prefix({D.norm('{g}')}, '-')))".replace("{g}", "substr(g, 2, length(g) - 2)")


def _grouped(name, source):
    """CTE of a source (id, t): t and its forms group g."""
    return f"{name} AS (SELECT id, t, list_extract([g FOR g IN regexp_extract_all(t, '\\([^()]*\\)') IF {_FORMS_OK}], 1) AS g FROM {source})"


_INNER = "substr(g, 2, length(g) - 2)"
_REST = f"CASE WHEN g IS NULL THEN t ELSE {D.norm('substr(t, 1, instr(t, g) - 1) || chr(32) || substr(t, instr(t, g) + length(g))')} END"
_FORMS = f"CASE WHEN g IS NULL THEN '' ELSE {D.forms(_INNER)} END"
_MORPH = f"{ENTRIES[:-1]}, " + _grouped("m", f"(SELECT id, {D.norm('raw')} AS t FROM entries)") + " "


@query(_MORPH + f"SELECT id, {_REST} AS rest, {_FORMS} AS forms FROM m")
def extract_morphology(spark, sf):
    m = C.extract_morphology(F.col("raw"))
    return view(spark, sf, "entries").select("id", m["text"].alias("rest"), m["forms"].alias("forms"))


_WORDS = "[w FOR w IN regexp_split_to_array(raw, '[ \\t\\n\\r]+') IF w <> '']"
_ANY = " OR ".join(f"contains(x, chr({ord(c)}))" for c in T.SEPARATORS)
_PARTED = f"w AS (SELECT id, raw, {_WORDS} AS ws FROM entries), p AS (SELECT id, raw, ws, list_position([{_ANY} FOR x IN ws], true) AS k FROM w)"


@query(ENTRIES[:-1] + f", {_PARTED} SELECT id, CASE WHEN k > 0 THEN array_to_string(ws[1:k], ' ') END AS head, CASE WHEN k > 0 THEN array_to_string(ws[k + 1:], ' ') END AS translation FROM p")
def split_separator(spark, sf):
    s = C.split_by_separator(F.filter(F.split("raw", "[ \\t\\n\\r]+"), lambda x: x != ""))
    return view(spark, sf, "entries").select("id", s["head"].alias("head"), s["translation"].alias("translation"))


def _particle(k):
    word = f"regexp_replace(a[{k}], '^[.,;:!?]+|[.,;:!?]+$', '', 'g')"
    return f"(coalesce({D.key(word)} IN ({', '.join(repr(p) for p in C.PARTICLES)}), false) AND len(a) > {k})"


def _by_forms(source):
    """CTEs from a source (id, t) to s: (id, ok, head, forms, translation)."""
    after = D.tokens("substr(t, instr(t, g) + length(g))")
    head, rest = D.norm("concat_ws(' ', b, nullif(array_to_string(a[1:k], ' '), ''))"), D.norm("array_to_string(a[k + 1:], ' ')")
    return f"""{_grouped("fm", source)}, fx AS (SELECT id, t, g, trim(substr(t, 1, instr(t, g) - 1), ' ') AS b, {after} AS a FROM fm),
fn AS (SELECT *, CASE WHEN NOT {_particle(1)} THEN 0 WHEN NOT {_particle(2)} THEN 1 WHEN NOT {_particle(3)} THEN 2 ELSE 3 END AS k FROM fx),
fr AS (SELECT id, t, g, b, a, {head} AS head, {D.forms(_INNER)} AS forms, {rest} AS translation FROM fn),
s AS (SELECT id, g IS NOT NULL AND b <> '' AND len(a) > 0 AND head <> '' AND translation <> '' AS ok, head, forms, translation FROM fr) """


_SPLIT = f"{ENTRIES[:-1]}, " + _by_forms(f"(SELECT id, {D.norm('raw')} AS t FROM entries)")


@query(_SPLIT + "SELECT id, CASE WHEN ok THEN head END AS head, CASE WHEN ok THEN forms END AS forms, CASE WHEN ok THEN translation END AS translation FROM s")
def split_morphology(spark, sf):
    s = C.split_by_morphology(F.col("raw"))
    return view(spark, sf, "entries").select("id", *[s[c].alias(c) for c in ("head", "forms", "translation")])


#: CTEs from entries (id, raw) to parsed: (id, raw, head, forms, translation, method), by separator or else by forms.
PARSED_CTES = f"""{_PARTED},
lm AS (SELECT id, {D.norm(D.clean_output("array_to_string(ws[1:k], ' ')"))} AS t, {D.clean_output("array_to_string(ws[k + 1:], ' ')")} AS translation FROM p WHERE k > 0),
lg AS (SELECT lm.id, lm.t, m.g, lm.translation FROM lm JOIN ({_grouped("m", "lm").removeprefix("m AS (").removesuffix(")")}) m ON m.id = lm.id AND m.t = lm.t),
bysep AS (SELECT id, {_REST} AS head, {_FORMS} AS forms, translation FROM lg),
{_by_forms(f"(SELECT id, {D.norm(D.clean_output('raw'))} AS t FROM entries)")},
parsed AS (SELECT e.id, e.raw, CASE WHEN coalesce(b.head <> '' AND b.translation <> '', false) THEN 'UNICODE_SEPARATOR' WHEN s.ok THEN 'MORPHOLOGY_FALLBACK' END AS method,
  CASE WHEN coalesce(b.head <> '' AND b.translation <> '', false) THEN b.head WHEN s.ok THEN s.head END AS head,
  CASE WHEN coalesce(b.head <> '' AND b.translation <> '', false) THEN b.forms WHEN s.ok THEN s.forms END AS forms,
  CASE WHEN coalesce(b.head <> '' AND b.translation <> '', false) THEN b.translation WHEN s.ok THEN s.translation END AS translation
  FROM entries e LEFT JOIN bysep b ON b.id = e.id LEFT JOIN s ON s.id = e.id) """
PARSED = f"{ENTRIES[:-1]}, {PARSED_CTES}"


@query(PARSED + "SELECT id, head, forms, translation, method FROM parsed")
def parse_row(spark, sf):
    s = C.parse_row(F.col("raw"))
    return view(spark, sf, "entries").select("id", s.alias("s")).select("id", "s.*")


SUSPICIOUS = f"coalesce(method = 'MORPHOLOGY_FALLBACK' AND {D.key('translation')} IN ({', '.join(repr(p) for p in C.LONE_PARTICLES)}), false)"


@query(PARSED + f"SELECT id, {SUSPICIOUS} AS suspicious FROM parsed")
def suspicious_fallback(spark, sf):
    rows = view(spark, sf, "entries").select("id", C.parse_row(F.col("raw")).alias("s"))
    return rows.select("id", C.suspicious_fallback(F.col("s.method"), F.col("s.translation")).alias("suspicious"))


# A lexicon made from part names: letters are tokens, so most map and some are unknown.
_LEXICON = "lex AS (SELECT DISTINCT lower(split_part(p_name, ' ', CAST(p_partkey % 2 + 1 AS INTEGER))) AS word, CAST(p_partkey % 3 AS BIGINT) AS ord, '\"' || CASE WHEN p_partkey % 3 = 0 THEN replace(array_to_string(regexp_extract_all(lower(split_part(p_name, ' ', CAST(p_partkey % 2 + 1 AS INTEGER))), '[a-z]'), '.'), '.', ' $') ELSE array_to_string(regexp_extract_all(lower(split_part(p_name, ' ', CAST(p_partkey % 2 + 1 AS INTEGER))), '[a-z]'), ' ') END || CASE WHEN p_partkey % 3 = 2 THEN ' s`' ELSE '' END AS sampa FROM part) "


def lexicon(spark, sf):
    word = F.lower(F.get(F.split("p_name", " "), (F.col("p_partkey") % 2).cast("int")))
    third = F.col("p_partkey") % 3
    letters = F.array_join(F.regexp_extract_all(word, F.lit("([a-z])")), ".")
    spaced = F.when(third == 0, F.replace(letters, F.lit("."), F.lit(" $"))).otherwise(F.replace(letters, F.lit("."), F.lit(" ")))
    sampa = F.concat(F.lit('"'), spaced, F.when(third == 2, " s`").otherwise(""))
    return table(spark, sf, "part").select(word.alias("word"), third.alias("ord"), sampa.alias("sampa")).distinct()


_MAP = "MAP {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), v) for k, v in P.SAMPA.items()) + "}"
_BODY = "replace(regexp_replace(x, '^[\"%$]*', ''), '$', '')"
_TOKEN = f"translate(regexp_extract(x, '^[\"%$]*'), '\"%$', 'ˈˌ') || CASE WHEN {_BODY} = '' THEN '' ELSE coalesce({_MAP}[{_BODY}], '[' || {_BODY} || ']') END"
_IPA = f"array_to_string([{_TOKEN} FOR x IN string_split(sampa, ' ')], '')"
_UNKNOWN = f"[{_BODY} FOR x IN string_split(sampa, ' ') IF {_BODY} <> '' AND {_MAP}[{_BODY}] IS NULL]"
_SAID = f"WITH {_LEXICON}, said AS (SELECT word, sampa, min(ord) AS ord, any_value({_IPA}) AS ipa, any_value({_UNKNOWN}) AS unknown FROM lex GROUP BY word, sampa), listed AS (SELECT word, list(sampa ORDER BY ord, sampa) AS ps, list(ipa ORDER BY ord, sampa) AS ipas, flatten(list(unknown ORDER BY ord, sampa)) AS unknown FROM said GROUP BY word), d AS (SELECT word, ps, unknown, [i FOR i, k IN ipas IF i <> '' AND list_position(ipas, i) = k] AS ds FROM listed) "


@query(_SAID + "SELECT word, array_to_string(ps, '|') AS pronunciations FROM d")
def lexicon_load(spark, sf):
    return L.pronunciations(lexicon(spark, sf)).select("word", F.array_join("pronunciations", "|").alias("pronunciations"))


@query(_SAID + "SELECT word, sampa, ipa, array_to_string(unknown, '|') AS unknown FROM said")
def sampa_to_ipa(spark, sf):
    rows = lexicon(spark, sf).select("word", "sampa").distinct()
    s = P.to_ipa(F.col("sampa"))
    return rows.select("word", "sampa", s["ipa"].alias("ipa"), F.array_join(s["unknown"], "|").alias("unknown"))


@query(_SAID + "SELECT word, array_to_string(ds, '|') AS distinct_ipa, CAST(len(unknown) AS INTEGER) AS n_unknown FROM d")
def distinct_ipa(spark, sf):
    s = P.distinct_ipa(F.col("pronunciations"))
    return L.pronunciations(lexicon(spark, sf)).select("word", F.array_join(s["distinct_ipa"], "|").alias("distinct_ipa"), F.size(s["unknown"]).alias("n_unknown"))


#: Entries of one word (some unknown, some with inflections), of more, and of none.
_TEXT = "CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 20 = 13 THEN split_part(p_name, ' ', 2) || ' (-en, -ar)' WHEN p_partkey % 20 = 17 THEN 'zz' || split_part(p_name, ' ', 2) WHEN p_partkey % 4 = 1 THEN split_part(p_name, ' ', 2) WHEN p_partkey % 9 = 2 THEN p_name || ' x' WHEN p_partkey % 9 = 3 THEN '?!' WHEN p_partkey % 9 = 4 THEN split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' (-t)' WHEN p_partkey % 9 = 5 THEN 'Zz ' || split_part(p_name, ' ', 2) ELSE p_name END"


def _words(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_TEXT} AS text")
    return rows.withColumn("normalized", T.lexicon_key(F.col("text"))["normalized"]).withColumn("n_words", T.word_count(F.col("normalized")))


_NAME = f"CASE WHEN {_TEXT} = '?!' THEN '' ELSE lower(trim(regexp_replace({_TEXT}, ' \\([^)]*\\)', ''))) END"
_W = _SAID[:-1] + f", w AS (SELECT p_partkey AS id, {_NAME} AS normalized, contains({_TEXT}, '(') AS removed, len([x FOR x IN string_split({_NAME}, ' ') IF x <> '']) AS n_words FROM part), c AS (SELECT w.id, w.n_words, w.normalized, w.removed, d.word, d.ds, d.unknown, CASE WHEN d.word IS NULL THEN 'MISSING' WHEN len(d.ds) = 1 AND len(d.unknown) = 0 THEN 'SAFE' ELSE 'REVIEW' END AS status FROM w LEFT JOIN d ON w.normalized = d.word), e AS (SELECT w.id, w.normalized, count(*) AS n_parts, count(d.word) AS n_found, string_agg(w.part || '=' || coalesce(array_to_string(d.ds, '/'), '-'), '|' ORDER BY w.k) AS parts FROM (SELECT id, normalized, unnest(string_split(normalized, ' ')) AS part, unnest(range(len(string_split(normalized, ' ')))) AS k FROM w WHERE normalized <> '') w LEFT JOIN d ON d.word = part GROUP BY w.id, w.normalized) "
_ROUTE = "CASE WHEN n_words = 0 THEN 'EMPTY' WHEN n_words = 1 THEN status WHEN n_words = 2 THEN 'REVIEW_TWO_WORD' ELSE 'TOO_LONG' END"


def _known(spark, sf):
    return L.pronunciations(lexicon(spark, sf))


def _classified(spark, sf):
    return L.classify(_words(spark, sf).where("n_words = 1"), _known(spark, sf))


@query(_W + "SELECT id, status, CASE WHEN status = 'SAFE' THEN ds[1] END AS selected_ipa FROM c WHERE n_words = 1")
def ipa_classify(spark, sf):
    return _classified(spark, sf).select("id", "status", "selected_ipa")


@query(_W + "SELECT e.id, n_parts, n_found, n_parts = n_found AS all_found, parts, d.word IS NOT NULL AS direct_match, array_to_string(d.ds, '/') AS direct_ipa FROM e JOIN w ON w.id = e.id AND n_words = 2 LEFT JOIN d ON d.word = e.normalized")
def ipa_two_word(spark, sf):
    rows = L.components(_words(spark, sf).where("n_words = 2"), _known(spark, sf), "id")
    part = lambda c: F.concat(c["word"], F.lit("="), F.when(c["found"], F.array_join(c["distinct_ipa"], "/")).otherwise("-"))
    return rows.select("id", "n_parts", "n_found", "all_found", F.array_join(F.transform("components", part), "|").alias("parts"), "direct_match", F.array_join("direct.distinct_ipa", "/").alias("direct_ipa"))


_METRICS = {
    "total": "count(*)",
    "eligible": "count(*) FILTER (n_words IN (1, 2))",
    "classified": "count(*) FILTER (n_words IN (1, 2))",
    "skipped": "count(*) FILTER (n_words NOT IN (1, 2))",
    "safe": "count(*) FILTER (route = 'SAFE')",
    "review": "count(*) FILTER (route = 'REVIEW')",
    "review_two_word": "count(*) FILTER (n_words = 2)",
    "missing": "count(*) FILTER (route = 'MISSING')",
    "safe_percent_of_eligible": "round(count(*) FILTER (route = 'SAFE') * 100 / count(*) FILTER (n_words IN (1, 2)), 2)",
    "one_word_total": "count(*) FILTER (n_words = 1)",
    "one_word_found": "count(*) FILTER (route IN ('SAFE', 'REVIEW'))",
    "one_word_missing": "count(*) FILTER (route = 'MISSING')",
    "two_word_total": "count(*) FILTER (n_words = 2)",
    "two_word_all_components_found": "count(*) FILTER (n_words = 2 AND n_parts = n_found)",
    "two_word_direct_matches": "count(*) FILTER (n_words = 2 AND word IS NOT NULL)",
    "inflections_removed": "count(*) FILTER (removed)",
    "cleaned_now_safe": "count(*) FILTER (removed AND route = 'SAFE')",
    "cleaned_now_review": "count(*) FILTER (removed AND route = 'REVIEW')",
    "cleaned_still_missing": "count(*) FILTER (removed AND route = 'MISSING')",
    "cleaned_still_two_word": "count(*) FILTER (removed AND n_words = 2)",
    "unknown_symbol_occurrences": "coalesce(sum(len(unknown)) FILTER (n_words = 1), 0)",
    "unique_unknown_symbols": "max((SELECT count(DISTINCT u) FROM (SELECT unnest(unknown) AS u FROM c WHERE n_words = 1)))",
}


@query(_W[:-1] + f", r AS (SELECT c.*, e.n_parts, e.n_found, {_ROUTE} AS route FROM c LEFT JOIN e ON e.id = c.id) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({x} AS DOUBLE) AS value FROM r" for n, x in _METRICS.items()))
def ipa_summary(spark, sf):
    return L.audit_summary(_words(spark, sf).select("id", "text"), _known(spark, sf), "id", "text")


@query(_W + "SELECT match, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM e), 2) AS percent FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.word = e.normalized) THEN 'DIRECT' WHEN n_parts = n_found THEN 'COMPOSED' ELSE 'MISSING' END AS match FROM e) GROUP BY match")
def coverage_summary(spark, sf):
    return L.coverage_summary(_words(spark, sf).where("n_words > 0"), _known(spark, sf), "id")


_PROBES = ("Almond", "antique!", "(blue)", "missing word", "BISQUE", "black,", "blanched", "'blush'", "burlywood", "chartreuse", "chiffon", "coral", "cornflower", "?", "not there")
_KEYS = tuple(p.lower().strip("!()?,'") for p in _PROBES)
_QUOTED = ", ".join("'" + p.replace("'", "''") + "'" for p in _PROBES)


@query(_SAID + f"SELECT asked AS word, d.word IS NOT NULL AS found, array_to_string(ps, '|') AS pronunciations FROM (SELECT unnest([{_QUOTED}]) AS asked, unnest({list(_KEYS)}) AS key) LEFT JOIN d ON d.word = key")
def lexicon_probe(spark, sf):
    return L.probe(_known(spark, sf), _PROBES).withColumn("pronunciations", F.array_join("pronunciations", "|"))


@query(_W + f"SELECT route, count(*) AS n FROM (SELECT {_ROUTE} AS route FROM c) GROUP BY route")
def ipa_audit(spark, sf):
    return L.audit(_words(spark, sf).select("id", "text"), _known(spark, sf), "id", "text").groupBy("route").agg(F.count("*").alias("n"))


@query(_W + "SELECT symbol, count(*) AS n FROM (SELECT unnest(unknown) AS symbol FROM c WHERE n_words = 1) GROUP BY symbol")
def unknown_symbols(spark, sf):
    return L.unknown_symbols(_classified(spark, sf)).orderBy(F.desc("n"), "symbol")


@query(_W + "SELECT id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.word = e.normalized) THEN 'DIRECT' WHEN n_parts = n_found THEN 'COMPOSED' ELSE 'MISSING' END AS match FROM e")
def lexicon_coverage(spark, sf):
    return L.coverage(_words(spark, sf).where("n_words > 0"), _known(spark, sf), "id")


_COVERED = "SELECT id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.word = e.normalized) THEN 'DIRECT' WHEN n_parts = n_found THEN 'COMPOSED' ELSE 'MISSING' END AS match FROM e"


@query(_W[:-1] + f", m AS ({_COVERED}) SELECT n_words, count(*) AS n_total, count(*) FILTER (match = 'DIRECT') AS n_direct, count(*) FILTER (match = 'COMPOSED') AS n_composed, count(*) FILTER (match = 'MISSING') AS n_missing FROM m JOIN w USING (id) GROUP BY n_words")
def coverage_by_length(spark, sf):
    return L.coverage_by_length(_words(spark, sf).where("n_words > 0"), _known(spark, sf), "id")


@query(_W[:-1] + f", m AS ({_COVERED}) SELECT id, normalized FROM m JOIN w USING (id) WHERE match = 'MISSING' ORDER BY id LIMIT 50")
def coverage_missing(spark, sf):
    return L.first_missing(_words(spark, sf).where("n_words > 0"), _known(spark, sf), "id")
