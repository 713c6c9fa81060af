"""Queries of ordered rows and page layout, over conversations and over boxes made from their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import layout as L
from quillspark.operators import quality
from quillspark.operators import sequence as S
from quillspark.plans import duck as D
from quillspark.plans.text_queries import _ANY, _FORMS, _REST, _WORDS, PARSED_CTES, SUSPICIOUS, _grouped
from quillspark.plans.views import Registry, table, view

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS asked, last_value(CASE WHEN length(text) > 200 THEN length(text) END IGNORE NULLS) OVER w AS long_length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def carry_forward(spark, sf):
    columns = {"asked": F.when(F.col("role") == "user", F.col("turn")), "long_length": F.when(F.length("text") > 200, F.length("text").cast("long"))}
    return S.carry_forward(turns(spark, sf), ["conv_id"], ["turn"], columns).select("conv_id", "turn", "asked", "long_length")


@query("SELECT conv_id, turn, last_value(CASE WHEN length(text) > 100 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_value, lead(turn) OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) AS next_value FROM conversations")
def review_context(spark, sf):
    rows = turns(spark, sf).withColumn("page", F.expr("turn DIV 4"))
    return S.neighbours(rows, ["conv_id"], ["turn"], F.length("text") > 100, "turn", ["conv_id", "page"]).select("conv_id", "turn", "previous_value", "next_value")


#: Rows of a printed list made from whole turns: two columns of four rows a page, some entries broken over two rows.
_LINE = {
    "doc": "conv_id",
    "turn": "turn",
    "side": "CASE WHEN turn % 8 < 4 THEN 'left' ELSE 'right' END",
    "page": "CAST(floor(turn / 8) AS INTEGER)",
    "y": "CAST(CASE WHEN turn % 8 < 4 THEN 640 ELSE 40 END + (turn % 4) * 15 + (conv_id % 3) * 5 AS DOUBLE)",
    "raw": "CASE CAST((conv_id + turn) % 11 AS INTEGER) WHEN 1 THEN text || ' (-en,' WHEN 2 THEN '-ar) ' || text WHEN 3 THEN 'ett ord (-et, -en) ' || text WHEN 4 THEN text || '\u00ad' WHEN 5 THEN ' kort del ' || text WHEN 6 THEN 'ord\u2002 ' || text || ' of the' WHEN 7 THEN text || ' och mer,' WHEN 8 THEN 'Kapitel ' || CAST(conv_id % 18 AS STRING) || ' ' || text WHEN 9 THEN 'B1+B2 ordlista ' || CAST(turn AS STRING) || ' ' || text WHEN 10 THEN text || ' (-r, -de) in' ELSE text END",
}
_LINES_SQL = "lines AS (SELECT {} FROM conversations)".format(", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _LINE.items()))
_SPLIT_WORDS = "[w FOR w IN regexp_split_to_array({}, '[ \\t\\n\\r]+') IF w <> '']"
_END = "regexp_replace({}, '" + D.WS.replace("{", "{{").replace("}", "}}") + "+$', '')"


def lines(spark, sf):
    return table(spark, sf, "conversations").selectExpr(*[f"{e} AS {c}" for c, e in _LINE.items()])


def _merge_sql(a, b):
    rest = f"regexp_replace({b}, '^{D.WS}+', '')"
    e = _END.format(a)
    return f"CASE WHEN suffix({e}, '{T.SOFT_HYPHEN}') THEN left({e}, length({e}) - 1) || {rest} ELSE {e} || ' ' || {rest} END"


def _joined_sql(name, source, starts):
    """CTEs of greedy pairs: source (doc, turn, side, page, y, raw) to name (doc, position, turn, side, page, y, raw, n_rows)."""
    p = f"{name}_"
    return f"""{p}b AS (SELECT *, row_number() OVER w AS n, coalesce({starts}, false) AND lead(turn) OVER w IS NOT NULL AS s FROM {source} WINDOW w AS (PARTITION BY doc ORDER BY turn)),
{p}r AS (SELECT *, n - sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY turn) AS run FROM {p}b),
{p}f AS (SELECT *, s AND row_number() OVER (PARTITION BY doc, run, s ORDER BY turn) % 2 = 1 AS first FROM {p}r),
{p}p AS (SELECT *, CASE WHEN first THEN n WHEN coalesce(lag(first) OVER (PARTITION BY doc ORDER BY turn), false) THEN n - 1 ELSE n END AS pair FROM {p}f),
{name} AS (SELECT a.doc, a.n AS position, a.turn, a.side, a.page, a.y, CASE WHEN b.n IS NULL THEN a.raw ELSE {_merge_sql("a.raw", "b.raw")} END AS raw, CASE WHEN b.n IS NULL THEN 1 ELSE 2 END AS n_rows FROM {p}p a LEFT JOIN {p}p b ON b.doc = a.doc AND b.pair = a.n AND b.n > a.n WHERE a.pair = a.n)"""


_SEPARATED = "[k FOR k IN range(1, len(ws) + 1) IF " + " OR ".join(f"contains(ws[k], chr({ord(c)}))" for c in T.SEPARATORS) + "]"
_UNFINISHED = f"(SELECT len({_SEPARATED}) > 0 AND {D.goes_on_strict(f'array_to_string(ws[{_SEPARATED}[1] + 1:], chr(32))')} FROM (SELECT {_SPLIT_WORDS.format('raw')} AS ws))"
_BROKEN = _joined_sql("repaired", "lines", f"({D.broken('raw')} AND lead(side) OVER w = side)")
_NEXT = "nexts AS (SELECT *, lead(side) OVER w AS next_side, lead(y) OVER w AS next_y, lead(raw) OVER w AS next_raw FROM lines WINDOW w AS (PARTITION BY doc ORDER BY turn))"
_PRE = f"{_NEXT}, open AS (SELECT *, {_UNFINISHED} AS unfinished FROM nexts), " + _joined_sql("prejoined", "open", f"(next_side = side AND next_y - y > 0 AND next_y - y < 24 AND {D.norm('raw')} <> '' AND {D.norm('next_raw')} <> '' AND (suffix({_END.format('raw')}, '{T.SOFT_HYPHEN}') OR unfinished AND len({D.tokens(D.norm('next_raw'))}) BETWEEN 1 AND 8))")


@query(f"WITH {_LINES_SQL}, {_BROKEN} SELECT doc, turn, raw, n_rows FROM repaired")
def broken_rows(spark, sf):
    return S.repair_broken_rows(lines(spark, sf), ["doc"], ["turn"]).select("doc", "turn", "raw", "n_rows")


@query(f"WITH {_LINES_SQL}, {_PRE} SELECT doc, turn, raw, n_rows FROM prejoined")
def prejoin_rows(spark, sf):
    return S.prejoin_rows(lines(spark, sf), ["doc"], ["turn"]).select("doc", "turn", "raw", "n_rows")


_LAST = "WINDOW w AS (PARTITION BY doc ORDER BY turn)"
_BELOW = "coalesce({0}.side = {1}.side AND {0}.page = {1}.page AND {0}.y - {1}.y > 0 AND {0}.y - {1}.y < 27, false)"
_ACROSS = "coalesce({0}.page = {1}.page AND {1}.side = 'left' AND {0}.side = 'right' AND {1}.y > 680 AND {0}.y < 150, false)"


@query(f"WITH {_LINES_SQL}, two AS (SELECT doc, turn, {{'y': y, 'side': side, 'page': page}} AS a, {{'y': lag(y) OVER w, 'side': lag(side) OVER w, 'page': lag(page) OVER w}} AS b FROM lines {_LAST}) SELECT doc, turn, {_BELOW.format('a', 'b')} AS below, {_ACROSS.format('a', 'b')} AS across FROM two")
def continuation_geometry(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("turn")
    rows = lines(spark, sf).withColumns({f"last_{c}": F.lag(c).over(w) for c in ("y", "side", "page")})
    at = [F.col(c) for c in ("y", "side", "page", "last_y", "last_side", "last_page")]
    return rows.select("doc", "turn", S.continues_below(*at).alias("below"), S.continues_across(*at).alias("across"))


#: Boxes made from words: every conversation is a page; places follow the word's number.
_BOX = {"page": "conv_id", "x0": "CAST((turn * 37 + k * 53) % 600 AS DOUBLE)", "y0": "CAST((k * 7 + turn * 3) % 90 AS DOUBLE) * 0.9", "text": "w", "turn": "turn", "k": "k"}
_TOKENS = "tokens AS (SELECT {} FROM (SELECT conv_id, turn, unnest({}) AS w, unnest(range(len({}))) AS k FROM conversations)) ".format(", ".join(f"{e} AS {c}" for c, e in _BOX.items()), D.tokens("text"), D.tokens("text"))


def boxes(spark, sf):
    words = turns(spark, sf).select("conv_id", "turn", F.posexplode(T.tokens(F.col("text"))).alias("k", "w")).withColumn("k", F.col("k").cast("long"))
    return words.selectExpr(*[f"{e} AS {c}" for c, e in _BOX.items()])


_COLUMN = "CASE WHEN x0 < 280 THEN 'left' WHEN x0 >= 300 THEN 'right' END"


@query(f"WITH {_TOKENS}SELECT page, {_COLUMN} AS side, count(*) AS n, sum(x0) AS x_sum FROM tokens WHERE {_COLUMN} IS NOT NULL GROUP BY ALL")
def word_column(spark, sf):
    rows = boxes(spark, sf).withColumn("side", L.column_of(F.col("x0"))).where("side IS NOT NULL")
    return rows.groupBy("page", "side").agg(F.count("*").alias("n"), F.sum("x0").alias("x_sum"))


@query(f"WITH {_TOKENS}SELECT page, turn, k, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN {_COLUMN} = 'left' THEN 0 ELSE 1 END, y0, x0, turn, k) AS place FROM tokens WHERE {_COLUMN} IS NOT NULL")
def reading_order(spark, sf):
    from pyspark.sql import Window

    rows = boxes(spark, sf).withColumn("side", L.column_of(F.col("x0"))).where("side IS NOT NULL")
    w = Window.partitionBy("page").orderBy(L.reading_order(F.col("side"), F.col("y0")), "x0", "turn", "k")
    return rows.select("page", "turn", "k", F.row_number().over(w).cast("long").alias("place"))


#: The fold over a page column's words, a word of every column at a time.
_ROWS = f"""WITH RECURSIVE {_TOKENS[:-1]}, placed AS (SELECT page, {_COLUMN} AS col, y0, x0, text, row_number() OVER (PARTITION BY page, {_COLUMN} ORDER BY y0, x0, text) AS i FROM tokens WHERE {_COLUMN} IS NOT NULL),
fold AS (SELECT page, col, i, y0, x0, text, 0 AS row, y0 AS mean, 1 AS n FROM placed WHERE i = 1
  UNION ALL SELECT p.page, p.col, p.i, p.y0, p.x0, p.text, CASE WHEN abs(p.y0 - f.mean) <= 1.8 THEN f.row ELSE f.row + 1 END, CASE WHEN abs(p.y0 - f.mean) <= 1.8 THEN (f.mean * f.n + p.y0) / (f.n + 1) ELSE p.y0 END, CASE WHEN abs(p.y0 - f.mean) <= 1.8 THEN f.n + 1 ELSE 1 END
  FROM fold f JOIN placed p ON p.page = f.page AND p.col = f.col AND p.i = f.i + 1) """


@query(_ROWS + 'SELECT page, col AS "column", row, CAST(count(*) AS INTEGER) AS n_words, string_agg(text, \' \' ORDER BY x0, text) AS raw FROM fold GROUP BY page, col, row')
def visual_rows(spark, sf):
    return L.visual_rows(boxes(spark, sf), ["page"]).select("page", "column", "row", F.size("words").alias("n_words"), "raw")


@query(f"WITH {_TOKENS}SELECT page, {_COLUMN} AS side, count(*) AS samples, CASE WHEN count(*) >= 3 THEN median(x0) END AS boundary FROM tokens WHERE {_COLUMN} IS NOT NULL GROUP BY ALL")
def boundary_median(spark, sf):
    rows = boxes(spark, sf).withColumn("side", L.column_of(F.col("x0"))).where("side IS NOT NULL")
    return L.boundaries(rows, ["page", "side"], "x0")


_LINES = f"WITH {_TOKENS[:-1]}, lines AS (SELECT page, turn, list({{'x0': x0, 'k': k, 'x1': x0 + length(text) * 5, 'text': text}} ORDER BY x0, k) AS ws FROM tokens GROUP BY page, turn), edges AS (SELECT page, CASE WHEN count(*) >= 3 THEN median(x0) END AS boundary FROM tokens GROUP BY page) "


def _lines(spark, sf):
    rows = boxes(spark, sf).withColumn("x1", F.col("x0") + F.length("text") * 5)
    return rows.groupBy("page", "turn").agg(F.array_sort(F.collect_list(F.struct("x0", "k", "x1", "text"))).alias("ws"))


def _side(keep):
    return f"array_to_string([w.text FOR w IN ws IF {keep}], ' ')"


_LEFT, _RIGHT = _side("w.x0 < boundary - 3"), _side("w.x0 >= boundary - 3")


def _bounded(spark, sf):
    return _lines(spark, sf).join(L.boundaries(boxes(spark, sf), ["page"], "x0").drop("samples"), "page", "left")


@query(_LINES + f"SELECT page, turn, CASE WHEN {_LEFT} <> '' AND {_RIGHT} <> '' THEN {_LEFT} END AS head, CASE WHEN {_LEFT} <> '' AND {_RIGHT} <> '' THEN {_RIGHT} END AS translation FROM lines JOIN edges USING (page)")
def layout_split(spark, sf):
    s = L.split_at_boundary(F.col("ws"), F.col("boundary"))
    return _bounded(spark, sf).select("page", "turn", s["head"].alias("head"), s["translation"].alias("translation"))


@query(_LINES + "SELECT page, turn, coalesce(ws[1].x0 >= boundary - 4, false) AS near, coalesce(ws[1].x0 >= boundary - 12, false) AS wide FROM lines JOIN edges USING (page)")
def layout_aligned(spark, sf):
    return _bounded(spark, sf).select("page", "turn", L.is_aligned(F.col("ws"), F.col("boundary"), 4.0).alias("near"), L.is_aligned(F.col("ws"), F.col("boundary"), 12.0).alias("wide"))


@query(
    _LINES[:-1]
    + f""", gaps AS (SELECT page, turn, ws, list_reverse(list_sort([g FOR g IN [{{'gap': ws[i + 1].x0 - ws[i].x1, 'pos': -i}} FOR i IN range(1, len(ws))] IF g.gap > 0])) AS gs FROM lines),
    c AS (SELECT page, turn, ws, gs[1].gap AS gap, coalesce(gs[2].gap, 0) AS second, -gs[1].pos AS k FROM gaps),
    t AS (SELECT *, array_to_string([w.text FOR w IN ws[1:k]], ' ') AS head, array_to_string([w.text FOR w IN ws[k + 1:]], ' ') AS translation FROM c),
    o AS (SELECT *, coalesce(len(ws) > 1 AND gap >= 10 AND (second <= 0 OR gap >= second * 1.35) AND {D.count_of('head', '(')} = {D.count_of('head', ')')} AND {D.count_of('translation', '(')} = {D.count_of('translation', ')')} AND NOT regexp_matches(head, '[(,/]$') AND NOT regexp_full_match(translation, '-[^ ]*') AND length(head) >= 2 AND length(translation) >= 2, false) AS ok FROM t)
    SELECT page, turn, CASE WHEN ok THEN head END AS head, CASE WHEN ok THEN translation END AS translation, CASE WHEN ok THEN gap END AS gap FROM o"""
)
def local_gap_split(spark, sf):
    s = L.split_at_gap(F.col("ws"))
    return _lines(spark, sf).select("page", "turn", s["head"].alias("head"), s["translation"].alias("translation"), s["gap"].alias("gap"))


_GLUE = "CASE WHEN suffix({e}, '\u00ad') THEN left({e}, length({e}) - 1) || {n} WHEN suffix({e}, '-') THEN {e} || {n} ELSE {e} || ' ' || {n} END"
_MORE = f"p.may AND ({_BELOW.format('p', 'f')} AND {D.goes_on_strict('f.text')} OR {_ACROSS.format('p', 'f')})"
_FOLD = f"""WITH RECURSIVE {_LINES_SQL}, placed AS (SELECT doc, turn, raw || CASE WHEN turn % 2 = 0 THEN ',' ELSE '' END AS text, y, side, page, length(raw) % 3 <> 1 AS may, row_number() OVER (PARTITION BY doc ORDER BY turn) AS i FROM lines),
fold AS (SELECT doc, i, turn AS began, text, y, side, page, 1 AS n FROM placed WHERE i = 1
  UNION ALL SELECT p.doc, p.i, CASE WHEN {_MORE} THEN f.began ELSE p.turn END, CASE WHEN {_MORE} THEN {D.norm(_GLUE.format(e=_END.format("f.text"), n=D.strip("p.text")))} ELSE p.text END, p.y, p.side, p.page, CASE WHEN {_MORE} THEN f.n + 1 ELSE 1 END FROM fold f JOIN placed p ON p.doc = f.doc AND p.i = f.i + 1) """


@query(_FOLD + "SELECT doc, began AS turn, arg_max(text, i) AS text, CAST(arg_max(n, i) AS BIGINT) AS n_rows FROM fold GROUP BY doc, began")
def join_continuation(spark, sf):
    rows = lines(spark, sf).withColumns({"may": F.length("raw") % 3 != 1, "text": F.concat("raw", F.when(F.col("turn") % 2 == 0, ",").otherwise(""))})
    return S.fold_continuations(rows, "doc", "turn", "text", F.col("may"))


_REPAIRED = f"WITH {_LINES_SQL}, {_BROKEN}, entries AS (SELECT doc || '/' || turn AS id, raw FROM repaired), {PARSED_CTES[:-1]}"
_KIND = f"CASE WHEN ch IS NOT NULL OR pg IS NOT NULL THEN 'MARKER' WHEN {D.noise('raw')} THEN 'NOISE' WHEN method IS NULL THEN 'REJECT' WHEN {SUSPICIOUS} THEN 'REVIEW' ELSE 'CARD' END"
_PIPE = f"""{_REPAIRED}, k0 AS (SELECT r.doc, r.turn, r.raw, p.head, p.forms, p.translation, p.method, {D.marker('r.raw', 'Kapitel')} AS ch, {D.marker('r.raw', 'Sidan')} AS pg FROM repaired r JOIN parsed p ON p.id = r.doc || '/' || r.turn),
k1 AS (SELECT *, {_KIND} AS kind, last_value(ch IGNORE NULLS) OVER u AS chapter, last_value(pg IGNORE NULLS) OVER u AS page FROM k0 WINDOW u AS (PARTITION BY doc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k2 AS (SELECT doc, turn, raw, kind, chapter, page, CASE WHEN method IS NOT NULL THEN {D.clean_output('head')} END AS head, CASE WHEN method IS NOT NULL THEN {D.forms('forms')} END AS forms, CASE WHEN method IS NOT NULL THEN {D.clean_output('translation')} END AS translation, method, CASE WHEN kind = 'CARD' THEN printf('riv_b_%04d', row_number() OVER (PARTITION BY kind ORDER BY doc, turn)) END AS card_id FROM k1) """


def _parsed(spark, sf):
    rows = S.repair_broken_rows(lines(spark, sf).drop("page"), ["doc"], ["turn"])
    return L.parse_rows(rows, ["doc"], ["turn"])


@query(_PIPE + "SELECT doc, turn, kind, chapter, page, head, forms, translation, method, card_id FROM k2")
def parse_pipeline(spark, sf):
    return _parsed(spark, sf).select("doc", "turn", "kind", "chapter", "page", "parsed.head", "parsed.forms", "parsed.translation", "parsed.method", "card_id")


@query(
    _PIPE[:-1]
    + """, v AS (SELECT *, last_value(CASE WHEN kind = 'CARD' THEN card_id END IGNORE NULLS) OVER b AS previous_card, lead(raw) OVER (PARTITION BY doc ORDER BY turn) AS next_row FROM k2 WINDOW b AS (PARTITION BY doc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc, turn, raw, CASE kind WHEN 'REVIEW' THEN 'SUSPICIOUS_FALLBACK' ELSE 'NO_SPLIT' END AS reason, previous_card, next_row, head AS attempted_head, translation AS attempted_translation FROM v WHERE kind IN ('REVIEW', 'REJECT')"""
)
def review_items(spark, sf):
    items = L.review_items(_parsed(spark, sf), ["doc"], ["turn"])
    return items.select("doc", "turn", "raw", "reason", F.col("previous_card.id").alias("previous_card"), "next_row", F.col("attempted_parse.head").alias("attempted_head"), F.col("attempted_parse.translation").alias("attempted_translation"))


@query(f"{_PIPE[:-1]}, {_PRE} SELECT 'AUTO_JOINED_BROKEN_ROW' AS type, count(*) AS n FROM repaired WHERE n_rows > 1 UNION ALL SELECT 'PREJOINED_ROW', count(*) FROM prejoined WHERE n_rows > 1 UNION ALL SELECT kind, count(*) FROM k2 GROUP BY kind")
def event_counts(spark, sf):
    event = lambda df, name: df.where("n_rows > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    broken = S.repair_broken_rows(lines(spark, sf), ["doc"], ["turn"])
    near = S.prejoin_rows(lines(spark, sf), ["doc"], ["turn"])
    kinds = _parsed(spark, sf).groupBy(F.col("kind").alias("type")).agg(F.count("*").alias("n"))
    return event(broken, "AUTO_JOINED_BROKEN_ROW").unionByName(event(near, "PREJOINED_ROW")).unionByName(kinds)


_RUN = {
    "PARENTHESES_LEFT": "regexp_matches(head, '[()]')",
    "NO_PAGE": "page IS NULL",
    "NO_CHAPTER": "chapter IS NULL",
    "SOFT_HYPHEN": f"contains(head || ' ' || translation, '{T.SOFT_HYPHEN}')",
    "EMPTY_HEAD": f"{D.strip('head')} = ''",
    "EMPTY_TRANSLATION": f"{D.strip('translation')} = ''",
    "OPEN_TRANSLATION": f"regexp_matches({_END.format('translation')}, '[,/-]$')",
}


@query(_PIPE[:-1] + ", c AS (SELECT * FROM k2 WHERE kind = 'CARD') SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule FROM c WHERE {x}" for n, x in _RUN.items()) + ") GROUP BY rule")
def run_report(spark, sf):
    cards = _parsed(spark, sf).where("kind = 'CARD'").select("card_id", "parsed.*", "chapter", "page")
    rules = quality.run_rules(F.col("head"), F.col("translation"), F.col("chapter"), F.col("page"))
    return quality.violations(cards, "card_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


#: Whole turns as rows of pages with places of words: some are parted by a separator, some begin where translations do, some by forms.
_PLACED = {
    "doc": "conv_id % 7",
    "place": "conv_id * 1000 + turn",
    "page": "CAST(conv_id % 3 AS INTEGER)",
    "side": "CASE WHEN turn % 8 < 4 THEN 'left' ELSE 'right' END",
    "y": "CAST(CASE WHEN turn % 8 < 4 THEN 640 ELSE 40 END + (turn % 4) * 15 AS DOUBLE)",
    "x": "CASE WHEN turn % 8 < 4 THEN 40 ELSE 310 END + CASE WHEN (conv_id * 3 + turn * 2) % 7 IN (3, 4, 5) THEN 60 ELSE 0 END",
    "raw": "CASE CAST((conv_id * 3 + turn * 2) % 7 AS INTEGER) WHEN 1 THEN 'ord\u2002 ' || text || ' of the' WHEN 2 THEN 'ett ord\u2002 ' || text || ',' WHEN 3 THEN text || ',' WHEN 6 THEN CASE WHEN turn % 5 = 0 THEN 'Kapitel ' || CAST(conv_id % 18 AS STRING) || ' ' || text ELSE text || ' (-et, -en) in' END ELSE text END",
}
_PAGES_SQL = "placed AS (SELECT {} FROM conversations)".format(", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _PLACED.items()))
_SIDE_OF = "array_to_string([w FOR w, i IN ws IF x + (i - 1) * 12 {} boundary - 3], ' ')"
_ON = f"(NOT r.card AND f.card IS NOT NULL AND ({_BELOW.format('r', 'f')} OR {_ACROSS.format('r', 'f')}) AND {D.goes_on_strict('f.text')})"
_JOINED_TEXT = D.norm(_GLUE.format(e=_END.format("f.text"), n=D.strip("r.text")))
_PAGES = f"""WITH RECURSIVE {_PAGES_SQL}, entries AS (SELECT place AS id, raw FROM placed), {PARSED_CTES[:-1]},
wordy AS (SELECT *, {_WORDS} AS ws FROM placed),
spots AS (SELECT *, list_position([{_ANY} FOR x IN ws], true) AS sep FROM wordy),
edges AS (SELECT doc, page, side, CASE WHEN count(*) >= 3 THEN median(x + sep * 12) END AS boundary FROM spots WHERE sep > 0 AND sep < len(ws) GROUP BY ALL),
bound AS (SELECT s.*, e.boundary FROM spots s LEFT JOIN edges e ON e.doc = s.doc AND e.page = s.page AND e.side = s.side),
lay AS (SELECT place AS id, {D.norm(_SIDE_OF.format("<"))} AS t, {D.norm(_SIDE_OF.format(">="))} AS rest FROM bound WHERE boundary IS NOT NULL),
lax AS (SELECT lay.id, lay.t, m.g, lay.rest FROM lay JOIN ({_grouped("m", "lay").removeprefix("m AS (").removesuffix(")")}) m ON m.id = lay.id AND m.t = lay.t),
bylay AS (SELECT id, {_REST} AS head, {_FORMS} AS forms, rest AS translation FROM lax WHERE t <> '' AND rest <> ''),
typed AS (SELECT b.*, CASE WHEN {D.marker("b.raw", "Kapitel")} IS NOT NULL OR {D.marker("b.raw", "Sidan")} IS NOT NULL THEN 'MARKER' WHEN {D.noise("b.raw")} THEN 'NOISE' WHEN p.method IS NOT NULL OR y.id IS NOT NULL THEN 'CARD' ELSE 'REJECT' END AS kind,
  coalesce(p.head, y.head) AS head, coalesce(p.forms, y.forms) AS forms, coalesce(p.translation, y.translation) AS translation, coalesce(p.method, CASE WHEN y.id IS NOT NULL THEN 'LAYOUT_FALLBACK' END) AS method, coalesce(x >= boundary - 4, false) AS aligned
  FROM bound b JOIN parsed p ON p.id = b.place LEFT JOIN bylay y ON y.id = b.place AND y.head <> ''),
live AS (SELECT doc, place, page, side, y, kind = 'CARD' AS card, CASE WHEN kind = 'CARD' THEN translation ELSE {D.norm("raw")} END AS text, row_number() OVER (PARTITION BY doc ORDER BY place) AS i FROM typed WHERE kind = 'CARD' OR kind = 'REJECT' AND aligned),
fold AS (SELECT doc, i, CASE WHEN card THEN place END AS card, CASE WHEN card THEN text END AS text, CASE WHEN card THEN y END AS y, CASE WHEN card THEN side END AS side, CASE WHEN card THEN page END AS page, NULL::BIGINT AS joined FROM live WHERE i = 1
  UNION ALL SELECT r.doc, r.i, CASE WHEN r.card THEN r.place ELSE f.card END, CASE WHEN r.card THEN r.text WHEN {_ON} THEN {_JOINED_TEXT} ELSE f.text END, CASE WHEN r.card OR {_ON} THEN r.y ELSE f.y END, CASE WHEN r.card OR {_ON} THEN r.side ELSE f.side END, CASE WHEN r.card OR {_ON} THEN r.page ELSE f.page END, CASE WHEN {_ON} THEN r.place END FROM fold f JOIN live r ON r.doc = f.doc AND r.i = f.i + 1),
whole AS (SELECT card, arg_max(text, i) AS text FROM fold WHERE joined IS NOT NULL GROUP BY card)
"""


@query(
    _PAGES
    + f"""SELECT t.doc, t.place, CASE WHEN j.joined IS NOT NULL THEN 'JOINED' ELSE kind END AS kind, CASE WHEN kind = 'CARD' THEN {D.clean_output("head")} END AS head, CASE WHEN kind = 'CARD' THEN {D.forms("forms")} END AS forms, CASE WHEN kind = 'CARD' THEN {D.clean_output("coalesce(w.text, translation)")} END AS translation,
    CASE WHEN kind = 'CARD' THEN method END AS method, boundary, aligned, CASE WHEN kind = 'CARD' THEN t.place ELSE j.card END AS card FROM typed t LEFT JOIN fold j ON j.joined = t.place LEFT JOIN whole w ON w.card = t.place"""
)
def parse_pages(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr(*[f"{e} AS {c}" for c, e in _PLACED.items()])
    words = F.filter(F.split("raw", "[ \\t\\n\\r]+"), lambda w: w != "")
    rows = rows.withColumn("words", F.transform(words, lambda w, k: F.struct((F.col("x") + k * 12).cast("double").alias("x0"), w.alias("text"))))
    out = L.parse_pages(rows, "doc", "place")
    return out.select("doc", "place", "kind", "parsed.head", "parsed.forms", "parsed.translation", "parsed.method", "boundary", "aligned", "card")
