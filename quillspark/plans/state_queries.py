"""Queries of stored state and of raw records: recorded statistics, write-back, JSON structure, gated and parted sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import quality, recorded, rules
from quillspark.plans.card_queries import _RULE_SQL, _rules, _union
from quillspark.plans.review_queries import DAY, today
from quillspark.plans.text_queries import _LEXICON, lexicon
from quillspark.plans.views import Registry, cte, table, view
from quillspark.sources import files, store

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: Statistics of customers as stored: sound, malformed as a whole, malformed for a day, none.
_STATS = {
    "user_id": "c_custkey",
    "total_answers": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 50 END",
    "total_known": "c_custkey % 30",
    "total_learning": "c_custkey % 20",
    "stats_days": """CASE CAST(c_custkey % 8 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN 'broken {' WHEN 2 THEN '[1, 2]'
      WHEN 3 THEN '{"2024-01-29": {"studied": 3, "known": 2, "learning": 1}, "2024-01-28": {"studied": 1, "known": 1, "learning": 0}, "2024-01-26": {"studied": 1}}'
      WHEN 4 THEN '{"2024-01-30": 7, "2024-01-29": {"studied": 2, "known": 1, "learning": 1}}'
      WHEN 5 THEN '{"2024-01-29": {"studied": "many", "known": 1}, "note": true}'
      WHEN 6 THEN '{"2024-01-30": {"studied": 0}, "2024-01-29": {"studied": 1, "known": 1, "learning": 0}}'
      ELSE '{"2024-01-30": {"studied": ' || CAST(c_custkey % 40 + 1 AS STRING) || ', "known": 1, "learning": 0}, "2024-01-29": {"studied": 5}, "2024-02-30": {"studied": 1}, "2024-02-01": {"studied": 1}}' END""",
}


def _sql_count(name):
    return f"CASE WHEN json_type(r) = 'OBJECT' AND json_type(r, '$.{name}') IN ('UBIGINT', 'BIGINT') THEN CAST(r ->> '$.{name}' AS BIGINT) ELSE 0 END"


#: stats and days: the stored totals and days of each user after all events.
_AFTER = f"""WITH stats AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _STATS.items())} FROM customer), answers AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id % 4 <> 0 AS known FROM events),
j AS (SELECT user_id, CASE WHEN CASE WHEN json_valid(stats_days) THEN json_type(stats_days) END = 'OBJECT' THEN stats_days ELSE '{{}}' END AS j FROM stats),
k AS (SELECT user_id, j, unnest(json_keys(j)) AS day FROM j), o AS (SELECT user_id, day, json_extract(j, '$."' || day || '"') AS r FROM k),
n AS (SELECT user_id, strftime(d, '%Y-%m-%d') AS day, count(*) AS studied, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS learning FROM answers GROUP BY ALL),
days AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.day, n.day) AS day, n.day IS NOT NULL OR json_type(r) = 'OBJECT' AS sound,
  {", ".join(f"{_sql_count(c)} + coalesce(n.{c}, 0) AS {c}" for c in recorded.COUNTS)} FROM o FULL JOIN n ON o.user_id = n.user_id AND o.day = n.day),
s AS (SELECT user_id, sum(studied) AS studied, sum(known) AS known, sum(learning) AS learning FROM n GROUP BY user_id),
totals AS (SELECT coalesce(stats.user_id, s.user_id) AS user_id, CAST(coalesce(total_answers, 0) + coalesce(studied, 0) AS BIGINT) AS total_answers, CAST(coalesce(total_known, 0) + coalesce(known, 0) AS BIGINT) AS total_known, CAST(coalesce(total_learning, 0) + coalesce(learning, 0) AS BIGINT) AS total_learning FROM stats FULL JOIN s ON s.user_id = stats.user_id) """


def _recorded(spark, sf):
    stats = table(spark, sf, "customer").selectExpr(*[f"{e} AS {c}" for c, e in _STATS.items()])
    return recorded.record_answers(stats, view(spark, sf, "answers"), ["user_id"], "ts", "known")


@query(_AFTER + "SELECT user_id, day, studied, known, learning FROM days")
def recorded_days(spark, sf):
    return recorded.recorded_days(_recorded(spark, sf), ["user_id"])


@query(
    _AFTER[:-1]
    + f""", e AS (SELECT t.user_id, CASE WHEN bool_or(day = strftime({DAY}, '%Y-%m-%d')) THEN {DAY} ELSE CAST({DAY} - 1 AS DATE) END AS last FROM totals t LEFT JOIN days USING (user_id) GROUP BY t.user_id),
    v AS (SELECT user_id, last, TRY_CAST(day AS DATE) AS d FROM days JOIN e USING (user_id) WHERE sound AND studied > 0 AND TRY_CAST(day AS DATE) <= last),
    r AS (SELECT user_id, count(*) FILTER (back = k) AS streak FROM (SELECT user_id, last - d AS back, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) - 1 AS k FROM v) GROUP BY user_id)
    SELECT t.user_id, total_answers, total_known, total_learning, coalesce(studied, 0) AS today_studied, coalesce(known, 0) AS today_known, coalesce(learning, 0) AS today_learning, coalesce(streak, 0) AS streak
    FROM totals t LEFT JOIN r USING (user_id) LEFT JOIN (SELECT * FROM days WHERE day = strftime({DAY}, '%Y-%m-%d')) USING (user_id)"""
)
def recorded_statistics(spark, sf):
    return recorded.load_statistics(_recorded(spark, sf), ["user_id"], today())


_SOUND = "CASE WHEN json_valid(stored) THEN json_type(stored) = 'OBJECT' AND coalesce(json_type(stored, '$.level'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT') AND coalesce(json_type(stored, '$.nextReview'), 'NULL') IN ('NULL', 'VARCHAR') ELSE false END"
_LOADED = cte("store")[:-1] + f", x AS (SELECT *, coalesce({_SOUND}, false) AS sound FROM store), l AS (SELECT *, CASE WHEN sound THEN coalesce(TRY_CAST(stored ->> '$.level' AS INTEGER), 0) WHEN status = 'learning' THEN 1 WHEN status = 'known' THEN 2 END AS level, CASE WHEN sound THEN CAST(TRY_CAST(stored ->> '$.nextReview' AS TIMESTAMP) AS DATE) WHEN status = 'known' THEN CAST({DAY} + 1 AS DATE) END AS next_review FROM x) "
_KV = "key string, value string"


def _kv(spark, sf):
    pairs = F.explode(F.array(*[F.struct(F.concat(F.lit(prefix), F.col("word_id").cast("string")).alias("key"), F.col(c).alias("value")) for prefix, c in (("progress_", "stored"), ("status_", "status"))]))
    return view(spark, sf, "store").select(pairs.alias("p")).select("p.*").where("value IS NOT NULL")


@query(_LOADED + "SELECT CAST(word_id AS VARCHAR) AS word, level, next_review, NOT sound AS migrated FROM l WHERE level > 0")
def load_progress(spark, sf):
    return recorded.load_progress(_kv(spark, sf), [], today())


@query(
    _LOADED
    + f"""SELECT 'progress_' || word_id AS key, CASE WHEN NOT sound AND level = 1 THEN '{{"level":1,"nextReview":null}}' WHEN NOT sound AND level = 2 THEN '{{"level":2,"nextReview":"' || strftime({DAY} + 1, '%Y-%m-%d') || 'T00:00:00.000"}}' ELSE stored END AS value FROM l WHERE stored IS NOT NULL OR level > 0
    UNION ALL SELECT 'status_' || word_id, status FROM l WHERE status IS NOT NULL"""
)
def store_write_back(spark, sf):
    at = files.work_folder(spark)
    store.commit(spark, at, _kv(spark, sf), ["key"], _KV, "import", 0)
    for _ in range(2):  # the second time the commit is known and changes nothing
        loaded = recorded.load_progress(store.read(spark, at, ["key"], _KV), [], today())
        store.commit(spark, at, recorded.progress_rows(loaded.where("migrated"), []), ["key"], _KV, "migration", 1)
    return store.read(spark, at, ["key"], _KV)


#: Cards as raw JSON, with fields missing, null, of another type, and texts that are no object.
_RAW = """CASE CAST(p_partkey % 10 AS INTEGER) WHEN 1 THEN '{"id":"c' || CAST(p_partkey AS STRING) || '","head":"' || p_name || '","page":"' || CAST(p_size AS STRING) || '","tags":[]}'
 WHEN 2 THEN '{"id":"c' || CAST(p_partkey AS STRING) || '","page":' || CAST(p_size AS STRING) || '}' WHEN 3 THEN '{"id":"","head":"' || p_name || '","page":null,"tags":"' || p_brand || '"}'
 WHEN 4 THEN '["' || p_name || '"]' WHEN 5 THEN '{"id":"' || p_name WHEN 6 THEN '{"id":null,"head":' || CAST(p_size AS STRING) || ',"page":true,"tags":["x",1]}'
 WHEN 7 THEN '{"id":"c","head":"' || p_name || '","page":2.5,"tags":[null]}' WHEN 8 THEN NULL WHEN 9 THEN '"' || p_name || '"'
 ELSE '{"id":"c' || CAST(p_partkey AS STRING) || '","head":"' || p_name || '","page":' || CAST(p_size AS STRING) || ',"tags":["' || p_brand || '"]}' END"""
_FIELDS = {"id": ("text", False), "head": ("text", False), "page": ("whole", True), "tags": ("texts", False)}
_OK = {"text": "t = 'VARCHAR'", "whole": "t IN ('UBIGINT', 'BIGINT')", "texts": "t = 'ARRAY' AND len([x FOR x IN json_type(raw, '$.tags[*]') IF x <> 'VARCHAR']) = 0"}
_TYPE = "CASE {} WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'NULL' THEN 'VOID' ELSE {} END"


def _field_sql(name, wanted, nullable):
    as_text = f"WHEN t = 'VARCHAR' AND regexp_full_match(raw ->> '$.{name}', '\\s*[-+]?[0-9]+(\\.[0-9]+)?\\s*') THEN 'NUMBER_AS_TEXT' " if wanted == "whole" else ""
    problem = f"CASE WHEN t IS NULL THEN 'MISSING' WHEN t = 'NULL' THEN {'NULL' if nullable else chr(39) + 'NULL_VALUE' + chr(39)} WHEN {_OK[wanted]} THEN NULL {as_text}ELSE 'WRONG_TYPE' END"
    return f"SELECT id, '{name}' AS field, {problem} AS problem, {_TYPE.format('t', 't')} AS found FROM (SELECT *, json_type(raw, '$.{name}') AS t FROM sound)"


@query(f"WITH raws AS (SELECT p_partkey AS id, {_RAW} AS raw FROM part), typed AS (SELECT *, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM raws), sound AS (SELECT * FROM typed WHERE kind = 'OBJECT') SELECT * FROM ({' UNION ALL '.join(_field_sql(n, *f) for n, f in _FIELDS.items())}) WHERE problem IS NOT NULL UNION ALL SELECT id, NULL, CASE WHEN kind IS NULL THEN 'NO_JSON' ELSE 'NO_OBJECT' END, {_TYPE.format('kind', 'kind')} FROM typed WHERE kind IS NULL OR kind <> 'OBJECT'")
def json_structure(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_RAW} AS raw")
    return quality.json_violations(rows, "id", "raw", _FIELDS)


def _line(metric, n):
    return f"rpad({metric}, 40, ' ') || lpad(CAST({n} AS VARCHAR), 12, ' ')"


@query(cte("cards") + f"SELECT 'refused' AS attempt, {_line('rule', 'n')} AS line, 0 AS stored FROM ({_union(_RULE_SQL, lambda n, r: f'SELECT {chr(39)}{n}{chr(39)} AS rule, count(*) FILTER ({r}) AS n FROM cards')} UNION ALL SELECT 'ROWS', count(*) FROM cards) UNION ALL SELECT 'written', {_line('rule', 'n')}, (SELECT count(*) FROM cards) FROM (SELECT 'NO_ID' AS rule, count(*) FILTER (id IS NULL) AS n FROM cards UNION ALL SELECT 'ROWS', count(*) FROM cards)")
def gated_write(spark, sf):
    cards, at = view(spark, sf, "cards"), files.work_folder(spark)
    try:
        files.write_observed(cards, _rules(), f"{at}/cards", f"{at}/refused")
    except ValueError:  # cards with violations are not written; the report is
        pass
    stored = spark.createDataFrame([], "id long") if not store.exists(spark, f"{at}/cards") else spark.read.json(f"{at}/cards")
    refused = spark.read.text(f"{at}/refused").crossJoin(stored.agg(F.count("*").alias("stored")))  # one row
    files.write_observed(cards, {"NO_ID": F.col("id").isNull()}, f"{at}/cards", f"{at}/written")
    written = spark.read.text(f"{at}/written").crossJoin(files.read_lines(spark, f"{at}/cards", "id long").agg(F.count("*").alias("stored")))
    return refused.select(F.lit("refused").alias("attempt"), F.col("value").alias("line"), "stored").unionByName(written.select(F.lit("written").alias("attempt"), F.col("value").alias("line"), "stored"))


@query("SELECT event_type, event_id, user_id, value FROM events")
def event_sink(spark, sf):
    events, at = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type"), files.work_folder(spark)
    files.write_events(events, "event_type", at)
    kinds = [r[0] for r in events.select("event_type").distinct().collect()]  # the kinds are a fixed few
    return files.read_events(spark, at, kinds, "event_type", "event_id long, user_id long, value double")


@query(f"WITH {_LEXICON} SELECT row_number() OVER (ORDER BY word, ord, sampa) AS place, word, sampa FROM lex")
def lexicon_order(spark, sf):
    at = files.work_folder(spark)
    lexicon(spark, sf).orderBy("word", "ord", "sampa").select(F.concat("word", F.lit("\t"), "sampa").alias("value")).write.text(at)
    return rules.numbered(files.read_lexicon(spark, at), ["ord"], "place").select("place", "word", "sampa")


_BAD = " OR ".join(f"({r})" for r in _RULE_SQL.values())
_SECTIONS = ("FIGURES", "CARDS BY METHOD", "CARDS WITH VIOLATIONS")


@query(
    cte("cards")[:-1]
    + f""", f AS (SELECT {_line("rule", "n")} AS value, row_number() OVER (ORDER BY rule) AS k FROM ({_union(_RULE_SQL, lambda n, r: f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS n FROM cards")})),
    h AS (SELECT {_line("method", "n")} AS value, row_number() OVER (ORDER BY n DESC, method) AS k FROM (SELECT method, count(*) AS n FROM cards GROUP BY method)),
    b AS (SELECT id, id || '  ' || head || ' = ' || translation AS value, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM cards WHERE {_BAD})
    SELECT CAST(unnest([0, 0, 1, 1, 2, 2]) AS INTEGER) AS section, CAST(unnest([0, 1, 0, 1, 0, 1]) AS INTEGER) AS line, unnest(['{_SECTIONS[0]}', repeat('-', 78), '{_SECTIONS[1]}', repeat('-', 78), '{_SECTIONS[2]}', repeat('-', 78)]) AS value
    UNION ALL SELECT 0, k + 1, value FROM f UNION ALL SELECT 1, k + 1, value FROM h UNION ALL SELECT 2, k + 1, value FROM b WHERE k <= 20 UNION ALL SELECT DISTINCT 2, 22, '... and ' || (n - 20) || ' more' FROM b WHERE n > 20"""
)
def report_sections(spark, sf):
    cards, found = view(spark, sf, "cards"), F.lit(False)
    for rule in _rules().values():
        found = found | F.coalesce(rule, F.lit(False))
    counts = quality.structure_counts(cards, _rules()).where("rule <> 'DUPLICATE_ID'").select(F.col("rule").alias("metric"), F.col("n").alias("value"))
    methods = cards.groupBy(F.col("method").alias("metric")).agg(F.count("*").alias("value"))
    figures = files.report_lines(counts.orderBy("metric")).withColumn("at", F.trim(F.substring("value", 1, 40)))
    histogram = methods.withColumn("at", -F.col("value")).select(F.concat(F.rpad("metric", 40, " "), F.lpad(F.col("value").cast("string"), 12, " ")).alias("value"), "at", "metric")
    cases = cards.where(found).select("id", F.concat(F.col("id").cast("string"), F.lit("  "), "head", F.lit(" = "), "translation").alias("value"))
    return files.report_sections(spark, [(_SECTIONS[0], figures, ["at"], None), (_SECTIONS[1], histogram, ["at", "metric"], None), (_SECTIONS[2], cases, ["id"], 20)])
