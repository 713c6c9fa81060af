"""Queries of spaced repetition over events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import review as R
from quillspark.plans.views import TODAY, Registry, cte, table, view

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
ANSWERS, PROGRESS, STORE = cte("answers"), cte("progress"), cte("store")
DAY = f"DATE '{TODAY}'"


def today():
    return F.lit(TODAY).cast("date")


def _due(level="level", at="next_review"):
    return f"coalesce({level} >= 2 AND ({at} IS NULL OR {at} <= {DAY}), false)"


@query(ANSWERS + "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS studied, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS learning FROM answers GROUP BY ALL")
def daily_stats(spark, sf):
    return R.daily_stats(view(spark, sf, "answers"), "ts", "known", ["user_id"])


_STREAK = f"days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM answers WHERE CAST(ts AS DATE) <= {DAY}), isl AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS i FROM days), runs AS (SELECT user_id, count(*) AS n, max(day) AS last FROM isl GROUP BY user_id, i), streak AS (SELECT user_id, coalesce(max(n) FILTER (last = {DAY} OR last = {DAY} - 1), 0) AS streak FROM runs GROUP BY user_id) "


@query(ANSWERS[:-1] + f", {_STREAK}SELECT user_id, streak FROM streak")
def study_streak(spark, sf):
    days = view(spark, sf, "answers").select("user_id", F.to_date("ts").alias("day"))
    return R.streaks(days.where(F.col("day") <= today()), "user_id", "day", today())


@query(ANSWERS[:-1] + f", {_STREAK}SELECT user_id, count(*) FILTER (CAST(ts AS DATE) = {DAY}) AS today_studied, count(*) FILTER (known AND CAST(ts AS DATE) = {DAY}) AS today_known, count(*) AS total_studied, count(*) FILTER (known) AS total_known, coalesce(any_value(streak), 0) AS streak FROM answers LEFT JOIN streak USING (user_id) GROUP BY user_id")
def study_stats(spark, sf):
    return R.study_stats(view(spark, sf, "answers"), "user_id", "ts", "known", today())


@query(
    ANSWERS[:-1]
    + """, f AS (SELECT user_id, word, max(CASE WHEN NOT known THEN (ts, event_id) END) AS fall, max((ts, event_id)) AS last, max(ts) AS last_ts FROM answers GROUP BY user_id, word),
    r AS (SELECT f.user_id, f.word, any_value(last_ts) AS last_ts, count(a.event_id) AS run FROM f LEFT JOIN answers a ON a.user_id = f.user_id AND a.word = f.word AND a.known AND (f.fall IS NULL OR (a.ts, a.event_id) > f.fall) GROUP BY f.user_id, f.word),
    l AS (SELECT *, CAST(least(6, 1 + run) AS INTEGER) AS level FROM r)
    SELECT user_id, word, level, CAST(CAST(last_ts AS DATE) + CASE level WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 7 WHEN 5 THEN 14 WHEN 6 THEN 30 END AS DATE) AS next_review FROM l"""
)
def srs_ladder(spark, sf):
    return R.ladder(view(spark, sf, "answers"), ["user_id", "word"], "ts", "event_id", "known")


#: Answers of customers' words: stored progress that a later log goes on from, for four words in five.
_LATER = "SELECT event_id, user_id AS word_id, ts, event_id % 4 <> 0 AS known FROM events"


@query(
    PROGRESS.replace("WITH ", "WITH RECURSIVE ", 1)[:-1]
    + f""", log AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY word_id) AS n FROM ({_LATER})),
    words AS (SELECT coalesce(p.word_id, l.word_id) AS word_id, level, next_review FROM (SELECT * FROM progress WHERE word_id % 5 <> 2) p FULL JOIN (SELECT DISTINCT word_id FROM log) l ON l.word_id = p.word_id),
    walk AS (SELECT word_id, level, next_review, 0::BIGINT AS k FROM words
      UNION ALL SELECT w.word_id, CASE WHEN NOT l.known THEN 1 WHEN coalesce(w.level, 0) <= 1 THEN 2 ELSE least(w.level + 1, 6) END,
        CASE WHEN l.known THEN CAST(CAST(l.ts AS DATE) + CASE WHEN coalesce(w.level, 0) <= 1 THEN 1 WHEN w.level = 2 THEN 3 WHEN w.level = 3 THEN 7 WHEN w.level = 4 THEN 14 ELSE 30 END AS DATE) END, l.k
      FROM walk w JOIN log l ON l.word_id = w.word_id AND l.k = w.k + 1)
    SELECT word_id, CAST(arg_max(coalesce(level, -1), k) AS INTEGER) AS level, arg_max({{'d': next_review}}, k).d AS next_review FROM walk GROUP BY word_id""".replace("{{", "{").replace("}}", "}")
)
def ladder_continued(spark, sf):
    progress = view(spark, sf, "progress").where("word_id % 5 <> 2").select("word_id", "level", "next_review")
    log = table(spark, sf, "events").selectExpr("event_id", "user_id AS word_id", "ts", "event_id % 4 <> 0 AS known")
    maps = R.composed_maps(R.answer_maps(log, ["word_id"], "ts", "event_id", "known", [F.to_date("ts")]), ["word_id"])
    return R.continued(progress, maps, ["word_id"]).select("word_id", F.coalesce("level", F.lit(-1)).alias("level"), "next_review")


@query(PROGRESS + f"SELECT word_id, level, next_review FROM progress WHERE {_due()}")
def due_words(spark, sf):
    return view(spark, sf, "progress").where(R.is_due(F.col("level"), F.col("next_review"), today())).select("word_id", "level", "next_review")


@query(PROGRESS + f"SELECT word_id, CASE WHEN coalesce(level, 0) <= 0 THEN 'NEW' WHEN level = 1 THEN 'LEARNING' WHEN {_due()} THEN 'REVIEW' ELSE 'LEVEL ' || level END AS label FROM progress")
def status_label(spark, sf):
    return view(spark, sf, "progress").select("word_id", R.status_label(F.col("level"), F.col("next_review"), today()).alias("label"))


_COUNTS = f"count(*) AS n_words, count(*) FILTER (coalesce(level, 0) <= 0) AS n_new, count(*) FILTER (level = 1) AS n_learning, count(*) FILTER ({_due()}) AS n_due, count(*) FILTER (level >= 2) AS n_learned, count(*) FILTER (coalesce(level, 0) <= 1 OR {_due()}) AS n_available"


@query(PROGRESS + f"SELECT user_id, {_COUNTS} FROM progress GROUP BY user_id")
def status_counts(spark, sf):
    return R.status_counts(view(spark, sf, "progress"), "level", "next_review", today(), ["user_id"]).drop("completion")


@query(PROGRESS + "SELECT segment, floor(count(*) FILTER (level >= 2) / count(*) * 10000 + 0.5) / 100 AS percent FROM progress GROUP BY segment")
def completion(spark, sf):
    counts = R.status_counts(view(spark, sf, "progress"), "level", "next_review", today(), ["segment"])
    return counts.select("segment", (F.floor(F.col("completion") * 10000 + 0.5) / 100).alias("percent"))


@query(
    PROGRESS[:-1]
    + f""", p AS (SELECT user_id, word_id, CASE WHEN coalesce(level, 0) <= 0 THEN 2 WHEN level = 1 THEN 1 WHEN {_due()} THEN 0 END AS pool, md5('s1|' || user_id || '|' || word_id) AS mark FROM progress),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool = 2 ORDER BY pool, mark, word_id) AS r, count(*) FILTER (pool = 2) OVER (PARTITION BY user_id) AS n, count(*) FILTER (pool < 2) OVER (PARTITION BY user_id) AS v FROM p WHERE pool IS NOT NULL),
    t AS (SELECT *, least(n, 20 - least(v, 4)) AS tn FROM q)
    SELECT user_id, word_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY mark, word_id) AS INTEGER) AS position FROM t WHERE r <= CASE WHEN pool = 2 THEN tn ELSE least(v, 20 - tn) END"""
)
def session_build(spark, sf):
    return R.session(view(spark, sf, "progress"), "user_id", "word_id", "level", "next_review", today(), 20, "s1")


@query(cte("cards") + "SELECT CASE WHEN level IN ('A1', 'A2') THEN 'A1-A2' WHEN level IN ('B1', 'B2') THEN 'B1-B2' WHEN level IN ('C1', 'C2') THEN 'C1-C2' END AS level_group, count(*) AS n FROM cards GROUP BY ALL")
def level_groups(spark, sf):
    c = F.col("level")
    group = F.when(c.isin("A1", "A2"), "A1-A2").when(c.isin("B1", "B2"), "B1-B2").when(c.isin("C1", "C2"), "C1-C2")
    return view(spark, sf, "cards").groupBy(group.alias("level_group")).agg(F.count("*").alias("n"))


@query(cte("cards", "progress") + "SELECT chapter, count(*) AS n_words, count(*) FILTER (progress.level >= 2) AS n_learned FROM cards LEFT JOIN progress ON word_id = id WHERE chapter > 0 GROUP BY chapter")
def chapter_groups(spark, sf):
    progress = view(spark, sf, "progress").select(F.col("word_id").alias("id"), F.col("level").alias("known_level"))
    words = view(spark, sf, "cards").withColumn("chapters", F.array("chapter")).join(progress, "id", "left")
    return words.select(F.explode("chapters").alias("chapter"), "known_level").where("chapter > 0").groupBy("chapter").agg(F.count("*").alias("n_words"), F.count_if(F.col("known_level") >= 2).alias("n_learned"))


_DECODED = STORE[:-1] + f", raw AS (SELECT word_id, status, CASE WHEN json_valid(stored) THEN TRY_CAST(stored ->> 'level' AS DOUBLE) END AS lv, CASE WHEN json_valid(stored) THEN TRY_CAST(stored ->> 'nextReview' AS TIMESTAMP) END AS due FROM store), decoded AS (SELECT word_id, CASE WHEN lv IS NOT NULL THEN CAST(trunc(lv) AS INTEGER) WHEN status = 'learning' THEN 1 WHEN status = 'known' THEN 2 END AS level, CASE WHEN lv IS NOT NULL THEN CAST(due AS DATE) WHEN status = 'known' THEN CAST({DAY} + 1 AS DATE) END AS next_review FROM raw) "


def _decoded(spark, sf):
    p = R.decode_progress(F.col("stored"), F.col("status"), today())
    return view(spark, sf, "store").select("word_id", p["level"].alias("level"), p["next_review"].alias("next_review"))


@query(_DECODED + "SELECT word_id, level, next_review FROM decoded")
def decode_progress(spark, sf):
    return _decoded(spark, sf)


@query(_DECODED[:-1] + ", m AS (SELECT word_id // 3 AS word_id, level, next_review FROM decoded WHERE level > 0), b AS (SELECT word_id, max((level, coalesce(next_review, DATE '0001-01-01'))) AS x FROM m GROUP BY word_id) SELECT word_id, x[1] AS level, nullif(x[2], DATE '0001-01-01') AS next_review FROM b".replace("x[1]", "struct_extract_at(x, 1)").replace("x[2]", "struct_extract_at(x, 2)"))
def migrate_progress(spark, sf):
    progress = _decoded(spark, sf)
    id_map = progress.select(F.col("word_id").alias("old_id"), F.expr("word_id DIV 3").alias("new_id"))
    return R.migrate_progress(progress, id_map)


_MOVED = "SELECT word_id // 3 AS word_id, level, next_review FROM decoded WHERE level > 0"


@query(cte("store", "progress")[:-1] + _DECODED.removeprefix(STORE[:-1])[:-1] + f", m AS ({_MOVED} UNION ALL SELECT word_id, level, next_review FROM progress WHERE level > 0), b AS (SELECT word_id, max((level, coalesce(next_review, DATE '0001-01-01'))) AS x FROM m GROUP BY word_id) SELECT word_id, struct_extract_at(x, 1) AS level, nullif(struct_extract_at(x, 2), DATE '0001-01-01') AS next_review FROM b")
def migrate_existing(spark, sf):
    progress = _decoded(spark, sf)
    id_map = progress.select(F.col("word_id").alias("old_id"), F.expr("word_id DIV 3").alias("new_id"))
    return R.migrate_progress(progress, id_map, view(spark, sf, "progress").where("level > 0"))


@query(PROGRESS + "SELECT key FROM (SELECT CASE CAST(word_id % 3 AS INTEGER) WHEN 0 THEN 'progress_' WHEN 1 THEN 'status_' ELSE 'theme_' END || word_id AS key FROM progress) WHERE NOT prefix(key, 'progress_') AND NOT prefix(key, 'status_')")
def progress_reset(spark, sf):
    prefix = F.when(F.col("word_id") % 3 == 0, "progress_").when(F.col("word_id") % 3 == 1, "status_").otherwise("theme_")
    return R.reset(view(spark, sf, "progress").select(F.concat(prefix, F.col("word_id").cast("string")).alias("key")))


_POOLS = PROGRESS[:-1] + f", p AS (SELECT user_id, word_id, CASE WHEN coalesce(level, 0) <= 0 THEN 2 WHEN level = 1 THEN 1 WHEN {_due()} THEN 0 END AS pool, md5('s1|' || user_id || '|' || word_id) AS mark FROM progress) "


@query(_POOLS + "SELECT user_id, word_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pool, mark, word_id) AS INTEGER) AS position FROM p WHERE pool IS NOT NULL")
def session_all(spark, sf):
    return R.session(view(spark, sf, "progress"), "user_id", "word_id", "level", "next_review", today(), None, "s1")


@query(_POOLS + "SELECT user_id, word_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY mark, word_id) AS INTEGER) AS position FROM p WHERE pool = 0")
def daily_review(spark, sf):
    return R.daily_review(view(spark, sf, "progress"), "user_id", "word_id", "level", "next_review", today(), "s1")


@query(PROGRESS + f"SELECT word_id, next_review IS NULL OR next_review <= {DAY} AS due FROM progress")
def due_by_date(spark, sf):
    return view(spark, sf, "progress").select("word_id", R.is_due_by_date(F.col("next_review"), today()).alias("due"))


@query(ANSWERS + "SELECT user_id, CAST(ts AS DATE) AS session, count(*) AS answered, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS learning FROM answers GROUP BY ALL")
def session_result(spark, sf):
    return R.session_results(view(spark, sf, "answers").withColumn("session", F.to_date("ts")), ["user_id", "session"], "known")


#: A key-value store of each user: progress, statistics and settings, some of them flags of versions.
_KEYS = "CASE CAST(word_id % 5 AS INTEGER) WHEN 0 THEN 'progress_' || CAST(word_id AS STRING) WHEN 1 THEN 'status_' || CAST(word_id AS STRING) WHEN 2 THEN 'stats_days' WHEN 3 THEN 'onboarding_v' || CAST(word_id % 3 AS STRING) ELSE 'theme' END"
_KV = PROGRESS[:-1] + f", kv AS (SELECT user_id, {_KEYS.replace('STRING', 'VARCHAR')} AS key, max(coalesce(CAST(level AS VARCHAR), '')) AS value FROM progress GROUP BY ALL) "


def _store(spark, sf):
    rows = view(spark, sf, "progress").withColumn("key", F.expr(_KEYS))
    return rows.groupBy("user_id", "key").agg(F.max(F.coalesce(F.col("level").cast("string"), F.lit(""))).alias("value"))


@query(_KV + "SELECT user_id, key, CASE WHEN key = 'theme' THEN 'dark' ELSE value END AS value FROM kv UNION ALL SELECT DISTINCT user_id, 'language', 'sv' FROM kv")
def store_write(spark, sf):
    kv = _store(spark, sf)
    users = kv.select("user_id").distinct()
    new = kv.where("key = 'theme'").select("user_id", "key", F.lit("dark").alias("value")).unionByName(users.select("user_id", F.lit("language").alias("key"), F.lit("sv").alias("value")))
    return R.put(kv, new, ["user_id", "key"])


@query(_KV + "SELECT user_id, max(value) FILTER (key = 'theme') AS theme, max(TRY_CAST(value AS INTEGER)) FILTER (key = 'stats_days') AS days FROM kv GROUP BY user_id")
def store_read(spark, sf):
    return R.get(_store(spark, sf), ["user_id"], {"theme": ("theme", "string"), "stats_days": ("days", "int")})


@query(_KV + "SELECT user_id, key, value FROM kv WHERE NOT prefix(key, 'progress_') AND NOT prefix(key, 'status_') AND key <> 'stats_days'")
def store_reset(spark, sf):
    return R.reset(_store(spark, sf), statistics=("stats_days",))


@query(_KV + "SELECT user_id, bool_or(prefix(key, 'progress_')) AS has_progress, bool_or(key = 'onboarding_v2') AS onboarded, NOT bool_or(prefix(key, 'progress_') OR prefix(key, 'status_')) AND NOT bool_or(key = 'onboarding_v2') AS show_onboarding FROM kv GROUP BY user_id")
def onboarding_flags(spark, sf):
    return R.onboarding(_store(spark, sf), ["user_id"], "onboarding_v2")
