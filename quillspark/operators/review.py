"""Spaced repetition: due words, the review ladder, sessions, statistics, streaks and progress migration.

The day is always a parameter. Day arithmetic is on calendar days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until the next review by level; the highest level.
INTERVALS = {2: 1, 3: 3, 4: 7, 5: 14, 6: 30}
TOP_LEVEL = 6


def interval_days(level: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, days in INTERVALS.items():
        out = F.when(level == k, days).otherwise(out)
    return out


def is_due(level: Column, next_review: Column, today: Column) -> Column:
    """Learned and without a date or with one that has come."""
    return F.coalesce((level >= 2) & (next_review.isNull() | (F.to_date(next_review) <= today)), F.lit(False))


def status_label(level: Column, next_review: Column, today: Column) -> Column:
    level = F.coalesce(level, F.lit(0))
    return F.when(level <= 0, "NEW").when(level == 1, "LEARNING").when(is_due(level, next_review, today), "REVIEW").otherwise(F.concat(F.lit("LEVEL "), level.cast("string")))


def status_counts(words: DataFrame, level: str, next_review: str, today: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts of new, learning, due, learned and available words, and the learned share (0 without words)."""
    lv, due = F.coalesce(F.col(level), F.lit(0)), is_due(F.col(level), F.col(next_review), today)
    out = words.groupBy(*(keys or [])).agg(F.count("*").alias("n_words"), F.count_if(lv <= 0).alias("n_new"), F.count_if(lv == 1).alias("n_learning"), F.count_if(due).alias("n_due"), F.count_if(lv >= 2).alias("n_learned"))
    return out.withColumn("n_available", F.col("n_new") + F.col("n_learning") + F.col("n_due")).withColumn("completion", F.coalesce(F.try_divide("n_learned", "n_words"), F.lit(0.0)))


def ladder(answers: DataFrame, keys: list[str], time: str, tiebreak: str, known: str) -> DataFrame:
    """Level and next review day of each word from its whole answer log, without state.

    A word whose last answer is "learning" is at level 1; otherwise at 1 plus the known answers since the
    last such one, at most the top level. The last "learning" is looked up and answers are counted in one shuffle.
    """
    at = F.struct(F.col(time), F.col(tiebreak))
    fall = F.max(F.when(~F.col(known), at)).over(Window.partitionBy(*keys))
    rows = answers.withColumn("_fall", fall)
    since = F.col(known) & (F.col("_fall").isNull() | (at > F.col("_fall")))
    out = rows.groupBy(*keys).agg(F.count_if(since).alias("_run"), F.max(at).alias("_last")).withColumn("level", F.least(F.lit(TOP_LEVEL), F.lit(1) + F.col("_run")).cast("int"))
    return out.select(*keys, "level", F.date_add(F.to_date(F.col("_last")[time]), interval_days(F.col("level"))).alias("next_review"))


def _after(known: Column, level: Column) -> Column:
    """The level after one answer."""
    return F.when(known, F.least(F.greatest(level, F.lit(1)) + 1, F.lit(TOP_LEVEL))).otherwise(F.lit(1))


def answer_maps(answers: DataFrame, keys: list[str], time: str, tiebreak: str, known: str, segment: list[Column] | None = None) -> DataFrame:
    """(keys, _first, _last, _to) of each segment of each word's log: its first and last moment, and the map of levels that it stands for.

    An answer maps the levels 0 to TOP_LEVEL to levels, and so does a sequence of answers: _to holds, for each level before,
    the level after. Maps of neighbouring segments compose, and composition is associative, so a log may be cut
    anywhere, and a word with very many answers is many small groups. Segments of a word must not overlap in time.
    """
    at = F.struct(F.col(time).alias("ts"), F.col(tiebreak).alias("tie"))
    parts = {f"_segment{k}": c for k, c in enumerate(segment or [])}
    grouped = answers.withColumns(parts).groupBy(*keys, *parts) if parts else answers.groupBy(*keys)
    log = grouped.agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(known).alias("known")))).alias("_log"))
    same = F.array(*(F.lit(k) for k in range(TOP_LEVEL + 1)))
    to = F.aggregate("_log", same, lambda levels, x: F.transform(levels, lambda level: _after(x["known"], level)))
    return log.select(*keys, F.get("_log", F.lit(0))["at"].alias("_first"), F.element_at("_log", -1)["at"].alias("_last"), to.alias("_to"))


def composed_maps(maps: DataFrame, keys: list[str]) -> DataFrame:
    """One map a word from those of its segments, earlier ones first; the result is a map of answer_maps() again."""
    parts = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "_last", "_to"))).alias("_parts"))
    same = F.array(*(F.lit(k) for k in range(TOP_LEVEL + 1)))
    to = F.aggregate("_parts", same, lambda levels, p: F.transform(levels, lambda level: F.get(p["_to"], level)))
    return parts.select(*keys, F.get("_parts", F.lit(0))["_first"].alias("_first"), F.element_at("_parts", -1)["_last"].alias("_last"), to.alias("_to"))


def continued(progress: DataFrame, maps: DataFrame, keys: list[str], level: str = "level", next_review: str = "next_review") -> DataFrame:
    """(keys, level, next_review) of stored progress after a later answer log: words of either side.

    Without answers a record stays as it is; without a record, or below level 0, a word begins at 0; above the top it counts as the top.
    """
    rows = progress.select(*keys, F.col(level).alias("_level"), F.col(next_review).alias("_at")).join(maps, keys, "full")
    begin = F.least(F.greatest(F.coalesce("_level", F.lit(0)), F.lit(0)), F.lit(TOP_LEVEL)).cast("int")
    out = rows.withColumn("_new", F.get("_to", begin))
    due = F.date_add(F.to_date(F.col("_last")["ts"]), interval_days(F.col("_new")))
    return out.select(*keys, F.when(F.col("_to").isNull(), F.col("_level")).otherwise(F.col("_new")).cast("int").alias("level"), F.when(F.col("_to").isNull(), F.col("_at")).otherwise(due).alias("next_review"))


def daily_stats(answers: DataFrame, time: str, known: str, keys: list[str] | None = None) -> DataFrame:
    return answers.groupBy(*(keys or []), F.to_date(time).alias("day")).agg(F.count("*").alias("studied"), F.count_if(known).alias("known"), F.count_if(~F.col(known)).alias("learning"))


def streaks(days: DataFrame, key: str, day: str, today: Column) -> DataFrame:
    """Days in a row with study that end today, or yesterday if today has none yet; 0 without."""
    one = days.select(key, day).distinct()
    island = F.date_sub(day, F.row_number().over(Window.partitionBy(key).orderBy(day)))
    runs = one.withColumn("_i", island).groupBy(key, "_i").agg(F.count("*").alias("n"), F.max(day).alias("last"))
    live = F.max(F.when((F.col("last") == today) | (F.col("last") == F.date_sub(today, 1)), F.col("n")))
    return runs.groupBy(key).agg(F.coalesce(live, F.lit(0)).cast("long").alias("streak"))


def study_stats(answers: DataFrame, key: str, time: str, known: str, today: Column) -> DataFrame:
    """Today's and all answers of each user, and the streak."""
    now = F.to_date(time) == today
    sums = answers.groupBy(key).agg(F.count_if(now).alias("today_studied"), F.count_if(now & F.col(known)).alias("today_known"), F.count("*").alias("total_studied"), F.count_if(known).alias("total_known"))
    return sums.join(streaks(answers.select(key, F.to_date(time).alias("day")).where(F.col("day") <= today), key, "day", today), key, "left").withColumn("streak", F.coalesce("streak", F.lit(0)).cast("long"))


def session(words: DataFrame, key: str, word: str, level: str, next_review: str, today: Column, size: int | None, seed: str) -> DataFrame:
    """Study sessions of each user: a fifth of reviews (due before learning), the rest new words, either filling up for the other.

    The order within a pool is that of md5(seed, key, word), so every engine gives one session. Without a
    size, all due, learning and new words come, in this order.
    """
    lv = F.coalesce(F.col(level), F.lit(0))
    pool = F.when(lv <= 0, 2).when(lv == 1, 1).when(is_due(F.col(level), F.col(next_review), today), 0)
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col(word).cast("string")))
    rows = words.withColumn("_pool", pool).where("_pool IS NOT NULL").withColumn("_mark", mark)
    side = (F.col("_pool") == 2).cast("int")
    if size is None:
        w = Window.partitionBy(key).orderBy("_pool", "_mark", word)
        return rows.withColumn("position", F.row_number().over(w)).select(key, word, "position")
    rank = F.row_number().over(Window.partitionBy(key, "_side").orderBy("_pool", "_mark", word))
    rows = rows.withColumn("_side", side).withColumn("_rank", rank)
    quota = -(-size // 5)
    counts = rows.groupBy(key).agg(F.sum("_side").alias("_new"), F.count_if(F.col("_side") == 0).alias("_rev"))
    n_new = F.least(F.col("_new"), F.lit(size) - F.least(F.col("_rev"), F.lit(quota)))
    counts = counts.withColumn("_take_new", n_new).withColumn("_take_rev", F.least(F.col("_rev"), F.lit(size) - n_new))
    taken = rows.join(counts, key).where(F.col("_rank") <= F.when(F.col("_side") == 1, F.col("_take_new")).otherwise(F.col("_take_rev")))
    return taken.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("_mark", word))).select(key, word, "position")


def decode_progress(stored: Column, status: Column, today: Column) -> Column:
    """(level, next_review) of a stored record, or of a legacy status if the record does not decode; null if neither.

    A record that decodes to level 0 or less wins over the status: the word is new.
    """
    raw = F.from_json(stored, "level double, nextReview string")
    modern = F.when(raw["level"].isNotNull(), F.struct(raw["level"].cast("int").alias("level"), F.try_to_timestamp(raw["nextReview"]).cast("date").alias("next_review")))
    nothing = F.lit(None).cast("date")
    legacy = F.when(status == "learning", F.struct(F.lit(1).alias("level"), nothing.alias("next_review"))).when(status == "known", F.struct(F.lit(2).alias("level"), F.date_add(today, 1).alias("next_review")))
    return F.coalesce(modern, legacy)


def progress_rank(level: Column, next_review: Column) -> Column:
    """Order of progress: higher level, then later review, none lowest; associative, so sums of parts may be merged."""
    return F.struct(level.alias("level"), F.coalesce(next_review, F.lit("0001-01-01").cast("date")).alias("at"))


def migrate_progress(progress: DataFrame, id_map: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """progress (word_id, level, next_review) moved by id_map (old_id, new_id), the best record of each new id kept.

    Words at level 0 or less stay behind; existing records of the new ids take part.
    """
    moved = progress.where("level > 0").join(id_map, F.col("word_id") == F.col("old_id")).select(F.col("new_id").alias("word_id"), "level", "next_review")
    rows = moved if existing is None else moved.unionByName(existing.select("word_id", "level", "next_review"))
    best = rows.groupBy("word_id").agg(F.max(progress_rank(F.col("level"), F.col("next_review"))).alias("b"))
    return best.select("word_id", F.col("b.level").alias("level"), F.nullif(F.col("b.at"), F.lit("0001-01-01").cast("date")).alias("next_review"))


def is_due_by_date(next_review: Column, today: Column) -> Column:
    """The older test, which looks at the date alone: without one a word is due."""
    return next_review.isNull() | (F.to_date(next_review) <= today)


def daily_review(words: DataFrame, key: str, word: str, level: str, next_review: str, today: Column, seed: str) -> DataFrame:
    """All due words of each user in a shuffled order, that of md5(seed, key, word): (key, word, position)."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col(word).cast("string")))
    due = words.where(is_due(F.col(level), F.col(next_review), today)).withColumn("_mark", mark)
    return due.select(key, word, F.row_number().over(Window.partitionBy(key).orderBy("_mark", word)).alias("position"))


def session_results(answers: DataFrame, keys: list[str], known: str) -> DataFrame:
    """What each session came to: answers, known and still to learn."""
    return answers.groupBy(*keys).agg(F.count("*").alias("answered"), F.count_if(known).alias("known"), F.count_if(~F.col(known)).alias("learning"))


def put(store: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A key-value store after writes: one value a key, the new one where there is one. The result is a new snapshot."""
    rows = store.select(*keys, value, F.lit(0).alias("_new")).unionByName(new.select(*keys, value, F.lit(1).alias("_new")))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("_new", value)).alias(value))


def get(store: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str]], key: str = "key", value: str = "value") -> DataFrame:
    """Point reads: wanted names for each key a column and a type; a missing or undecodable value is null."""
    return store.groupBy(*keys).agg(*[F.max(F.when(F.col(key) == k, F.col(value)).try_cast(kind)).alias(name) for k, (name, kind) in wanted.items()])


def onboarding(store: DataFrame, keys: list[str], flag: str, prefixes: tuple[str, ...] = ("progress_", "status_"), key: str = "key") -> DataFrame:
    """Whether the first steps are still to be shown: neither the version's flag nor any progress is stored."""
    begun = F.lit(False)
    for p in prefixes:
        begun = begun | F.col(key).startswith(p)
    out = store.groupBy(*keys).agg(F.bool_or(F.col(key).startswith(prefixes[0])).alias("has_progress"), F.bool_or(F.col(key) == flag).alias("onboarded"), F.bool_or(begun).alias("_begun"))
    return out.withColumn("show_onboarding", ~F.col("_begun") & ~F.col("onboarded")).drop("_begun")


def reset(store: DataFrame, prefixes: tuple[str, ...] = ("progress_", "status_"), key: str = "key", statistics: tuple[str, ...] = ()) -> DataFrame:
    """A key-value store without the keys of some prefixes and without some statistics."""
    gone = F.col(key).isin(*statistics) if statistics else F.lit(False)
    for p in prefixes:
        gone = gone | F.col(key).startswith(p)
    return store.where(~gone)
