"""Study statistics and progress as they are stored: counters apart from days, days as a JSON record, progress in two formats.

A user's row is (keys, total_answers, total_known, total_learning, stats_days); stats_days maps days, as yyyy-MM-dd, to
{"studied", "known", "learning"}. The totals stand apart from the days, so the two may disagree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTALS = ("total_answers", "total_known", "total_learning")
COUNTS = ("studied", "known", "learning")


def _days(stored: Column) -> Column:
    """The map of days, its records as VARIANT; empty without a record or with one that is no JSON object."""
    return F.coalesce(F.from_json(stored, "map<string, variant>"), F.from_json(F.lit("{}"), "map<string, variant>"))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def _count(record: Column, name: str) -> Column:
    """A counter of a day's record: 0 where the record is no object, or the counter missing or not a whole number."""
    whole = F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")) == "BIGINT"
    return F.when(_is_object(record) & whole, F.try_variant_get(record, f"$.{name}", "bigint")).otherwise(F.lit(0).cast("bigint"))


def day_counts(answers: DataFrame, keys: list[str], time: str, known: str) -> DataFrame:
    """(keys, _new, _sums): the counters of each day and in all. Sums of parts add up, so an answer log may be cut anywhere.

    An answer without a time counts in the totals alone; one that doesn't say whether it was known was not.
    """
    yes = F.coalesce(F.col(known), F.lit(False))
    by_day = answers.groupBy(*keys, F.date_format(time, "yyyy-MM-dd").alias("_day")).agg(F.count("*").alias("studied"), F.count_if(yes).alias("known"), F.count_if(~yes).alias("learning"))
    record = F.when(F.col("_day").isNotNull(), F.struct("_day", F.struct(*COUNTS)))
    return by_day.groupBy(*keys).agg(F.map_from_entries(F.array_compact(F.collect_list(record))).alias("_new"), F.struct(*[F.sum(c).alias(c) for c in COUNTS]).alias("_sums"))


def record_answers(stats: DataFrame, answers: DataFrame, keys: list[str], time: str, known: str) -> DataFrame:
    """Stored statistics after further answers; users of either side.

    Days of a user whose record is malformed begin anew, if the user answers, and so does a day whose own record is no object; other days stay
    as they stand, whatever they hold. A user without answers keeps the row as it is. One shuffle by user; a user is one row
    with as many entries as days of study.
    """
    rows = stats.select(*keys, *TOTALS, "stats_days").join(day_counts(answers, keys, time, known), keys, "full")
    rows = rows.withColumn("_old", _days(F.col("stats_days")))

    def after(day: Column) -> Column:
        old, new = F.try_element_at("_old", day), F.try_element_at("_new", day)
        return F.when(new.isNull(), old).otherwise(F.to_variant_object(F.struct(*[(_count(old, c) + new[c]).alias(c) for c in COUNTS])))

    days = F.array_sort(F.array_union(F.map_keys("_old"), F.map_keys("_new")))
    merged = F.to_json(F.map_from_entries(F.transform(days, lambda d: F.struct(d.alias("day"), after(d).alias("record")))))
    totals = [(F.coalesce(t, F.lit(0)) + F.coalesce(F.col("_sums")[c], F.lit(0))).cast("bigint").alias(t) for t, c in zip(TOTALS, COUNTS)]
    return rows.select(*keys, *totals, F.when(F.col("_new").isNull(), F.col("stats_days")).otherwise(merged).alias("stats_days"))


def load_statistics(stats: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """(keys, totals, today_studied, today_known, today_learning, streak) of stored statistics; malformed days count as none.

    The streak ends today if today has an entry, of whatever kind, else yesterday; it goes back over days whose record is an object
    with studied above 0.
    """
    rows = stats.withColumn("_d", _days(F.col("stats_days")))
    now = F.try_element_at("_d", F.date_format(today, "yyyy-MM-dd"))
    end = F.when(F.map_contains_key("_d", F.date_format(today, "yyyy-MM-dd")), today).otherwise(F.date_sub(today, 1))
    as_date = lambda k: F.try_to_date(k, "yyyy-MM-dd")
    studied = F.map_filter("_d", lambda k, v: (_count(v, "studied") > 0) & F.coalesce((F.date_format(as_date(k), "yyyy-MM-dd") == k) & (as_date(k) <= end), F.lit(False)))
    back = F.sort_array(F.transform(F.map_keys(studied), as_date), asc=False)
    # distinct days, newest first: the k-th is k days before the end as long as none is left out, and never again after
    streak = F.size(F.filter(back, lambda d, k: d == F.date_sub(end, k))).cast("bigint")
    totals = [F.coalesce(t, F.lit(0)).cast("bigint").alias(t) for t in TOTALS]
    return rows.select(*keys, *totals, *[_count(now, c).alias(f"today_{c}") for c in COUNTS], streak.alias("streak"))


def recorded_days(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, studied, known, learning): the entries of stored days, one a row."""
    return stats.select(*keys, F.explode(_days(F.col("stats_days"))).alias("day", "_r")).select(*keys, "day", *[_count(F.col("_r"), c).alias(c) for c in COUNTS])


def load_progress(store: DataFrame, keys: list[str], today: Column, prefixes: tuple[str, str] = ("progress_", "status_"), key: str = "key", value: str = "value") -> DataFrame:
    """(keys, word, level, next_review, migrated) of the words with progress in a key-value store.

    A record is sound if it is a JSON object whose level is a whole number or missing (0) and whose nextReview is a text or missing; at
    level 0 or less the word is new, whatever the legacy status says. Only without a sound record does the status count:
    "learning" is level 1, "known" level 2 due tomorrow; such rows are marked migrated, to be written back.
    """
    word = F.when(F.col(key).startswith(prefixes[0]), F.substring(key, len(prefixes[0]) + 1, 1 << 30)).when(F.col(key).startswith(prefixes[1]), F.substring(key, len(prefixes[1]) + 1, 1 << 30))
    modern = F.col(key).startswith(prefixes[0])
    rows = store.withColumn("word", word).where("word IS NOT NULL").groupBy(*keys, "word").agg(F.max(F.when(modern, F.col(value))).alias("_saved"), F.max(F.when(~modern, F.col(value))).alias("_status"))
    v = F.try_parse_json("_saved")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    sound = _is_object(v) & kind("$.level").isin("BIGINT", "VOID") & kind("$.nextReview").isin("STRING", "VOID")
    level = F.coalesce(F.try_variant_get(v, "$.level", "bigint"), F.lit(0))
    legacy = F.when(F.col("_status") == "learning", 1).when(F.col("_status") == "known", 2)
    out = rows.withColumn("_sound", sound).select(
        *keys,
        "word",
        F.when(F.col("_sound"), level).otherwise(legacy).cast("int").alias("level"),
        F.when(F.col("_sound"), F.try_to_timestamp(F.try_variant_get(v, "$.nextReview", "string")).cast("date")).when(legacy == 2, F.date_add(today, 1)).alias("next_review"),
        (~F.col("_sound")).alias("migrated"),
    )
    return out.where("level > 0")


def progress_rows(progress: DataFrame, keys: list[str], prefix: str = "progress_") -> DataFrame:
    """(keys, key, value): progress (keys, word, level, next_review) as records of the store, the day as its midnight."""
    at = F.date_format("next_review", "yyyy-MM-dd'T00:00:00.000'")
    value = F.to_json(F.struct("level", at.alias("nextReview")), {"ignoreNullFields": "false"})
    return progress.select(*keys, F.concat(F.lit(prefix), "word").alias("key"), value.alias("value"))
