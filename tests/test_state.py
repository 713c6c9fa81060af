"""Stored statistics, the layered store, gated sinks and the order of lexicon lines against plain loops."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexicon, quality, recorded, rules
from quillspark.sources import files, store
from quillspark.streaming import recorded as stream

STATS = "u int, total_answers long, total_known long, total_learning long, stats_days string"
KV = "key string, value string"


def loop(stats, answers):
    """One answer after the other, as an application would count them."""
    out = {u: [a or 0, k or 0, n or 0, d] for u, a, k, n, d in stats}
    for u, ts, known in answers:
        row = out.setdefault(u, [0, 0, 0, None])
        row[0] += 1
        row[1 if known else 2] += 1
        try:
            days = json.loads(row[3])
            days = days if isinstance(days, dict) else {}
        except (TypeError, ValueError):
            days = {}
        day = days.get(ts[:10])
        day = day if isinstance(day, dict) else {}
        number = lambda c: day[c] if type(day.get(c)) is int else 0  # noqa: E731, B023
        days[ts[:10]] = {"studied": number("studied") + 1, "known": number("known") + known, "learning": number("learning") + (not known)}
        row[3] = json.dumps(days)
    return out


def loop_streak(stored, today):
    try:
        days = json.loads(stored)
        days = days if isinstance(days, dict) else {}
    except (TypeError, ValueError):
        days = {}
    at = today if str(today) in days else today - timedelta(1)
    n = 0
    while isinstance(days.get(str(at)), dict) and type(days[str(at)].get("studied")) is int and days[str(at)]["studied"] > 0:
        n, at = n + 1, at - timedelta(1)
    return n


def made(seed, users=40, n=300):
    r = random.Random(seed)
    odd = [None, "", "null", "[]", "{", "7", "{}", '{"2024-01-09": 5}', '{"2024-01-09": null, "x": [1]}', '{"2024-01-10": {"studied": "1"}}', '{"2024-01-08": {"studied": 2, "known": 1.5}, "2024-01-07": {"studied": 1}}', '{"2024-01-10": {"studied": -1}}']
    stats = [(u, r.choice([None, 0, 9]), r.randint(0, 5), r.randint(0, 5), r.choice(odd)) for u in range(users)]
    answers = [(r.choice([0, 1, r.randint(0, users + 9)]), f"2024-01-{r.randint(5, 10):02d} {r.randint(0, 23):02d}:00:00", r.random() < 0.6) for _ in range(n)]
    return stats, answers


def plain_days(text):
    try:
        d = json.loads(text)
    except (TypeError, ValueError):
        return text
    return d


def answers_df(spark, answers):
    return spark.createDataFrame(answers, "u int, ts string, known boolean").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("seed", [1, 2])
def test_recorded_statistics_equal_the_loop(spark, seed):
    stats, answers = made(seed)
    df = spark.createDataFrame(stats, STATS)
    for part in (answers[:120], answers[120:]):  # a log may be cut anywhere
        df = recorded.record_answers(df, answers_df(spark, part), ["u"], "ts", "known")
    want = loop(stats, answers)
    got = {r["u"]: r for r in df.collect()}
    assert {u: [r["total_answers"], r["total_known"], r["total_learning"], plain_days(r["stats_days"])] for u, r in got.items()} == {u: [*v[:3], plain_days(v[3])] for u, v in want.items()}
    today = date(2024, 1, 10)
    streaks = {r["u"]: r["streak"] for r in recorded.load_statistics(df, ["u"], F.lit(today)).collect()}
    assert streaks == {u: loop_streak(v[3], today) for u, v in want.items()}


def test_recorded_statistics_of_nothing(spark):
    none, answers = spark.createDataFrame([], STATS), answers_df(spark, [])
    assert recorded.record_answers(none, answers, ["u"], "ts", "known").count() == 0
    lone = answers_df(spark, [(1, None, True), (1, "2024-01-05 10:00:00", None)])
    row = recorded.record_answers(none, lone, ["u"], "ts", "known").first()
    assert (row["total_answers"], row["total_known"], row["total_learning"]) == (2, 1, 1)
    assert json.loads(row["stats_days"]) == {"2024-01-05": {"studied": 1, "known": 0, "learning": 1}}


def test_stream_keeps_statistics_and_counts_a_repeated_batch_once(spark, tmp_path):
    _, answers = made(3, users=10, n=60)
    at, source = str(tmp_path / "stats"), tmp_path / "source"
    schema = stream.statistics_schema(answers_df(spark, answers), ["u"])
    for k in range(3):
        answers_df(spark, [*answers[k * 20 : k * 20 + 20], (None, "2024-01-05 00:00:00", True)]).coalesce(1).write.mode("append").parquet(str(source))
        rows = spark.readStream.schema("u int, ts timestamp, known boolean").option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.record_answers(rows, at, ["u"], "ts", "known").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "offsets")).start().awaitTermination(120)
    before = store.head(spark, at)
    assert before[1]["done"] == {"answers": 2}
    # a batch that is run again, as after a lost driver: its number is known
    again = store.commit(spark, at, spark.createDataFrame([(0, 99, 99, 99, "{}")], schema), ["u"], schema, "answers", 2)
    assert not again and store.head(spark, at) == before
    got = {r["u"]: [r[1], r[2], r[3], plain_days(r[4])] for r in store.read(spark, at, ["u"], schema).collect()}
    assert got == {u: [*v[:3], plain_days(v[3])] for u, v in loop([], answers).items()}


def test_store_equals_a_dictionary(spark, tmp_path):
    r, at, want = random.Random(5), str(tmp_path / "kv"), {}
    assert store.read(spark, at, ["key"], KV).count() == 0
    for n in range(11):  # beyond MAX_LAYERS, so the layers are written as one on the way
        changes = [(f"k{r.randint(0, 15)}", r.choice([None, "a", "b"]), r.random() < 0.3) for _ in range(1)] + [(f"only{n}", "x", False)]
        assert store.commit(spark, at, spark.createDataFrame(changes, KV + ", _gone boolean"), ["key"], KV, "w", n)
        for key, value, gone in changes:
            want.pop(key, None) if gone else want.update({key: value})
    assert {x["key"]: x["value"] for x in store.read(spark, at, ["key"], KV).collect()} == want
    n, state = store.head(spark, at)
    assert n == 11 and len(state["layers"]) <= store.MAX_LAYERS and state["done"] == {"w": 10}


def test_store_heads_are_published_once(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(1).write.parquet(str(tmp_path / name))
    assert store.rename_new(spark, str(tmp_path / "a"), str(tmp_path / "heads/1"))
    assert not store.rename_new(spark, str(tmp_path / "b"), str(tmp_path / "heads/1"))
    assert (tmp_path / "b").exists()


def test_progress_is_read_and_written_back(spark):
    day = F.lit(date(2024, 1, 30))
    rows = [("progress_1", '{"level":3,"nextReview":"2024-02-01T00:00:00.000"}'), ("progress_2", '{"level":0}'), ("status_2", "known"), ("progress_3", "x"), ("status_3", "known"), ("status_4", "learning"), ("progress_5", '{"level":2.0}'), ("status_5", "learning"), ("progress_6", '{"level":2,"nextReview":5}'), ("progress_7", '{"level":2,"nextReview":"soon"}'), ("status_8", "other"), ("theme", "dark"), ("progress_9", None), ("progress_", '{"level":1}')]
    kv = spark.createDataFrame(rows, KV)
    got = {r["word"]: (r["level"], r["next_review"], r["migrated"]) for r in recorded.load_progress(kv, [], day).collect()}
    assert got == {"1": (3, date(2024, 2, 1), False), "3": (2, date(2024, 1, 31), True), "4": (1, None, True), "5": (1, None, True), "7": (2, None, False), "": (1, None, False)}
    back = recorded.progress_rows(recorded.load_progress(kv, [], day).where("migrated"), [])
    assert {r["key"]: r["value"] for r in back.collect()} == {"progress_3": '{"level":2,"nextReview":"2024-01-31T00:00:00.000"}', "progress_4": '{"level":1,"nextReview":null}', "progress_5": '{"level":1,"nextReview":null}'}


def test_json_violations(spark):
    fields = {"a": ("text", False), "n": ("whole", True), "l": ("texts", False), "f": ("flag", True), "x y": ("number", True)}
    good = {"a": "", "n": None, "l": [], "f": True, "x y": 1.5}
    cases = [(good, set()), (good | {"a": 5}, {("a", "WRONG_TYPE")}), (good | {"n": "7"}, {("n", "NUMBER_AS_TEXT")}), (good | {"n": 7.5}, {("n", "WRONG_TYPE")}), (good | {"l": ["a", None]}, {("l", "WRONG_TYPE")}), (good | {"l": [1]}, {("l", "WRONG_TYPE")}), (good | {"f": "true", "x y": "-1.5"}, {("f", "WRONG_TYPE"), ("x y", "NUMBER_AS_TEXT")}), ({k: v for k, v in good.items() if k != "f"} | {"a": None}, {("f", "MISSING"), ("a", "NULL_VALUE")}), ([good], {(None, "NO_OBJECT")}), (None, {(None, "NO_OBJECT")})]
    rows = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(97, "{"), (98, None), (99, "")]
    got = {}
    for r in quality.json_violations(spark.createDataFrame(rows, "id int, raw string"), "id", "raw", fields).collect():
        got.setdefault(r["id"], set()).add((r["field"], r["problem"]))
    assert got == {k: w for k, (_, w) in enumerate(cases) if w} | {k: {(None, "NO_JSON")} for k in (97, 98, 99)}


def test_observed_write_keeps_what_stood_there(spark, tmp_path):
    at, report = str(tmp_path / "out"), str(tmp_path / "report")
    rule = {"EVEN": F.col("id") % 2 == 0, "NULL": F.lit(None).cast("boolean")}
    assert files.write_observed(spark.createDataFrame([(1,), (3,)], "id long"), rule, at, report) == {"ROWS": 2, "EVEN": 0, "NULL": 0}
    with pytest.raises(ValueError, match="EVEN"):
        files.write_observed(spark.range(10), rule, at, report)
    assert sorted(r["id"] for r in files.read_lines(spark, at, "id long").collect()) == [1, 3]
    assert [r["value"].split() for r in spark.read.text(report).collect()] == [["EVEN", "5"], ["NULL", "0"], ["ROWS", "10"]]
    assert not [p for p in tmp_path.iterdir() if "waiting" in p.name]
    assert files.write_observed(spark.createDataFrame([], "id long"), rule, at)["ROWS"] == 0


def test_events_of_other_kinds_are_not_opened(spark, tmp_path):
    at = str(tmp_path / "events")
    files.write_events(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, kind string"), "kind", at)
    got = files.read_events(spark, at, ["a"], "kind", "id long")
    assert sorted(r["id"] for r in got.collect()) == [1, 3]
    assert "PartitionFilters: [isnotnull(kind" in got._jdf.queryExecution().toString() or "PartitionFilters: [kind" in got._jdf.queryExecution().toString()


def test_lexicon_lines_keep_their_order_over_splits(spark, tmp_path):
    r = random.Random(9)
    lines = [[f"w{f}x{k} s{r.random()}" for k in range(2000)] for f in range(3)]
    for f, of in enumerate(lines):
        (tmp_path / f"{f}.txt").write_text("\n".join(of) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_lexicon(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert [f"{x['word']} {x['sampa']}" for x in got.orderBy("ord").collect()] == [x for of in lines for x in of]
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def test_times_of_a_day(spark):
    late = datetime(2024, 1, 5, 23, 59, 59)
    df = spark.createDataFrame([(1, late, True)], "u int, ts timestamp, known boolean")
    assert list(json.loads(recorded.record_answers(spark.createDataFrame([], STATS), df, ["u"], "ts", "known").first()["stats_days"])) == ["2024-01-05"]


def test_best_match_of_crowded_keys_equals_pairs(spark):
    r = random.Random(4)
    row = lambda k: (k, r.choice(["a", "a", "a", "b", "c", None, ""]), r.choice([1, 2, 3, None]), r.choice([1, 2, 3]), r.choice(["", "x", "y", None]))
    wanted, pool = [row(k) for k in range(60)], [row(k) for k in range(150)]
    scores = [("chapter", 10, False), ("page", 10, False), ("forms", 5, True)]
    want = {}
    for k, head, *own in wanted:
        points = [(sum(p for (_, p, filled), x, y in zip(scores, own, theirs) if x is not None and x == y and (x != "" or not filled)), i) for i, h, *theirs in pool if h is not None and h == head]
        best = max((p for p, _ in points), default=None)
        ids = [i for p, i in points if p == best]
        want[k] = (ids[0] if len(ids) == 1 else None, best, "NONE" if not ids else "OK" if len(ids) == 1 else "AMBIGUOUS")
    w = spark.createDataFrame(wanted, "review int, head string, chapter int, page int, forms string")
    p = spark.createDataFrame(pool, "id int, head string, chapter int, page int, forms string")
    for crowd in (0, 20, 10_000):
        assert {x["review"]: (x["id"], x["score"], x["status"]) for x in rules.best_match(w, p, "head", scores, crowd=crowd).collect()} == want
    assert rules.best_match(w, p.limit(0), "head", scores).where("status = 'NONE'").count() == 60


def test_best_match_broadcasts_no_rows(spark, tmp_path):
    """Files of repeated values look small, but neither the candidates nor their subsets go through the driver; only the list of crowded keys may."""
    rows = spark.range(4000).selectExpr("id", "IF(id % 10 < 9, 'a', CAST(id AS STRING)) AS head", "id % 3 AS chapter", "id % 5 AS page", "'x' AS forms")
    rows.coalesce(1).write.parquet(str(tmp_path / "cards"))
    cards = spark.read.parquet(str(tmp_path / "cards"))
    scores = [("chapter", 10, False), ("page", 10, False), ("forms", 5, True)]
    for crowd in (10, 10_000):
        out = rules.best_match(cards.withColumnRenamed("id", "review"), cards, "head", scores, crowd=crowd)
        joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
        assert joins and all("SortMergeJoin" in x or "LeftAnti" in x or "LeftSemi" in x for x in joins)
        assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"AMBIGUOUS": 3600, "OK": 400}


def test_lexicon_summary_of_nothing(spark):
    words, known = spark.createDataFrame([], "id int, text string"), spark.createDataFrame([], "word string, pronunciations array<string>")
    assert {r["value"] for r in lexicon.audit_summary(words, known, "id", "text").collect()} == {0.0}


def test_report_sections(spark):
    rows = spark.createDataFrame([(k, f"card {k}") for k in range(5)], "id int, value string")
    got = files.report_sections(spark, [("ALL", rows, ["id"], None), ("FEW", rows, ["id"], 2), ("NONE", rows.limit(0), ["id"], 2)]).orderBy("section", "line").collect()
    rule = "-" * 78
    assert [r["value"] for r in got] == ["ALL", rule, *(f"card {k}" for k in range(5)), "FEW", rule, "card 0", "card 1", "... and 3 more", "NONE", rule]
