"""Operators on invented rows, and their equivalence to plain loops."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import phonetics as P
from quillspark.functions import text as T
from quillspark.operators import dedup, layout, quality, review, rules, sequence
from quillspark.plans import sequence_queries
from quillspark.sources import files
from quillspark.streaming import daily


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def test_text_normalisation(spark):
    assert one(spark, "\u00a0a b – c\u200b\ufeff\t", T.normalize_basic) == "a b - c"
    assert one(spark, None, T.normalize_basic) == ""
    assert one(spark, "-en ,- ar,x", T.normalize_forms) == "-en, -ar, x"
    assert one(spark, "ord  bok\u00aden", T.clean_output) == "ord boken"
    assert one(spark, "ord\u2002bok", T.clean_output) == "ordbok"
    assert one(spark, " Straße  X ", T.match_key) == "strasse x"
    assert one(spark, "å", T.nfc) == "å"
    assert one(spark, "tysk(-t, -a)", T.lexicon_key)["normalized"] == "tysk"
    assert one(spark, "foo (obs)!", T.lexicon_key)["normalized"] == "foo (obs"
    assert one(spark, "a\x1cb  c", T.word_count) == 3


def test_entry_rules(spark):
    assert one(spark, "Kapitel 12", lambda c: C.marker(c, "Kapitel")) == 12
    assert one(spark, "xKapitel 12", lambda c: C.marker(c, "Kapitel")) is None
    assert one(spark, "åKapitel 12", lambda c: C.marker(c, "Kapitel")) is None
    for text, noise in (("", True), ("123", True), ("1234", False), ("( Svenska )", True), ("© x", True), ("ord", False)):
        assert one(spark, text, C.is_noise) is noise
    assert one(spark, "ta (-r, tog) tid", C.extract_morphology) == Row(text="ta tid", forms="-r, tog")
    assert one(spark, "ta (x) (-r) tid", C.extract_morphology) == Row(text="ta (x) tid", forms="-r")
    assert one(spark, "ta (-r, tog) en dusch", C.split_by_morphology) == Row(head="ta en", forms="-r, tog", translation="dusch")
    assert one(spark, "ringa (-r) in", C.split_by_morphology) == Row(head="ringa", forms="-r", translation="in")
    parsed = one(spark, "bild (-en)\u2002 picture of", C.parse_row)
    assert (parsed["head"], parsed["forms"], parsed["translation"], parsed["method"]) == ("bild", "-en", "picture of", "UNICODE_SEPARATOR")
    assert one(spark, "inget", C.parse_row) is None
    assert one(spark, "mother in ", C.goes_on_strict) is True
    assert one(spark, "a (b", C.is_broken) is True
    assert one(spark, "dele\u00ad", lambda c: C.join_continuation(c, F.lit(" del x"))) == "deledel x"


def test_phonetics(spark):
    got = one(spark, '"b o: $t Q', P.to_ipa)
    assert (got["ipa"], got["unknown"]) == ("ˈboːt[Q]", ["Q"])
    assert one(spark, None, P.to_ipa)["ipa"] == ""
    assert len(P.SAMPA) == 49


def cards(spark):
    rows = [("riv_b_0001", "Båt", "-en", "boat", 1, 3), ("riv_b_0009", "båt", "-en, -ar, -arna", "Boat", 4, 40), ("riv_b_manual_0001", "båt", "", "boat", 2, None), ("riv_b_0020", "ton", "-en", "tone", 2, 12), ("riv_b_0021", "ton", "-net", "ton (unit)", 6, 60), ("riv_b_0030", "", "", "x", 1, 1), ("riv_b_0031", "", "", "x", 1, 1)]
    df = spark.createDataFrame(rows, "id string, head string, forms string, translation string, chapter int, page int").withColumn("source_pdf_page", F.lit(1))
    return dedup.keyed(df, {"h": "head", "t": "translation"})


def test_merge_groups(spark):
    out = {r["id"]: r for r in dedup.merge_groups(cards(spark), ["h", "t"], C.sort_key(F.col("id"))).collect()}
    assert set(out) == {"riv_b_0001", "riv_b_0020", "riv_b_0021", "riv_b_0030", "riv_b_0031"}
    kept = out["riv_b_0001"]
    assert kept["forms"] == "-en, -ar, -arna" and kept["chapters"] == [1, 2, 4]
    assert kept["deduplicated_from"] == ["riv_b_0009", "riv_b_manual_0001"]
    assert [o["original_id"] for o in kept["occurrences"]] == ["riv_b_0001", "riv_b_manual_0001", "riv_b_0009"]
    again = dedup.merge_groups(dedup.keyed(spark.createDataFrame([(r["id"], r["head"], r["forms"], r["translation"], r["chapter"], r["page"], 1) for r in out.values()], "id string, head string, forms string, translation string, chapter int, page int, source_pdf_page int"), {"h": "head", "t": "translation"}), ["h", "t"], C.sort_key(F.col("id")))
    assert again.count() == len(out)
    lineage = {x for r in out.values() for x in r["deduplicated_from"]} | set(out)
    assert lineage == {r["id"] for r in cards(spark).collect()}
    assert dedup.merge_groups(cards(spark).limit(0), ["h", "t"], C.sort_key(F.col("id"))).count() == 0


def test_rules(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, head string, translation string")
    fixed = rules.apply_corrections(base, spark.createDataFrame([(2, "B", None)], "id long, head string, translation string"))
    assert {tuple(r) for r in fixed.collect()} == {(1, "a", "x", False), (2, "B", "y", True), (3, "c", "z", False)}
    assert rules.missing_targets(base, spark.createDataFrame([(9,)], "id long")).count() == 1
    wanted = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "q", 1)], "review long, head string, page int")
    pool = spark.createDataFrame([(10, "a", 1), (11, "a", 2), (12, "b", 5), (13, "b", 5)], "id long, head string, page int")
    got = {r["review"]: (r["id"], r["status"]) for r in rules.best_match(wanted, pool, "head", [("page", 10, False)]).collect()}
    assert got == {1: (10, "OK"), 2: (None, "AMBIGUOUS"), 3: (None, "NONE")}
    problems = rules.fix_completeness(spark.createDataFrame([(1, "SKIP"), (1, "SKIP"), (3, "X")], "review long, action string"), 3)
    assert {tuple(r) for r in problems.collect()} == {(2, "MISSING"), (1, "REPEATED"), (3, "BAD_ACTION")}
    with pytest.raises(ValueError):
        quality.gate(base, problems)


@pytest.mark.parametrize(("parts", "reuse"), [(4, "true"), (8, "false"), (200, "false")])
def test_numbered_is_a_total_order(spark, parts, reuse):
    """More rows than the ranges' sample holds, further columns, and no reuse of exchanges."""
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.exchange.reuse": reuse, "spark.sql.execution.rangeExchange.sampleSizePerPartition": "20"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(50_000).withColumns({"k": F.pmod(F.xxhash64("id"), F.lit(97)), "text": F.repeat(F.col("id").cast("string"), 3), "odd": F.col("id") % 3 == 1})
        rows = rules.numbered(df, ["k", "id"]).collect()
        odd = rules.numbered(df, [F.desc("k"), "id"], only=F.col("odd")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted(rows, key=lambda r: r["number"])
    assert [r["number"] for r in got] == list(range(1, 50_001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)
    assert all(r["text"] == str(r["id"]) * 3 for r in got)
    numbered = sorted((r for r in odd if r["number"] is not None), key=lambda r: r["number"])
    assert [r["number"] for r in numbered] == list(range(1, len(numbered) + 1)) and len(odd) == 50_000
    assert [r["id"] for r in numbered] == [r["id"] for r in sorted((r for r in got if r["odd"]), key=lambda r: (-r["k"], r["id"]))]


def test_numbered_of_nothing(spark):
    assert rules.numbered(spark.range(0), ["id"]).collect() == []


def test_fixes_in_order_equal_the_loop(spark):
    """Few headwords, so that fixes depend on each other; manual ids in use; ties; keys that no card has."""
    rng = random.Random(12)
    heads = list("abcdefgh")
    cards = {f"m_{k:04d}" if k % 9 == 1 else f"p{k}": [rng.choice(heads), f"t{k}", rng.randrange(50), "PARSED"] for k in range(40)}
    fixes, wanted = [], []
    for r in range(1, 23):
        action = rng.choice(["UPDATE_PREVIOUS"] * 3 + ["ADD_CARD", "SKIP"])
        head = rng.choice([None, *heads, "g"]) if action != "ADD_CARD" else rng.choice(heads)
        fixes.append((r, action, head, rng.choice([None, f"n{r}"])))
        meant = rng.choice(list(cards.values()))
        wanted.append((r, *rng.choice([(meant[0], meant[2]), (meant[0], meant[2]), (rng.choice([*heads, "none", None]), 1)])))
    now, log, number = {k: list(v) for k, v in cards.items()}, {}, 1
    for (r, action, head, translation), (_, seen, page) in zip(fixes, wanted):
        if action == "ADD_CARD":
            while f"m_{number:04d}" in now:
                number += 1
            now[f"m_{number:04d}"] = [head, translation, None, "MANUAL"]
            log[r] = (f"m_{number:04d}", None, None, head)
        elif action == "SKIP":
            log[r] = (None, None, None, None)
        else:
            scored = [(10 * (c[2] is not None and c[2] == page), k) for k, c in now.items() if c[0] == seen]
            best = [k for x, k in scored if x == max(scored)[0]]
            status = "NONE" if not best else "OK" if len(best) == 1 else "AMBIGUOUS"
            log[r] = (None, status, None, None)
            if status == "OK":
                card = now[best[0]]
                before = card[0]
                now[best[0]] = [head if head is not None else card[0], translation if translation is not None else card[1], card[2], "FIXED"]
                log[r] = (best[0], status, before, now[best[0]][0])
    df = spark.createDataFrame([(k, *v[:3]) for k, v in cards.items()], "id string, head string, translation string, page int")
    out, told = rules.fixes_in_order(df, spark.createDataFrame(wanted, "review long, head string, page int"), spark.createDataFrame(fixes, "review long, action string, head string, translation string"), ["head", "translation"], "head", [("page", 10, False)], prefix="m_")
    assert {r["id"]: [r["head"], r["translation"], r["page"], r["origin"]] for r in out.collect()} == now
    assert {r["review"]: (r["id"], r["status"], r["before_head"], r["after_head"]) for r in told.collect()} == log
    assert sum(x[1] == "OK" for x in log.values()) > 3


def test_nfc_in_bounded_batches(spark):
    """Texts go to Python in batches of bounded rows and bytes, whatever the session had, and are composed as before."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.unset(keys[1])
        rows = spark.range(30).select(F.when(F.col("id") > 0, F.repeat(F.lit("e\u0301 "), 100_000)).alias("t")).coalesce(1)
        got = rows.select(T.nfc(F.col("t")).alias("n")).groupBy("n").count().collect()
        assert {r["n"]: r["count"] for r in got} == {None: 1, "\u00e9 " * 100_000: 29}
        assert (int(spark.conf.get(keys[0])), int(spark.conf.get(keys[1]).rstrip("bB"))) == (T.ARROW_ROWS, T.ARROW_BYTES)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fixes_of_one_headword_take_few_rounds(spark, monkeypatch):
    """Fixes that share a headword but no card don't wait for each other; a fix that sees what another left does."""
    cards = spark.createDataFrame([(f"p{k}", "a", f"t{k}", k) for k in range(40)], "id string, head string, translation string, page int")
    wanted = spark.createDataFrame([(r, "a", r) for r in range(40)] + [(40, "b", 7)], "review long, head string, page int")
    fixes = spark.createDataFrame([(r, "UPDATE_PREVIOUS", "b" if r == 7 else None, f"n{r}") for r in range(41)], "review long, action string, head string, translation string")
    stored, kept = [], rules.files.stored
    monkeypatch.setattr(rules.files, "stored", lambda df, name="table": stored.append(name) or kept(df, name))
    out, log = rules.fixes_in_order(cards, wanted, fixes, ["head", "translation"], "head", [("page", 10, False)])
    assert len(stored) < 20
    assert {r["id"]: (r["head"], r["translation"]) for r in out.collect()} == {f"p{k}": ("b", "n40") if k == 7 else ("a", f"n{k}") for k in range(40)}
    assert {r["review"]: (r["id"], r["before_translation"]) for r in log.collect()} == {r: (f"p{r}", f"t{r}") if r < 40 else ("p7", "n7") for r in range(41)}


def test_pages_calibrate_themselves(spark):
    """Three parted rows tell where translations begin; the fold joins what goes on, over a column's end, and leaves the rest."""
    line = lambda at, side, y, x, raw: ("d", at, 1, side, float(y), [(float(x + 50 * k), w) for k, w in enumerate(raw.split(" "))], raw)
    rows = [
        line(1, "left", 600, 40, "katt\u2002 cat"),
        line(2, "left", 615, 40, "hund\u2002 dog"),
        line(3, "left", 630, 40, "Kapitel 4"),
        line(4, "left", 645, 40, "häst horse and,"),
        line(5, "left", 660, 90, "mare or,"),
        line(6, "left", 675, 91, "foal"),
        line(7, "left", 690, 90, "alone here"),
        line(8, "left", 705, 40, "bo (-r, -dde) live of the"),
        line(9, "left", 720, 40, "fisk\u2002 fish,"),
        line(10, "right", 40, 360, "carp"),
        line(11, "right", 55, 310, "far gone"),
    ]
    df = spark.createDataFrame(rows, "doc string, at long, page int, side string, y double, words array<struct<x0: double, text: string>>, raw string")
    got = {r["at"]: r for r in layout.parse_pages(df, "doc", "at").collect()}
    assert [got[k]["kind"] for k in range(1, 12)] == ["CARD", "CARD", "MARKER", "CARD", "JOINED", "JOINED", "REJECT", "CARD", "CARD", "REJECT", "REJECT"]
    assert got[4]["boundary"] == 90.0 and got[10]["boundary"] is None
    assert (got[4]["parsed"]["head"], got[4]["parsed"]["translation"], got[4]["parsed"]["method"]) == ("häst", "horse and, mare or, foal", "LAYOUT_FALLBACK")
    assert [got[k]["card"] for k in (4, 5, 6, 7)] == [4, 4, 4, None]
    short = {r["at"]: r["kind"] for r in layout.parse_pages(df, "doc", "at", short=1).collect()}
    assert short[5] == "REJECT" and short[6] == "REJECT"
    assert layout.parse_pages(df.limit(0), "doc", "at").collect() == []


def test_values_are_carried_over_ranges(spark):
    """A value goes on over ranges that hold none, and ends with its document."""
    rng = random.Random(3)
    rows = [(d, k, k if rng.random() < share else None) for d, n, share in ((1, 400, 0.01), (None, 30, 0.2), (2, 300, 0.0), (3, 5, 0.5), (4, 200, 0.5)) for k in range(n)]
    want, last = {}, {}
    for d, k, v in rows:
        last[d] = v if v is not None else last.get(d)
        want[d, k] = last[d]
    df = spark.createDataFrame(rows, "d long, k long, v long").repartition(3)
    got = sequence.carry_over_ranges(df, ["d"], ["k"], "c", F.col("v"))
    assert got.columns == ["d", "k", "v", "c"]
    assert {(r["d"], r["k"]): r["c"] for r in got.collect()} == want


def test_one_document_of_many_cards(spark):
    """Cards of one document and page column are folded one by one, and go on over the ranges that rows are dealt by."""
    line = lambda at, y, x, raw: ("d", at, 1, "left", float(y), [(float(x + 50 * k), w) for k, w in enumerate(raw.split(" "))], raw)
    rows = [r for k in range(120) for r in (line(3 * k, 600, 40, f"katt\u2002 cat{k},"), line(3 * k + 1, 615, 90, f"kitten{k},"), line(3 * k + 2, 630, 90, f"tom{k}"))]
    df = spark.createDataFrame(rows, "doc string, at long, page int, side string, y double, words array<struct<x0: double, text: string>>, raw string")
    out = layout.parse_pages(df, "doc", "at")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [len(keys.split(",")) for keys in re.findall(r"Aggregate \[([^\]]*)\], .*collect_list", plan)] == [2]
    assert not re.search(r"percentile|median", plan)
    got = {r["at"]: (r["kind"], r["card"], r["parsed"] and r["parsed"]["translation"]) for r in out.collect()}
    want = {3 * k + j: (("JOINED", 3 * k, None) if j else ("CARD", 3 * k, f"cat{k}, kitten{k}, tom{k}")) for k in range(120) for j in range(3)}
    assert got == want


def test_continued_ladder_equals_the_loop(spark):
    """Logs cut at random places, composed in two ways, from any level."""
    rng = random.Random(9)
    stored = [(u, rng.choice([None, -1, 0, 1, 2, 3, 5, 6, 9]), dt.date(2023, 5, 1 + u % 20)) for u in range(90) if u % 7]
    log = [(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i + rng.randint(0, 6)), rng.random() < 0.7) for u in range(120) if u % 5 for i in range(rng.randint(1, 14))]
    cuts = {u: sorted(rng.sample(range(1, 14), 4)) for u in range(120)}
    df = spark.createDataFrame([(*x, sum(x[1] >= c for c in cuts[x[0]])) for x in log], "u long, i long, ts timestamp, known boolean, part int")
    want = {u: (level, at) for u, level, at in stored}
    for u, _, ts, known in sorted(log, key=lambda x: (x[0], x[2], x[1])):
        level = min(want.get(u, (0, None))[0] or 0, 6)
        level = (2 if level <= 1 else min(level + 1, 6)) if known else 1
        want[u] = (level, ts.date() + dt.timedelta(days=review.INTERVALS[level]) if known else None)
    progress = spark.createDataFrame(stored, "u long, level int, next_review date")
    whole = review.answer_maps(df, ["u"], "ts", "i", "known")
    parted = review.answer_maps(df, ["u"], "ts", "i", "known", [F.col("part")])
    halves = review.composed_maps(parted.where("_first.tie < 5"), ["u"]).unionByName(review.composed_maps(parted.where("_first.tie >= 5"), ["u"]))
    for maps in (whole, review.composed_maps(parted, ["u"]), review.composed_maps(halves, ["u"])):
        assert {r["u"]: (r["level"], r["next_review"]) for r in review.continued(progress, maps, ["u"]).collect()} == want


def test_ladder_equals_fold(spark):
    rng = random.Random(5)
    logs = [(u, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 30) + 40 * i), rng.random() < 0.7) for u in range(120) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(logs, "u long, i long, ts timestamp, known boolean")
    got = {r["u"]: (r["level"], r["next_review"]) for r in review.ladder(df, ["u"], "ts", "i", "known").collect()}
    for u in range(120):
        level, at = 0, None
        for _, _, ts, known in sorted((x for x in logs if x[0] == u), key=lambda x: (x[2], x[1])):
            level = (2 if level <= 1 else min(level + 1, 6)) if known else 1
            at = ts.date() + dt.timedelta(days=review.INTERVALS[level]) if level > 1 else None
        assert got[u] == (level, at)


def test_session_quota_equals_loop(spark):
    for size, new, rev in ((5, 9, 9), (10, 3, 20), (10, 30, 1), (20, 0, 5), (1, 2, 2), (10, 2, 3)):
        words = [(1, k, 0, None) for k in range(new)] + [(1, 100 + k, 1, None) for k in range(rev)]
        df = spark.createDataFrame(words, "u long, w long, level int, next date")
        got = review.session(df, "u", "w", "level", "next", F.lit("2024-01-30").cast("date"), size, "s").collect()
        quota = -(-size // 5)
        take_rev, take_new = min(rev, quota), min(new, size - quota)
        left = size - take_rev - take_new
        more_new = min(left, new - take_new)
        take_new, take_rev = take_new + more_new, take_rev + min(left - more_new, rev - take_rev)
        assert sum(r["w"] < 100 for r in got) == take_new and sum(r["w"] >= 100 for r in got) == take_rev


def test_greedy_pairs_equal_loop(spark):
    rng = random.Random(9)
    rows = [(d, k, rng.random() < 0.6) for d in range(60) for k in range(rng.randint(1, 15))]
    out = sequence.pair_greedily(spark.createDataFrame(rows, "d long, k long, s boolean"), ["d"], ["k"], F.col("s")).collect()
    got = {(r["d"], r["k"]): r["pair"] for r in out}
    for d in range(60):
        mine, i = [r for r in rows if r[0] == d], 0
        while i < len(mine):
            width = 2 if mine[i][2] and i + 1 < len(mine) else 1
            for j in range(width):
                assert got[(d, mine[i + j][1])] == i + 1
            i += width


def test_progress(spark):
    raw = spark.createDataFrame([(1, '{"level":3,"nextReview":"2024-01-30T00:00:00.000"}', "known"), (2, "x", "learning"), (3, '{"level":0}', "known"), (4, None, "known"), (5, None, None)], "word_id long, s string, l string")
    p = review.decode_progress(F.col("s"), F.col("l"), F.lit("2024-01-30").cast("date"))
    got = {r["word_id"]: r["p"] and (r["p"]["level"], str(r["p"]["next_review"])) for r in raw.select("word_id", p.alias("p")).collect()}
    assert got == {1: (3, "2024-01-30"), 2: (1, "None"), 3: (0, "None"), 4: (2, "2024-01-31"), 5: None}
    moved = review.migrate_progress(raw.select("word_id", p["level"].alias("level"), p["next_review"].alias("next_review")), spark.createDataFrame([(1, 7), (4, 7), (3, 8)], "old_id long, new_id long"))
    assert [tuple(r) for r in moved.collect()] == [(7, 3, dt.date(2024, 1, 30))]


def test_visual_rows_follow_the_running_mean(spark):
    tokens = spark.createDataFrame([(1, 10.0, 10.0, "a"), (1, 30.0, 11.5, "b"), (1, 50.0, 12.6, "c"), (1, 290.0, 10.0, "gutter"), (1, 300.0, 10.0, "r")], "page int, x0 double, y0 double, text string")
    got = {(r["column"], r["row"]): r["raw"] for r in layout.visual_rows(tokens, ["page"]).collect()}
    assert got == {("left", 0): "a b", ("left", 1): "c", ("right", 0): "r"}
    assert layout.visual_rows(tokens.limit(0), ["page"]).count() == 0


def test_continuations_chain(spark):
    """Chains follow the joined text; geometry decides what is near."""
    rows = [(1, 1, "mother in", 10.0, "left", False), (1, 2, "law of", 20.0, "left", True), (1, 3, "mine", 30.0, "left", True), (1, 4, "x", 40.0, "left", True), (2, 1, None, 1.0, "left", True)]
    rows += [(3, 1, "one's", 690.0, "left", False), (3, 2, "mind", 20.0, "right", True), (3, 3, "far of", 30.0, "right", False), (3, 4, "too far", 90.0, "right", True)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "d long, k long, t string, y double, side string, f boolean, page int")
    got = {(r["d"], r["k"]): (r["t"], r["n_rows"]) for r in sequence.fold_continuations(df, "d", "k", "t", F.col("f")).collect()}
    assert got == {(1, 1): ("mother in law of mine", 3), (1, 4): ("x", 1), (2, 1): ("", 1), (3, 1): ("one's mind", 2), (3, 3): ("far of", 1), (3, 4): ("too far", 1)}
    assert sequence.fold_continuations(df.limit(0), "d", "k", "t", F.col("f")).count() == 0


def test_continuation_query_reads_whole_texts(spark, tmp_path):
    long = "a long sentence of many words " * 20 + "end"
    df = spark.createDataFrame([(1, 1, "user", long), (1, 3, "user", long)], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert all(long in r["text"] for r in sequence_queries.join_continuation(spark, str(tmp_path)).collect())


def test_repairs_join_two_rows(spark):
    rows = [(1, "hund (-en,", "left", 10.0), (2, "-ar) dog", "left", 20.0), (3, "katt (-en", "left", 30.0), (4, "right side", "right", 10.0), (5, "bil\u2002 car of the", "right", 20.0), (6, "family", "right", 30.0), (7, "sol\u00ad", "right", 40.0), (8, "sken", "right", 70.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "d int, k int, raw string, side string, y double")
    assert [r["raw"] for r in sequence.repair_broken_rows(df, ["d"], ["k"]).orderBy("k").collect()] == ["hund (-en, -ar) dog", "katt (-en", "right side", "bil\u2002 car of the", "family", "sol\u00ad", "sken"]
    assert [r["raw"] for r in sequence.prejoin_rows(df, ["d"], ["k"]).orderBy("k").collect()] == ["hund (-en,", "-ar) dog", "katt (-en", "right side", "bil\u2002 car of the family", "sol\u00ad", "sken"]


def test_store(spark):
    store = spark.createDataFrame([(1, "progress_a", "3"), (1, "theme", "light"), (2, "stats", "x")], "u int, key string, value string")
    new = spark.createDataFrame([(1, "theme", "dark"), (3, "onboarding", "1")], "u int, key string, value string")
    put = review.put(store, new, ["u", "key"])
    assert {tuple(r) for r in put.collect()} == {(1, "progress_a", "3"), (1, "theme", "dark"), (2, "stats", "x"), (3, "onboarding", "1")}
    assert {tuple(r) for r in review.get(put, ["u"], {"theme": ("theme", "string"), "stats": ("n", "int")}).collect()} == {(1, "dark", None), (2, None, None), (3, None, None)}
    assert {(r["u"], r["show_onboarding"]) for r in review.onboarding(put, ["u"], "onboarding").collect()} == {(1, False), (2, True), (3, False)}


def test_gap_split(spark):
    words = [{"x0": 0.0, "x1": 20.0, "text": "en"}, {"x0": 24.0, "x1": 40.0, "text": "bild"}, {"x0": 90.0, "x1": 120.0, "text": "picture"}]
    df = spark.createDataFrame([(words,), (words[:1],)], "w array<struct<x0: double, x1: double, text: string>>")
    assert [r["s"] and tuple(r["s"]) for r in df.select(layout.split_at_gap(F.col("w")).alias("s")).collect()] == [("en bild", "picture", 50.0), None]


def test_files(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("\ufeffbil\tb i: l\nx\n\nbil  b I l\n", encoding="utf-8")
    assert [(r["word"], r["sampa"]) for r in files.read_lexicon(spark, str(tmp_path / "lex.txt")).orderBy("ord").collect()] == [("bil", "b i: l"), ("bil", "b I l")]
    (tmp_path / "a.json").write_text('[{"id": "1", "swedish": "bil", "english": ["car"]}]')
    (tmp_path / "b.json").write_text('{"words": [{"id": "2"}]}')
    assert files.read_words(spark, str(tmp_path / "a.json")).first()["english"] == ["car"]
    assert files.read_words(spark, str(tmp_path / "b.json")).first()["id"] == "2"
    (tmp_path / "list.json").write_text('[{"id": "1", "swedish": "bil", "chapter": 3},\n {"id": "2"}]')
    assert [(r["id"], r["chapter"]) for r in files.read_list(spark, str(tmp_path / "list.json")).collect()] == [("1", 3), ("2", None)]
    assert [r["id"] for r in files.read_assets(spark, str(tmp_path / "list.json")).collect()] == ["1", "2"]
    for k, bad in enumerate(('{"id": "1"}', '[{"id": "1"}, 5]', '["x"]', "broken")):
        (tmp_path / f"bad{k}.json").write_text(bad)
        with pytest.raises(Exception, match="list of objects"):
            files.read_assets(spark, str(tmp_path / f"bad{k}.json")).collect()
    (tmp_path / "bytes.txt").write_bytes(b"caf\xff\tk a f\nonly\n")
    assert [(r["word"], r["sampa"]) for r in files.read_lexicon(spark, str(tmp_path / "bytes.txt")).collect()] == [("caf\ufffd", "k a f")]
    seen = {r["name"]: (r["present"], r["first"]) for r in files.presence(spark, {"lexicon": str(tmp_path / "lex.txt"), "none": str(tmp_path / "none")}).collect()}
    assert seen["none"] == (False, None) and seen["lexicon"][0] and seen["lexicon"][1].endswith("b i: l")
    (tmp_path / "c.json").write_text('"no"')
    with pytest.raises(Exception, match=re.escape("words must be a list")):
        files.read_words(spark, str(tmp_path / "c.json")).collect()
    good = spark.createDataFrame([(1,)], "id long")
    files.write_checked(good, good.limit(0), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    errors = spark.createDataFrame([(1, "EMPTY"), (2, "EMPTY")], "id long, rule string")
    with pytest.raises(ValueError, match="not written"):
        files.write_checked(good, errors, str(tmp_path / "shut"), str(tmp_path / "report"))
    assert not (tmp_path / "shut").exists()
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["EMPTY" + " " * 46 + "2"]
    files.write_lines(good, str(tmp_path / "plain"))
    assert files.read_lines(spark, str(tmp_path / "plain"), "id LONG").first()["id"] == 1


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    known = F.col("event_id") % 4 != 0
    q = daily.daily_stats(stream, "ts", known).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = review.daily_stats(events.withColumn("known", known), "ts", "known")
    assert {tuple(r) for r in spark.table("daily").collect()} == {tuple(r) for r in batch.select("day", "studied", "known", "learning").collect()}
