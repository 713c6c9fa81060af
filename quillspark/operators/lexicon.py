"""Matching words with a pronunciation lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import phonetics as P
from quillspark.functions import text as T


def pronunciations(lexicon: DataFrame) -> DataFrame:
    """lexicon (word, ord, sampa) -> (word, pronunciations): distinct, in the order they stand."""
    first = lexicon.groupBy("word", "sampa").agg(F.min("ord").alias("ord"))
    return first.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sampa"))), lambda x: x["sampa"]).alias("pronunciations"))


def classify(words: DataFrame, lexicon: DataFrame, key: str = "normalized") -> DataFrame:
    """One-word entries against pronunciations(): MISSING, SAFE (one IPA, nothing unknown, selected) or REVIEW."""
    out = words.join(lexicon, F.col(key) == F.col("word"), "left").withColumn("_d", P.distinct_ipa("pronunciations"))
    ipa, unknown = F.col("_d.distinct_ipa"), F.col("_d.unknown")
    status = F.when(F.col("pronunciations").isNull(), "MISSING").when((F.size(ipa) == 1) & (F.size(unknown) == 0), "SAFE").otherwise("REVIEW")
    return out.withColumns({"status": status, "distinct_ipa": ipa, "unknown": unknown}).withColumn("selected_ipa", F.when(F.col("status") == "SAFE", F.get("distinct_ipa", F.lit(0)))).drop("_d", "word")


def components(words: DataFrame, lexicon: DataFrame, id_col: str, key: str = "normalized") -> DataFrame:
    """Multi-word entries against pronunciations(): parts found, all found, each part's pronunciations and IPA, and those of the whole entry, which tell but never decide."""
    known = lexicon.select(F.col("word").alias("part"), "pronunciations")
    parts = words.select(id_col, key, F.posexplode(T.tokens(F.col(key))).alias("position", "part")).join(known, "part", "left").withColumn("_d", P.distinct_ipa("pronunciations"))
    nothing = F.array().cast("array<string>")
    item = F.struct("position", F.col("part").alias("word"), F.col("pronunciations").isNotNull().alias("found"), F.coalesce("pronunciations", nothing).alias("pronunciations"), F.coalesce("_d.distinct_ipa", nothing).alias("distinct_ipa"))
    met = parts.groupBy(id_col, key).agg(F.count("*").alias("n_parts"), F.count("pronunciations").alias("n_found"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("position")).alias("components"))
    whole = lexicon.select(F.col("word").alias(key), F.struct("pronunciations", P.distinct_ipa("pronunciations")["distinct_ipa"].alias("distinct_ipa")).alias("direct"))
    return met.join(whole, key, "left").select(id_col, "n_parts", "n_found", "components", (F.col("n_parts") == F.col("n_found")).alias("all_found"), F.col("direct").isNotNull().alias("direct_match"), "direct")


def _routed(words: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, route, removed, unknown, all_found, direct_match) of every entry."""
    rows = words.select(F.col(id_col), T.lexicon_key(F.col(text_col)).alias("k")).select(id_col, "k.*").withColumn("n_words", T.word_count(F.col("normalized")))
    single = classify(rows.where("n_words = 1"), lexicon).select(id_col, F.col("status").alias("route"), "removed", F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))
    pairs = rows.where("n_words = 2")
    two = components(pairs, lexicon, id_col).join(pairs.select(id_col, "removed"), id_col).select(id_col, F.lit("REVIEW_TWO_WORD").alias("route"), "removed", "all_found", "direct_match")
    rest = rows.where("n_words NOT IN (1, 2)").select(id_col, F.when(F.col("n_words") == 0, "EMPTY").otherwise("TOO_LONG").alias("route"), "removed")
    return single.unionByName(two, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def audit(words: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, route): EMPTY, TOO_LONG, REVIEW_TWO_WORD, or the class of a single word."""
    return _routed(words, lexicon, id_col, text_col).select(id_col, "route")


def audit_summary(words: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(metric, value): how the entries fare against the lexicon, in 22 counts and shares."""
    r, cleaned = F.col("route"), F.col("removed")
    one, found = r.isin("SAFE", "REVIEW", "MISSING"), r.isin("SAFE", "REVIEW")
    two, skipped = r == "REVIEW_TWO_WORD", r.isin("EMPTY", "TOO_LONG")
    metrics = {
        "total": F.count("*"),
        "eligible": F.count_if(~skipped),
        "classified": F.count_if(one | two),
        "skipped": F.count_if(skipped),
        "safe": F.count_if(r == "SAFE"),
        "review": F.count_if(r == "REVIEW"),
        "review_two_word": F.count_if(two),
        "missing": F.count_if(r == "MISSING"),
        "safe_percent_of_eligible": F.round(F.coalesce(F.try_divide(F.count_if(r == "SAFE") * 100, F.count_if(~skipped)), F.lit(0.0)), 2),
        "one_word_total": F.count_if(one),
        "one_word_found": F.count_if(found),
        "one_word_missing": F.count_if(r == "MISSING"),
        "two_word_total": F.count_if(two),
        "two_word_all_components_found": F.count_if(two & F.col("all_found")),
        "two_word_direct_matches": F.count_if(two & F.col("direct_match")),
        "inflections_removed": F.count_if(cleaned),
        "cleaned_now_safe": F.count_if(cleaned & (r == "SAFE")),
        "cleaned_now_review": F.count_if(cleaned & (r == "REVIEW")),
        "cleaned_still_missing": F.count_if(cleaned & (r == "MISSING")),
        "cleaned_still_two_word": F.count_if(cleaned & two),
        "unknown_symbol_occurrences": F.coalesce(F.sum(F.size("unknown")), F.lit(0)),
    }
    # every entry once without a symbol and once for each of its unknown ones: a group of counts and a group a symbol, in one pass
    rows = _routed(words, lexicon, id_col, text_col).withColumn("_u", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("unknown", F.array().cast("array<string>")))))
    groups = rows.groupBy("_u").agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    counts = groups.agg(*[F.coalesce(F.max(F.when(F.col("_u").isNull(), F.col(n))), F.lit(0.0)).alias(n) for n in metrics], F.count("_u").cast("double").alias("unique_unknown_symbols"))
    return counts.unpivot([], [*metrics, "unique_unknown_symbols"], "metric", "value")


def unknown_symbols(classified: DataFrame) -> DataFrame:
    """How often each unknown token stands in the entries."""
    return classified.select(F.explode("unknown").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def coverage(words: DataFrame, lexicon: DataFrame, id_col: str, key: str = "normalized") -> DataFrame:
    """(id, match): DIRECT, COMPOSED (every part found) or MISSING."""
    met = components(words, lexicon, id_col, key)
    return met.select(id_col, F.when(F.col("direct_match"), "DIRECT").when(F.col("all_found"), "COMPOSED").otherwise("MISSING").alias("match"))


def coverage_summary(words: DataFrame, lexicon: DataFrame, id_col: str, key: str = "normalized") -> DataFrame:
    """(match, n, percent) of coverage(), percent of all entries rounded to two places."""
    counts = coverage(words, lexicon, id_col, key).groupBy("match").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("match", "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("percent"))  # three rows beside one


def coverage_by_length(words: DataFrame, lexicon: DataFrame, id_col: str, key: str = "normalized", n_words: str = "n_words") -> DataFrame:
    """(n_words, n_total, n_direct, n_composed, n_missing) of coverage(), for each number of words."""
    rows = coverage(words, lexicon, id_col, key).join(words.select(id_col, n_words), id_col)
    of = lambda m: F.count_if(F.col("match") == m)
    return rows.groupBy(n_words).agg(F.count("*").alias("n_total"), of("DIRECT").alias("n_direct"), of("COMPOSED").alias("n_composed"), of("MISSING").alias("n_missing"))


def first_missing(words: DataFrame, lexicon: DataFrame, id_col: str, size: int = 50, key: str = "normalized") -> DataFrame:
    """(id, key) of the first entries, by id, that coverage() finds nothing for: a sample for a report."""
    missing = coverage(words, lexicon, id_col, key).where("match = 'MISSING'").orderBy(id_col).limit(size)
    return words.select(id_col, key).join(F.broadcast(missing.select(id_col)), id_col)


def probe(lexicon: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(word, found, pronunciations) of a few words that a lexicon should have."""
    asked = lexicon.sparkSession.createDataFrame([(w,) for w in words], "asked string").withColumn("key", T.plain_key(F.col("asked")))
    return asked.join(lexicon, F.col("key") == F.col("word"), "left").select(F.col("asked").alias("word"), F.col("pronunciations").isNotNull().alias("found"), "pronunciations")
