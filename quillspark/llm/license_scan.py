"""Licence scan: the places of licence phrases, and the text blocks that contain a licence notice, word for word or reworded.

Two parts, both of DataFrame functions alone:

* Phrases: places where the words of a phrase stand consecutively in a text.
* Notices: an exact set-similarity join of text blocks (lines) and templates on their distinct words. A block meets a template
  if it holds at least CONTAINED hundredths of the template's words. Words are put in one global order, the rarest over all
  blocks first. Of a template of n words of which a block must hold need, any such block holds one of the first n - need + 1
  (prefix filter); a block of fewer than need template words is out (length filter); and where the first common word stands
  at place i of the template and j of the block, no more than the shorter rest can follow (positional filter). What is
  left is counted exactly.

A block takes part with its words that stand in any template: no other can count. These short lists and the phrases' places
are found in one pass over the texts and stored, a row a document; the join reads that table alone. Templates are a parameter of
bounded size (at most MAX_TEMPLATES), so they are broadcast.

Defined cases: null and empty texts have no words, no places and no labels; rows of one id, or without an id, are scanned each
for itself; a phrase may overlap another or itself, each place counts; a block of any length is taken whole; an empty table
gives no rows; further columns take no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.letters import small_letters

#: What does not belong to a word: ASCII but letters and digits (of small letters); within a block all of it but line ends.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WITHIN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hundredths of a template's distinct words that a block must hold.
CONTAINED = 80
MAX_TEMPLATES = 1000
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and their labels: the usual short forms, and the sentences that licences ask to be repeated.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def words_of(text: str) -> list[str]:
    """The words of a phrase or template, by the rule for texts."""
    return re.sub(BETWEEN, " ", text.translate({k: k + 32 for k in range(65, 91)})).split(" ")


def spaced(text: Column) -> Column:
    """The words of a text, each between single blanks; one blank if there are none."""
    words = F.trim(F.regexp_replace(text, BETWEEN, " "))
    return F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number, first and last of a phrase's places in spaced() words, counted in words from 0; null places without any."""
    has = F.contains(words, F.lit(f" {phrase} "))
    first = F.position(F.lit(f" {phrase} "), words)
    from_end = F.position(F.lit(f" {phrase[::-1]} "), F.reverse(words))
    number = F.when(has, F.regexp_count(words, F.lit(f"(?<= )(?={phrase} )"))).otherwise(0).cast("long")  # no width, so places may overlap
    return number, F.when(has, _blanks(F.left(words, first - 1))), F.when(has, _blanks(F.left(words, F.length(words) - from_end - len(phrase) - 1)))


def _sorted(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _need(n: int, contained: int) -> int:
    return max(1, -(-contained * n // 100))


def surveyed(docs: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]], contained: int = CONTAINED) -> DataFrame:
    """One pass over the texts: doc_id, the numbers and places of phrases, their labels, and the blocks that hold enough template words."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)} - {""})
    least = min((_need(len(set(words_of(t)) - {""}), contained) for _, t in templates), default=1)
    text = docs.select("doc_id", F.regexp_replace(small_letters(F.coalesce("text", F.lit(""))), WITHIN, " ").alias("_text")).withColumn("_words", spaced(F.col("_text")))
    found = [(*_places(F.col("_words"), " ".join(words_of(p))), label) for p, label in phrases.items()]
    first, last = F.array_min(F.array(*(a for _, a, _, _ in found))), F.array_max(F.array(*(b for _, _, b, _ in found)))
    labels = F.array_compact(F.array(*(F.when(a.isNotNull(), label) for _, a, _, label in found)))
    known = F.transform(F.split("_text", "\n"), lambda line: F.array_distinct(F.filter(F.split(line, " "), lambda w: w.isin(vocabulary))))
    blocks = F.filter(F.transform(known, lambda ws, k: F.struct(k.alias("block"), ws.alias("words"))), lambda b: F.size(b["words"]) >= least)
    return text.select("doc_id", (_blanks(F.col("_words")) - 1).alias("n_words"), sum((n for n, *_ in found), F.lit(0)).cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("base"), blocks.alias("blocks"))


def contained_templates(blocks: DataFrame, templates: list[tuple[str, str]], contained: int = CONTAINED) -> DataFrame:
    """blocks (at, block, words: distinct template words) to (at, block, template, label, containment) of each template that a block holds enough of."""
    spark = blocks.sparkSession
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates are broadcast")
    named = [(k, label, w) for k, (label, t) in enumerate(templates) for w in sorted(set(words_of(t)) - {""})]
    members = spark.createDataFrame(named, "template int, label string, word string")
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("_n"))
    ordered = members.select("word").distinct().join(counts, "word", "left")  # at most the words of all templates
    ranks = ordered.select("word", F.row_number().over(Window.orderBy(F.coalesce("_n", F.lit(0)), "word")).alias("rank"))
    ranks = scratch.saved(ranks, "word-ranks")
    size = F.size("_ranks")
    sides = members.join(ranks, "word").groupBy("template", "label").agg(F.array_sort(F.collect_list("rank")).alias("_ranks")).select("template", "label", F.col("_ranks").alias("_all"), size.alias("_size"), F.greatest(F.ceil(size * contained / 100), F.lit(1)).alias("_need"))
    prefixes = sides.select("*", F.posexplode(F.slice("_all", F.lit(1), (F.col("_size") - F.col("_need") + 1).cast("int"))).alias("_i", "rank"))
    own = blocks.select("at", "block", F.explode("words").alias("word")).join(F.broadcast(ranks), "word").groupBy("at", "block").agg(F.array_sort(F.collect_list("rank")).alias("_ranks"))
    met = own.select("at", "block", "_ranks", F.posexplode("_ranks").alias("_j", "rank")).join(F.broadcast(prefixes), "rank")
    met = met.where(size >= F.col("_need")).where(F.least(F.col("_size") - F.col("_i"), size - F.col("_j")) >= F.col("_need"))
    pairs = met.dropDuplicates(["at", "block", "template"])
    overlap = F.size(F.array_intersect("_ranks", "_all"))
    return pairs.where(overlap >= F.col("_need")).select("at", "block", "template", "label", (overlap / F.col("_size")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, contained: int = CONTAINED) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): score is the largest containment found, a phrase being one wholly contained."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    rows = scratch.saved(surveyed(docs, phrases, templates, contained).withColumn("at", F.monotonically_increasing_id()), "surveyed")
    blocks = rows.select("at", F.explode("blocks").alias("b")).select("at", "b.block", "b.words")
    hits = contained_templates(blocks, templates, contained).groupBy("at").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    out = rows.drop("blocks").join(hits, "at", "left")
    labels = F.concat("base", F.coalesce("_labels", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", _sorted(F.col("base")).alias("base_labels"), _sorted(labels).alias("labels"), score.alias("score"))


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LIST = r"[w FOR w IN regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> '']"
#: Every line is held against every template.
ORACLE_SQL = f"""
WITH phrases AS (SELECT * FROM (VALUES {", ".join(f"({_QUOTED(' '.join(words_of(p)))}, {_QUOTED(x)})" for p, x in PHRASES.items())}) AS v(phrase, label)),
templates AS (SELECT k, label, list_distinct({_LIST.format("t")}) AS ws FROM (SELECT k, label, {_SMALL.replace("coalesce(text, '')", "t")} AS t FROM (VALUES {", ".join(f"({k}, {_QUOTED(x)}, {_QUOTED(t)})" for k, (x, t) in enumerate(TEMPLATES))}) AS v(k, label, t))),
d AS (SELECT doc_id, row_number() OVER () AS r, {_SMALL} AS t FROM documents),
w AS (SELECT doc_id, r, {_LIST.format("t")} AS ws FROM d),
p AS (SELECT r, label, [i FOR i IN range(1, len(ws) + 1) IF array_to_string(ws[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase] AS places FROM w, phrases),
b AS (SELECT r, sum(len(places)) AS n_base, min(places[1]) - 1 AS first_word, max(places[-1]) - 1 AS last_word, coalesce(list(DISTINCT label) FILTER (len(places) > 0), []) AS base FROM p GROUP BY r),
lines AS (SELECT r, list_distinct({_LIST.format("line")}) AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
h AS (SELECT r, label, len(list_intersect(lines.ws, templates.ws)) AS n, len(templates.ws) AS size FROM lines, templates),
m AS (SELECT r, list(DISTINCT label) AS found, max(CAST(n AS DOUBLE) / size) AS best FROM h WHERE 100 * n >= {CONTAINED} * size GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END AS score
FROM w JOIN b USING (r) LEFT JOIN m USING (r)
"""
