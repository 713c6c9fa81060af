"""SAMPA tokens to IPA."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: The phonetic map of the lexicon's notation.
SAMPA = {
    "i:": "iː", "I": "ɪ", "y:": "yː", "Y": "ʏ", "u0": "ɵ", "}:": "ʉː", "e:": "eː", "e": "e", "2:": "øː", "9": "œ",
    "E:": "ɛː", "E": "ɛ", "u:": "uː", "U": "ʊ", "o:": "oː", "O": "ɔ", "A:": "ɑː", "a": "a", "@": "ə",
    "a*U": "aʊ", "E*U": "ɛʊ",
    "p": "p", "b": "b", "t": "t", "d": "d", "k": "k", "g": "ɡ", "t`": "ʈ", "d`": "ɖ",
    "m": "m", "n": "n", "N": "ŋ", "n`": "ɳ",
    "f": "f", "v": "v", "s": "s", "h": "h", "s'": "ɕ", "S": "ɧ", "x\\": "ɧ", "s`": "ʂ",
    "r": "r", "l": "l", "j": "j", "l`": "ɭ",
    "w": "w", "T": "θ", "D": "ð", "tC": "tɕ",
}


def mapping(table: dict[str, str] = SAMPA) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))


def token_parts(token: Column) -> Column:
    """(prefix, body): stress marks in IPA, and the token without marks and boundaries."""
    marks = F.regexp_extract(token, r'^["%$]*', 0)
    body = F.replace(F.substring(token, F.length(marks) + 1, F.length(token)), F.lit("$"), F.lit(""))
    return F.struct(F.translate(marks, '"%$', "ˈˌ").alias("prefix"), body.alias("body"))


def to_ipa(pronunciation: Column, table: dict[str, str] = SAMPA) -> Column:
    """(ipa, unknown): the tokens mapped and joined; unknown tokens stand in brackets and are listed."""
    known = mapping(table)
    parts = F.transform(T.tokens(F.coalesce(pronunciation, F.lit(""))), token_parts)
    said = F.transform(parts, lambda p: F.concat(p["prefix"], F.when(p["body"] == "", "").otherwise(F.coalesce(F.try_element_at(known, p["body"]), F.concat(F.lit("["), p["body"], F.lit("]"))))))
    unknown = F.filter(F.transform(parts, lambda p: p["body"]), lambda b: (b != "") & F.try_element_at(known, b).isNull())
    return F.struct(F.array_join(said, "").alias("ipa"), unknown.alias("unknown"))


def distinct_ipa(pronunciations: Column, table: dict[str, str] = SAMPA) -> Column:
    """(distinct_ipa, unknown) of a list of pronunciations, in their order."""
    made = F.transform(pronunciations, lambda p: to_ipa(p, table))
    return F.struct(F.filter(F.array_distinct(F.transform(made, lambda m: m["ipa"])), lambda x: x != "").alias("distinct_ipa"), F.flatten(F.transform(made, lambda m: m["unknown"])).alias("unknown"))
