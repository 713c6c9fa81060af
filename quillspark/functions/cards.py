"""Rules for vocabulary rows: markers, noise, splitting into headword, forms and translation, and card keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Particles that may follow the forms and belong to the headword.
PARTICLES = (
    "sig", "mig", "dig", "oss", "er", "på", "av", "om", "upp", "ner", "ned", "ut", "in", "fram", "till", "över", "under",
    "ihop", "igen", "bort", "hem", "med", "för", "efter", "före", "mot", "en", "ett",
)
#: Particles that are no translation by themselves.
LONE_PARTICLES = (
    "in", "ut", "upp", "ner", "ned", "på", "av", "om", "till", "med", "över", "under", "fram", "bort", "hem", "igen",
    "ihop", "sig", "mig", "dig", "oss", "er",
)
#: Endings of a translation that goes on in the next row.
OPEN_ENDINGS = (" in", " of", " the", " a", " an", " to", " with", " from", " for", " one", " one's", " one’s", " my", " your", " his", " her", " their", " other", " mother in", " father in", " brother in", " sister in")
#: Open endings of the older list.
OLDER_ENDINGS = (" in", " of", " the", " a", " an", " to", " with", " from", " for", " one", " my", " your", " his", " her", " their", " other", " civil", " human", " per", " mother in", " father in", " brother in", " sister in")
#: Endings of a translation that was probably cut.
CUT_ENDINGS = (" in", " of", " to", " the", " a", " an", " and", " or", " with", " for", " from", " on", " at", " by", " into", " about", " as", " one’s", " one's")


def marker(c: Column, word: str) -> Column:
    """The number after a marker word, or null."""
    return F.regexp_extract(c, rf"(?iU)(?<![\p{{L}}\p{{N}}_]){word}\s*(\d+)(?![\p{{L}}\p{{N}}_])", 1).try_cast("int")


def is_noise(c: Column) -> Column:
    """Rows that hold no entry: empty, page numbers, headers, language labels, notices."""
    return T.let(T.match_key(T.normalize_basic(c)), lambda t: (t == "") | t.rlike(r"^\d{1,3}$") | (t.contains("b1+b2") & t.contains("ordlista")) | t.rlike(r"^\(?\s*(engelska|svenska)\s*\)?$") | t.rlike(r"^svenska\s+engelska$") | t.startswith("kopieringsunderlag") | t.startswith("©") | t.startswith("isbn"))


def looks_like_forms(c: Column) -> Column:
    """A group in parentheses that can be inflections."""
    return T.let(T.normalize_basic(c), lambda t: (t != "") & (t.contains(",") | t.startswith("-")))


def _inner(group: Column) -> Column:
    return F.substring(group, F.lit(2), F.length(group) - 2)


def forms_group(c: Column) -> Column:
    """The first group in parentheses without inner ones that looks like forms, with its parentheses, or null."""
    return F.get(F.filter(F.regexp_extract_all(c, F.lit(r"(\([^()]*\))"), F.lit(1)), lambda g: looks_like_forms(_inner(g))), F.lit(0))


def _around(text: Column, body) -> Column:
    """body(text, group, before, after) of a normalised text and its forms group; group is null where there is none."""
    parts = lambda t, g: F.struct(t.alias("t"), g.alias("g"), F.substring(t, F.lit(1), F.instr(t, g) - 1).alias("before"), F.substring(t, F.instr(t, g) + F.length(g), F.length(t)).alias("after"))
    return T.let(T.normalize_basic(text), lambda t: T.let(T.let(forms_group(t), lambda g: parts(t, g)), lambda x: body(x["t"], x["g"], x["before"], x["after"])))


def extract_morphology(c: Column) -> Column:
    """(text, forms): the text without its forms group; forms are empty where there is none."""
    text = lambda t, g, before, after: F.when(g.isNull(), t).otherwise(T.normalize_basic(F.concat(before, F.lit(" "), after)))
    return _around(c, lambda t, g, before, after: F.struct(text(t, g, before, after).alias("text"), F.coalesce(T.normalize_forms(_inner(g)), F.lit("")).alias("forms")))


def split_by_separator(words: Column) -> Column:
    """(head, translation) of a row's tokens: the first token with a separator ends the headword; null without one."""
    at = F.array_position(F.transform(words, T.has_separator), True).cast("int")
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(at, F.lit(1))), " ")
    rest = F.array_join(F.slice(words, at + 1, F.size(words)), " ")
    return F.when(at > 0, F.struct(head.alias("head"), rest.alias("translation")))


def _particles(after: Column) -> Column:
    """How many of the first three words are particles, with a word left after them."""
    is_one = lambda k: F.coalesce(T.match_key(F.regexp_replace(F.get(after, F.lit(k)), r"^[.,;:!?]+|[.,;:!?]+$", "")).isin(*PARTICLES), F.lit(False)) & (F.size(after) > k + 1)
    return F.when(~is_one(0), 0).when(~is_one(1), 1).when(~is_one(2), 2).otherwise(3)


def split_by_morphology(c: Column) -> Column:
    """(head, forms, translation): headword before the forms group, up to three particles after it, then the translation."""

    def parts(before: Column, group: Column, after: Column, n: Column) -> Column:
        head = T.normalize_basic(F.concat_ws(" ", before, F.nullif(F.array_join(F.slice(after, F.lit(1), n), " "), F.lit(""))))
        rest = T.normalize_basic(F.array_join(F.slice(after, n + 1, F.size(after)), " "))
        made = F.struct(head.alias("head"), T.normalize_forms(_inner(group)).alias("forms"), rest.alias("translation"))
        return T.let(made, lambda m: F.when((before != "") & (F.size(after) > 0) & (m["head"] != "") & (m["translation"] != ""), m))

    whole = lambda t, g, before, after: F.when(g.isNotNull(), T.let(T.tokens(after), lambda a: T.let(_particles(a), lambda n: parts(F.trim(before), g, a, n))))
    return _around(c, whole)


def parse_row(raw: Column) -> Column:
    """(head, forms, translation, method) of a row, by separator or else by its forms group; null if neither parts it."""
    method = lambda x, name: F.struct(x["head"].alias("head"), x["forms"].alias("forms"), x["translation"].alias("translation"), F.lit(name).alias("method"))

    def separated(parted: Column) -> Column:
        left = T.let(extract_morphology(T.clean_output(parted["head"])), lambda m: F.struct(m["text"].alias("head"), m["forms"].alias("forms"), T.clean_output(parted["translation"]).alias("translation")))
        return F.when(parted.isNotNull(), T.let(left, lambda x: F.when((x["head"] != "") & (x["translation"] != ""), method(x, "UNICODE_SEPARATOR"))))

    by_separator = T.let(split_by_separator(F.filter(F.split(raw, "[ \\t\\n\\r]+"), lambda x: x != "")), separated)
    by_forms = T.let(split_by_morphology(T.clean_output(raw)), lambda x: F.when(x.isNotNull(), method(x, "MORPHOLOGY_FALLBACK")))
    return F.coalesce(by_separator, by_forms)


def suspicious_fallback(method: Column, translation: Column) -> Column:
    """A fallback split that left a lone particle as the translation."""
    return F.coalesce((method == "MORPHOLOGY_FALLBACK") & T.match_key(translation).isin(*LONE_PARTICLES), F.lit(False))


def goes_on(c: Column) -> Column:
    """A translation that ends open: empty, or with a soft hyphen, comma, slash or dash."""
    return T.let(T.strip_end(F.coalesce(c, F.lit(""))), lambda t: (t == "") | t.rlike("[\u00ad,/\\-–—]$"))


def goes_on_strict(c: Column, endings: tuple[str, ...] = OPEN_ENDINGS) -> Column:
    """goes_on, or an ending that a translation seldom has."""
    low = F.lower(T.drop_soft_hyphens(T.strip_end(F.coalesce(c, F.lit("")))))
    return goes_on(c) | T.let(low, lambda t: T.ends_with_any(t, endings))


def join_continuation(previous: Column, following: Column) -> Column:
    """Two parts of one text: glued after a soft hyphen (which goes) or hyphen, else with a blank."""
    n = T.strip(following)
    return T.normalize_basic(T.let(T.strip_end(previous), lambda p: F.when(p.endswith(T.SOFT_HYPHEN), F.concat(F.substring(p, F.lit(1), F.length(p) - 1), n)).when(p.endswith("-"), F.concat(p, n)).otherwise(F.concat(p, F.lit(" "), n))))


def merge_rows(first: Column, second: Column) -> Column:
    """Two rows of one entry as one: glued after a soft hyphen, which goes, else with a blank."""
    rest = F.regexp_replace(second, r"(?U)^[\s\x1c-\x1f]+", "")
    return T.let(T.strip_end(first), lambda f: F.when(f.endswith(T.SOFT_HYPHEN), F.concat(F.substring(f, F.lit(1), F.length(f) - 1), rest)).otherwise(F.concat(f, F.lit(" "), rest)))


def is_short_fragment(c: Column, most: int = 8) -> Column:
    return T.let(T.word_count(T.normalize_basic(c)), lambda n: n.between(1, most))


def is_broken(c: Column) -> Column:
    """A headword that goes on in the next row: an open parenthesis, or a soft hyphen before one."""
    opened, closed = T.count_of(c, "("), T.count_of(c, ")")
    return (opened > closed) | (c.contains(T.SOFT_HYPHEN) & (opened > 0) & (closed == 0))


def is_balanced(c: Column) -> Column:
    return T.count_of(c, "(") == T.count_of(c, ")")


def sort_key(card_id: Column, prefix: str = "riv_b_") -> Column:
    """Order of cards: parsed ids by number, then manual ids by number, then all others by id."""
    parsed, manual = (F.regexp_extract(card_id, rf"^{prefix}{kind}(\d+)$", 1).try_cast("long") for kind in ("", "manual_"))
    return F.struct(F.when(parsed.isNotNull(), 0).when(manual.isNotNull(), 1).otherwise(2).alias("kind"), F.coalesce(parsed, manual, F.lit(999999)).alias("number"), card_id.alias("id"))


def forms_rank(forms: Column) -> Column:
    """Order of forms by completeness: parts, then length, then the folded text; ends in the text itself, so ties cannot differ."""
    parts = F.size(F.filter(F.split(forms, ","), lambda x: T.strip(x) != ""))
    return F.struct(parts.alias("parts"), F.length(forms).alias("length"), T.match_key(forms).alias("folded"), forms.alias("forms"))


def card_id(number: Column, prefix: str = "riv_b_") -> Column:
    return F.format_string(f"{prefix}%04d", number)
