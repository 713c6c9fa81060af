"""DuckDB forms of the Column functions, as SQL text around an expression."""

from __future__ import annotations

from quillspark.functions import cards as C
from quillspark.functions import text as T

WS = "[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]"
NOT_WORD = "[^\\p{L}\\p{N}_]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return collapse(f"translate(coalesce({x}, ''), '\u00a0–—−\u200b\ufeff', ' ---')")


def forms(x: str) -> str:
    tied = f"regexp_replace({norm(x)}, '-\\s+(\\p{{L}})', '-\\1', 'g')"
    return f"trim(regexp_replace({tied}, '\\s*,\\s*', ', ', 'g'), ' ')"


def soft(x: str) -> str:
    return f"replace({x}, '{T.SOFT_HYPHEN}', '')"


def clean_output(x: str) -> str:
    return norm(soft(f"translate(coalesce({x}, ''), '{T.SEPARATORS}', '')"))


def clean_field(x: str) -> str:
    return strip(f"translate({x}, '{T.SOFT_HYPHEN}\u200b', '')")


def key(x: str) -> str:
    return f"replace(lower({collapse(f'coalesce({x}, {chr(39)}{chr(39)})')}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return f"[w FOR w IN regexp_split_to_array({x}, '{WS}+') IF w <> '']"


def count_of(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, '{mark}', '')))"


def ends(x: str, endings: tuple[str, ...]) -> str:
    return "(" + " OR ".join("suffix({}, '{}')".format(x, e.replace("'", "''")) for e in endings) + ")"


def goes_on(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '{WS}+$', '')"
    return f"({t} = '' OR regexp_matches({t}, '[{T.SOFT_HYPHEN},/\\-–—]$'))"


def goes_on_strict(x: str, endings: tuple[str, ...] = C.OPEN_ENDINGS) -> str:
    t = f"lower({soft(f'regexp_replace(coalesce({x}, {chr(39)}{chr(39)}), {chr(39)}{WS}+$' + chr(39) + f', {chr(39)}{chr(39)})')})"
    return f"({goes_on(x)} OR {ends(t, endings)})"


def broken(x: str) -> str:
    o, c = count_of(x, "("), count_of(x, ")")
    return f"({o} > {c} OR (contains({x}, '{T.SOFT_HYPHEN}') AND {o} > 0 AND {c} = 0))"


def noise(x: str) -> str:
    t = key(norm(x))
    return f"({t} = '' OR regexp_full_match({t}, '[0-9]{{1,3}}') OR (contains({t}, 'b1+b2') AND contains({t}, 'ordlista')) OR regexp_full_match({t}, '\\(?\\s*(engelska|svenska)\\s*\\)?') OR regexp_full_match({t}, 'svenska\\s+engelska') OR prefix({t}, 'kopieringsunderlag') OR prefix({t}, '©') OR prefix({t}, 'isbn'))"


def marker(x: str, word: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '(?i)(?:^|{NOT_WORD}){word}\\s*([0-9]+)(?:$|{NOT_WORD})', 1), '') AS INTEGER)"
