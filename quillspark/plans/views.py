"""The provided tables in the roles that the operators expect; the same expressions serve Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The day up to which study events are looked at.
TODAY = "2024-01-30"

CARD = {
    "id": "p_partkey",
    "head": "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 11 = 0 THEN '  ' || p_name ELSE p_name END",
    "translation": "CASE WHEN p_partkey % 13 = 0 THEN p_type || ' of the' WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'ab-' ELSE p_type END",
    "forms": "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN p_brand || ', -x' ELSE p_brand END",
    "chapter": "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size % 18 + 1 AS INTEGER) END",
    "page": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS INTEGER) END",
    "source_pdf_page": "CAST(p_partkey % 50 AS INTEGER)",
    "level": "CASE CAST(p_partkey % 7 AS INTEGER) WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'B1' WHEN 3 THEN 'B2' WHEN 4 THEN 'C1' WHEN 5 THEN 'C2' ELSE 'X' END",
    "method": "CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN 'UNICODE_SEPARATOR' WHEN 1 THEN 'MORPHOLOGY_FALLBACK' WHEN 2 THEN 'MANUAL_REVIEW' WHEN 3 THEN 'MANUAL_REVIEW_FIXED' ELSE 'OTHER' END",
}
#: Documents with the marks of badly extracted text.
MESSY = "replace(replace(replace(replace(replace(text, 'e ', 'e '), ' a', ' –a'), 'th', 't\u200bh'), 'en ', 'e\u00adn, '), ' de ', ' - de ')"
TEXT = {"id": "doc_id", "t": MESSY}
#: Rows of an entry list made from whole documents: markers, a headword with forms, with a separator, both or neither, a page heading.
ROW = {
    "id": "doc_id",
    "raw": "CASE CAST(doc_id % 8 AS INTEGER) WHEN 0 THEN 'Kapitel ' || CAST(doc_id % 18 AS STRING) || ' ' || text WHEN 1 THEN text || ' (-en, -ar) på sig ' || text WHEN 2 THEN text || '\u2002' || ' ' || text WHEN 3 THEN 'Sidan ' || CAST(doc_id % 90 AS STRING) || ' ' || text WHEN 4 THEN '  B1+B2 ordlista ' || CAST(doc_id % 1000 AS STRING) || ' ' || text WHEN 5 THEN text || ' (-r, -de) in' WHEN 6 THEN 'ett ord (-et,  -en)\u2003 ' || text ELSE text END",
}
ANSWER = {"event_id": "event_id", "user_id": "user_id", "word": "event_type", "ts": "ts", "known": "event_id % 4 <> 0"}
PROGRESS = {
    "word_id": "c_custkey",
    "user_id": "c_custkey % 40",
    "level": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS INTEGER) END",
    "next_review": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(CASE WHEN c_custkey % 2 = 0 THEN '2024-01-28' WHEN c_custkey % 3 = 0 THEN '2024-01-30' ELSE '2024-02-03' END AS DATE) END",
    "segment": "c_mktsegment",
}
STORE = {
    "word_id": "c_custkey",
    "stored": """CASE CAST(c_custkey % 6 AS INTEGER) WHEN 0 THEN '{"level":3,"nextReview":"2024-02-01T00:00:00.000"}' WHEN 1 THEN '{"level":0}' WHEN 2 THEN 'broken' WHEN 3 THEN NULL WHEN 4 THEN '{"level":2.7,"nextReview":"soon"}' ELSE '{"nextReview":"2024-02-01"}' END""",
    "status": "CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN 'learning' WHEN 1 THEN 'known' ELSE NULL END",
}
ROLES = {"cards": ("part", CARD), "texts": ("documents", TEXT), "entries": ("documents", ROW), "answers": ("events", ANSWER), "progress": ("customer", PROGRESS), "store": ("customer", STORE)}


class Registry:
    """Queries of a module and their DuckDB forms, by name."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def view(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    table, columns = ROLES[role]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*roles: str) -> str:
    """WITH clause of the roles for DuckDB."""
    parts = []
    for r in roles:
        source, columns = ROLES[r]
        parts.append(f"{r} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})")
    return "WITH " + ", ".join(parts) + " "
