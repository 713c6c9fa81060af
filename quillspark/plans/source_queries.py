"""Queries of the readers and writers, over files written from the tables."""

from __future__ import annotations

import uuid
import zlib
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from quillspark.operators import layout, quality
from quillspark.operators import lexicon as L
from quillspark.plans.card_queries import _RULE_SQL, _rules, _union
from quillspark.plans.sequence_queries import _TOKENS, boxes
from quillspark.plans.text_queries import _SAID, lexicon
from quillspark.plans.views import Registry, cte, view
from quillspark.sources import files, pdf

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
CARDS = cte("cards")


@query(CARDS + "SELECT id, head, translation, forms, chapter, page FROM cards")
def json_round_trip(spark, sf):
    at = files.work_folder(spark)
    files.write_lines(view(spark, sf, "cards").select("id", "head", "translation", "forms", "chapter", "page"), at)
    return files.read_lines(spark, at, "id LONG, head STRING, translation STRING, forms STRING, chapter INT, page INT")


@query(_SAID + "SELECT word, array_to_string(list_sort(ps), '|') AS pronunciations FROM d")
def lexicon_scan(spark, sf):
    at = files.work_folder(spark)
    lexicon(spark, sf).select(F.concat("word", F.lit("\t"), "sampa").alias("value")).write.text(at)
    said = L.pronunciations(files.read_lexicon(spark, at))
    return said.select("word", F.array_join(F.array_sort("pronunciations"), "|").alias("pronunciations"))


@query(CARDS + "SELECT rpad(rule, 40, ' ') || lpad(CAST(n AS VARCHAR), 12, ' ') AS value FROM (" + _union(_RULE_SQL, lambda n, r: f"SELECT '{n}' AS rule, count(*) FILTER ({r}) AS n FROM cards") + " UNION ALL SELECT 'DUPLICATE_ID', count(*) FROM (SELECT id FROM cards GROUP BY id HAVING count(*) > 1))")
def report_lines(spark, sf):
    counts = quality.structure_counts(view(spark, sf, "cards"), _rules())
    at = files.work_folder(spark)
    files.write_report(counts.select(F.col("rule").alias("metric"), F.col("n").alias("value")), at)
    return spark.read.text(at)


#: Height of the pages of written files, size of their letters, and pages of a file.
_TOP, _SIZE, _PAGES = 792, 10, 256


def pdf_bytes(pages: list[list[tuple]]) -> bytes:
    """A file of pages of words (x0, y0, text): letters all six tenths of their size wide, a composite font for each page."""
    out, kids = [b"%PDF-1.4\n"], []

    def stream(number: int, data: bytes) -> None:
        data = zlib.compress(data, 1)
        out.append(b"%d 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (number, len(data), data))

    for k, words in enumerate(pages):
        first = 3 + 5 * k
        kids.append(b"%d 0 R" % first)
        lines = "\n".join(f"1 0 0 1 {x:.4f} {_TOP - y - 0.8 * _SIZE:.4f} Tm <{(text + ' ').encode('utf-16-be').hex()}> Tj" for x, y, text in words)
        raw = " ".join([""] + [w[2] for w in words] + [""]).encode("utf-16-be")
        codes = [code.hex() for code in sorted({raw[i : i + 2] for i in range(0, len(raw), 2)})]
        fonts = b"<< /Font << /F1 %d 0 R >> >>" % (first + 2)
        out.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 %d] /Contents %d 0 R /Resources %s >>\nendobj\n" % (first, _TOP, first + 1, fonts))
        stream(first + 1, f"BT /F1 {_SIZE} Tf\n{lines}\nET".encode())
        out.append(b"%d 0 obj\n<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>\nendobj\n" % (first + 2, first + 3, first + 4))
        out.append(b"%d 0 obj\n<< /Type /Font /Subtype /CIDFontType2 /DW 600 >>\nendobj\n" % (first + 3))
        stream(first + 4, f"{len(codes)} beginbfchar\n{chr(10).join(f'<{c}> <{c}>' for c in codes)}\nendbfchar".encode())
    out.append(b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count %d /Kids [%s] >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%%%EOF\n" % (len(kids), b" ".join(kids)))
    return b"".join(out)


def _write_pdf(at: str):
    """Writes sorted rows (page, x0, y0, text) to files and gives (file, number, page) of each page; only files named so count."""

    def saved(pages: dict) -> pa.RecordBatch:
        store, folder = fs.FileSystem.from_uri("file:///" + at[5:].lstrip("/") if at.startswith("file:") else at)
        name = f"{uuid.uuid4().hex}.pdf"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(pdf_bytes(list(pages.values())))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(pages)), pa.array(range(1, len(pages) + 1), pa.int32()), pa.array(list(pages), pa.int64())], ["file", "number", "page"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            page, x0, y0, text = batch.columns
            words = zip(x0.to_numpy().tolist(), y0.to_numpy().tolist(), text.to_pylist(), strict=True)
            for page, some in groupby(zip(page.to_pylist(), words, strict=True), itemgetter(0)):
                if page not in held and len(held) == _PAGES:
                    yield saved(held)
                    held = {}
                held.setdefault(page, []).extend(word for _, word in some)
        if held:
            yield saved(held)

    return run


@query(f"WITH {_TOKENS}SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY turn, k) - 1 AS INTEGER) AS n, x0, round(y0, 2) AS y0, x0 + length(text) * 6 AS x1, round(y0 + 10, 2) AS y1, text FROM tokens")
def pdf_words(spark, sf):
    at = files.work_folder(spark)
    words = boxes(spark, sf).repartition("page").sortWithinPartitions("page", "turn", "k").select("page", "x0", "y0", "text")
    index = files.stored(words.mapInArrow(_write_pdf(at), "file string, number int, page long"), "pdf-pages")
    found = pdf.read_boxes(spark, at).withColumnRenamed("page", "number").withColumn("file", F.substring_index("path", "/", -1))
    return found.join(index, ["file", "number"]).select("page", "n", *[F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")], "text")


@query(f"WITH {_TOKENS}SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, text) AS INTEGER) AS line, printf('%8.1f %8.1f %8.1f %8.1f  %s', x0, y0, x0 + length(text) * 6, y0 + 10, text) AS value FROM tokens")
def layout_dump(spark, sf):
    rows = boxes(spark, sf).withColumns({"x1": F.col("x0") + F.length("text") * 6, "y1": F.col("y0") + 10})
    return layout.layout_dump(rows, ["page"])
