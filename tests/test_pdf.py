"""Word boxes from PDF files: operators of text, fonts, object streams, and cases without words."""

import random
import zlib

import pytest

from quillspark.operators.layout import layout_dump
from quillspark.plans.source_queries import pdf_bytes
from quillspark.sources import pdf

COURIER = b"<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >>"


def built(contents, fonts=COURIER, flate=True, more=b""):
    """A file of pages that inherit their fonts from the page tree."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(contents)))
    out = [b"%PDF-1.4\n", more, b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /MediaBox [0 0 600 800] /Resources << /Font " + fonts + b" >> >> endobj\n"]
    for k, content in enumerate(contents):
        data = zlib.compress(content) if flate else content
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * k, 11 + 2 * k))
        out.append(b"%d 0 obj << /Length %d %s >> stream\n%s\nendstream endobj\n" % (11 + 2 * k, len(data), b"/Filter /FlateDecode" if flate else b"", data))
    return b"".join(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


def found(data):
    return [(n, *(round(x, 3) for x in w[:4]), w[4]) for n, *page in pdf.File(data).pages() for w in pdf.words(*page)]


def test_text_operators():
    first = b"BT /F1 10 Tf 50 700 Td (Hello w\\366rld) Tj 0 -20 TD [(an) -50 (d) -900 (more)] TJ T* 5 Tw (x y) Tj ET"
    second = b"q 2 0 0 2 0 0 cm BT /F1 5 Tf 14 TL 1 0 0 1 10 300 Tm (a) Tj T* (b\\(c\\)) ' ET Q BI /W 1 ID \x00(\xff EI BT /F1 10 Tf 5 5 Td (z(y)) Tj ET"
    want = [
        (1, 50, 92, 80, 102, "Hello"),
        (1, 86, 92, 116, 102, "wörld"),
        (1, 50, 112, 68.5, 122, "and"),
        (1, 77.5, 112, 101.5, 122, "more"),
        (1, 50, 132, 56, 142, "x"),
        (1, 67, 132, 73, 142, "y"),
        (2, 20, 192, 26, 202, "a"),
        (2, 20, 248, 44, 258, "b(c)"),
        (2, 5, 787, 29, 797, "z(y)"),
    ]
    assert found(built([first, b"", second][::2])) == want
    assert found(built([first, second], flate=False)) == want
    assert found(built([first, b"BT (no font) Tj Td Tf 1 Tm [] TJ ET"]))[:6] == want[:6]


def test_widths_ranges_and_object_streams():
    inner = [b"<< /Type /Font /Subtype /Type0 /DescendantFonts [21 0 R] /ToUnicode 22 0 R >>", b"<< /W [1 [500 250] 5 6 750] /DW 1000 /FontDescriptor << /Ascent 900 /Descent -300 >> >>"]
    head = b"20 0 21 %d " % (len(inner[0]) + 1)
    packed = zlib.compress(head + b" ".join(inner))
    cmap = b"2 beginbfchar <0001> <00e5> <0002> <d83dde00> endbfchar 2 beginbfrange <0005> <0006> <0041> <0007> <0008> [<0066006c> <0020>] endbfrange"
    more = b"19 0 obj << /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    more += b"22 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    data = built([b"BT /F1 10 Tf 0 100 Td <00010002000500060007> Tj <0008> Tj <0009> Tj ET"], b"<< /F1 20 0 R >>", more=more)
    assert found(data) == [(1, 0, 691, 32.5, 703, "å😀ABfl"), (1, 42.5, 691, 52.5, 703, "�")]


def test_placed_words_are_not_read_token_by_token(monkeypatch):
    """Operators after numbers and one hexadecimal string are matched whole; other items go through values()."""
    pages = [(n, *page) for n, *page in pdf.File(pdf_bytes([[(30.0 * k, 9.0, f"w{k}") for k in range(50)]])).pages()]
    read, kept = [], pdf.values
    monkeypatch.setattr(pdf, "values", lambda data, at=0: (read.append(item) or item for item in kept(data, at)))
    got = [w for _, *page in pages for w in pdf.words(*page)]
    assert [w[4] for w in got] == [f"w{k}" for k in range(50)] and got[3][0] == 90.0
    assert len(read) < 5


def test_whole_strings_equal_single_letters():
    """A string gives the words that its letters give one by one, with widths, blanks, stretch, rise, spacing and turned or mirrored text."""
    rng = random.Random(4)
    fonts = {"F1": (1, {97: 311, 98: 0, 99: 712.5}, 487, {k: chr(k).encode("utf-16-be") for k in range(32, 123)}, 0.7, -0.3), "F2": (2, {97: 457}, 991, {k: chr(k).encode("utf-16-be") for k in range(32, 123)} | {98: b"", 99: b"\0f\0i"}, 0.8, -0.2), "F3": (1, {97: -213}, 413, {97: b"\0a"}, 0.8, -0.2)}
    for _ in range(300):
        whole, single = [], []
        for _ in range(rng.randint(1, 6)):
            name = rng.choice(["F1", "F1", "F2", "F3"])
            matrix = rng.choice(["1 0 0 1", "2.5 0 0 2", "1 0 0 1.", "0 1 -1 0", "-1 0 0 1", ".5 .1 0 +1", "0 0 0 0"])
            text = "".join(rng.choice("abc  xq") for _ in range(rng.randint(0, 9)))
            codes = [b"%0*x" % (2 * fonts[name][0], ord(c)) for c in text]
            size = rng.choice([b"10", b"0.5", b"-4", b"0"]) if rng.random() < 0.3 else b"12"
            state = b"%s 0 0 %s %d 0 cm " % (rng.choice([b"1", b"1", b"0.5"]), rng.choice([b"1", b"2"]), rng.randint(0, 1)) + b"/%s %s Tf %d Tz %d Ts %.2f Tc %.2f Tw " % (name.encode(), size, rng.choice([100, 100, 80, -50]), rng.choice([0, 0, 3]), rng.choice([0, 0, 1.37]), rng.choice([0, 0, 5.29]))
            state += f"{matrix} {rng.randint(0, 300)} {rng.randint(0, 300)}.25 Tm".encode()
            whole.append(state + b"<" + b"".join(codes) + b">Tj")
            single.append(state + b"".join(b"<%s> Tj " % c for c in codes))
        join = lambda parts: b"BT q " + b" Q q ".join(parts) + b" Q ET"
        got, want = (pdf.words(800, join(parts), fonts) for parts in (whole, single))
        assert [w[4] for w in got] == [w[4] for w in want]
        assert [x for w in got for x in w[:4]] == pytest.approx([x for w in want for x in w[:4]], abs=1e-6)


def test_later_objects_count():
    data = built([b"BT /F1 10 Tf (old) Tj ET"]) + b"\n11 0 obj << /Length 9999 >> stream\nBT /F1 10 Tf (new) Tj ET\nendstream endobj"
    assert [w[-1] for w in found(data)] == ["new"]


def test_files_that_are_not_read(spark, tmp_path):
    for data in (b"", b"plain", built([b""]).replace(b"/Root", b"/Encrypt 9 0 R /Root")):
        with pytest.raises(ValueError):
            pdf.File(data)
    (tmp_path / "a.pdf").write_bytes(b"no file of the kind")
    with pytest.raises(Exception, match="not a PDF"):
        pdf.read_boxes(spark, str(tmp_path)).collect()


def test_boxes_of_many_files(spark, tmp_path):
    (tmp_path / "none.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "blank.pdf").write_bytes(pdf_bytes([[]]))
    pages = [[(10.0 * k, 7.5 * n, f"ö{n}-{k}😀") for k in range(3)] for n in range(40)]
    for name in "ab":
        (tmp_path / f"{name}.pdf").write_bytes(pdf_bytes(pages))
    got = pdf.read_boxes(spark, str(tmp_path))
    rows = sorted((r["path"][-5:], r["page"], r["n"], round(r["x0"], 3), round(r["y0"], 3), r["text"]) for r in got.collect())
    assert rows == sorted((f"{name}.pdf", n + 1, k, x, y, t) for name in "ab" for n, page in enumerate(pages) for k, (x, y, t) in enumerate(page))
    dump = layout_dump(got, ["path", "page"], got["page"] == 2).where("path LIKE '%a.pdf'").orderBy("line").collect()
    assert [r["line"] for r in dump] == [1, 2, 3]
    assert dump[1]["value"] == "    10.0      7.5     46.0     17.5  ö1-1😀"
