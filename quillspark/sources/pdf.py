"""Words and their boxes from PDF files of any store that Spark reads, with the pages of all files spread over all tasks.

Files come through Spark's binaryFile source, a row a file of at most 2 GB. A first pass walks the objects of a file and
gives a row for each page: its content, still compressed in the plan's exchange, and its fonts. Pages are then dealt
over tasks, so that one book of ten thousand pages is not one task, and a second pass runs their text operators.

Read are classic and compressed object tables, Flate and hexadecimal streams, simple fonts (by ToUnicode, else as Windows
Latin) and composite fonts of two-byte codes. A word ends at white space, at a change of line, and at a jump of more
than a fifth of the font size.

Defined cases: a page without text, and a file without pages, give no words; characters that a font gives no Unicode
for are U+FFFD; text inside form objects and pictures is not read, and pages are not turned; streams that are cut off give
what is left of them, and other damage raises; files that are no PDF or are encrypted raise ValueError when read; an empty file is no PDF.
"""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "path string, page int, n int, x0 double, y0 double, x1 double, y1 double, text string"
#: Share of the font size that ends a word, tolerance of a line, and a font's height above and below the line where it states none.
GAP, LINE, ASCENT, DESCENT = 0.2, 0.5, 0.8, -0.2
#: The font of text without one.
PLAIN: tuple = (1, {}, 500, {}, ASCENT, DESCENT)

_TOKEN = re.compile(rb"(?P<skip>[\s\0]+|%[^\r\n]*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))(?=[\s\0()<>\[\]/%]|$)|/(?P<name>[^\s\0()<>\[\]{}/%]*)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<text>\()|(?P<word>[^\s\0()<>\[\]/%]+|.)", re.S)
#: Of a content as Latin-1: an operator after numbers and at most one hexadecimal string, and a string shown at a place of its own, as many writers put words.
_NUMBER, _HEX, _END = r"[+-]?(?:\d++(?:\.\d*+)?|\.\d++)\s++", r"<([0-9A-Fa-f]*+)>\s*+", r"(?=[\s\0()<>\[\]/%]|$)"
_OPERATOR = re.compile(rf"\s*+((?:{_NUMBER})*+)(?:{_HEX})?+([A-Za-z*'\"]++){_END}", re.A)
_PLACED = re.compile(rf"\s*+((?:{_NUMBER}){{6}}+)Tm\s*+{_HEX}Tj{_END}", re.A)
_OBJECT, _STREAM = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b"), re.compile(rb"\s*stream\r?\n")
_PART, _ESCAPE = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S), {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Name(str):
    """A name of PDF syntax."""


class Word(str):
    """A bare word of PDF syntax: an operator."""


class Ref(int):
    """The number of another object."""


_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket ends at a place, and the place after it."""
    out, depth = [], 1
    while m := _PART.match(data, at):
        at, x = m.end(), m[0]
        depth += (x == b"(") - (x == b")")
        if not depth:
            break
        if x[:1] == b"\\":
            x = bytes([int(x[1:], 8) & 255]) if x[1:2].isdigit() else _ESCAPE.get(x[1:], x[1:])
        out.append(x)
    return b"".join(out), at


def values(data: bytes, at: int = 0):
    """(value, place after it) of each item: numbers, Name, bytes, list, dict, Word, and Ref within lists and dicts."""
    held: list[tuple[bytes, list]] = []
    while m := _TOKEN.match(data, at):
        at, kind, x = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "skip":
            continue
        if kind == "open":
            held.append((x, []))
            continue
        if kind == "close":
            if not held:
                continue
            opened, inner = held.pop()
            value = inner if opened == b"[" else {str(k): v for k, v in zip(inner[::2], inner[1::2], strict=False)}
        elif kind == "num":
            value = float(x) if b"." in x else int(x)
        elif kind == "name":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), x).decode("latin-1"))
        elif kind == "hex":
            digits = b"".join(x.split())
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "text":
            value, at = _string(data, at)
        elif x == b"R" and held and len(held[-1][1]) > 1:
            value = Ref(held[-1][1][-2])
            del held[-1][1][-2:]
        else:
            value = _CONSTANTS[x] if x in _CONSTANTS else Word(x.decode("latin-1"))
        if held:
            held[-1][1].append(value)
        else:
            yield value, at


class File:
    """The objects of one file: later ones of a number take the place of earlier ones."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, tuple] = {}
        self.known: dict[int, tuple] = {}  # fonts by number, as pages share them
        at, trailers = 0, []
        while m := _OBJECT.search(data, at):
            trailers += re.findall(rb"/Encrypt\b", data[at : m.start()])
            value, at = next(values(data, m.end()), (None, m.end()))
            body, s = None, _STREAM.match(data, at)
            if s and isinstance(value, dict):
                size, end = value.get("Length"), -1
                if type(size) is int and re.match(rb"\s*endstream", data[s.end() + size : s.end() + size + 20]):
                    end = s.end() + size
                end = end if end >= 0 else data.find(b"endstream", s.end())
                body, at = data[s.end() : end if end >= 0 else len(data)], max(end, s.end())
            self.objects[int(m[1])] = (value, body)
            if isinstance(value, dict) and value.get("Type") == "XRef" and "Encrypt" in value:
                trailers.append(b"")
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                inner = self.stream(value, body)
                first = int(value["First"])
                numbers = [x for x, _ in values(inner[:first])]
                for k, place in zip(numbers[::2], numbers[1::2], strict=False):
                    self.objects[k] = (next(values(inner, first + place), (None, 0))[0], None)
        if trailers or re.search(rb"/Encrypt\b", data[at:]):
            raise ValueError("encrypted PDF files are not read")

    def get(self, x):
        """What a value or a reference stands for."""
        for _ in range(32):  # references to references end
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x), (None, None))[0]
        return None

    def stream(self, value: dict, body: bytes | None) -> bytes:
        """The bytes of a stream without its filters."""
        filters = self.get(value.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if name in ("FlateDecode", "Fl"):
                body = zlib.decompressobj().decompress(body or b"")
            elif name in ("ASCIIHexDecode", "AHx"):
                body = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", body or b"").decode())
            else:
                raise ValueError(f"streams of {name} are not read")
        return body or b""

    def bytes_of(self, x) -> bytes:
        """The bytes of a stream, or of a list of streams, by reference."""
        if isinstance(x, Ref) and self.objects.get(int(x), (None, None))[1] is not None:
            return self.stream(*self.objects[int(x)])
        x = self.get(x)
        return b"\n".join(map(self.bytes_of, x)) if isinstance(x, list) else b""

    def pages(self):
        """(page from 1, top of the page, content, fonts) in the order of the file's page tree."""
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        todo, seen, n = [(roots[-1].get("Pages"), {})] if roots else [], set(), 0
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            seen |= {int(ref)} if isinstance(ref, Ref) else set()
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                todo += [(kid, own) for kid in reversed(self.get(node["Kids"]) or [])]
                continue
            n += 1
            fonts = self.get((self.get(own.get("Resources")) or {}).get("Font")) or {}
            box = [self.get(x) for x in self.get(own.get("MediaBox")) or [0, 0, 612, 792]]
            yield n, float(box[3]), self.bytes_of(node.get("Contents")), {k: self.shared(f) for k, f in fonts.items()}

    def shared(self, font) -> tuple:
        """A page's font, read once for all pages that refer to it."""
        if not isinstance(font, Ref):
            return self.font(font or {})
        if int(font) not in self.known:
            self.known[int(font)] = self.font(self.get(font) or {})
        return self.known[int(font)]

    def font(self, font: dict) -> tuple:
        """(bytes of a code, width by code, width of others, text by code as UTF-16, ascent, descent)."""
        wide = font.get("Subtype") == "Type0"
        held = self.get((self.get(font.get("DescendantFonts")) or [None])[0]) or {} if wide else font
        shape = self.get(held.get("FontDescriptor")) or {}
        widths: dict[int, float] = {}
        if wide:
            listed = [self.get(x) for x in self.get(held.get("W")) or []]
            while len(listed) > 1:
                if isinstance(listed[1], list):
                    widths |= {listed[0] + k: self.get(x) for k, x in enumerate(listed[1])}
                    listed = listed[2:]
                else:
                    widths |= dict.fromkeys(range(listed[0], listed[1] + 1), listed[2])
                    listed = listed[3:]
        else:
            widths = {int(font.get("FirstChar") or 0) + k: self.get(x) for k, x in enumerate(self.get(font.get("Widths")) or [])}
        other = self.get(held.get("DW")) if wide else self.get(shape.get("MissingWidth"))
        other = other or (1000 if wide else 600 if "Courier" in str(font.get("BaseFont")) else 500)
        ascent, descent = (self.get(shape.get(k)) for k in ("Ascent", "Descent"))
        texts = {} if wide else {k: bytes([k]).decode("cp1252", "replace").encode("utf-16-be") for k in range(256)}
        texts |= _unicode(self.bytes_of(font.get("ToUnicode")))
        return 2 if wide else 1, widths, other, texts, ascent / 1000 if ascent else ASCENT, descent / 1000 if descent else DESCENT


def _unicode(cmap: bytes) -> dict[int, bytes]:
    """Texts as UTF-16 by code, of a ToUnicode table."""
    out: dict[int, bytes] = {}
    number = lambda x: int.from_bytes(x, "big")
    held: list = []
    for x, _ in values(cmap):
        if x in ("beginbfchar", "beginbfrange"):
            held = []
        elif x == "endbfchar":
            out |= {number(a): b for a, b in zip(held[::2], held[1::2], strict=False)}
        elif x == "endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                for k in range(number(a), min(number(b), 0xFFFF) + 1):
                    i = k - number(a)
                    if isinstance(c, bytes):
                        out[k] = (number(c) + i).to_bytes(max(len(c), 2), "big")
                    elif i < len(c):
                        out[k] = c[i]
        else:
            held.append(x)
    return out


def _times(a: tuple, b: tuple) -> tuple:
    """The matrix that applies a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


@lru_cache(4096)
def _blank(text: bytes) -> bool:
    return text.decode("utf-16-be", "replace").isspace()


class _Letters(dict):
    """(way, text or None for a blank) by code, in a font at a size and stretch; forward as long as no letter goes back."""

    def __init__(self, widths: dict, other: float, texts: dict, size: float, stretch: float):
        self.font, self.scale, self.forward = (widths, other, texts), (size, stretch), True

    def __missing__(self, code: int) -> tuple:
        (widths, other, texts), (size, stretch) = self.font, self.scale
        advance = (widths.get(code) or other) / 1000 * size
        self.forward = self.forward and advance >= 0
        text = texts.get(code, b"\xff\xfd")
        self[code] = advance * stretch, None if _blank(text) else text
        return self[code]


def words(top: float, content: bytes, fonts: dict[str, tuple]) -> list[tuple]:
    """(x0, y0, x1, y1, text) of the words of a page in the order of its content; y grows downwards."""
    out, now = [], []  # now: x0, y0, x1, y1, baseline, text of the word that goes on
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, tm, line = one, [], one, one
    font, size, spread, between, stretch, leading, rise = None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0

    def ended():
        if now:
            x0, y0, x1, y1, _, text = now
            out.append((x0, y0, x1, y1, text.decode("utf-16-be", "replace")))
            now.clear()

    known: dict[tuple, tuple[_Letters, dict]] = {}  # letters and shapes of strings, by font, size and stretch

    def shape(data: bytes, letters: _Letters, wide: bool) -> tuple[tuple, float]:
        """(runs, way) of a string: a run is (way to its first letter, to its last, width of the last, text), None a blank."""
        runs, first, moved = [], None, 0.0
        for code in struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]) if wide else data:
            step, letter = letters[code]
            if letter is None:
                if first is not None:
                    runs.append((first, last, width, text))
                runs.append(first := None)
            else:
                first, text = (moved, letter) if first is None else (first, text + letter)
                last, width = moved, step
            moved += step
        if first is not None:
            runs.append((first, last, width, text))
        return tuple(runs), moved

    def shown(data: bytes):
        nonlocal tm
        n, widths, other, texts, ascent, descent = font or PLAIN
        at = tm if ctm == one else _times(tm, ctm)
        at = _times((1, 0, 0, 1, 0, rise), at) if rise != 0 else at
        high, moved = abs(at[3]) * size, 0.0
        if isinstance(data, bytes) and spread == 0 and (n == 2 or between == 0) and at[1] == 0:  # letters of a string lie side by side on a line
            key = (id(font), size, stretch)
            if key not in known:
                known[key] = _Letters(widths, other, texts, size, stretch), {}
            letters, shapes = known[key]
            if data not in shapes:
                shapes[data] = shape(data, letters, n == 2)
            runs, way = shapes[data]
            if letters.forward and at[0] * stretch > 0 and abs(at[4]) + abs(way * at[0]) < 1e9 * high:
                y, low, up = at[5], top - at[5] - ascent * high, top - at[5] - descent * high
                for run in runs:
                    if run is None:
                        ended()
                        continue
                    x0, x1 = at[4] + run[0] * at[0], at[4] + run[1] * at[0] + run[2] * at[0]
                    if now and (abs(y - now[4]) > LINE or not -high / 2 < x0 - now[2] < GAP * high):
                        ended()
                    if now:
                        now[1], now[2], now[3] = min(now[1], low), max(now[2], x1), max(now[3], up)
                        now[5] += run[3]
                    else:
                        now[:] = [x0, low, x1, up, y, run[3]]
                tm = (*tm[:4], tm[4] + way * tm[0], tm[5] + way * tm[1])
                return
        for k in range(0, len(data) - n + 1, n):
            code = int.from_bytes(data[k : k + n], "big")
            advance = (widths.get(code) or other) / 1000 * size
            x0, y = at[4] + moved * at[0], at[5] + moved * at[1]
            x1 = x0 + advance * stretch * at[0]
            moved += (advance + spread + (between if n == 1 and code == 32 else 0)) * stretch
            text = texts.get(code, b"\xff\xfd")
            if _blank(text):
                ended()
                continue
            if now and (abs(y - now[4]) > LINE or not -high / 2 < x0 - now[2] < GAP * high):
                ended()
            if not now:
                now[:] = [x0, top - y - ascent * high, x1, top - y - descent * high, y, b""]
            now[1], now[2], now[3] = min(now[1], top - y - ascent * high), max(now[2], x1), max(now[3], top - y - descent * high)
            now[5] += text
        tm = (*tm[:4], tm[4] + moved * tm[0], tm[5] + moved * tm[1])

    args: list = []
    at, plainly = 0, content.decode("latin-1")
    while True:
        if placed := _PLACED.match(plainly, at):
            at, args, text = placed.end(), [], placed[2]
            tm = line = tuple(map(float, placed[1].split()))
            try:
                shown(bytes.fromhex(text + "0" if len(text) % 2 else text))
            except (IndexError, TypeError, ValueError):
                pass  # as below
            continue
        plain = _OPERATOR.match(plainly, at)
        if plain and (x := plain[3]) not in ("ID", "true", "false", "null"):
            at = plain.end()
            args += [float(v) if "." in v else int(v) for v in plain[1].split()]
            if (text := plain[2]) is not None:
                args.append(bytes.fromhex(text + "0" if len(text) % 2 else text))
        elif item := next(values(content, at), None):
            x, at = item
            if not isinstance(x, Word):
                args.append(x)
                continue
        else:
            break
        held, args = args, []
        try:
            if x == "Tj":
                shown(held[-1])
            elif x == "Tm":
                tm = line = tuple(map(float, held[-6:]))
            elif x == "q":
                saved.append((ctm, font, size, spread, between, stretch, leading, rise))
            elif x == "Q" and saved:
                ctm, font, size, spread, between, stretch, leading, rise = saved.pop()
            elif x == "cm":
                ctm = _times(tuple(held[-6:]), ctm)
            elif x == "BT":
                tm = line = one
            elif x == "Tf":
                font, size = fonts.get(held[-2]), float(held[-1])
            elif x == "Tc":
                spread = held[-1]
            elif x == "Tw":
                between = held[-1]
            elif x == "Tz":
                stretch = held[-1] / 100
            elif x == "TL":
                leading = held[-1]
            elif x == "Ts":
                rise = held[-1]
            elif x in ("Td", "TD"):
                leading = -held[-1] if x == "TD" else leading
                tm = line = _times((1, 0, 0, 1, held[-2], held[-1]), line)
            elif x in ("T*", "'", '"'):
                between, spread = held[-3:-1] if x == '"' else (between, spread)
                tm = line = _times((1, 0, 0, 1, 0, -leading), line)
            elif x == "ID":  # the bytes of an inline picture
                end = re.compile(rb"\sEI(?=\s|$)").search(content, at)
                at = end.end() if end else len(content)
            if x in ("'", '"'):
                shown(held[-1])
            elif x == "TJ":
                for part in held[-1]:
                    if isinstance(part, bytes):
                        shown(part)
                    else:
                        tm = _times((1, 0, 0, 1, -part / 1000 * size * stretch, 0), tm)
        except (IndexError, TypeError, ValueError):
            continue  # an operator without its operands does nothing
    ended()
    return out


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, n, x0, y0, x1, y1, text): the words of PDF files; n counts the words of a page from 0, y grows downwards."""

    def pages(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                for n, top, content, fonts in File(data.as_py() or b"").pages():
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([n], pa.int32()), pa.array([zlib.compress(pickle.dumps((top, content, fonts), 5), 1)], pa.binary())], ["path", "page", "held"])

    def run(batches):
        for batch in batches:
            for name, page, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(*pickle.loads(zlib.decompress(held)))
                columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([page] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), *(pa.array(c, pa.float64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["path", "page", "n", "x0", "y0", "x1", "y1", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    held = files.mapInArrow(pages, "path string, page int, held binary")
    return held.repartition(F.col("path"), F.col("page")).mapInArrow(run, WORDS)
