"""Benchmark decontamination: MinHash containment search for short items in long documents, verified exactly.

An item of n distinct word shingles is contained in a document if at least percent of them stand in it. Its
MinHash sketch is its s smallest shingle hashes; a document that contains the item lacks at most
m = n - ceil(percent * n) of its shingles, so it holds at least s - m of the sketch. Items are parted by
size; each part fixes s from its largest size so that at least REQUIRED of the sketch must be met (or all
of the item's shingles, if it has fewer). So the search loses nothing, and a chance hit of one shingle
makes no candidate. A document needs no sketch: all its shingle hashes are looked up, however long it is.

Candidates are verified on the words themselves. The sketches are an index of bounded size: its rows are
counted, and beyond INDEX_ROWS they are dealt in slices of that size, each broadcast in its turn over all
documents, so that any number of items is searched whole.

Words are as in text_kernels, A-Z made small. Defined cases: null, empty and wordless texts contain nothing
and items without words are contained in nothing; items shorter than the shingle have their whole word
sequence as the one shingle, which may stand anywhere in a document; very long texts are searched whole; null ids
are reported as null; repeated rows are reported each; equal items are all reported; columns of any name stay as
they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.text_kernels import U64, batches_by_bytes, window_hashes, words

#: Words of a shingle, percent of an item's shingles, sketch hashes that must be met, and sketch rows of a slice.
SHINGLE, PERCENT, REQUIRED, INDEX_ROWS = 5, 80, 3, 4_000_000


def shingles(tokens: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if len(tokens) < n:
        return {tuple(tokens)} if tokens else set()
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}


def part_of(size: int) -> int:
    """Size part of an item: parts double in width."""
    return size.bit_length()


def sketch_size(size: int, percent: int = PERCENT, required: int = REQUIRED) -> tuple[int, int]:
    """(s, r): smallest hashes kept of an item of a size, and how many of them a containing document holds at least."""
    largest = (1 << part_of(size)) - 1
    lacks = largest - -(-percent * largest // 100)
    s = min(size, lacks + required)
    return s, max(1, s - (size - -(-percent * size // 100)))


class Sketches:
    """The sketches of items, sorted by hash, with the items' words."""

    def __init__(self, items: list[tuple[int, str]], n: int, percent: int):
        self.items, self.lengths, self.required = [], [], []
        hashes, owner = [], []
        for key, text in items:
            tokens = text.encode().lower().split()
            found = shingles(tokens, n)
            if not found:
                continue
            s, r = sketch_size(len(found), percent)
            own = np.sort(_hashes(tokens, n))[:s]
            hashes.append(own)
            owner.append(np.full(len(own), len(self.items)))
            self.items.append((key, found))
            self.lengths.append(len(tokens))
            self.required.append(r)
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.required = np.array(self.required, np.int64)
        self.short = sorted({x for x in self.lengths if x < n})

    def candidates(self, text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs for which enough distinct sketch hashes are met."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, h)
        ok = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        pair = np.unique(np.stack([text[ok].astype(np.int64), h[ok].view(np.int64)], 1), axis=0)
        own = np.ascontiguousarray(pair[:, 1]).view(U64)
        lo, hi = np.searchsorted(self.hashes, own), np.searchsorted(self.hashes, own, "right")
        n = hi - lo
        item = self.owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        code, met = np.unique(np.repeat(pair[:, 0], n) * max(1, len(self.items)) + item, return_counts=True)
        t, i = code // max(1, len(self.items)), code % max(1, len(self.items))
        enough = met >= self.required[i]
        return t[enough], i[enough]


def _hashes(tokens: list[bytes], n: int) -> np.ndarray:
    _, _, _, _, h = words(pa.array([b" ".join(tokens).decode()]), fold=True)
    return np.unique(window_hashes(h, n)) if len(h) >= n else window_hashes(h, len(h))


def _matches(index: Sketches, column: pa.Array, n: int, percent: int):
    """(row, item key, shingles met, shingles of the item) for each item that a text contains."""
    data, starts, ends, first, h = words(column, fold=True)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    grams = window_hashes(h, n)
    whole = text[: len(grams)] == text[n - 1 : n - 1 + len(grams)]
    t, g = text[: len(grams)][whole], grams[whole]
    for k in index.short:  # an item shorter than the shingle is one shingle of its own length
        short = window_hashes(h, k)
        if len(short):
            same = text[: len(short)] == text[k - 1 : k - 1 + len(short)]
            t, g = np.append(t, text[: len(short)][same]), np.append(g, short[same])
    found, item = index.candidates(t, g)
    at, held = -1, {}
    for d, i in zip(found.tolist(), item.tolist(), strict=True):
        if d != at:
            at, held = d, {}
            tokens = data[starts[first[d]] : ends[first[d + 1] - 1]].tobytes().lower().split()
        key, wanted = index.items[i]
        k = min(n, index.lengths[i])
        if k not in held:
            held[k] = shingles(tokens, k)
        met = len(wanted & held[k])
        if met * 100 >= percent * len(wanted):
            yield d, key, met, len(wanted)


def _slices(items: DataFrame, item_col: str, item_text: str, index_rows: int):
    """Broadcasts of the items in slices of bounded sketch size; the driver holds one slice at a time."""
    sent = items.sparkSession.sparkContext.broadcast
    rows = items.select(F.col(item_col).cast("long").alias("k"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    held, size, n = [], 0, 0
    for r in rows.toLocalIterator():
        held.append((r["k"], r["t"]))
        size += len(r["t"]) // 2 + 1  # at least its words, so its shingles
        if size > index_rows:
            yield sent(held)
            held, size, n = [], 0, n + 1
    if held or not n:
        yield sent(held)


def contained(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_rows: int = INDEX_ROWS) -> DataFrame:
    """(id, item_id, n_met, n_shingles) for each document and item that it contains."""
    scratch.few_rows(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def search(sent):
        kept = []

        def run(batches):
            if not kept:
                kept.append(Sketches(sent.value, n, percent))
            for b in batches_by_bytes(batches, "t"):
                rows = list(_matches(kept[0], b.column(1), n, percent))
                d, key, met, size = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d, pa.int64())), *(pa.array(c, pa.int64()) for c in (key, met, size))], ["i", "item_id", "n_met", "n_shingles"])

        return texts.mapInArrow(run, "i long, item_id long, n_met long, n_shingles long")

    out = None
    for part in _slices(items, item_col, item_text, index_rows):
        found = search(part)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("i", id_col)


def clean(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_rows: int = INDEX_ROWS) -> DataFrame:
    """docs without the rows that contain an item."""
    scratch.few_rows(docs.sparkSession)
    rows = docs.select(scratch.packed(docs))
    schema, at = rows.schema, docs.columns.index(text_col)

    def without(rows, sent):
        kept = []

        def run(batches):
            if not kept:
                kept.append(Sketches(sent.value, n, percent))
            for whole in batches:
                for b in batches_by_bytes([pa.RecordBatch.from_arrays([whole.column(0), whole.column(0).field(at)], ["row", "t"])], "t"):
                    keep = np.ones(b.num_rows, bool)
                    keep[[d for d, *_ in _matches(kept[0], b.column(1), n, percent)]] = False
                    yield b.select(["row"]).filter(pa.array(keep))

        return rows.mapInArrow(run, schema)

    for part in _slices(items, item_col, item_text, index_rows):
        rows = without(rows, part)
    return scratch.unpacked(rows, docs)


#: DuckDB's form of contained() for the tables documents and benchmark with the default parameters.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] FROM benchmark
), lengths AS (
  SELECT DISTINCT least(len(w), 5) AS k FROM texts WHERE kind = 'b' AND len(w) > 0
), grams AS (
  SELECT DISTINCT kind, id, r, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM texts JOIN lengths ON kind = 'd' AND len(w) >= k OR kind = 'b' AND k = least(len(w), 5))
), sizes AS (SELECT r, count(*) AS n_shingles FROM grams WHERE kind = 'b' GROUP BY r)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_met, any_value(s.n_shingles) AS n_shingles
FROM grams d JOIN grams b ON d.kind = 'd' AND b.kind = 'b' AND d.k = b.k AND d.g = b.g JOIN sizes s ON s.r = b.r
GROUP BY d.id, d.r, b.id, b.r HAVING count(*) * 100 >= 80 * any_value(s.n_shingles)
"""
