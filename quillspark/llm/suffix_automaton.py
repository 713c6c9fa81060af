"""Substring dedup by suffix automata: matching statistics of streamed word sequences against references.

A suffix automaton over words holds every substring of its reference; streaming a text through it gives at
each word the longest suffix that the reference holds. Words in matches of at least the window are removed.

Within a corpus the reference of a document is every document with a smaller id. No broadcast of that is of
bounded size, so the automata are built by shards of candidate runs (see repeats), each in the task that
streams the runs of its shard in the order of ids. Against a given reference of bounded size, the shards
are broadcast and every document streams through each (reference_spans).

Defined cases: null, empty and short texts lose nothing; rows with a null id come after all ids and are no
reference for each other; rows that share an id are no reference for each other; repeated rows give equal
results; very long texts are taken whole; columns of any name stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import repeats, scratch
from quillspark.llm.text_kernels import batches_by_bytes, spans, text_buffers, text_keys

#: Words of a shard of a given reference, and the most words that a given reference may have.
SHARD_WORDS, REFERENCE_WORDS = 1 << 20, 1 << 24
GRAM = 5


class SuffixAutomaton:
    """A generalised suffix automaton over hashable symbols, extended sequence by sequence."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        next_, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = next_[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, c, q)
                continue
            cur = len(next_)
            next_.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and (q := next_[p].get(c)) is None:
                next_[p][c] = cur
                p = link[p]
            if p >= 0:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        next_, link, length = self.next, self.link, self.length
        clone = len(next_)
        next_.append(next_[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and next_[p].get(c) == q:
            next_[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def statistics(self, sequence) -> list[int]:
        """At each symbol, the length of the longest suffix read that the automaton holds."""
        next_, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in sequence:
            q = next_[state].get(c)
            while q is None and state:
                state = link[state]
                n = length[state]
                q = next_[state].get(c)
            if q is not None:
                state, n = q, n + 1
            out.append(n)
        return out


def spans_of(statistics: list[int], least: int) -> np.ndarray:
    """Maximal spans of symbols within matches of at least a length."""
    out: list[list[int]] = []
    for i, n in enumerate(statistics):
        if n >= least:
            if out and i - n + 1 <= out[-1][1]:
                out[-1] = [min(out[-1][0], i - n + 1), i + 1]
            else:
                out.append([i - n + 1, i + 1])
    return np.array(out, np.int64).reshape(-1, 2)


def _cover(ids: np.ndarray, contents: list[bytes], unit: repeats.Unit) -> list[np.ndarray]:
    """Streams runs in the order of ids through the automaton of all runs with smaller ids."""
    automaton, out, waiting, at = SuffixAutomaton(), [], [], None
    for i, content in zip(ids.tolist(), contents, strict=True):
        if i != at:
            for x in waiting:
                automaton.add(x)
            waiting, at = [], i
        words = content.split()
        found = automaton.statistics(words)
        out.append(spans_of(found, unit.window))
        if min(found[unit.window - 1 :]) < unit.window:  # else the automaton holds every window of it
            waiting.append(words)
    return out


def find_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text"):
    """(documents, spans): see repeats.covered."""
    docs = docs.select(F.col(scratch.quoted(id_col)).cast("long").alias("i"), F.col(scratch.quoted(text_col)).alias("t"))
    return repeats.covered(docs, repeats.Unit(True, window, min(GRAM, window)), _cover, "automaton")


def _rows(batches):
    """(id, text, text key, words, merged spans) of each row."""
    for b in batches_by_bytes(batches, "t"):
        data, off = text_buffers(b.column(1))
        keys = text_keys(data, off)
        starts, ends, first = spans(data, off)
        whole = data.tobytes()
        for k, (i, found) in enumerate(zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
            lo, hi = first[k], first[k + 1]
            yield i, whole[off[k] : off[k + 1]], starts[lo:hi] - off[k], ends[lo:hi] - off[k], repeats.row_spans(int(keys[k]), found, int(hi - lo))


def digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """Per row (doc_id, n_words, n_removed, kept_sha256)."""

    def run(batches):
        rows = []
        for i, text, starts, ends, cut in _rows(batches):
            keep = np.ones(len(starts), bool)
            for a, b in cut.tolist():
                keep[a:b] = False
            kept = b" ".join(text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))
            rows.append((i, len(starts), int((~keep).sum()), hashlib.sha256(kept).hexdigest()))
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeats.with_spans(*find_repeats(docs, window)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: bytes, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> str:
    """The text without the spans of words, everything else as it stands."""
    out, at = [], 0
    for a, b in cut.tolist():
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]]).decode()


def remove(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, its texts without the words that documents with smaller ids hold; a null text stays null."""
    _, found = find_repeats(docs, window, id_col, text_col)
    rows = docs.select(F.col(scratch.quoted(id_col)).cast("long").alias("i"), scratch.packed(docs))
    place = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            row = whole.column(1)
            for b in batches_by_bytes([pa.RecordBatch.from_arrays([whole.column(0), row.field(place), row, whole.column(2)], ["i", "t", "row", "found"])], "t"):
                null = b.column(1).is_null().to_pylist()
                made = [cut_text(text, starts, ends, cut) for _, text, starts, ends, cut in _rows([b])]
                texts = pa.array([None if x else t for x, t in zip(null, made, strict=True)], pa.string())
                fields = list(b.column(2).type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([texts if k == place else b.column(2).field(k) for k in range(len(fields))], fields=[pa.field(f.name, pa.string()) if k == place else f for k, f in enumerate(fields)])], ["row"])

    return scratch.unpacked(repeats.with_spans(rows, found).mapInArrow(run, rows.select("row").schema), docs)


def reference_spans(docs: DataFrame, reference: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): word spans of docs that a given reference (text) holds; its shards are broadcast.

    The reference is counted first and refused beyond REFERENCE_WORDS words; the corpus form has no bound.
    """
    spark = docs.sparkSession
    counted = reference.select(F.col("text").alias("t")).where("t IS NOT NULL").withColumn("n", F.size(F.split("t", "[ \\t-\\r]+")))
    if (counted.agg(F.sum("n")).first()[0] or 0) > REFERENCE_WORDS:
        raise ValueError(f"the reference has more than {REFERENCE_WORDS} words; find_repeats has no such bound")
    shards, n = [[]], 0
    for r in counted.toLocalIterator():
        if n + r["n"] > SHARD_WORDS and n:
            shards.append([])
            n = 0
        shards[-1].append(r["t"])
        n += r["n"]
    sent = [spark.sparkContext.broadcast(s) for s in shards]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or "").encode().split()
                for s in sent:
                    rows += [(i, x, y) for x, y in spans_of(_automaton(s).statistics(words), window).tolist()]
            ids, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["i", "start", "end"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, start long, end long").withColumnRenamed("i", id_col)


@lru_cache(8)
def _automaton(shard) -> SuffixAutomaton:
    out = SuffixAutomaton()
    for t in shard.value:
        out.add(t.encode().split())
    return out
