"""Substring dedup over bytes by suffix arrays, built with the difference-cover algorithm.

The array of a shard: suffixes at two of every three places are sorted by triples of symbols, equal names
recurse, the third class follows from those ranks, and the classes are merged by counting, for each suffix,
those of the other class before it. All steps are sorts and searches over whole columns. Adjacent suffixes
that agree in the first window bytes form a group; a place is repeated if its group holds a smaller id.

Shards are dealt by content (see repeats), so the corpus is sorted shard by shard in parallel and only text
that has a partner is sorted at all.

Defined cases: as in suffix_automaton, over the bytes of texts; null texts are empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import repeats, scratch
from quillspark.llm.text_kernels import U64, batches_by_bytes, text_buffers, text_keys

GRAM = 20


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the suffixes of s (integers from 1) in ascending order, by the difference cover {1, 2} of 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    bits = int(s.max()).bit_length()
    if 3 * bits > 63 or int(s.min()) < 1:
        values, s = np.unique(s, return_inverse=True)
        s, bits = s + 1, len(values).bit_length()
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    place = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    # for n % 3 == 1 a sentinel suffix at n parts the classes, as its triple is all zeros
    n1 = len(range(1, n + (n % 3 == 1), 3))
    triple = (t[place] << (2 * bits)) | (t[place + 1] << bits) | t[np.minimum(place + 2, n + 2)]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    step = np.append(1, (ordered[1:] != ordered[:-1]).astype(np.int64))
    names = np.empty(len(place), np.int64)
    names[order] = np.cumsum(step)
    if step.all():
        sa12 = order
    else:
        sa12 = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[place[sa12]] = np.arange(1, len(place) + 1)
    sa12 = place[sa12]
    sa12 = sa12[sa12 < n]
    wide = int(rank.max()).bit_length()
    zero = np.arange(0, n, 3)
    pair = (t[:n] << wide) | rank[1 : n + 1]
    sa0 = zero[np.argsort(pair[zero], kind="stable")]
    ones, twos = sa12[sa12 % 3 == 1], sa12[sa12 % 3 == 2]
    out = np.empty(n, np.int64)
    before12 = np.searchsorted(pair[ones], pair[sa0])
    before0 = np.zeros(len(sa12), np.int64)
    is_one = sa12 % 3 == 1
    before0[is_one] = np.searchsorted(pair[sa0], pair[ones], "right")
    if len(twos):
        if 2 * bits + wide <= 63:
            deep = lambda at: (t[at] << (bits + wide)) | (t[at + 1] << wide) | rank[at + 2]
            x, y = deep(sa0), deep(twos)
        else:
            deep = np.stack([t[np.concatenate([sa0, twos]) + k] for k in (0, 1)] + [rank[np.concatenate([sa0, twos]) + 2]])
            order = np.lexsort(deep[::-1])
            new = np.append(1, (np.diff(deep[:, order], axis=1) != 0).any(0).astype(np.int64))
            both = np.empty(len(order), np.int64)
            both[order] = np.cumsum(new)
            x, y = both[: len(sa0)], both[len(sa0) :]
        before12 = before12 + np.searchsorted(y, x)
        before0[~is_one] = np.searchsorted(x, y, "right")
    out[np.arange(len(sa0)) + before12] = sa0
    out[np.arange(len(sa12)) + before0] = sa12
    return out


def groups_of_prefixes(data: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """True where a place, in the order of the suffix array, differs in its first n bytes from the one before."""
    new = np.ones(len(places), bool)
    if len(places) < 2:
        return new
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(room, 8)
    left = np.arange(1, len(places))
    for k in range(0, n, 8):
        at = min(k, max(0, n - 8))
        a, b = eight[places[left] + at], eight[places[left - 1] + at]
        same = (a[:, : min(8, n)] == b[:, : min(8, n)]).all(1)
        left = left[same]
    new[left] = False
    return new


def _cover(ids: np.ndarray, contents: list[bytes], unit: repeats.Unit) -> list[np.ndarray]:
    """Spans of each run whose windows also start in runs of smaller ids."""
    n = np.array([len(c) for c in contents], np.int64)
    at = np.cumsum(n + 1) - (n + 1)
    data = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + len(contents) + 1
    symbols[at + n] = np.arange(1, len(contents) + 1)  # every run has an end of its own
    array = suffix_array(symbols)
    run = np.repeat(np.arange(len(contents)), n + 1)
    array = array[at[run[array]] + n[run[array]] - array >= unit.window]
    new = groups_of_prefixes(data, array, unit.window)
    first = np.flatnonzero(new)
    who = ids[run[array]]
    least = np.minimum.reduceat(who, first) if len(first) else who
    hit = np.sort(array[who > least[np.cumsum(new) - 1]])
    out = [np.zeros((0, 2), np.int64)] * len(contents)
    if len(hit):
        owner = run[hit]
        edge = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1]))
        lo = np.flatnonzero(edge)
        hi = np.append(lo[1:], len(hit)) - 1
        s = np.stack([hit[lo] - at[owner[lo]], hit[hi] - at[owner[lo]] + unit.window], 1)
        cuts = np.searchsorted(owner[lo], np.arange(len(contents) + 1))
        for k in np.unique(owner[lo]).tolist():
            out[k] = s[cuts[k] : cuts[k + 1]]
    return out


def find_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text"):
    """(documents, spans): see repeats.covered."""
    docs = docs.select(F.col(scratch.quoted(id_col)).cast("long").alias("i"), F.col(scratch.quoted(text_col)).alias("t"))
    return repeats.covered(docs, repeats.Unit(False, window, min(GRAM, window)), _cover, "suffixes")


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches_by_bytes(batches, "t"):
            data, off = text_buffers(b.column(1))
            keys, whole, rows = text_keys(data, off), data.tobytes(), []
            for k, (i, found) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                text, kept, at = whole[off[k] : off[k + 1]], [], 0
                cut = repeats.row_spans(int(keys[k]), found, len(text))
                for x, y in cut.tolist():
                    kept.append(text[at:x])
                    at = y
                kept = b"".join([*kept, text[at:]])
                rows.append((i, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return repeats.with_spans(*find_repeats(docs, window)).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
