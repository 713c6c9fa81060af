"""What documents repeat of documents with smaller ids: candidates by minimizers, routed to index shards.

A window is w consecutive symbols (words or bytes) of one text. Its anchor is the smallest hash among its
k-symbol grams, so equal windows have equal anchors wherever they stand. A run is a stretch of consecutive
windows with one anchor.

1. Equal texts (by 128 bits) are one text, held by the smallest id; every other copy is covered whole.
2. All runs are dealt by anchor into buckets, packed in columns; anchors of two or more texts stay. Within
   a map task such anchors are known at once, so a passage that a third of all texts hold is one row a task.
3. The symbols of the runs that stay are dealt by anchor into shards. Equal runs are one run of the
   smallest id. Each shard builds its own index over these and says which windows start in smaller ids.
4. Covered spans go back to the documents.

No candidate is dropped: a window that stands in two texts has its anchor in both. Buckets grow in number,
not in size, with the input.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.text_kernels import TABLES, U64, batches_by_bytes, mix, sliding_min, spans, span_hashes, text_buffers, text_keys, window_hashes

#: Bytes of text for each bucket, runs a map task holds, bytes up to which a side is broadcast, and symbols a shard indexes at once.
BUCKET_BYTES, HELD, BROADCAST_BYTES, SHARD_SYMBOLS = 12 << 20, 1 << 18, 96 << 20, 1 << 19
NO_ID = 2**63 - 1
PACKED = "bucket long, payload binary"


@dataclass(frozen=True)
class Unit:
    """What windows are made of: words or bytes, symbols of a window and of an anchor gram."""

    words: bool
    window: int
    gram: int

    def symbols(self, column: pa.Array):
        """(bytes, starts, ends, first symbol of each text, symbol hashes) of a string column."""
        data, off = text_buffers(column)
        if not self.words:
            at = np.arange(len(data))
            return data, at, at + 1, off, TABLES[False][data]
        starts, ends, first = spans(data, off)
        return data, starts, ends, first, span_hashes(data, starts, ends)

    def runs(self, hashes: np.ndarray, first: np.ndarray):
        """(anchor, text, a, b): windows a to b of a text, counted from its first symbol, share an anchor."""
        w = self.window
        counts = np.maximum(np.diff(first) - w + 1, 0)
        if not counts.any():
            return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
        v = sliding_min(window_hashes(hashes, self.gram), w - self.gram + 1)
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        v = v[at + first[text]]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(v)) - 1
        return v[lo], text[lo], at[lo], at[hi]


def _by_bucket(columns: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """Arrow rows (bucket, payload): columns dealt by bucket, in their order, each part packed and compressed."""
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    moved = {k: c[order] for k, c in columns.items()}
    payloads = [zlib.compress(pickle.dumps({k: c[a:b] for k, c in moved.items()}, 5), 1) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _by_text(key: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Columns dealt by text key, small numbers stored small."""
    small = {k: c.astype(np.uint32) if k in "an" else c for k, c in columns.items()}
    order = np.argsort(key, kind="stable")
    return _by_bucket({"key": key[order]} | {k: c[order] for k, c in small.items()}, (mix(key[order].view(U64)) % U64(buckets)).astype(np.int64))


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _gathered(batches):
    """(bucket, columns) of each run of rows of one bucket; batches are sorted by bucket."""
    from quillspark.llm.components import sorted_groups

    for bucket, rows in sorted_groups(batches):
        parts = [pickle.loads(zlib.decompress(x)) for x in rows.column(1).to_pylist()]
        yield bucket, {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _candidates(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """(key, runs): the runs of each distinct text whose anchors stand in two or more texts."""

    def emit(held):
        v, key, a, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((key, v))
        v, key, a, n = v[order], key[order], a[order], n[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(v)) - 1
        several = key[first] != key[last]
        known = several[group]
        # A row for the anchor tells other tasks; the runs themselves are answered in the bucket of their text.
        heads = first[several]
        flag = np.concatenate([np.zeros((~known).sum(), np.uint8), np.ones(len(heads), np.uint8), np.full(known.sum(), 2, np.uint8)])
        pick = np.concatenate([np.flatnonzero(~known), heads, np.flatnonzero(known)])
        bucket = (mix(np.where(flag == 2, key[pick].view(U64), v[pick])) % U64(buckets)).astype(np.int64)
        small = np.uint32 if max(int(a.max(initial=0)), int(n.max(initial=0))) < 2**32 else np.uint64
        texts, index = np.unique(key[pick], return_inverse=True)
        order = np.lexsort((v[pick], bucket))
        found, at = np.unique(bucket[order], return_index=True)
        payloads = []
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            rows = order[lo:hi]
            own, local = np.unique(index[rows], return_inverse=True)
            payloads.append(zlib.compress(pickle.dumps((v[pick][rows], texts[own], local.astype(np.uint32), a[pick][rows].astype(small), n[pick][rows].astype(small), flag[rows]), 5), 1))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def deal(batches):
        held, n_held, seen = [], 0, set()
        for b in batches_by_bytes(batches, "t", 2 << 20):
            data, off = text_buffers(b.column(1))
            keys = text_keys(data, off)
            fresh = []
            for k, x in enumerate(keys.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            if not fresh:
                continue
            column = b.column(1).take(pa.array(fresh))
            _, _, _, first, hashes = unit.symbols(column)
            v, text, lo, hi = unit.runs(hashes, first)
            held.append((v, keys[fresh][text], lo, hi - lo))
            n_held += len(v)
            if n_held > HELD:
                yield emit(held)
                held, n_held = [], 0
        if n_held:
            yield emit(held)

    def meet(batches):
        from quillspark.llm.components import sorted_groups

        for _, rows in sorted_groups(batches):
            parts = [pickle.loads(zlib.decompress(x)) for x in rows.column(1).to_pylist()]
            v, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1][p[2]] for p in parts])
            a, n, flag = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (3, 4, 5))
            ready = flag == 2
            asked = np.flatnonzero(~ready)
            order = asked[np.lexsort((key[asked], v[asked]))]
            x, y, f = v[order], key[order], flag[order]
            keep = np.zeros(len(order), bool)
            if len(order):
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                last = np.append(first[1:], len(x)) - 1
                shared = (y[first] != y[last]) | (np.maximum.reduceat(f, first) > 0)
                keep = np.repeat(shared, last - first + 1) & (f == 0)
            rows = np.concatenate([np.flatnonzero(ready), order[keep]])
            if not len(rows):
                continue
            yield _by_text(key[rows], {"a": a[rows], "n": n[rows]}, buckets)

    def merge(batches):
        for _, c in _gathered(batches):
            order = np.lexsort((c["a"], c["key"]))
            texts, at = np.unique(c["key"][order], return_index=True)
            packed = np.stack([c["a"][order], c["n"][order]], 1).astype(np.uint32)
            runs = [packed[lo:hi].tobytes() for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(runs, pa.binary())], ["key", "runs"])

    rows = _dealt(docs.mapInArrow(deal, PACKED), buckets).mapInArrow(meet, PACKED)
    return _dealt(rows, buckets).mapInArrow(merge, "key long, runs binary")


def _joined(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with a stored table that states the bytes of its rows: broadcast if they are few in sum, else shuffled."""
    size = found.agg(F.sum("bytes")).first()[0] or 0
    found = found.drop("bytes")
    return rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, key, how)


def _listed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(i, name, bytes): the (key, value) pairs of each id."""
    grouped = rows.groupBy("i").agg(F.collect_list(F.struct("key", value)).alias(name), F.sum(F.octet_length(value) + 40).alias("bytes"))
    return grouped.where("i IS NOT NULL")


def covered(docs: DataFrame, unit: Unit, cover: Callable, name: str) -> tuple[DataFrame, DataFrame]:
    """(docs (i, t), spans (i, found)): found lists (key, spans) by text key for the rows of an id.

    cover(ids, contents, unit) gets distinct runs of a shard with their smallest ids, ascending, and returns
    for each an array of (start, end) symbol spans, relative to the run, of windows that start in smaller ids.
    Spans are little-endian unsigned 32-bit pairs; empty bytes stand for the whole text.
    """
    spark, began = docs.sparkSession, scratch.mark()
    scratch.few_rows(spark)
    window = unit.window

    def keyed(batches):
        for b in batches_by_bytes(batches, "t"):
            data, off = text_buffers(b.column(1))
            first = spans(data, off)[2] if unit.words else off
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (text_keys(data, off), text_keys(data, off, 1), np.diff(off), np.diff(first)))], ["i", "key", "more", "size", "symbols"])

    rows = scratch.saved(docs.mapInArrow(keyed, "i long, key long, more long, size long, symbols long"), f"{name}-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)
    classes = rows.groupBy("key", "more").agg(F.min(F.coalesce("i", F.lit(NO_ID))).alias("rep"), F.count("*").alias("n"))
    classes = scratch.saved(classes, f"{name}-classes")
    runs = _candidates(docs, unit, buckets).join(classes, "key").select(F.when(F.col("rep") < NO_ID, F.col("rep")).alias("i"), "key", "runs")
    runs = scratch.saved(runs, f"{name}-runs")
    by_id = _listed(runs, "runs", "wanted").drop("bytes")
    lone = runs.where("i IS NULL").select("key", "runs")  # texts that only rows without an id hold

    def ship(batches):
        held, n_held, done = [], 0, set()
        for b in batches_by_bytes(batches, "t"):
            ids, wanted = b.column(0).to_pylist(), b.column(2).to_pylist()
            data, off = text_buffers(b.column(1))
            keys = text_keys(data, off)
            data, starts, ends, first, hashes = unit.symbols(b.column(1))
            grams = window_hashes(hashes, unit.gram)
            whole = data.tobytes()
            for k, (i, asked) in enumerate(zip(ids, wanted, strict=True)):
                for x in asked:
                    if x["key"] != keys[k] or (i, x["key"]) in done:
                        continue
                    done.add((i, x["key"]))
                    found = np.frombuffer(x["runs"], np.uint32).reshape(-1, 2).astype(np.int64)
                    base = int(first[k])
                    for a, n in found.tolist():
                        v = grams[base + a : base + a + window - unit.gram + 1].min()
                        lo, hi = base + a, base + a + n + window
                        content = b" ".join(whole[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)) if unit.words else whole[lo:hi]
                        held.append((int(v), NO_ID if i is None else i, x["key"], a, content))
                        n_held += len(content) + 32
            if n_held > 4 << 20:
                yield packed(held)
                held, n_held = [], 0
        if held:
            yield packed(held)

    def packed(held):
        held.sort(key=lambda r: (r[0], r[4]))
        v = np.array([r[0] for r in held], U64)
        columns = {"v": v, "i": np.array([r[1] for r in held], np.int64), "key": np.array([r[2] for r in held], np.int64), "a": np.array([r[3] for r in held], np.uint32)}
        text = np.empty(len(held), object)
        text[:] = [r[4] for r in held]
        return _by_bucket(columns | {"text": text}, (mix(v) % U64(buckets)).astype(np.int64))

    def search(batches):
        for _, c in _gathered(batches):
            order = np.lexsort((c["i"], c["v"]))
            v, ids, keys, at, texts = (c[k][order] for k in ("v", "i", "key", "a", "text"))
            del c
            ends = np.append(np.flatnonzero(v[1:] != v[:-1]) + 1, len(v))
            lo, size, out = 0, 0, {}
            cut = [0]
            for e in ends.tolist():
                size += sum(map(len, texts[cut[-1] if not size else lo : e]))
                lo = e
                if size >= SHARD_SYMBOLS * (2 if unit.words else 1):
                    cut.append(e)
                    size = 0
            if cut[-1] != len(v):
                cut.append(len(v))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                shard(v[lo:hi], ids[lo:hi], keys[lo:hi], at[lo:hi], texts[lo:hi], out)
            if out:
                n = [sum(map(len, x)) for x in out.values()]
                found = np.concatenate([y for x in out.values() for y in x])
                who = np.repeat(np.array(list(out), np.int64), n, 0)
                yield _by_text(who[:, 1], {"i": who[:, 0], "a": found[:, 0], "n": found[:, 1]}, buckets)

    def merge(batches):
        for _, c in _gathered(batches):
            order = np.lexsort((c["a"], c["i"], c["key"]))
            i, key = c["i"][order], c["key"][order]
            at = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (key[1:] != key[:-1])))
            packed = np.stack([c["a"][order], c["n"][order]], 1)
            spans = [packed[lo:hi].tobytes() for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(key[at]), pa.array(spans, pa.binary())], ["i", "key", "spans"])

    def shard(v, ids, keys, at, texts, out):
        first: dict = {}
        for k in range(len(v)):
            first.setdefault((v[k], texts[k]), k)  # ids ascend within an anchor, so the first has the smallest
        lead = sorted(first.values(), key=lambda k: ids[k])
        found = dict(zip(lead, cover(ids[lead], [texts[k] for k in lead], unit), strict=True))
        for k in range(len(v)):
            head = first[(v[k], texts[k])]
            if ids[k] > ids[head]:
                n = texts[k].count(b" ") + 1 if unit.words else len(texts[k])
                rel = np.array([[0, n]])
            else:
                rel = found[head]
            if len(rel):
                out.setdefault((int(ids[k]), int(keys[k])), []).append(rel.astype(np.int64) + int(at[k]))

    shipped = docs.join(by_id, "i").select("i", "t", "wanted").mapInArrow(ship, PACKED)
    if lone.limit(1).count():
        shipped = shipped.unionByName(_lone(docs, lone).mapInArrow(ship, PACKED))
    hits = _dealt(_dealt(shipped, buckets).mapInArrow(search, PACKED), buckets).mapInArrow(merge, "i long, key long, spans binary")
    copies = rows.join(classes.where("n > 1"), ["key", "more"]).where((F.coalesce("i", F.lit(NO_ID)) > F.col("rep")) & (F.col("symbols") >= window)).select(F.coalesce("i", F.lit(NO_ID)).alias("i"), "key", F.lit(b"").alias("spans")).distinct()
    found = scratch.saved(_listed(hits.unionByName(copies), "spans", "found"), f"{name}-spans")
    scratch.cleared(spark, began, found)
    return docs, found


def _lone(docs: DataFrame, lone: DataFrame) -> DataFrame:
    """Rows without an id beside the runs wanted of their texts."""
    schema = "i long, t string, key long"

    def keyed(batches):
        for b in batches_by_bytes(batches, "t"):
            data, off = text_buffers(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text_keys(data, off), pa.int64())], ["i", "t", "key"])

    rows = docs.where("i IS NULL").mapInArrow(keyed, schema).join(lone, "key")
    return rows.select("i", "t", F.array(F.struct("key", "runs")).alias("wanted"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of docs (i, t and more) beside what was found for its id."""
    rows = docs.withColumn("j", F.coalesce("i", F.lit(NO_ID)))
    return _joined(rows, spans.withColumnRenamed("i", "j"), "j", "left").select(*docs.columns, "found")


def row_spans(key: int, found: list | None, n: int) -> np.ndarray:
    """Merged (start, end) spans of one row of n symbols; spans that touch are one."""
    mine = [x["spans"] for x in found or () if x["key"] == key]
    if not mine:
        return np.zeros((0, 2), np.int64)
    if any(not x for x in mine):
        return np.array([[0, n]])
    s = np.concatenate([np.frombuffer(x, np.uint32) for x in mine]).reshape(-1, 2).astype(np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.append(True, s[1:, 0] > reach[:-1])
    lo = np.flatnonzero(new)
    return np.stack([s[lo, 0], reach[np.append(lo[1:], len(s)) - 1]], 1)
