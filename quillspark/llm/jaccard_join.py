"""Exact join of texts by the Jaccard similarity of their word n-gram sets, with signature trees.

1. Every text becomes the set of its distinct n-word shingles (64-bit hashes); rows of equal sets are one class by
   a 128-bit fingerprint and the set size, and only a class goes on, as one node.
2. Two sets as similar as asked share an element among their first len - ceil(percent * len / 100) + 1, in any one
   order of all elements. The order here is that of their counts in a sample of the corpus, the rarest first (the
   sample decides speed, not results): exact counts of the most frequent, rough ones by cells of hashes of the rest,
   in a table that grows with the corpus. So passages and phrases that many texts share tie nobody. Elements that
   one class alone has are dropped where they meet; a map task that knows an element as shared sends one row to say so.
3. Star rounds: each node meets the node with which it shares most elements, among the smallest (then the largest)
   node of each element. What is similar enough is linked, and elements whose nodes are all in one component by
   now need no more work: most near copies end here, with rows in proportion to the nodes. Rounds go on while at
   least half of the pairs link.
4. The rest. Elements of few nodes count the shared elements of their pairs; a pair of sizes x, y needs
   ceil(p (x + y) / (100 + p)) - ceil(p max(x, y) / 100) + 1 of them. Elements of many nodes build signature trees over
   bitmaps of their nodes' sets; nodes that share many such elements, as those of a cluster do, meet in one of them.
   Only what survives is closed into blocks, each of which is joined by a tree.
5. A signature tree's nodes hold the OR of their sets' token bitmaps, the range of set sizes, the fewest elements that
   the bitmap leaves out, and the range of labels; a dual traversal drops node pairs whose sizes or whose largest
   possible overlap rule out a link, or that are in one component already. The rest is verified on whole sets.
6. Stars and blocks are dealt in pages of bounded rows and bytes; of large blocks each page meets itself and a pivot
   page first, then only pages whose members are not yet all in one component meet. Members of the largest component
   of a block or element have pages of their own, which don't meet each other.

Results don't depend on pages, samples or the order of rows. Overlaps are counted on 64-bit hashes.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; texts of fewer than n words
have their whole word sequence as the one shingle; very long texts are taken whole; rows with a null id link with
nothing and have no component; rows that share an id are linked each by its own text, and repeated rows have equal
results; an empty table gives no rows; columns of any name stay as they are.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.components import Forest, components, sorted_groups
from quillspark.llm.text_kernels import U64, batches_by_bytes, mix, text_buffers, window_hashes, words

#: Elements a map task holds at once, and texts' bytes for each bucket of elements.
HELD, BUCKET_BYTES = 1 << 18, 8 << 20
#: Share of the texts (but at least so many bytes) whose frequent elements go last, and the most of these.
SAMPLE_SHARE, SAMPLE_BYTES, COMMON = 1 / 8, 16 << 20, 1 << 18
#: Texts' bytes for each cell of the table of rough counts, and the most cells (of a byte each, broadcast) as a power of two.
CELL_BYTES, CELLS = 256, 25
#: Rows and bytes of a page, children of a tree node, nodes of an element up to which its pairs are counted.
PAGE, PAGE_BYTES, FANOUT, FEW = 256, 4 << 20, 8, 24
#: Bitmaps that take the room of one text, and pairs of tree nodes whose children are made at once.
BITMAPS, PARENTS = 4, 1 << 12
#: Rows up to which a side is broadcast (about 50 bytes each), and fingerprints a map task remembers.
BROADCAST_ROWS, SEEN = 400_000, 1 << 20
#: Bits of the filter that keeps texts nobody asks for out of a shuffle (16 MB, broadcast).
FILTER_BITS = 1 << 27


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, _, first, hashes = words(column, fold=True)
    grams = window_hashes(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a))
        else:
            out.append(hashes[:0])
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    return tuple(int(mix(s ^ U64(seed)).sum(dtype=U64).view(np.int64)) for seed in (0x51ED270B, 0xA0761D64))


def prefix(s: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """The first elements of a set, of which similar sets share one: by the rough count of their cell and by hash, then the common ones by rank."""
    if cells is not None:
        s = s[np.argsort(cells[s >> U64(65 - len(cells).bit_length())], kind="stable")]
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        hit = common[at] == s
        if hit.any():
            s = np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]], kind="stable")]])
    return s[: len(s) + (-percent * len(s) // 100) + 1]


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document: id, text key, set size, fingerprint, bytes of the text."""

    def run(batches):
        for b in batches_by_bytes(batches, "t"):
            sets = shingle_sets(b.column(2), n)
            prints = [fingerprint(s) for s in sets]
            size = np.diff(text_buffers(b.column(2))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints], size))], ["i", "k", "n", "f1", "f2", "size"])

    return docs.mapInArrow(run, "i long, k long, n long, f1 long, f2 long, size long")


def _common(docs: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, ranks, cells) of what several texts of a sample have, the most frequent last: at most COMMON elements, those of the largest counts, and the rough counts of all."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(total, 1)))

    def run(batches):
        held, n_held, seen = [], 0, set()
        for b in batches_by_bytes(batches, "t"):
            for s in shingle_sets(b.column(0), n):
                p = fingerprint(s)
                if p not in seen:
                    seen.add(p)
                    held.append(s)
                    n_held += len(s)
            if n_held > HELD:
                yield counted(held)
                held, n_held, seen = [], 0, set()
        if n_held:
            yield counted(held)

    def counted(held):
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

    picked = docs.where(F.pmod(F.xxhash64(F.lit(7), "k"), F.lit(1 << 30)) < int(share * (1 << 30))).select("t")
    counts = scratch.saved(picked.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1"), "jaccard-common")
    least, kept = 1 << 62, 0
    for r in sorted(counts.groupBy("c").agg(F.count("*").alias("n")).collect(), reverse=True):  # a row for each count
        kept += r["n"]
        if kept > COMMON:
            break
        least = r["c"]
    found = counts.where(F.col("c") >= least).toArrow()
    h, c = found["h"].to_numpy().view(U64), found["c"].to_numpy()
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(len(h))
    return h[order], rank[order], _cells(counts, min(CELLS, max(16, (total // CELL_BYTES).bit_length())))


def _cells(counts: DataFrame, bits: int) -> np.ndarray:
    """The largest count of each cell of hashes, as eighths of its power of two; a task makes a block of 65,536 cells."""

    def run(batches):
        for block, rows in sorted_groups(batches):
            held = np.zeros(1 << 16, np.uint8)
            np.maximum.at(held, rows.column(1).to_numpy(), np.minimum(255, 8 * np.log2(rows.column(2).to_numpy())).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["block", "cells"])

    cell = F.shiftrightunsigned("h", 64 - bits)
    rows = counts.select(F.shiftright(cell, 16).alias("block"), cell.bitwiseAND(F.lit(65535)).alias("at"), "c")
    blocks = scratch.saved(rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, cells binary"), "jaccard-cells")
    out = np.zeros(1 << bits, np.uint8)
    for r in blocks.toLocalIterator():
        out[r["block"] << 16 :][: 1 << 16] = np.frombuffer(r["cells"], np.uint8)
    return out


def _shared(docs: DataFrame, n: int, percent: int, buckets: int, total: int) -> DataFrame:
    """(element, f): the prefix elements that several sets have, beside the first half of each set's fingerprint."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, n, total))

    def emit(held):
        e = mix(np.concatenate([h[1] for h in held]))
        f = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
        order = np.lexsort((f, e))
        e, f = e[order], f[order]
        new = np.append(True, e[1:] != e[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(e)) - 1
        several = f[first] != f[last]
        known = several[np.cumsum(new) - 1]
        ask = np.sort(np.concatenate([np.flatnonzero(~known), first[several]]))
        own, local = np.unique(f, return_inverse=True)
        local = local.astype(np.uint32)
        rows = []
        bucket = ((e[ask] >> U64(32)) * U64(buckets)) >> U64(32)  # ascends with the element
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64)).tolist()
        for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if hi > lo:
                mine = ask[lo:hi]
                which, at = np.unique(local[mine], return_inverse=True)
                rows.append((b, pickle.dumps((True, e[mine], at.astype(np.uint32), own[which], known[mine]), 5)))
        told = np.flatnonzero(known)
        if len(told):  # known as shared here: they need no bucket, and go on from anywhere
            b = int(mix(e[told[:1]])[0] % U64(buckets))
            rows.append((b, pickle.dumps((False, e[told], local[told], own, None), 5)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    def deal(batches):
        common, rank, cells = sent.value
        held, n_held, seen = [], 0, set()
        for b in batches_by_bytes(batches, "t"):
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(2), n), strict=True):
                if i is None or not len(s) or (p := fingerprint(s)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(p)
                held.append((p[0], prefix(s, percent, common, rank, cells)))
                n_held += len(held[-1][1])
            if n_held > HELD:
                yield emit(held)
                held, n_held = [], 0
        if held:
            yield emit(held)

    def meet(batches):
        for _, rows in sorted_groups(batches):
            es, fs, flags = [], [], []
            for x in rows.column(1).to_pylist():
                asked, e, at, own, told = pickle.loads(x)
                if asked:
                    es.append(e)
                    fs.append(own[at])
                    flags.append(told)
                else:
                    yield made(e, own[at])
            if es:
                e, f, told = np.concatenate(es), np.concatenate(fs), np.concatenate(flags)
                order = np.lexsort((f, e))
                e, f, told = e[order], f[order], told[order]
                first = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
                last = np.append(first[1:], len(e)) - 1
                shared = (f[first] != f[last]) | np.maximum.reduceat(told, first)
                keep = np.repeat(shared, last - first + 1) & ~told
                yield made(e[keep], f[keep])

    def made(e, f):
        return pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(f)], ["element", "f"])

    rows = docs.mapInArrow(deal, "bucket long, payload binary")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "element long, f long")


def bitmap(s: np.ndarray) -> bytes:
    """A bitmap of half of a set's elements, with at least a bit for each; its width is a power of two."""
    half = s[(s >> U64(40)) & U64(1) == 0]
    row = np.zeros(max(64, 1 << (len(s) - 1).bit_length()), bool)
    row[(half & U64(len(row) - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").tobytes()


class SignatureTree:
    """A tree over sets: nodes hold OR-combined token bitmaps, the ranges of sizes and labels, and the most elements left out."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        """bits: a row of 64-bit words for each set."""
        lost = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        _, which, count = np.unique(labels, return_inverse=True, return_counts=True)
        group = np.where(count[which] > FANOUT, which, -1)  # members of large components stand together
        order = np.lexsort((bits[:, 0], sizes, group))
        level = (bits[order], sizes[order], sizes[order], lost[order], labels[order], labels[order])
        self.order, self.levels = order, [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), FANOUT)
            level = tuple(f.reduceat(x, at, 0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)


def tree_of(sets: list[np.ndarray], labels: np.ndarray) -> SignatureTree:
    """The tree of whole sets; one width of bitmaps serves all."""
    sizes = np.array([len(s) for s in sets])
    width = min(1 << 14, 64 << max(0, int(4 * np.median(sizes)) // 64).bit_length())
    rows = np.zeros((len(sets), width // 8), np.uint8)
    for k, s in enumerate(sets):
        row = np.zeros(width, bool)
        row[(s & U64(width - 1)).astype(np.int64)] = True
        rows[k] = np.packbits(row)
    return SignatureTree(rows.view(U64), sizes, labels)


def candidate_pairs(x: SignatureTree, percent: int, apart: bool):
    """Pairs of set numbers (arrays) that survive the dual traversal of a tree with itself; apart: of different labels."""
    frontier = (np.zeros(1, np.int64), np.zeros(1, np.int64))
    child = np.arange(FANOUT)

    def survivors(depth, a, b):
        bits, low, high, lost, least, most = x.levels[depth]
        if depth < len(x.levels) - 1:
            a = (a[:, None] * FANOUT + child)[:, :, None].repeat(FANOUT, 2).ravel()
            b = (b[:, None] * FANOUT + child)[:, None, :].repeat(FANOUT, 1).ravel()
            ok = (a <= b) if depth else (a < b)
            ok &= (a < len(low)) & (b < len(low))
            a, b = a[ok], b[ok]
        ok = (high[a] * 100 >= low[b] * percent) & (high[b] * 100 >= low[a] * percent)
        if apart:
            ok &= ~((least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b]))
        a, b = a[ok], b[ok]
        keep = np.zeros(len(a), bool)
        chunk = max(1, (1 << 21) // bits.shape[1])
        for lo in range(0, len(a), chunk):
            p, q = a[lo : lo + chunk], b[lo : lo + chunk]
            # Common elements: one for each common bit, and of those left out at most the fewer of both.
            common = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64) + np.minimum(lost[p], lost[q])
            common = np.minimum(common, np.minimum(high[p], high[q]))
            keep[lo : lo + chunk] = common * (100 + percent) >= percent * (low[p] + low[q])
        return a[keep], b[keep]

    for depth in range(len(x.levels) - 1, -1, -1):  # PARENTS pairs at once, so that memory is for what survives
        parts = [survivors(depth, *(f[lo : lo + PARENTS] for f in frontier)) for lo in range(0, len(frontier[0]), PARENTS)]
        frontier = tuple(np.concatenate(f) for f in zip(*parts, strict=True)) if parts else frontier
    if len(x.levels) == 1:
        return frontier[0][:0], frontier[1][:0]
    return x.order[frontier[0]], x.order[frontier[1]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> int | None:
    """The overlap of two sets if they are similar enough."""
    o = overlap(a, b)
    return o if 100 * o >= percent * (len(a) + len(b) - o) else None


def _join_tasks(rows: DataFrame, n: int, percent: int, spanning: bool) -> DataFrame:
    """rows (task, node, label, t) -> links (a, b, overlap, n_union) within each task; rows of a task are few.

    With spanning, pairs that are already in one component, by labels or by links found, are not verified.
    """

    def run(batches):
        for _, rows in sorted_groups(batches):
            nodes, at = np.unique(rows.column(1).to_numpy(), return_index=True)  # repeated rows are one node
            labels = rows.column(2).to_numpy()[at]
            sets = []
            for b in batches_by_bytes(rows.select(["t"]).take(pa.array(at)).to_batches(), "t"):
                sets += shingle_sets(b.column(0), n)
            forest, out = Forest(), []
            first, second = candidate_pairs(tree_of(sets, labels), percent, spanning) if len(nodes) > 1 else ((), ())
            ids, labels = nodes.tolist(), labels.tolist()
            for i, j in zip(np.asarray(first).tolist(), np.asarray(second).tolist(), strict=True):
                if spanning and forest.find(labels[i]) == forest.find(labels[j]):
                    continue
                if (o := linked(sets[i], sets[j], percent)) is not None:
                    forest.join(labels[i], labels[j])
                    a, b = sorted((ids[i], ids[j]))
                    out.append((a, b, o, len(sets[i]) + len(sets[j]) - o))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "overlap", "n_union"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, overlap long, n_union long")


def asked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The docs whose (i, k) is among those of rows, and some few others whose hash shares a bit with one of them."""
    bit = F.pmod(F.xxhash64("i", "k"), F.lit(FILTER_BITS))
    at = rows.select(bit.alias("_bit")).select(F.bitmap_bucket_number("_bit").alias("_bucket"), F.bitmap_bit_position("_bit").alias("_at"))
    bits = scratch.saved(at.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), "jaccard-asked")
    met = docs.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).join(F.broadcast(bits), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("CAST(_at DIV 8 AS INT) + 1"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.expr("CAST(_at % 8 AS INT)")) == 1).select(*docs.columns)


class _Texts:
    """The texts of classes, for rows that name their nodes."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes.select("node", "i", "k")

    def of(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (node, ...) beside the text t of the node; rows are broadcast if they are few, else both sides are shuffled, of the texts those alone that rows may name."""
        rows = scratch.saved(rows.join(self.classes, "node"), name)
        if rows.count() <= BROADCAST_ROWS:
            return self.docs.join(F.broadcast(rows), ["i", "k"]).drop("i", "k")
        return asked(self.docs, rows).join(rows, ["i", "k"]).drop("i", "k")


def _star(members: DataFrame, classes: DataFrame, texts: _Texts, n: int, percent: int, largest: bool) -> tuple[int, DataFrame]:
    """(pairs, links): links of each node with the node it shares most elements with, of the first (or last) nodes of elements; members (element, node, label, n).

    Pairs that share less than half of what a link needs are left to the exact steps: they share more elements at most by others' nodes.
    """
    pick = F.max if largest else F.min
    heads = members.groupBy("element").agg(pick(F.struct(F.col("node").alias("head"), F.col("label").alias("head_label"), F.col("n").alias("head_n"))).alias("x"), F.count("*").alias("m")).where("m > 1")
    heads = scratch.saved(heads.select("element", "x.*"), "jaccard-heads")
    met = members.join(heads, "element").where("label <> head_label").groupBy("node", "label", "n", "head", "head_label", "head_n").agg(F.count("*").alias("c"))
    met = met.where(_similar_sizes("n", "head_n", percent) & (2 * F.col("c") >= _least("n", "head_n", percent)))
    best = met.groupBy("node").agg(F.max_by(F.struct("label", "head", "head_label"), F.struct("c", "head")).alias("x")).select("node", "x.*")
    best = scratch.saved(best.join(classes.select("node", "size"), "node"), "jaccard-stars")
    per = best.groupBy("head").agg(F.greatest(F.ceil(F.count("*") / PAGE), F.ceil(F.sum("size") / PAGE_BYTES)).alias("pages"))
    paged = best.join(scratch.saved(per, "jaccard-pages"), "head").withColumn("task", F.xxhash64("head", F.pmod(F.xxhash64("node"), "pages")))
    centres = paged.select(F.col("head").alias("node"), "task", F.col("head_label").alias("label")).distinct()
    tasks = texts.of(paged.select("node", "task", "label").unionByName(centres), "jaccard-star").select("task", "node", "label", "t")
    return best.count(), scratch.saved(_join_tasks(tasks, n, percent, True), "jaccard-links")


def _similar_sizes(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _least(a: str, b: str, percent: int):
    """Prefix elements that linked sets of these sizes share at least."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent)) - F.ceil(percent * F.greatest(a, b) / 100) + 1


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (element, node, n, label, m) of elements (of m nodes) whose nodes are not yet all in one component."""
    found = components(links.select("a", "b"), "jaccard-found")
    rows = members.join(found, "node", "left").select("element", "node", "n", F.coalesce("component", "node").alias("label"))
    rows = scratch.saved(rows, "jaccard-labels")
    open_ = rows.groupBy("element").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x <> y").select("element", "m")
    return scratch.saved(rows.join(scratch.saved(open_, "jaccard-open"), "element"), "jaccard-rest")


def _counted(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of elements of few nodes that share enough elements; elements of many nodes count as shared by both."""
    many = rest.where(F.col("m") > FEW).groupBy("node").agg(F.count("*").alias("many"))
    rows = rest.where(F.col("m") <= FEW).join(many, "node", "left").select("element", "node", "label", "n", F.coalesce("many", F.lit(0)).alias("many"))
    rows = scratch.saved(rows, "jaccard-few")
    other = rows.select("element", *(F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "many")))
    pairs = rows.join(other, "element").where("node < node_b AND label <> label_b").where(_similar_sizes("n", "n_b", percent))
    counted = pairs.groupBy("node", "node_b", "n", "n_b", "many", "many_b").agg(F.count("*").alias("c"))
    return counted.where(F.col("c") + F.least("many", "many_b") >= _least("n", "n_b", percent)).select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def _treed(rest: DataFrame, texts: _Texts, n: int, percent: int, page: int) -> DataFrame:
    """Edges (a, b) that connect whatever the signature trees of elements of many nodes leave as possible links."""
    rows = rest.where(F.col("m") > FEW)
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "a long, b long")
    rows = scratch.saved(_once(rows), "jaccard-many")

    def bitmaps(batches):
        for b in batches_by_bytes(batches, "t"):
            sets = shingle_sets(b.column(1), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], ["node", "n", "bits"])

    bits = texts.of(rows.select("node").distinct(), "jaccard-mapped").select("node", "t").mapInArrow(bitmaps, "node long, n long, bits binary")
    bits = scratch.saved(bits.dropDuplicates(["node"]), "jaccard-bitmaps")
    rows = rows.drop("n", "m").join(bits, "node").withColumn("band", _band(percent))

    def run(batches):
        for _, t in sorted_groups(batches):
            nodes, labels, sizes = (t[c].to_numpy() for c in ("node", "label", "n"))
            forest, packed = Forest(), t["bits"].to_pylist()
            width = np.array([len(x) for x in packed])
            for w in np.unique(width).tolist():  # wider bitmaps that similar sets can have are folded
                mine = np.flatnonzero((width >= w) & (width * percent <= 200 * w))
                rows = np.stack([np.bitwise_or.reduce(np.frombuffer(packed[k], U64).reshape(-1, w // 8), 0) for k in mine.tolist()])
                for i, j in zip(*(mine[x].tolist() for x in candidate_pairs(SignatureTree(rows, sizes[mine], labels[mine]), percent, True)), strict=True):
                    forest.join(int(nodes[i]), int(nodes[j]))
            if forest.up:
                yield forest.rows()

    tasks = _paged(rows.select("element", "node", "label", "n", "bits", "band", "code"), "element", BITMAPS * page, F.octet_length("bits"))
    return tasks.select("task", "node", "label", "n", "bits").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _once(rows: DataFrame) -> DataFrame:
    """The rows (element, node, label, n, m) of elements where some pair of nodes must meet, beside the node's code.

    Elements of a cluster have nearly the same nodes, which need not meet in each. Two nodes meet in the element of
    most nodes of both, if that is one; else wherever they share one. The code has a bit for the nodes that have met
    so in one other element, and a bit for those of one component: of each, that of most of the element's nodes. No
    two nodes that share a bit need to meet here.
    """
    first = rows.groupBy("node").agg(F.max(F.struct("m", "element")).alias("x")).select("node", F.col("x.element").alias("first"))
    rows = scratch.saved(rows.join(first, "node"), "jaccard-first")

    def most(column):
        counts = rows.groupBy("element", column).agg(F.count("*").alias("c")).groupBy("element")
        return counts.agg(F.max(F.struct("c", column)).alias(f"most_{column}"))

    per = most("first").join(most("label"), "element")
    met = (F.col("first") == F.col("most_first.first")) & (F.col("first") != F.col("element"))
    code = F.when(met, 1).otherwise(0) + F.when(F.col("label") == F.col("most_label.label"), 2).otherwise(0)
    open_ = (F.col("most_first.c") < F.col("m")) | (F.col("most_first.first") == F.col("element"))
    return rows.join(per, "element").where(open_).select("element", "node", "label", "n", "m", code.alias("code"))


def _band(percent: int):
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / float(np.log(100 / percent))).cast("long")


def _pages(rows: DataFrame, key: str, page: int, size) -> tuple[DataFrame, DataFrame]:
    """(rows with page, pairs of pages that must meet (key, band_a, page_a, band_b, page_b)) of groups by key; bands are of sizes.

    Rows of a page have one code, the last two bits of its number; pages that share a bit of it need not meet.
    """
    per = rows.groupBy(key, "band", "code").agg(F.greatest(F.ceil(F.count("*") / page), F.ceil(F.sum(size) / PAGE_BYTES)).alias("pages"))
    paged = rows.join(scratch.saved(per, "jaccard-per-band"), [key, "band", "code"])
    paged = paged.withColumn("page", 4 * F.pmod(F.xxhash64("node"), "pages") + F.col("code")).drop("pages", "code")
    paged = scratch.saved(paged, "jaccard-pages")
    pages = paged.select(key, "band", "page").distinct()
    first = pages.select(key, F.col("band").alias("band_a"), F.col("page").alias("page_a"))
    # bands that differ by one hold all sizes within the threshold; one more covers rounding at the borders
    second = pages.select(key, F.explode(F.array("band", F.col("band") + 1, F.col("band") + 2)).alias("band_a"), F.col("band").alias("band_b"), F.col("page").alias("page_b"))
    met = second.join(first, [key, "band_a"]).where("(band_a > band_b OR page_a >= page_b) AND (page_a & page_b & 3) = 0")
    return paged, met.withColumn("task", F.xxhash64(key, "band_a", "page_a", "band_b", "page_b"))


def _dealt(pairs: DataFrame, paged: DataFrame, key: str) -> DataFrame:
    """The rows of both pages of each pair, beside the task of the pair."""
    side = lambda s: pairs.select("task", key, F.col(f"band_{s}").alias("band"), F.col(f"page_{s}").alias("page"))
    return paged.join(side("a").unionByName(side("b")).distinct(), [key, "band", "page"])


def _paged(rows: DataFrame, key: str, page: int, size) -> DataFrame:
    """Rows with a task: groups of few rows and bytes are one task, larger ones every pair of pages near in size."""
    whole = rows.groupBy(key).agg((F.count("*") > page).alias("over"), (F.sum(size) > PAGE_BYTES).alias("heavy"))
    rows = rows.join(scratch.saved(whole.select(key, (F.col("over") | F.col("heavy")).alias("large")), "jaccard-groups"), key)
    small = rows.where("NOT large").withColumn("task", F.xxhash64(key)).drop("large", "code")
    paged, met = _pages(rows.where("large").drop("large"), key, page, size)
    return small.unionByName(_dealt(met, paged, key).select(*small.columns))


def _links(members: DataFrame, texts: _Texts, n: int, percent: int, page: int, spanning: bool) -> DataFrame:
    """Verified links between the members (node, label, block, n, size) of blocks; spanning: enough of them to join all components."""
    counted = members.groupBy("block").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    counted = scratch.saved(counted.select("block", ((F.col("m") > page) | (F.col("bytes") > PAGE_BYTES)).alias("large")), "jaccard-blocks")
    rows = scratch.saved(members.join(counted, "block").withColumn("band", _band(percent)), "jaccard-block-rows")

    def joined(tasks, name):
        return scratch.saved(_join_tasks(texts.of(tasks.select("node", "task", "label"), name).select("task", "node", "label", "t"), n, percent, spanning), "jaccard-links")

    links = joined(rows.where("NOT large").withColumn("task", F.col("block")), "jaccard-small")
    large = rows.where("large")
    if not large.isEmpty():
        most = large.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
        large = large.join(scratch.saved(most, "jaccard-most"), "block").withColumn("code", F.when(F.col("label") == F.col("most"), 2).otherwise(0))
        paged, met = _pages(large.select("node", "label", "block", "band", "size", "code"), "block", page, F.col("size"))
        met = scratch.saved(met, "jaccard-met")
        if spanning:
            pivot = "page_b = 0 OR (band_a = band_b AND page_a = page_b)"
            links = links.unionByName(joined(_dealt(met.where(pivot), paged, "block"), "jaccard-pivot"))
            more = links.select("a", "b").unionByName(paged.select(F.col("label").alias("a"), F.col("node").alias("b")))
            found = components(more, "jaccard-pivots")
            paged = scratch.saved(paged.join(found, "node", "left").withColumn("label", F.coalesce("component", "label")).drop("component"), "jaccard-relabelled")
            even = paged.groupBy("block", "band", "page").agg(F.min("label").alias("x"), F.max("label").alias("y"))
            side = lambda s: even.select("block", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "page", "x", "y")))
            met = met.where(f"NOT ({pivot})").join(side("a"), ["block", "band_a", "page_a"]).join(side("b"), ["block", "band_b", "page_b"]).where("NOT (x_a = y_a AND x_b = y_b AND x_a = x_b)")
        links = links.unionByName(joined(_dealt(met, paged, "block"), "jaccard-large"))
    return links


def _linked(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, page: int, spanning: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): the profile of all rows, classes of equal sets, links (a, b, overlap, n_union) of their nodes."""
    spark = docs.sparkSession
    scratch.few_rows(spark)
    docs = docs.select(F.col(scratch.quoted(id_col)).cast("long").alias("i"), F.xxhash64(F.col(scratch.quoted(text_col))).alias("k"), F.col(scratch.quoted(text_col)).alias("t"))
    rows = scratch.saved(_profile(docs, n), "jaccard-profile")
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)
    classes = rows.where("i IS NOT NULL AND n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("i", "k", "size")).alias("r"), F.count("*").alias("c"))
    classes = scratch.saved(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", "r.*", "c"), "jaccard-classes")
    links = spark.createDataFrame([], "a long, b long, overlap long, n_union long")
    if percent >= 100:  # equal sets are one class already, and no others link
        return rows, classes, links
    texts, began, kept = _Texts(docs, classes), scratch.mark(), []
    shared = scratch.saved(_shared(docs, n, percent, buckets, total), "jaccard-shared")  # its shuffle files go before the next are made
    members = shared.join(classes.select(F.col("f1").alias("f"), "node", "n"), "f").select("element", "node", "n").distinct()
    members = scratch.saved(members.withColumn("label", F.col("node")), "jaccard-members")
    rest, largest, more = members, False, spanning
    while more and not rest.isEmpty():
        stars, found = _star(rest, classes, texts, n, percent, largest)
        links = links.unionByName(found)
        kept.append(found)
        rest = _labelled(rest.select("element", "node", "n"), links)
        scratch.cleared(spark, began, rest, *kept)
        more, largest = 0 < stars <= 2 * found.count(), not largest
    if not spanning:
        rest = _labelled(rest.select("element", "node", "n"), links)
    if rest.isEmpty():
        return rows, classes, links
    edges = scratch.saved(_counted(rest, percent).unionByName(_treed(rest, texts, n, percent, page)).distinct(), "jaccard-edges")
    if edges.isEmpty():
        return rows, classes, links
    blocks = components(edges, "jaccard-closed")
    labels = rest.select("node", "label").distinct()
    found = scratch.saved(blocks.withColumnRenamed("component", "block").join(labels, "node").join(classes.select("node", "n", "size"), "node"), "jaccard-candidates")
    return rows, classes, links.unionByName(_links(found, texts, n, percent, page, spanning))


def _components(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, page: int) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): labels (f1, f2, n, ci, ck) name the smallest (id, text key) of the component of each class that several rows share."""
    began = scratch.mark()
    rows, classes, links = _linked(docs, n, percent, id_col, text_col, page, True)
    found = components(links.select("a", "b"), "jaccard-result")
    whole = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min(F.struct("i", "k")).alias("least"), F.sum("c").alias("rows")).where("rows > 1")
    labels = whole.join(least, "component").select("f1", "f2", "n", F.col("least.i").alias("ci"), F.col("least.k").alias("ck"))
    labels = scratch.saved(labels, "jaccard-components")
    scratch.cleared(docs.sparkSession, began, rows, labels)
    return rows, labels


def join_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE) -> DataFrame:
    """Per row (id, n_shingles, component_id): the smallest id reachable by links of at least percent similarity."""
    rows, labels = _components(docs, n, percent, id_col, text_col, page)
    out = rows.join(labels, ["f1", "f2", "n"], "left").withColumn("ci", F.when(F.col("i").isNotNull(), F.coalesce("ci", "i")))
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("ci").alias("component_id"))


def join_pairs(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE) -> DataFrame:
    """All links (a, b, overlap, n_union), a < b, between the smallest ids of classes of equal sets."""
    _, classes, links = _linked(docs, n, percent, id_col, text_col, page, False)
    name = lambda c: classes.select(F.col("node").alias(c), F.col("i").alias(f"{c}_id"))
    named = links.distinct().join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "overlap", "n_union")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE) -> DataFrame:
    """docs with one row of each component: that of the smallest id, then text key; rows with a null id or no words all stay."""
    rows, labels = _components(docs, n, percent, id_col, text_col, page)
    gone = rows.where("i IS NOT NULL").join(labels, ["f1", "f2", "n"]).where("i <> ci OR k <> ck").select("i", "k").distinct()
    gone = scratch.saved(gone, "jaccard-gone")
    whole = docs.select(F.col(scratch.quoted(id_col)).cast("long").alias("i"), F.xxhash64(F.col(scratch.quoted(text_col))).alias("k"), scratch.packed(docs))
    kept = whole.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["i", "k"], "left_anti")
    twice = scratch.saved(rows.where("i IS NOT NULL AND n > 0").groupBy("i", "k").count().where("count > 1").select("i", "k"), "jaccard-twice")
    if twice.limit(1).count():  # repeated rows: the one that comes first as JSON stays
        once = kept.join(twice, ["i", "k"]).groupBy("i", "k").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(twice, ["i", "k"], "left_anti").select("row").unionByName(once.select("row"))
    return scratch.unpacked(kept, docs)
