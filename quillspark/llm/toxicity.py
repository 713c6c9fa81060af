"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of letters, small). A text is its vector of all its terms, (1 + ln tf) * idf * (PLAIN + |z|)
at unit length. z is the standard score of the number of toxic examples with the term, given how many examples
have it: plain TF-IDF looks at what a text is about, and the factor lets terms that tell the classes apart weigh
more (on sf0.1 held-out recall at 0.7 is 0.20 without it). No term of an example is left out, so any text that
shares a word with an example has neighbours, and a copy of an example has it at cosine 1.

The index keeps the postings of each term in the order of entries, entries in blocks of BLOCK, and the largest
weight of each term in each block. A query adds up its terms' largest weights by block, first scores the blocks of
the largest bounds, then every block whose bound reaches the k-th cosine: the result equals comparing with all.
Entries as near as the k-th all vote, so ties need no rule. A vote weighs 1 / (1.05 - cosine), the training share
of toxic examples has BASE_VOTE votes; a logistic curve, fitted to the votes that each example gets from the
others, makes the weighted share a probability. Evidence names the nearest examples.

Labels, languages, sources and ids are no inputs of a score. At most MAX_LABELLED labelled texts of at most
TRAIN_BYTES in sum train: all, or those of the smallest hashes of their ids. This bounds the index that is
broadcast. All documents are scored, whole.

Defined cases: null and empty texts have no terms and score as the base share; very long texts are scored whole;
repeated rows score alike, and labelled rows of one text are one entry with a vote each; a document without an id
is not held out; null labels are left out and a document labelled both ways is toxic; without toxic examples or
without clean ones there is no calibration; an empty table gives no rows; columns of any name stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillspark.llm import scratch
from quillspark.llm.text_kernels import LETTERS, batches_by_bytes, lowered, span_hashes, spans, text_buffers

#: Labelled texts that train, and their bytes.
MAX_LABELLED, TRAIN_BYTES = 4096, 32 << 20
#: Weight of a term beside its standard score, votes of the base share, neighbours, threshold.
PLAIN, BASE_VOTE, NEIGHBOURS, THRESHOLD = 0.2, 0.5, 8, 0.7
#: Entries of a block, blocks scored first, rounding of sums.
BLOCK, FIRST, SLACK = 32, 4, 1e-9


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of every text."""
    data, off = text_buffers(column)
    data = lowered(data)
    starts, ends, first = spans(data, off, LETTERS)
    return np.repeat(np.arange(len(off) - 1), np.diff(first)), span_hashes(data, starts, ends)


def _held_out(column):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, most: int = TRAIN_BYTES) -> DataFrame:
    """(t, toxic, votes, sample, entry) of the distinct texts of labelled training documents, each an entry of its own; their number and bytes are bounded."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("i").agg(F.max((F.col("y") > 0).cast("int")).alias("y")).where(~_held_out("i"))
    known = known.withColumn("r", F.xxhash64("i")).orderBy("r", "i").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).join(F.broadcast(known), "i")
    whole = rows.groupBy(F.coalesce("t", F.lit("")).alias("t")).agg(F.sum("y").alias("toxic"), F.count("*").alias("votes"), F.min("i").alias("sample"), F.min("r").alias("r"))
    whole = scratch.saved(whole.withColumns({"size": F.octet_length("t"), "entry": F.monotonically_increasing_id()}), "toxicity-examples")
    sizes = whole.select("r", "size").toArrow()  # at most limit rows
    r, size = sizes["r"].to_numpy(), sizes["size"].to_numpy()
    order = np.argsort(r, kind="stable")
    over = np.flatnonzero(np.cumsum(size[order].astype(np.int64)) > most)
    return whole.where(F.col("r") < int(r[order[over[0]]])) if len(over) else whole


def _bags(examples: DataFrame) -> pa.Table:
    """(sample, entry, toxic, votes, h, tf) of each example: its distinct terms and how often it has them."""

    def run(batches):
        for b in batches_by_bytes(batches, "t"):
            text, h = terms(b.column(0))
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)])
            tf = np.diff(np.append(first, len(h))).astype(np.uint32)
            cuts = np.searchsorted(text[first], np.arange(b.num_rows + 1)).tolist()
            bags = [(h[first[a:e]].tobytes(), tf[a:e].tobytes()) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), b.column(1), b.column(2), *(pa.array(c, pa.binary()) for c in zip(*bags, strict=True))], ["sample", "entry", "toxic", "votes", "h", "tf"])

    return examples.select("t", "toxic", "votes", "sample", "entry").mapInArrow(run, "sample long, entry long, toxic long, votes long, h binary, tf binary").toArrow()


def _slots(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] to first[i] + size[i] - 1 of each i."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _kth(cosines: np.ndarray, votes: np.ndarray, k: int) -> float:
    """The cosine of the k-th vote, or 0 if there are fewer."""
    if len(cosines) > k:  # each entry has a vote at least
        top = np.argpartition(-cosines, k - 1)[:k]
        cosines, votes = cosines[top], votes[top]
    by = np.argsort(-cosines, kind="stable")
    enough = np.searchsorted(np.cumsum(votes[by]), k)
    return float(cosines[by[enough]]) if enough < len(by) else 0.0


class Index:
    """Entries with votes, their unit vectors as postings by term, and block maxima."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, votes: np.ndarray, sample: np.ndarray, plain: float = PLAIN, base_vote: float = BASE_VOTE):
        self.base_vote = base_vote
        size = np.array([len(h) for h, _ in bags], np.int64)
        h = np.concatenate([h for h, _ in bags]) if bags else np.zeros(0, np.uint64)
        tf = np.concatenate([c for _, c in bags]) if bags else np.zeros(0)
        entry = np.repeat(np.arange(len(bags)), size)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        n, positive = int(votes.sum()), int(toxic.sum())
        count = np.bincount(term, votes[entry], len(self.vocabulary))
        share = positive / n if n else 0.0
        z = (np.bincount(term, toxic[entry], len(self.vocabulary)) - count * share) / np.sqrt(np.maximum(count * share * (1 - share), 1e-9)) if 0 < share < 1 else np.zeros(len(count))
        self.weight = (np.log((n + 1) / (count + 1)) + 1e-6) * (plain + np.abs(z))
        w = (1 + np.log(tf)) * self.weight[term]
        w /= np.sqrt(np.bincount(entry, w * w, len(bags)))[entry]
        # Alike entries stand together, so that block maxima are tight: by class, then by the commonest of the most used terms.
        used = np.zeros(len(bags), np.int64)
        by = np.lexsort((count[term], tf, entry))
        used[entry[by]] = term[by]
        place = np.lexsort((used, -(toxic / np.maximum(votes, 1))))
        self.toxic, self.votes, self.sample = toxic[place], votes[place], sample[place]
        self.moved = np.empty(len(bags), np.int64)  # where each given entry stands
        self.moved[place] = np.arange(len(bags))
        entry = self.moved[entry]
        by = np.lexsort((entry, term))
        term, self.entry, self.posting = term[by], entry[by], w[by]
        block = self.entry // BLOCK
        new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)]
        self.start = np.flatnonzero(new)  # of each cell, a term in a block
        self.block = block[self.start]
        self.most = np.maximum.reduceat(w[by], self.start) if len(self.start) else np.zeros(0)
        self.start = np.append(self.start, len(term))
        self.cells = np.searchsorted(term[self.start[:-1]], np.arange(len(self.vocabulary) + 1))
        self.base = (positive + 0.5) / (n + 1)
        self.slope, self.shift = 1.0, 0.0

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, unit weights) of each text, without terms that no example has."""
        text, h = terms(column)
        return self._vectors(text, h, len(column))

    def _vectors(self, text: np.ndarray, h: np.ndarray, texts: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of (text, term hash) of all words."""
        if not len(self.vocabulary):
            return [(np.zeros(0, np.int64), np.zeros(0))] * texts
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        key, tf = np.unique(text[known] * len(self.vocabulary) + at[known], return_counts=True)
        text, term = np.divmod(key, len(self.vocabulary))
        w = (1 + np.log(tf)) * self.weight[term]
        w /= np.sqrt(np.bincount(text, w * w, texts))[text]
        cuts = np.searchsorted(text, np.arange(texts + 1)).tolist()
        return [(term[a:b], w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def nearest(self, term: np.ndarray, query: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the examples with the k nearest votes, with all that are as near as the last."""
        first = self.cells[term]
        size = self.cells[term + 1] - first
        cell, q = _slots(first, size), np.repeat(query, size)
        block = self.block[cell]
        blocks = -(-len(self.votes) // BLOCK)
        bound = np.bincount(block, q * self.most[cell], blocks)
        found = np.zeros(len(self.votes))

        def scored(wanted):
            mine = wanted[block]
            c = cell[mine]
            n = self.start[c + 1] - self.start[c]
            at = _slots(self.start[c], n)
            return np.bincount(self.entry[at], np.repeat(q[mine], n) * self.posting[at], len(self.votes))

        wanted = np.zeros(blocks, bool)
        wanted[np.argpartition(-bound, min(FIRST, blocks - 1))[:FIRST]] = True
        for _ in range(2):
            found += scored(wanted)
            if without >= 0:
                found[without] = 0
            least = _kth(found, self.votes, k)
            done = wanted
            wanted = (bound >= least - SLACK) & ~done
            if not wanted.any():
                break
        found = np.round(found, 9)
        near = np.flatnonzero((found > 0) & (found >= _kth(found, self.votes, k)))
        near = near[np.lexsort((self.sample[near], -found[near]))]
        return near, np.minimum(found[near], 1.0)

    def share(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Distance-weighted share of toxic votes."""
        w = 1 / (1.05 - cosine)
        return (float((w * self.toxic[near]).sum()) + self.base_vote * self.base) / (float((w * self.votes[near]).sum()) + self.base_vote)

    def probability(self, share: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log(share / (1 - share)) + self.shift, -40, 40))))

    def score(self, column: pa.Array) -> tuple[list[float], list[str | None]]:
        """(score, evidence) of each text; evidence: example, cosine, toxic votes of votes of the three nearest."""
        scores, told = [], []
        for term, query in self.vectors(column):
            near, cosine = self.nearest(term, query) if len(term) else (np.zeros(0, np.int64), np.zeros(0))
            scores.append(self.probability(self.share(near, cosine)))
            rows = zip(self.sample[near[:3]].tolist(), cosine[:3].tolist(), self.toxic[near[:3]].tolist(), self.votes[near[:3]].tolist(), strict=True)
            told.append(" ".join(f"{i}:{c:.3f}:{a}/{v}" for i, c, a, v in rows) or None)
        return scores, told

    def calibrated(self, shares: np.ndarray) -> None:
        """Fits the logistic curve to each entry's share of votes from the others (Newton's method, lightly regularised)."""
        y, n = self.toxic.astype(float), self.votes.astype(float)
        if not 0 < y.sum() < n.sum():
            return
        x = np.stack([np.log(shares / (1 - shares)), np.ones(len(shares))], 1)
        b = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (y - n * p) - 1e-2 * (b - [1.0, 0.0])
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        if b[0] > 0:
            self.slope, self.shift = float(b[0]), float(b[1])


def _fitted(docs: DataFrame, labels: DataFrame, limit: int):
    """(index, its broadcast without calibration) of the labelled training documents."""
    scratch.few_rows(docs.sparkSession)
    began = scratch.mark()
    examples = training_rows(docs, labels, limit)
    bags = _bags(examples)
    column = lambda c: bags[c].to_numpy() if bags.num_rows else np.zeros(0, np.int64)
    index = Index([(np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)) for h, c in zip(bags["h"].to_pylist(), bags["tf"].to_pylist(), strict=True)], column("toxic"), column("votes"), column("sample"))
    sent = docs.sparkSession.sparkContext.broadcast(index)
    place = dict(zip(column("entry").tolist(), index.moved.tolist(), strict=True))  # ids may name several entries

    def run(batches):
        index = sent.value
        for b in batches_by_bytes(batches, "t"):
            at = [place[s] for s in b.column(1).to_pylist()]
            found = [index.nearest(*v, without=k) if len(v[0]) else (np.zeros(0, np.int64), np.zeros(0)) for v, k in zip(index.vectors(b.column(0)), at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([index.share(*f) for f in found], pa.float64())], ["at", "share"])

    told = examples.select("t", "entry").mapInArrow(run, "at long, share double").toArrow()  # a row for each example
    if told.num_rows:
        index.calibrated(told["share"].to_numpy()[np.argsort(told["at"].to_numpy())])
    scratch.cleared(docs.sparkSession, began)
    return index, sent


def fold_losses(docs: DataFrame, labels: DataFrame, settings: list[tuple[float, int, float]], folds: int = 4, limit: int = MAX_LABELLED) -> DataFrame:
    """(plain, neighbours, base_vote, fold, votes, loss, caught, toxic, flagged): how settings do on training rows left out, a fold at a time.

    Folds part the labelled training texts by the order of entries; each (setting, fold) is a task that fits the index and its
    calibration on the other folds and scores this one: the sum of log losses of its votes, toxic votes at THRESHOLD or more of
    all toxic ones, and clean votes there. Rows that are held out are never seen, so constants can be chosen by it.
    """
    spark, began = docs.sparkSession, scratch.mark()
    scratch.few_rows(spark)
    bags = _bags(training_rows(docs, labels, limit)).sort_by("entry")
    sent = spark.sparkContext.broadcast([bags[c].to_pylist() for c in ("h", "tf", "toxic", "votes")])
    scratch.cleared(spark, began)

    def run(batches):
        words, counts, toxic, votes = sent.value
        toxic, votes = np.array(toxic, np.int64), np.array(votes, np.int64)
        bags = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)) for h, c in zip(words, counts, strict=True)]
        for batch in batches:
            for plain, k, base_vote, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.arange(len(bags)) % folds == fold
                rest = np.flatnonzero(~mine)
                index = Index([bags[i] for i in rest], toxic[rest], votes[rest], rest, plain, base_vote)

                def shares(at, out=()):
                    size = [int(bags[i][1].sum()) for i in at]
                    h = np.concatenate([np.zeros(0, np.uint64), *(np.repeat(*bags[i]) for i in at)])
                    vectors = index._vectors(np.repeat(np.arange(len(at)), size), h, len(at))
                    none = (np.zeros(0, np.int64), np.zeros(0))
                    return np.array([index.share(*(index.nearest(*v, k, out[n] if len(out) else -1) if len(v[0]) else none)) for n, v in enumerate(vectors)])

                known = np.zeros(len(rest))
                known[index.moved] = shares(rest, index.moved)
                index.calibrated(known)
                asked = np.flatnonzero(mine)
                p = np.clip([index.probability(s) for s in shares(asked)], 1e-6, 1 - 1e-6)
                y, n = toxic[asked], votes[asked]
                over = p >= THRESHOLD
                row = [plain, k, base_vote, fold, int(n.sum()), float(-(y * np.log(p) + (n - y) * np.log(1 - p)).sum()), int(y[over].sum()), int(y.sum()), int((n - y)[over].sum())]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))])

    names = ["plain", "neighbours", "base_vote", "fold", "votes", "loss", "caught", "toxic", "flagged"]
    todo = spark.createDataFrame([(float(p), k, float(b), f) for p, k, b in settings for f in range(folds)], "plain double, neighbours long, base_vote double, fold long")
    return todo.repartition(len(settings) * folds, "plain", "neighbours", "base_vote", "fold").mapInArrow(run, "plain double, neighbours long, base_vote double, fold long, votes long, loss double, caught long, toxic long, flagged long")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Index:
    """The calibrated index of the labelled training documents."""
    return _fitted(docs, labels, limit)[0]


def _scored(docs: DataFrame, labels: DataFrame, limit: int, rows: DataFrame, text: list[int]) -> DataFrame:
    """The first column of rows with (score, evidence); text: the place of the text in a row, a column and then a field."""
    index, sent = _fitted(docs, labels, limit)
    slope, shift = index.slope, index.shift

    def run(batches):
        index = sent.value
        index.slope, index.shift = slope, shift
        for whole in batches:
            column = whole.column(text[0])
            for k in text[1:]:
                column = column.field(k)
            for b in batches_by_bytes([pa.RecordBatch.from_arrays([whole.column(0), column], ["first", "t"])], "t"):
                scores, told = index.score(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(told, pa.string())], [whole.schema.names[0], "score", "evidence"])

    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("score", DoubleType()), StructField("evidence", StringType())]))


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Per row (doc_id, held_out, score, predicted, evidence)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _scored(docs, labels, limit, rows, [1])
    return out.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """docs without the rows predicted toxic."""
    out = _scored(docs, labels, limit, docs.select(scratch.packed(docs)), [0, docs.columns.index("text")])
    return scratch.unpacked(out.where(F.col("score") < THRESHOLD), docs)
