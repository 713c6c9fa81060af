"""A hidden Markov language model: Baum-Welch over all training documents, exact forward likelihoods.

Tokens are words (A-Z made small) and one end for each text. Every training word is a symbol with emissions of its
own: count times the share of a state in the word, over the state's sum. Shares are stored in 8 bits of logarithm, and
the sums are of the stored shares, so emissions of a state add up to one. Any other word has the share of one
count, as in the base, so the model gives every sequence of words, known or not, a probability.

Texts are encoded once, in parts of PART_BYTES, as numbers into the part's own sorted words. The vocabulary is dealt
into buckets by hash. A round is one job: each part adds up the expected counts of its whole texts, by word and state;
a bucket adds those of its words over all parts and sends each part the new shares of its words, which are a file of
the shared folder. So no process holds the vocabulary, and what moves in a round is a few bytes for each word of a
part. Rounds start from word clusters of a bounded sample of texts and end when the mean log likelihood of a
training token rises by less than GAIN, or after ROUNDS.

Recursions run over many texts at once, one token of each a step. Texts of more than LONG tokens are cut into
stretches whose transfer matrices are multiplied up in both directions, which gives each stretch the exact vectors at
its ends: expected counts and likelihoods are those of whole texts, however long.

Defined cases: null and empty texts are one end token; very long texts are scored whole; a null id is not held out;
repeated rows have equal results; columns beside doc_id and text are not read; without training texts every count is
zero, N and V too, and the model knows only unseen words; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.components import sorted_groups
from quillspark.llm.text_kernels import U64, batches_by_bytes, trim, words

#: Latent states, the most rounds, and the rise of log likelihood for each token that ends them.
STATES, ROUNDS, GAIN = 6, 6, 0.02
#: Bytes of texts of a part and for each bucket of words, tokens of a row of tokens.
PART_BYTES, BUCKET_BYTES, CHUNK = 32 << 20, 12 << 20, 1 << 20
#: Texts of the first clusters, their most bytes each, and the words that cluster them.
SAMPLE, SAMPLE_BYTES, SAMPLE_WORDS = 1000, 16 << 10, 2000
#: Tokens handled at once, tokens of a text that is cut and of its stretches, smoothing of start and transition counts.
POOL, LONG, STRETCH, SMOOTH = 1 << 20, 1536, 768, 0.05
#: Steps of a stored share for each doubling.
STEPS = 20
END = U64(1)
LN10 = np.log(10.0)


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): word hashes with an end after each text; first[d]:first[d+1] are the tokens of text d."""
    _, _, _, first, h = words(column, fold=True)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


class Model:
    """Start, transition and emission probabilities; emissions have a row for each symbol."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit, self.short = start, move, np.ascontiguousarray(emit), None

    def _stretches(self, symbols: np.ndarray, first: np.ndarray, both: bool):
        """(cuts, opening, before, after): stretches of all sequences; the state vectors before those that open no sequence, and those after, from behind."""
        length = np.diff(first)
        k = len(self.start)
        if not (length > LONG).any():
            return first, np.ones(len(length), bool), np.zeros((len(length), k)), np.ones((len(length), k))
        cuts = [np.append(a, np.arange(a + 1, e, STRETCH)) if e - a > LONG else np.array([a]) for a, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        heads = np.cumsum([0, *map(len, cuts)])
        cuts = np.append(np.concatenate(cuts), first[-1])
        opening = np.zeros(len(cuts) - 1, bool)
        opening[heads[:-1]] = True
        before, after = np.zeros((len(opening), k)), np.ones((len(opening), k))
        later = np.flatnonzero(~opening)
        moved = np.empty((len(opening), k, k))
        moved[later] = self._transfers(symbols, cuts[later], cuts[later + 1] - cuts[later])
        for d in np.flatnonzero(length > LONG).tolist():
            lo, hi = heads[d], heads[d + 1]
            a = self.start * self.emit[symbols[cuts[lo]]]
            for s in range(lo + 1, hi):
                before[s] = a / a.sum()
                a = before[s] @ moved[s]
            for s in range(hi - 1, lo, -1) if both else ():
                b = moved[s] @ after[s]
                after[s - 1] = b / b.sum()
        return cuts, opening, before, after

    def _transfers(self, symbols: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each stretch the matrix, up to a factor, from the states before it to those at its end."""
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        v = np.repeat(np.eye(len(self.start))[None], len(at), 0)
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t, "left"))
            x = (v[:n] @ self.move) * self.emit[symbols[at[:n] + t]][:, None, :]
            v[:n] = x / x.sum((1, 2), keepdims=True)
        out = np.empty_like(v)
        out[order] = v
        return out

    def log_likelihood(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each sequence symbols[first[d]:first[d+1]], none empty."""
        cuts, opening, before, _ = self._stretches(symbols, first, False)
        length = np.diff(cuts)
        order = np.argsort(-length, kind="stable")
        at, length, opening, before = cuts[:-1][order], length[order], opening[order], before[order]
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # stretches longer than t
        total = np.zeros(len(order))
        alpha = None
        for t, n in enumerate(active.tolist()):
            e = self.emit[symbols[at[:n] + t]]
            alpha = np.where(opening[:, None], self.start, before @ self.move) * e if t == 0 else (alpha[:n] @ self.move) * e
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out = np.empty(len(order))
        out[order] = total
        return np.add.reduceat(out, np.searchsorted(cuts[:-1], first[:-1])) if len(first) > 1 else out

    def expected(self, symbols: np.ndarray, first: np.ndarray, counts: list[np.ndarray]) -> float:
        """Adds the expected counts of sequences to (start, move, emit); returns their log likelihood. Vectors of a token are short floats, counts are long ones."""
        cuts, opening, before, after = self._stretches(symbols, first, True)
        length = np.diff(cuts)
        order = np.argsort(-length, kind="stable")
        at, length, opening, before, after = cuts[:-1][order], length[order], opening[order], before[order].astype(np.float32), after[order].astype(np.float32)
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left").tolist()
        if self.short is None:
            self.short = self.emit.astype(np.float32)
        probability, step = self.short, self.move.astype(np.float32)
        alphas, emitted, scales, places, likelihood = [], [], [], [], 0.0
        for t, n in enumerate(active):
            place = symbols[at[:n] + t]
            e = probability[place]
            a = (np.where(opening[:, None], self.start.astype(np.float32), before @ step) if t == 0 else alphas[-1][:n] @ step) * e
            s = a.sum(1)
            a /= s[:, None]
            alphas.append(a)
            emitted.append(e)
            scales.append(s)
            places.append(place)
            likelihood += float(np.log(s, dtype=np.float64).sum())
        start, move, emit = counts
        moved = np.zeros_like(move)
        beta, gammas = None, []
        for t in range(len(active) - 1, -1, -1):
            n, m = active[t], active[t + 1] if t + 1 < len(active) else 0
            if n > m:  # stretches that end here
                new = np.empty_like(alphas[t])
                new[m:] = after[m:n] / (alphas[t][m:] * after[m:n]).sum(1, keepdims=True)
            if m:
                ahead = emitted[t + 1]
                ahead *= beta
                ahead /= scales[t + 1][:, None]
                moved += alphas[t][:m].T @ ahead
                back = ahead @ step.T
                beta = back if n == m else new
                beta[:m] = back
            else:
                beta = new
            gammas.append(alphas[t] * beta)
        later = np.flatnonzero(~opening)
        if len(later):
            moved += before[later].T @ (emitted[0] * beta / scales[0][:, None])[later]
        move += moved * self.move
        start += gammas[-1][opening].sum(0, dtype=np.float64)
        gammas.reverse()
        g, place = np.concatenate(gammas), np.concatenate(places)
        g /= g.sum(1, keepdims=True)
        for k in range(g.shape[1]):
            emit[:, k] += np.bincount(place, g[:, k], len(emit))
        return likelihood


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def _symbols(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted table, or its length."""
    if not len(table):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, len(table))


def _clusters(sample: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    """A state for each sampled text, by clusters on the common words (spherical k-means from spread-out seeds)."""
    x = np.zeros((len(sample), max(len(common), 1)))
    for row, h in zip(x, sample, strict=True):
        c = _symbols(h, common)
        row += np.bincount(c[c < len(common)], minlength=len(row))
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seeds = [0]
    while len(seeds) < min(STATES, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    centre = x[seeds]
    for _ in range(12):
        near = np.argmax(x @ centre.T, 1)
        centre = np.stack([x[near == k].sum(0) if (near == k).any() else centre[k] for k in range(len(seeds))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return near


_WORD = r"[^\x20\x09-\x0D]"


def _first_shares(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(words, shares of states) of a bounded sample of distinct texts, those of the smallest hashes, by cluster; of a long text a stretch of SAMPLE_BYTES characters takes part."""
    texts = train.count()
    by_hash = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    rows = train.where(by_hash < int(min(1.0, 2 * SAMPLE / max(texts, 1)) * (1 << 30)))
    begin = F.pmod(F.xxhash64("t", F.lit(1)), F.length("t") - SAMPLE_BYTES + 1).cast("int") + 1
    stretch = F.regexp_replace(F.substring("t", begin, F.lit(SAMPLE_BYTES)), f"^{_WORD}*|{_WORD}*$", "")  # words that the cut goes through are left out
    rows = rows.select(F.xxhash64("t").alias("x"), F.when(F.length("t") > SAMPLE_BYTES, stretch).otherwise(F.col("t")).alias("t"))
    picked = rows.groupBy("x").agg(F.min("t").alias("t")).orderBy("x").limit(SAMPLE).toArrow()
    if not picked.num_rows:
        return np.zeros(0, U64), np.zeros((0, STATES), np.float32)
    h, first = token_hashes(picked["t"].combine_chunks() if picked["t"].num_chunks != 1 else picked["t"].chunk(0))
    sample = [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    own, at, count = np.unique(h, return_inverse=True, return_counts=True)
    near = _clusters(sample, np.sort(own[np.lexsort((own, -count))[:SAMPLE_WORDS]]))
    state = np.repeat(near, np.diff(first))
    x = np.stack([np.bincount(at[state == k], minlength=len(own)) for k in range(STATES)], 1) + 0.5 / STATES
    return own, (x / x.sum(1, keepdims=True)).astype(np.float32)


def _stored(shares: np.ndarray) -> np.ndarray:
    """Shares of states as 8-bit logarithms; the least stands for every smaller one."""
    with np.errstate(divide="ignore"):
        return np.clip(np.round(np.log2(shares) * STEPS) + 255, 0, 255).astype(np.uint8)


_SHARES = np.exp2((np.arange(256) - 255) / STEPS)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def _opened(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def _put(path: str, *arrays: np.ndarray) -> None:
    """Writes a file of the shared folder; a task that is run again moves an equal one in its place."""
    system, at = scratch.store(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    name = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(name, compression=None) as out:
        pickle.dump(arrays, out, 5)
    system.move(name, at)


def _get(path: str) -> tuple:
    system, at = scratch.store(path)
    with system.open_input_stream(at, compression=None) as file:
        return pickle.loads(file.read())


ROWS = "part long, bucket long, payload binary"


def _row(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, bucket, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], ["part", "bucket", "payload"])


def _cut(buckets: int, h: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) of sorted hashes."""
    at = np.searchsorted((h >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64)).tolist()
    return [(b, lo, hi) for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]


def _encoded(docs: DataFrame, buckets: int) -> DataFrame:
    """Stored rows (kind, part, bucket, payload): tokens of a part as numbers of its words (0), and its words by bucket (1)."""

    def run(batches):
        held, size = [], 0
        for b in batches_by_bytes(batches, "t"):
            h, first = token_hashes(b.column(1))
            held.append((b.column(0), b.column(2).to_numpy(zero_copy_only=False).astype(bool), h, first))
            size += b.column(1).nbytes
            if size > PART_BYTES:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)
        trim()

    def made(held):
        part = uuid.uuid4().int >> 66
        table = np.unique(np.concatenate([np.unique(x[2]) for x in held]))
        train = np.zeros(len(table), np.int64)
        rows = []
        for ids, out, h, first in held:
            s = np.searchsorted(table, h).astype(np.uint32)
            train += np.bincount(s[np.repeat(~out, np.diff(first))], minlength=len(table))
            i = ids.fill_null(0).to_numpy()
            rows.append((part, -1, _packed(i, ids.is_null().to_numpy(zero_copy_only=False), out, first, s)))
        for x in rows:
            yield kind(0, [x])
        yield kind(1, [(part, b, _packed(table[lo:hi], train[lo:hi])) for b, lo, hi in _cut(buckets, table)])

    def kind(k, rows):
        b = _row(rows)
        return pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), *b.columns], ["kind", *b.schema.names])

    at = scratch.folder(docs.sparkSession, "markov-parts")
    made_ = docs.mapInArrow(run, f"kind int, {ROWS}")
    made_.write.partitionBy("kind").parquet(at)
    return docs.sparkSession.read.schema(f"{ROWS}, kind int").parquet(at)


def _exchange(rows: DataFrame, buckets: int, folder: str, step: int, first) -> dict[int, float]:
    """One exchange between parts and buckets: adds up what rows (part, bucket, payload) say, and stores new shares.

    Rows of negative parts carry sums, which are added up as they are. first: a broadcast of the first shares, with which
    the rows bring the words themselves; then they bring expected counts.
    """

    def add(batches):
        for bucket, t in sorted_groups(batches, 1):
            parts, payloads = t.column(0).to_pylist(), t.column(2).to_pylist()
            yield from (_row([(-1 - bucket, -1, x)]) for p, x in zip(parts, payloads, strict=True) if p < 0)
            got = [(p, _opened(x)) for p, x in zip(parts, payloads, strict=True) if p >= 0]
            if not got:
                continue
            if first is not None:
                h, at = np.unique(np.concatenate([x[0] for _, x in got]), return_inverse=True)
                c = np.bincount(at, np.concatenate([x[1] for _, x in got])).astype(np.int64)
                ends = np.cumsum([0, *(len(x[0]) for _, x in got)]).tolist()
                places = {p: at[lo:hi].astype(np.uint32) for (p, _), lo, hi in zip(got, ends[:-1], ends[1:], strict=True)}
                _put(f"{folder}/buckets/{bucket}", c, places)
                own, shares = first.value
                k = _symbols(h, own)
                q = _stored(np.concatenate([shares, np.full((1, STATES), 1 / STATES, np.float32)])[k])
            else:
                c, places = _get(f"{folder}/buckets/{bucket}")
                x = np.zeros((len(c), STATES))
                for p, (share, n) in got:
                    x[places[p]] += share * (n / 65535)[:, None]
                q = _stored(x / np.maximum(x.sum(1, keepdims=True), 1e-300))
            yield _row([(-1 - bucket, -1, _packed(np.append([c.sum(), (c > 0).sum()], (c[:, None] * _SHARES[q]).sum(0))))])
            for p, at in places.items():
                yield _row([(p, bucket, _packed(q[at], *([c[at]] if first is not None else [])))])

    def keep(batches):
        for part, t in sorted_groups(batches):
            if part >= 0:
                got = [_opened(x) for x in t.column(2).to_pylist()]
                _put(f"{folder}/shares-{step}/{part}", np.concatenate([x[0] for x in got]))
                if first is not None:
                    ends = np.cumsum([len(x[1]) for x in got])
                    _put(f"{folder}/counts/{part}", np.concatenate([x[1] for x in got]), np.stack([t.column(1).to_numpy(), np.append(0, ends[:-1]), ends], 1))
                continue
            for x in t.column(2).to_pylist():
                (value,) = _opened(x)
                shift = 0 if len(value) == 2 + STATES else 100
                yield pa.RecordBatch.from_arrays([pa.array(shift + np.arange(len(value))), pa.array(value, pa.float64())], ["slot", "value"])

    added = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(add, ROWS)
    kept = added.repartition(buckets, "part").sortWithinPartitions("part", "bucket").mapInArrow(keep, "slot long, value double")
    return {r["slot"]: r["value"] for r in kept.groupBy("slot").agg(F.sum("value").alias("value")).collect()}


class _Parts:
    """Reads the model of the part that a row of tokens belongs to."""

    def __init__(self, folder: str, step: int, start: np.ndarray, move: np.ndarray, sums: np.ndarray, unseen: float):
        self.folder, self.step, self.start, self.move, self.sums, self.unseen = folder, step, start, move, sums, unseen

    def rows(self, batches):
        """(part, counts, model, tokens) of each row; the model is read when the part changes."""
        at = None
        for b in batches:
            for part, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if part != at:
                    at = part
                    (c, _), (q,) = _get(f"{self.folder}/counts/{part}"), _get(f"{self.folder}/shares-{self.step}/{part}")
                    emit = _SHARES[q] * c[:, None] * ((1 - self.unseen) / np.maximum(self.sums, 1e-300))
                    emit[c == 0] = self.unseen
                    model = Model(self.start, self.move, emit)
                yield part, c, model, _opened(payload)


def _expected(tokens: DataFrame, parts: _Parts, buckets: int) -> DataFrame:
    """Rows (part, bucket, payload) of the expected counts of training texts, as shares of states and numbers of tokens; sums in part -1."""

    def run(batches):
        at, counts, n, told = None, None, None, 0.0
        for part, c, model, (_, _, out, first, s) in parts.rows(batches):
            if part != at:
                if counts:
                    yield from made(at, counts, n, told)
                at, told = part, 0.0
                counts, n = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(c), STATES))], np.zeros(len(c), np.int64)
            mine = np.flatnonzero(~out)
            length = np.diff(first)[mine]
            s = s[np.repeat(~out, np.diff(first))]
            first = np.append(0, np.cumsum(length))
            n += np.bincount(s, minlength=len(c))
            lo = 0
            while lo < len(mine):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + POOL, "right")) - 1)
                told += model.expected(s[first[lo] : first[hi]], first[lo : hi + 1] - first[lo], counts)
                lo = hi
        if counts:
            yield from made(at, counts, n, told)
        trim()

    def made(part, counts, n, told):
        start, move, x = counts
        share = np.round(x / np.maximum(n, 1)[:, None] * 65535).astype(np.uint16)
        yield _row([(-1, part % buckets, _packed(np.concatenate([[told], start, move.ravel()])))])
        _, cuts = _get(f"{parts.folder}/counts/{part}")
        yield _row([(part, b, _packed(share[lo:hi], n[lo:hi])) for b, lo, hi in cuts.tolist()])

    return tokens.mapInArrow(run, ROWS)


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, _Parts, int, int, list[float]]:
    """(rows of tokens, model, N, V, mean log likelihood of a token before each round) of docs (i, t, out)."""
    spark = docs.sparkSession
    scratch.few_rows(spark)
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)
    parts = _encoded(docs, buckets)
    tokens, listed = parts.where("kind = 0").drop("kind"), parts.where("kind = 1").drop("kind")
    folder = scratch.folder(spark, "markov")
    first = spark.sparkContext.broadcast(_first_shares(docs.where("NOT out")))
    got = _exchange(listed, buckets, folder, 0, first)
    n, v = int(got.get(0, 0)), int(got.get(1, 0))
    sums = lambda got: np.array([got.get(2 + k, 0.0) for k in range(STATES)])
    start, move = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.02 / max(STATES - 1, 1))
    np.fill_diagonal(move, 0.98)
    model = _Parts(folder, 0, start, move, sums(got), 1 / (n + v + 1))
    means: list[float] = []
    for step in range(1, 1 + (rounds if n else 0)):
        got = _exchange(_expected(tokens, model, buckets), buckets, folder, step, None)
        told = np.array([got.get(100 + k, 0.0) for k in range(1 + STATES + STATES**2)])
        start, move = _unit(told[1 : 1 + STATES] + SMOOTH), _unit(told[1 + STATES :].reshape(STATES, STATES) + SMOOTH)
        scratch.removed(spark, f"{folder}/shares-{step - 1}")
        model = _Parts(folder, step, start, move, sums(got), 1 / (n + v + 1))
        means.append(float(told[0]) / n)
        if len(means) > 1 and means[-1] - means[-2] < GAIN:
            break
    return tokens, model, n, v, means


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); log10 probabilities."""
    docs = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).withColumn("out", held_out("i"))
    tokens, parts, n, v, _ = train(docs, rounds)
    floor = np.log10(n + v + 1)

    def run(batches):
        for _, c, model, (i, null, out, first, s) in parts.rows(batches):
            base = np.log10(c[s] + 1.0) - floor
            add = lambda x: np.add.reduceat(x, first[:-1])
            likelihood, lo = [], 0
            while lo < len(out):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + POOL, "right")) - 1)
                likelihood.append(model.log_likelihood(s[first[lo] : first[hi]], first[lo : hi + 1] - first[lo]))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64(), mask=null), pa.array(out), pa.array(np.diff(first)), pa.array(add((c[s] > 0).astype(np.int64))), pa.array(add(base)), pa.array(np.concatenate(likelihood) / LN10)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        trim()

    made = tokens.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
