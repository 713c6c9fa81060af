"""Cases that once went wrong: composed capitals, ids that name several examples, corpora of long texts alone, and disk that a join kept."""

import random
import time
import zlib
from pathlib import Path

import numpy as np

from quillspark.llm import hidden_markov, jaccard_join, packed_ids, queries, scratch, toxicity


def test_packed_ids_of_combining_marks():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(queries.WORD_BPE), random.Random(2)
    bits = [*"YyAaWwTtHhJjEe", "̊", "̈", "̱", "̌", "́", "̇", "É", "–", " ", ",", "'s", "ﬁ", "각"]
    texts = ["Y̊", "W̊ord T̈", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    for text, ids in zip(texts, packed_ids.encode_texts(queries.WORD_BPE, texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_toxicity_of_ids_with_several_texts(spark):
    """Examples of one id are examples like any others: the fitted curve is that of the same texts under ids of their own."""
    rng = random.Random(3)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    free = [k for k in range(500) if not held(k)]
    plain = [f"w{'abcdefghij'[k % 10]}{'klmnopq'[k // 10]}" for k in range(60)]
    texts = [" ".join(rng.choice(plain) for _ in range(rng.choice([4, 20, 60]))) + (rng.choice([" idiot", " moron", " idiot moron"]) if n % 3 == 0 else "") for n in range(90)]
    toxic = [int(n % 3 == 0 and n != 9 or n == 10) for n in range(90)]
    apart = spark.createDataFrame([(free[n], t) for n, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(free[n], y) for n, y in enumerate(toxic)], "doc_id long, toxic int")
    ids = {0: free[0], 1: free[1]}
    shared = spark.createDataFrame([(ids[toxic[n]], t) for n, t in enumerate(texts)], "doc_id long, text string")
    few = spark.createDataFrame([(ids[0], 0), (ids[1], 1)], "doc_id long, toxic int")
    want, got = toxicity.fit(apart, marks), toxicity.fit(shared, few)
    assert len(got.sample) == len(want.sample) and (want.slope, want.shift) != (1.0, 0.0)
    assert np.allclose((got.slope, got.shift), (want.slope, want.shift), atol=1e-6)


def test_hidden_markov_learns_from_long_texts_alone(spark):
    """Three vocabularies that never meet in a text: the states part them, however long every text is."""
    rng = random.Random(7)
    rows = [(k, " ".join(f"{'abc'[k % 3]}{rng.randrange(300)}" for _ in range(8000))) for k in range(24)]
    assert min(len(t) for _, t in rows) > 2 * hidden_markov.SAMPLE_BYTES
    got = hidden_markov.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["score"] for r in got) > 0.85 * sum(r["base_score"] for r in got)


def test_toxicity_folds_see_training_rows_alone(spark):
    """Every labelled training text is left out once, settings that cannot work do worse, and labels of held-out rows change nothing."""
    rng = random.Random(5)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = [(k, " ".join(rng.choice(plain) for _ in range(12)) + (" idiot moron" if k % 4 == 0 else "")) for k in range(160)] + [(160, None), (161, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(k, int(k % 4 == 0)) for k, _ in rows]
    settings = [(0.2, 8, 0.5), (0.2, 8, 1e6)]

    def found(labels):
        out = toxicity.fold_losses(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), settings)
        return sorted(map(tuple, out.collect()))

    got = found(marks)
    assert got == found([(k, 1 - y if held(k) else y) for k, y in marks])
    free = [(k, y) for k, y in marks if not held(k)]
    for setting in settings:
        mine = [r for r in got if r[:3] == setting]
        assert len(mine) == 4 and sum(r[4] for r in mine) == len(free) and sum(r[7] for r in mine) == sum(y for _, y in free)
    good, bad = (sum(r[5] for r in got if r[:3] == s) for s in settings)
    assert good < bad and sum(r[6] for r in got if r[:3] == settings[0]) >= 0.9 * sum(y for _, y in free)


def test_saved_tables_leave_no_shuffle_files(spark):
    """What a stored table was made from goes when it is stored, not when the driver collects its garbage."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before = held()
    out = scratch.saved(spark.range(100_000).repartition(4, "id"), "shuffled")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)  # Spark deletes in the background
    assert not held() - before and out.count() == 100_000


def test_jaccard_join_of_shuffled_texts(spark, monkeypatch):
    """Texts that are shuffled, as rows are too many to be broadcast, give the same result."""
    rng = random.Random(11)
    rows = [(k, " ".join(f"w{rng.randrange(90)}" for _ in range(40))) for k in range(0, 90, 3)]
    rows += [(k + 1, t.rpartition(" ")[0]) for k, t in rows[::5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    got = {r[0]: r[2] for r in jaccard_join.join_components(docs).collect()}
    assert got == {k: k - (k % 3 == 1) for k, _ in rows}


def test_asked_texts(spark, monkeypatch):
    """No text that is asked for is lost, and few others are kept."""
    docs = spark.range(5000).selectExpr("id AS i", "xxhash64(id) AS k", "CAST(id AS STRING) AS t")
    rows = docs.where("i % 50 = 0").select("i", "k")
    for bits, most in ((jaccard_join.FILTER_BITS, 101), (1 << 16, 150), (1 << 5, 5000)):
        monkeypatch.setattr(jaccard_join, "FILTER_BITS", bits)
        got = [r["i"] for r in jaccard_join.asked(docs, rows).collect()]
        assert {k for k in got if k % 50 == 0} == set(range(0, 5000, 50)) and len(got) == len(set(got)) <= most


def _cluster(size: int, seed: int):
    """Texts of 200 words that share most of them, no two of them similar enough; each fifth has a copy without its last word."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(202)]
    rows = []
    for k in range(size):
        text = list(base)
        for at in rng.sample(range(5, 195), 4):
            text[at] = f"u{k}x{at}"
        rows.append((2 * k, " ".join(text)))
        if k % 5 == 0:
            rows.append((2 * k + 1, " ".join(text[:-1])))
    return rows


def test_jaccard_join_meets_a_cluster_once(spark, monkeypatch):
    """Nodes of a cluster share many elements and do not go to the trees of each with all others."""
    rows, dealt, paged = _cluster(60, 3), [], jaccard_join._paged
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    monkeypatch.setattr(jaccard_join, "_paged", lambda *a: [out := paged(*a), dealt.append(out.count())][0])
    got = {r[0]: r[2] for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), page=4).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}
    assert sum(dealt) <= 40 * len(rows)


def test_elements_lose_no_pair_that_must_meet(spark):
    """Two nodes of one element and of two components share some element in which their codes share no bit."""
    rng = random.Random(4)
    labels = {k: k if rng.random() < 0.6 else 0 for k in range(50)}
    rows = {(e, k) for e in range(12) for k in range(50) if rng.random() < (0.9 if e < 6 else 0.2)} | {(90, k) for k in range(30)} | {(91, k) for k in range(30)}
    m = {e: sum(x == e for x, _ in rows) for e, _ in rows}
    rest = spark.createDataFrame([(e, k, labels[k], 100, m[e]) for e, k in rows], "element long, node long, label long, n long, m long")
    got = {}
    for r in jaccard_join._once(rest).collect():
        got.setdefault(r["element"], {})[r["node"]] = r["code"]
    met = {(a, b) for at in got.values() for a in at for b in at if a < b and not at[a] & at[b]}
    for a in range(50):
        for b in range(a + 1, 50):
            if labels[a] != labels[b] and any((e, a) in rows and (e, b) in rows for e in m):
                assert (a, b) in met
    assert sum(not at[a] & at[b] for at in got.values() for a in at for b in at if a < b) < 0.5 * sum(x * (x - 1) // 2 for x in m.values())


def test_prefixes_by_rough_counts(spark):
    """Frequent elements go behind rare ones by the counts of their cells, and similar sets share as many elements as before."""
    rng = np.random.default_rng(5)
    draw = lambda k: np.unique(rng.integers(1, 2**63, k, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    often = draw(60)
    counts = spark.createDataFrame([(int(h), 2 + k) for k, h in enumerate(often.view(np.int64).tolist())], "h long, c long")
    cells = jaccard_join._cells(counts, 17)
    assert len(cells) == 1 << 17 and np.count_nonzero(cells) == len(np.unique(often >> np.uint64(47)))
    none = often[:0]
    for _ in range(40):
        a = np.unique(np.concatenate([often, draw(140)]))
        b = np.delete(a, rng.choice(len(a), 8, False))
        p, q = (jaccard_join.prefix(s, 90, none, none, cells) for s in (a, b))
        assert np.intersect1d(p, often).size == 0  # by hash alone some three of ten would be frequent
        assert np.intersect1d(p, q).size >= -(-90 * (len(a) + len(b)) // 190) - -(-90 * len(a) // 100) + 1
