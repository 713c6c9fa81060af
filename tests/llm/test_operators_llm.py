"""The training-data operators on small fixtures: brute force, round trips and the defined cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, components, decontamination, flac, hidden_markov, jaccard_join, packed_ids, queries, repeats, scratch, suffix_array, suffix_automaton, text_kernels, toxicity, warc

DOCS = "doc_id long, text string, i string, t string, key long, score double"


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages and the awkward cases."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Ünd", "a", *(f"w{k}" for k in range(80)), "é", "x\x1fy"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [None, "", " \t\n", "one", "one two", "ha " * 300, "ONE", "no-break space"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 12:
            t = rng.choice(texts[8:])
        elif kind < 0.4 and len(texts) > 12:
            w = rng.choice(texts[8:]).split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 40, 90])))
            if kind > 0.75:
                t = f"{t} {passage}\n{t[:20]}"
        texts.append(t)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    """Rows with further columns of clashing names, in several partitions."""
    return spark.createDataFrame([(k, t, "i", "t", 7, 0.5) for k, t in rows], DOCS).repartition(parts)


def test_kernels():
    texts = ["A b\tc", "", "dd  e", "x" * 3000 + " y", "\x0b\x0c"]
    data, starts, ends, first, h = text_kernels.words(pa.array(texts))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in words_of(t)]
    assert np.diff(first).tolist() == [len(words_of(t)) for t in texts]
    again = text_kernels.words(pa.array(["c dd", "A"]).slice(0))[4]
    assert again.tolist() == [h[2], h[3], h[0]]
    assert text_kernels.words(pa.array(["AbÉ"]), True)[4][0] == text_kernels.words(pa.array(["abÉ"]), True)[4][0]
    x = np.array([5, 3, 4, 1, 7, 2], np.uint64)
    assert text_kernels.sliding_min(x, 3).tolist() == [3, 1, 1, 1]
    long = "word " * 400_000
    hashes = text_kernels.words(pa.array([long]))[4]
    assert len(hashes) == 400_000 and len(set(hashes.tolist())) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(3500)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.find(x) for e in edges for x in e if e[0] != e[1]}
    old = components.FINISH
    try:
        for finish in (10, old):
            components.FINISH = finish
            df = spark.createDataFrame(edges, "a long, b long").repartition(4)
            got = {r["node"]: r["component"] for r in components.components(df).collect()}
            assert {k: got[k] for k in want} == want
    finally:
        components.FINISH = old
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("payload", [b"", b"abc", bytes(range(256)) * 3, bytes([0, 255] * 500), random.Random(2).randbytes(5000), b"a" * 191 + b"\xff", bytes((128 + int(60 * np.sin(i / 9))) for i in range(4000))])
def test_flac_round_trip(payload):
    p = flac.padded(payload)
    assert len(p) % 192 == 0 and len(p) >= 192 and p.startswith(payload)
    (stream,) = flac.encode_payloads([p])
    assert flac.decode_streams([stream]) == [p]
    assert bytes(v + 128 for v in flac.decode_plain(stream)[0]) == p
    assert bytes(v + 128 for v in flac.decode_plain(stream, None, 5, 150)[0]) == p[5:150]


def test_flac_damage_is_found():
    (stream,) = flac.encode_payloads([flac.padded(b"some text " * 60)])
    for at in (len(stream) - 1, len(stream) - 80, 30):
        broken = bytearray(stream)
        broken[at] ^= 16
        with pytest.raises((ValueError, KeyError)):
            flac.decode_streams([bytes(broken)])


def test_flac_plain_reader_on_other_streams():
    """A stereo stream of 16 bits with mid and side, partitions, an escape and wasted bits, written bit by bit."""
    bits = []

    def put(v, n):
        bits.extend(str(v >> (n - 1 - k) & 1) for k in range(n))

    left, right = [10, 12, 14, 200] * 4, [8, 12, 10, 100] * 4
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    put(0x3FFE, 14), put(0, 2), put(6, 4), put(0, 4), put(10, 4), put(4, 3), put(0, 1), put(0, 8), put(15, 8)
    head = bytes(int("".join(bits[k : k + 8]), 2) for k in range(0, len(bits), 8))
    put(flac._crc8_bytes(head), 8)
    put(0, 1), put(8, 6), put(0, 1), put(0, 2), put(1, 4)
    put(15, 4), put(16, 5)
    for v in mid[:8]:
        put(v & 0xFFFF, 16)
    put(3, 4)
    for v in mid[8:]:
        z = v << 1 ^ v >> 31
        put(1, (z >> 3) + 1), put(z & 7, 3)
    put(0, 1), put(1, 6), put(1, 1), put(1, 1)
    for v in side:
        put(v >> 1 & 0xFFFF, 16)
    bits += "0" * (-len(bits) % 8)
    frame_ = bytes(int("".join(bits[k : k + 8]), 2) for k in range(0, len(bits), 8))
    frame_ += flac._crc16_bytes(frame_).to_bytes(2, "big")
    info = {"blocks": (16, 16), "channels": 2, "bits": 16, "samples": 16, "frames": 0, "seek": []}
    assert flac.decode_plain(frame_, info) == [left, right]


def test_flac_blocks(spark):
    docs = frame(spark, [(1, "abc " * 9000), (2, None), (3, "é")])
    media = flac.encode(docs)
    blocks = flac.pcm_blocks(media, 1920)
    cut = flac.samples_between(blocks.where("doc_id = 1"), 1900, 1950).orderBy("sample_offset").collect()
    assert b"".join(bytes(r["pcm"]) for r in cut) == ("abc " * 9000).encode()[1900:1950]
    got = {r["doc_id"]: r for r in flac.digests(docs).collect()}
    assert got[2]["payload_bytes"] == 192 and got[2]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    assert got[3]["n_bytes"] == 2 and got[1]["tail_crc32"] == zlib.crc32(flac.padded(("abc " * 9000).encode())[-16:])
    for r in media.collect():  # digests and features from the stored form, by the plain reader and plain loops
        samples = flac.decode_plain(bytes(r["media"]))[0]
        d = got[r["doc_id"]]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
        assert d["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and d["media_bytes"] == len(r["media"])
        assert d["payload_sha256"] == hashlib.sha256(bytes(v + 128 for v in samples)).hexdigest()
        assert d["feature"] == f"frames={len(samples) // 192} energy={sum(v * v for v in samples)} crossings={crossings} peak={max(map(abs, samples))}"
    assert flac.digests(docs.limit(0)).count() == 0


def test_byte_bpe_equals_the_library(spark):
    import tiktoken

    enc, raw = byte_bpe.encoding(queries.BYTE_RANKS, public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding) and len(raw) == 50256
    rng = random.Random(4)
    for _ in range(60):
        t = "".join(rng.choice(["a", " ", "  ", "\n", "é", "7", "'s", "!", "word", " ", "\x1c", "<|endoftext|>", "漢"]) for _ in range(rng.randint(0, 400)))
        assert byte_bpe.encode_text(enc, t, 16) == enc.encode_ordinary(t)
    rows = corpus() + [(None, "null id"), (5, "x" * 200_000), (5, "x " * 100_000)]
    got = byte_bpe.digests(frame(spark, rows), queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((k is None, k or 0, len(i := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == want
    docs = frame(spark, rows)
    apart = byte_bpe.decode(byte_bpe.encode(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN), queries.BYTE_RANKS, public_tokenizers.PATTERN)
    assert sorted(map(str, apart.collect())) == sorted(map(str, byte_bpe.encode_and_decode(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect()))
    assert byte_bpe.digests(frame(spark, rows).limit(0), queries.BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 11, 16, 17, 23, 31])
def test_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == -(-len(ids) // 8) * width
    assert (packed_ids.unpack(data, width, len(ids)) == ids).all()


def test_packed_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus(5) + [(None, "nobody"), (9, "twice"), (9, "again"), (900, "a <|endoftext|> b"), (901, "x<|StartOfText|>y, z <|endoftext|>"), (902, "no <| special"), (903, "long " * 40_000)]
    index = packed_ids.write(frame(spark, rows), scratch.folder(spark, "ids"), queries.WORD_BPE)
    got = packed_ids.read(index).orderBy("start").collect()
    t = Tokenizer.from_file(queries.WORD_BPE)
    at = 0
    for r, (k, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    first = index.orderBy("file_no", "start").first()
    reader = packed_ids.Reader(first["file"])
    assert reader.width == 16 and reader.document(0).tolist() == reader.ids(0, reader.n_ids)[: first["n_tokens"]].tolist()
    assert packed_ids.read(packed_ids.write(frame(spark, rows).limit(0), scratch.folder(spark, "ids"), queries.WORD_BPE)).count() == 0


def test_warc(spark):
    rows = [(5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (7, "u", None), (8, "u", ""), (9, "u", "x" * 500_000), (None, "u", "<p>é</p>"), (4, "u", "lone"), (9, "u", "x" * 500_000)]
    pages = spark.createDataFrame([(*r, "d", "f", 1) for r in rows], "page_id long, url string, html string, digest string, first string, `a.n` int").repartition(3)
    index = warc.write(pages, scratch.folder(spark, "warc"), frame=2000)
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(index).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    least = {}
    for k, _, h in rows:
        least[h or ""] = min(least.get(h or "", 10**9), k if k is not None else 10**9)
    want = sorted((k is None, k or 0, "response" if k == least[h or ""] else "revisit", None if k == least[h or ""] else least[h or ""], len((h or "").encode()), digest(h)) for k, _, h in rows)
    assert got == want
    one = warc.fetch(index, spark.createDataFrame([("urn:page:4",), ("urn:page:9",)], "record_id string")).collect()
    assert sorted(bytes(r["payload"])[:4] for r in one) == [b"lone", b"xxxx", b"xxxx"]
    path = index.where("page_id = 3").first()["bundle"]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(open(path.removeprefix("file:"), "rb"), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n")
    small = {r["page_id"]: r["record_type"] for r in warc.with_revisits(pages, 9).select("page_id", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type")).collect()}
    assert small[8] == small[7] == "response" and small[5] == "revisit"
    assert warc.read(warc.write(pages.limit(0), scratch.folder(spark, "warc"))).count() == 0


def brute_components(rows, n, percent):
    sets, forest = {}, components.Forest()
    for k, t in rows:
        w = [x.lower() for x in words_of(t)]
        s = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets[k] = s
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                forest.join(a, b)
    return {k: (len(s), forest.find(k)) for k, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "page"), [(3, 90, 256), (5, 80, 256), (2, 60, 2), (3, 100, 256)])
def test_jaccard_join(spark, n, percent, page):
    rows = corpus(8, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(frame(spark, rows), n, percent, page=page).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_cases(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (2, None), (3, " "), (4, "A B C D"), (1, "zz yy xx ww"), (6, "zz yy xx ww")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(frame(spark, rows)).collect())
    assert got == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 0, 2), (False, 3, 0, 3), (False, 4, 2, 1), (False, 6, 2, 1), (True, 0, 2, None)]
    kept = jaccard_join.representatives(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert jaccard_join.join_components(frame(spark, rows).limit(0)).count() == 0
    pairs = jaccard_join.join_pairs(frame(spark, [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "q")]), 3, 90).collect()
    assert [tuple(r) for r in pairs] == [(1, 2, 10, 11)]


def test_prefixes_and_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(1, 2**63, 40, dtype=np.int64).astype(np.uint64))
    for percent in (60, 80, 90, 97):
        sets = []
        for _ in range(60):
            a = np.unique(np.append(rng.integers(1, 2**63, int(rng.integers(1, 200)), dtype=np.int64).astype(np.uint64), common[rng.random(40) < 0.3]))
            sets += [a, *(np.delete(a, rng.choice(len(a), int(rng.integers(0, len(a) * (100 - percent) // 100 + 1)), False)) for _ in range(2))]
        sets = [s for s in sets if len(s)]
        left = set(zip(*(x.tolist() for x in jaccard_join.candidate_pairs(jaccard_join.tree_of(sets, np.arange(len(sets))), percent, True)), strict=True))
        p = lambda s: jaccard_join.prefix(s, percent, common, np.arange(40))  # noqa: B023, E731
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if jaccard_join.linked(a, b, percent) is not None:
                    shared = np.intersect1d(p(a), p(b)).size
                    assert (i, j) in left or (j, i) in left
                    assert shared >= max(1, -(-percent * (len(a) + len(b)) // (100 + percent)) - -(-percent * max(len(a), len(b)) // 100) + 1)


def test_jaccard_joins_pages_of_many_nodes(spark, monkeypatch):
    """Elements of many nodes, large blocks and small pages: the same links as all pairs."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(40)]
    rows = [(k, " ".join(rng.sample(base, 3) + base + [f"u{k}" for _ in range(rng.randint(0, 3))])) for k in range(70)]
    rows += [(100 + k, " ".join(w if rng.random() > 0.02 else "edit" for w in base)) for k in range(60)]
    monkeypatch.setattr(jaccard_join, "FEW", 3)
    monkeypatch.setattr(jaccard_join, "COMMON", 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(frame(spark, rows), 2, 85, page=7).collect()}
    assert got == brute_components(rows, 2, 85)
    sets = {k: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for k, t in rows for w in [t.split()]}
    least = {}
    for k, s in sets.items():
        least[frozenset(s)] = min(k, least.get(frozenset(s), k))
    ids = sorted(least.values())
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in jaccard_join.join_pairs(frame(spark, rows), 2, 85, page=9).collect()} == want


def test_representatives_are_rows(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "a b c d e f g h"), (0, "x y z x y z"), (5, "w " * 50_000), (6, "W " * 40_000)]
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, `i.k` int, row string")
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"][:3], r["i.k"]) for r in kept.collect()) == [(0, "x y", 1), (1, "a b", 1), (1, "q r", 1), (5, "w w", 1)]


def brute_cover(rows, split, window):
    first, seqs = {}, {}
    for k, t in rows:
        s = split(t)
        seqs.setdefault(k, []).append((t, s))
        for j in range(len(s) - window + 1):
            g = tuple(s[j : j + window])
            first[g] = min(first.get(g, repeats.NO_ID), repeats.NO_ID if k is None else k)
    out = []
    for k, members in seqs.items():
        for _, s in members:
            cut = [False] * len(s)
            for j in range(len(s) - window + 1):
                if first[tuple(s[j : j + window])] < (repeats.NO_ID if k is None else k):
                    cut[j : j + window] = [True] * window
            out.append((k, s, cut))
    return out


REPEATS = corpus(11, 80) + [(None, "q " * 60), (None, "r1 r2 r3 " * 20), (500, "q " * 60), (12, "one of two rows " * 8), (12, "another row of this id " * 8), (501, "one of two rows " * 8)]
REPEATS += [(600, "lo ng " * 1500 + "tail a"), (601, "lo ng " * 1500 + "tail b"), (602, " ".join(f"v{k}" for k in range(4000)))]


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup_equals_brute_force(spark, window):
    want = sorted((k is None, k or 0, len(s), sum(c), hashlib.sha256(b" ".join(w for w, x in zip(s, c) if not x)).hexdigest()) for k, s, c in brute_cover(REPEATS, words_of, window))
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in suffix_automaton.digests(frame(spark, REPEATS), window).collect())
    assert got == want


@pytest.mark.parametrize("window", [5, 50])
def test_suffix_array_dedup_equals_brute_force(spark, window):
    want = []
    for k, s, c in brute_cover(REPEATS, lambda t: (t or "").encode(), window):
        n = sum(x and not (j and c[j - 1]) for j, x in enumerate(c))
        want.append((k is None, k or 0, len(s), sum(c), n, hashlib.sha256(bytes(b for b, x in zip(s, c) if not x)).hexdigest()))
    got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in suffix_array.digests(frame(spark, REPEATS), window).collect())
    assert got == sorted(want)


def test_removal_keeps_all_else(spark):
    shared = " ".join(f"p{k}" for k in range(20))
    docs = frame(spark, [(1, f"a\t{shared}\nb"), (2, f"c  {shared}\n\nd"), (3, None), (4, "")])
    got = {r["doc_id"]: r for r in suffix_automaton.remove(docs, 13).collect()}
    assert got[1]["text"] == f"a\t{shared}\nb" and got[2]["text"] == "c  \n\nd" and got[3]["text"] is None and got[4]["text"] == ""
    assert got[2]["key"] == 7 and got[2]["t"] == "t" and suffix_automaton.remove(docs, 13).columns == docs.columns
    assert suffix_automaton.remove(docs.limit(0), 13).count() == 0 and suffix_array.digests(docs.limit(0)).count() == 0
    reference = spark.createDataFrame([(shared,), (None,)], "text string")
    assert sorted(tuple(r) for r in suffix_automaton.reference_spans(docs, reference, 13).collect()) == [(1, 1, 21), (2, 1, 21)]


def test_suffix_array_and_automaton():
    rng = random.Random(3)
    for _ in range(400):
        s = np.array([rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))], np.int64)
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    for _ in range(200):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        automaton = suffix_automaton.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        q = [rng.randint(0, 2) for _ in range(20)]
        parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)} | {()}
        assert automaton.statistics(q) == [max(n for n in range(i + 2) if tuple(q[i + 1 - n : i + 1]) in parts) for i in range(len(q))]


def test_decontamination(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "one two"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, "")]
    long = " ".join(f"n{k}" for k in range(3000))
    rows = [(10, f"{long} ALPHA beta gamma delta\nepsilon zeta eta theta iota kappa {long}"), (11, "beta gamma delta epsilon zeta eta theta iota kappa"), (12, "gamma delta epsilon zeta eta theta iota"), (13, "One Two"), (14, "one two three"), (15, None), (None, "one two"), (10, "one two")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, t in rows:
        for i, x in items:
            asked = [w.lower() for w in words_of(x)]
            held = decontamination.shingles([w.lower() for w in words_of(t)], n := min(5, len(asked)) or 5)
            asked = decontamination.shingles(asked, n)
            if asked and 100 * len(held & asked) >= 80 * len(asked):
                want.append((k is None, k or 0, i, len(held & asked), len(asked)))
    for index_rows in (4_000_000, 1):
        got = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in decontamination.contained(docs, bench, index_rows=index_rows).collect())
        assert got == sorted(want)
        kept = decontamination.clean(docs, bench, index_rows=index_rows)
        assert sorted(r["doc_id"] for r in kept.collect()) == [12, 15] and kept.columns == docs.columns
    assert decontamination.contained(docs.limit(0), bench).count() == 0
    assert decontamination.contained(docs, bench.limit(0)).count() == 0


def test_toxicity_index_is_exact():
    """The pruned search finds what comparing with all entries finds."""
    rng = np.random.default_rng(2)
    bags = [(np.sort(rng.choice(60, rng.integers(1, 12), False)).astype(np.uint64), rng.integers(1, 5, 12)) for _ in range(700)]
    bags = [(h, c[: len(h)]) for h, c in bags]
    votes = rng.integers(1, 4, 700)
    toxic = np.where(rng.random(700) < 0.2, votes, 0)
    index = toxicity.Index(bags, toxic, votes, np.arange(700))
    dense = np.zeros((700, len(index.vocabulary)))
    for k, (h, c) in enumerate(bags):
        t = np.searchsorted(index.vocabulary, h)
        dense[k, t] = (1 + np.log(c)) * index.weight[t]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    dense = dense[index.sample]  # in the order of entries
    for k in range(0, 700, 9):
        t = np.flatnonzero(dense[k])
        cos = np.round(dense @ dense[k], 9)
        for without in (-1, k):
            own = cos.copy()
            own[without] = 0 if without >= 0 else own[without]
            order = np.argsort(-own, kind="stable")
            least = own[order[np.searchsorted(np.cumsum(index.votes[order]), 8)]]
            entries, found = index.nearest(t, dense[k, t], 8, without)
            assert sorted(entries.tolist()) == np.flatnonzero((own >= least) & (own > 0)).tolist()
            assert np.allclose(found, np.minimum(own[entries], 1), atol=2e-9)


def test_toxicity_score_equals_brute_force(spark):
    """The whole of score(), from texts to calibrated shares, with plain dictionaries and all pairs."""
    import math

    rng = random.Random(8)
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 3 == 1
    plain = [f"w{'abcdefghij'[k % 10]}{'klmnopq'[k // 10]}" for k in range(60)]
    rows, labels = [], []
    for k in range(90):
        bad = k % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.choice([4, 20, 60]))] + (["Idiot", "moron"][: rng.randint(1, 2)] if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        if k % 3:
            labels.append((k, int(bad)))
    rows += [(200, rows[4][1]), (201, rows[4][1]), (202, None), (203, "zzz"), (None, "idiot"), (204, "idiot " * 30_000)]
    labels += [(200, 1), (201, 0), (202, None), (None, 1)]
    bag = lambda t: __import__("collections").Counter(re.findall("[a-z]+", (t or "").lower()))
    known = {k: y for k, y in labels if k is not None and y is not None and not held(k)}
    entries = {}
    for k, t in rows:
        if k in known:
            entries.setdefault(t or "", []).append((k, known[k]))
    entries = [(bag(t), len(v), sum(y for _, y in v), min(k for k, _ in v)) for t, v in entries.items()]
    n, positive = sum(e[1] for e in entries), sum(e[2] for e in entries)
    weight, share = {}, positive / n
    for w in {w for e in entries for w in e[0]}:
        c, p = sum(e[1] for e in entries if w in e[0]), sum(e[2] for e in entries if w in e[0])
        weight[w] = (math.log((n + 1) / (c + 1)) + 1e-6) * (0.2 + abs((p - c * share) / math.sqrt(c * share * (1 - share))))

    def vector(b):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in b.items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = [vector(e[0]) for e in entries]

    def toxic_share(v, without=None):
        cos = sorted(((round(sum(x * u.get(w, 0) for w, x in v.items()), 9), j) for j, u in enumerate(vectors) if j != without), reverse=True)
        votes, least = 0, 0.0
        for c, j in cos:
            votes += entries[j][1]
            if votes >= 8:
                least = c
                break
        near = [(min(c, 1.0), j) for c, j in cos if c > 0 and c >= least]
        total = sum(entries[j][1] / (1.05 - c) for c, j in near) + 0.5
        return (sum(entries[j][2] / (1.05 - c) for c, j in near) + 0.5 * (positive + 0.5) / (n + 1)) / total

    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.fit(docs, marks)
    curve = toxicity.Index([], np.zeros(0), np.zeros(0), np.zeros(0))
    curve.toxic, curve.votes = np.array([e[2] for e in entries]), np.array([e[1] for e in entries])
    curve.calibrated(np.array([toxic_share(v, j) for j, v in enumerate(vectors)]))
    assert abs(curve.slope - index.slope) < 1e-3 and abs(curve.shift - index.shift) < 1e-3
    got = sorted(toxicity.score(docs, marks).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, (k, t) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        want = index.probability(toxic_share(vector(bag(t))))
        assert (r["doc_id"], r["held_out"]) == (k, held(k)) and abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.95 and np.mean([r["predicted"] for r in got if not r["toxic"]]) < 0.02
    odd = frame(spark, [(1, None), (2, ""), (None, "idiot"), (2, "x")])
    out = toxicity.score(odd, labels.limit(0)).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out) and all(r["predicted"] in (0, 1) for r in out)
    assert toxicity.score(odd.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(k, f"some text idiot {k}", 1, 2, 3, 4.0, "r", 5) for k in range(9)], "doc_id int, text string, y int, i int, t int, score double, row string, `a.b` int")
    kept = toxicity.accepted(odd, spark.createDataFrame([(2, 1), (3, 0)], "doc_id int, toxic int"))
    assert kept.columns == odd.columns and kept.schema == odd.schema and {r["a.b"] for r in kept.collect()} <= {5}
    assert toxicity.score(odd, labels).count() == 9
    assert toxicity.accepted(docs, labels).columns == docs.columns


def test_toxicity_indexes_every_term_and_example(spark):
    """A copy of any labelled training text finds it, however plain its words; a word of one example alone is met."""
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    train = [k for k in range(400) if not held(k)][:120]
    own = {k: "".join("abcdefghij"[int(d)] for d in f"{k:04}") for k in train}
    texts = {k: f"plain common words about {own[k]} and other matters" for k in train}
    rows = [*texts.items(), (9001, texts[train[5]]), (9002, f"only {own[train[7]]}")]
    labels = spark.createDataFrame([(k, int(n % 4 == 1)) for n, k in enumerate(train)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows), labels).collect()}
    assert got[9001]["evidence"].startswith(f"{train[5]}:1.000:1/1")
    assert got[9002]["evidence"].startswith(f"{train[7]}:")
    assert all(got[k]["evidence"].startswith(f"{k}:1.000:") for k in train)


def test_hidden_markov_forward_is_exact():
    rng = np.random.default_rng(1)
    unit = lambda x, a: x / x.sum(a, keepdims=True)
    model = hidden_markov.Model(unit(rng.random(3), 0), unit(rng.random((3, 3)), 1), unit(rng.random((5, 3)), 0))
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 3, 5)]
    first = np.cumsum([0, *map(len, seqs)])
    import itertools

    for s, got in zip(seqs, model.log_likelihood(np.concatenate(seqs), first), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert abs(got - np.log(total)) < 1e-9
    # over all sequences of one length the model sums to one
    every = np.array(list(itertools.product(range(5), repeat=4))).ravel()
    assert abs(np.exp(model.log_likelihood(every, np.arange(0, len(every) + 1, 4))).sum() - 1) < 1e-9
    before = None
    for _ in range(6):
        counts = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
        now = model.expected(np.concatenate(seqs), first, counts)
        assert abs(counts[2].sum() - first[-1]) < 1e-5 and (before is None or now >= before - 1e-5)
        before = now
        model = hidden_markov.Model(unit(counts[0], 0), unit(counts[1], 1), unit(counts[2], 0))


def test_hidden_markov_stretches_are_exact(monkeypatch):
    """Long texts, cut and joined by transfer matrices, give the counts and likelihoods of whole ones."""
    rng = np.random.default_rng(4)
    unit = lambda x, a: x / x.sum(a, keepdims=True)
    model = hidden_markov.Model(unit(rng.random(3), 0), unit(rng.random((3, 3)) ** 3, 1), unit(rng.random((50, 3)) ** 3, 0))
    seqs = [rng.integers(0, 50, n) for n in (1, 2, 700, 40, 41, 999, 7)]
    symbols, first = np.concatenate(seqs), np.cumsum([0, *map(len, seqs)])
    got = []
    for long, stretch in ((10**9, 512), (6, 4), (40, 17)):
        monkeypatch.setattr(hidden_markov, "LONG", long)
        monkeypatch.setattr(hidden_markov, "STRETCH", stretch)
        counts = [np.zeros(3), np.zeros((3, 3)), np.zeros((50, 3))]
        got.append((model.log_likelihood(symbols, first), model.expected(symbols, first, counts), *counts))
        assert abs(got[-1][0].sum() - got[-1][1]) < 1e-2 and abs(counts[1].sum() - (len(symbols) - len(seqs))) < 1e-2
    for x in got[1:]:
        assert np.allclose(x[0], got[0][0], atol=1e-7) and all(np.allclose(a, b, rtol=1e-4, atol=1e-3) for a, b in zip(x, got[0], strict=True))


def brute_markov(rows, first, steps):
    """Baum-Welch over whole texts with a loop for each text and token, from the first shares of states; log10 likelihoods."""
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    texts = [[w.lower() for w in words_of(t)] + [None] for _, t in rows]
    k = hidden_markov.STATES
    known, counts = {}, {}
    for (i, _), t in zip(rows, texts, strict=True):
        for w in t if not held(i) else ():
            counts[w] = counts.get(w, 0) + 1
    name = lambda w: int(hidden_markov.END) if w is None else int(text_kernels.words(pa.array([w.decode()]))[4][0])
    start = dict(zip(first[0].tolist(), first[1].astype(float), strict=True))
    for w in counts:
        known[w] = start.get(name(w), np.full(k, 1 / k))
    n, v = sum(counts.values()), len(counts)
    pi, move = np.full(k, 1 / k), np.full((k, k), 0.02 / (k - 1))
    np.fill_diagonal(move, 0.98)
    for step in range(steps + 1):
        stored = {w: 2 ** ((np.clip(np.round(np.log2(np.maximum(x, 1e-30)) * 20) + 255, 0, 255) - 255) / 20) for w, x in known.items()}
        sums = sum(stored[w] * c for w, c in counts.items())
        emit = {w: stored[w] * c / sums * (1 - 1 / (n + v + 1)) for w, c in counts.items()}
        of = lambda w: emit.get(w, np.full(k, 1 / (n + v + 1)))  # noqa: B023, E731
        likelihoods, new, a0, m0 = [], {w: np.zeros(k) for w in counts}, np.zeros(k), np.zeros((k, k))
        for (i, _), t in zip(rows, texts, strict=True):
            alphas, scales = [], []
            for j, w in enumerate(t):
                a = (pi if j == 0 else alphas[-1] @ move) * of(w)
                scales.append(a.sum())
                alphas.append(a / a.sum())
            likelihoods.append(float(np.log10(scales).sum()))
            if held(i) or step == steps:
                continue
            b = np.ones(k)
            for j in range(len(t) - 1, -1, -1):
                new[t[j]] += alphas[j] * b
                if j:
                    m0 += np.outer(alphas[j - 1], of(t[j]) * b / scales[j]) * move
                    b = move @ (of(t[j]) * b) / scales[j]
                else:
                    a0 += alphas[0] * b
        if step < steps:
            known = {w: x / x.sum() for w, x in new.items()}
            pi, move = (a0 + 0.05) / (a0 + 0.05).sum(), (m0 + 0.05) / (m0 + 0.05).sum(1, keepdims=True)
    return likelihoods


def test_hidden_markov_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hidden_markov, "PART_BYTES", 2000)
    monkeypatch.setattr(hidden_markov, "LONG", 50)
    monkeypatch.setattr(hidden_markov, "STRETCH", 16)
    rows = [(k, t) for k, t in corpus(33, 90)] + [(None, "no id of it"), (1000, "far " * 700)]
    docs = frame(spark, rows)
    train = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where(~hidden_markov.held_out("i"))
    want = brute_markov(rows, hidden_markov._first_shares(train), 2)
    got = sorted(hidden_markov.score(docs, 2).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, (key, x) in zip(got, sorted(zip(rows, want, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0)), strict=True):
        assert r["doc_id"] == key[0] and abs(r["score"] - x) < 0.02 + 0.002 * r["n_tokens"]


def test_hidden_markov(spark):
    import math
    from collections import Counter

    rows = corpus(21, 150) + [(None, "no id"), (4, "a b"), (4, "a b")]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: [w.lower() for w in words_of(t)] + [None]
    counts = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted(hidden_markov.score(frame(spark, rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(tokens(r[1]))))
    for r, (k, t) in zip(got, want, strict=True):
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t))
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k, held(k), len(tokens(t)), sum(w in counts for w in tokens(t)), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert hidden_markov.score(frame(spark, rows).limit(0)).count() == 0


def test_hidden_markov_keeps_rare_words(spark):
    """Words met once among 100,000 tokens and more have emissions of their own."""
    rng = random.Random(5)
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    rows = []
    for n, k in enumerate([k for k in range(100) if not held(k)][:60]):
        rows.append((k, " ".join(f"{'ab'[n % 2]}{rng.randrange(20)}" for _ in range(2500)) + (" rarea" if n == 0 else " rareb" if n == 1 else "")))
    new = [k for k in range(1000, 1100) if held(k)][:2]
    rows += [(k, " ".join(f"a{j}" for j in range(20)) + f" {w}") for k, w in zip(new, ("rarea", "rareb"))]
    got = {r["doc_id"]: r for r in hidden_markov.score(frame(spark, rows)).collect()}
    assert got[new[0]]["train_tokens"] > 100_000 and abs(got[new[0]]["base_score"] - got[new[1]]["base_score"]) < 1e-9
    assert got[new[0]]["score"] > got[new[1]]["score"] + 0.01
