"""Spelling variants, licence scan and Merkle manifest against brute force, and their defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillspark.llm import license_scan, merkle, spelling

DOCS = "doc_id long, text string, source string, lang string, n_chars long, word string, leaf string, at long"


def frame(spark, rows):
    """Documents with further columns of clashing names."""
    return spark.createDataFrame([(i, t, s, "x", None if t is None else len(t), "w", "l", 7) for i, t, s in rows], DOCS)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(words):
    """{word: (form, root, n, n_near, form_n)} of {word: n}, every pair compared."""
    form, out = {}, {}
    met = {w: [v for v in words if near(w, v)] for w in words}
    for w, vs in met.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(met[w]), form[w] and words[form[w]])
    return out


def counted(docs):
    counts = {}
    for i, t, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def word_rows(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_variants_equal_all_pairs(spark, monkeypatch, chunk):
    """Few letters, so that grams repeat within words; with small chunks the frequent grams are split between shards."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "HELD", 30)
    rng = random.Random(chunk)
    words = {}
    for _ in range(120):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 6, 25, 30, 125, 700])
        k = rng.randrange(len(w))
        for v in (w[:k] + w[k + 1 :], w[:k] + "c" + w[k:], w[:k] + "c" + w[k + 1 :]):
            if len(v) >= 6:
                words.setdefault(v, rng.choice([5, 5, 30]))
    words["x" * 3000], words["x" * 3001] = 5, 50
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert word_rows(spelling.variants(df).collect()) == variants_of(words)
    pairs = [(r["word"], r["other"]) for r in spelling.near_pairs(df).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})


def test_damaged_variants_of_documents(spark):
    rng = random.Random(4)
    vocabulary = ["Sentence", "sentence", "éclairé", "Éclairé", "straße", "short", "abcdefgh", "abcdefgi", "x×y÷zzz", "lettre's"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(60)) + rng.choice(["", ",", "1"]), None) for k in range(400)]
    docs += [(None, "sentence " * 9, None), (5, "sentence", "s"), (401, None, "s"), (402, "", "s"), (402, " \t", "s"), (403, "lengthy" * 5000, None)] + [(404, "abcdefgj " * 5, None)] * 2
    assert word_rows(spelling.damaged_variants(frame(spark, docs)).collect()) == variants_of(counted(docs))


def test_no_words(spark):
    assert spelling.damaged_variants(frame(spark, [])).collect() == []
    assert spelling.damaged_variants(frame(spark, [(1, None, "s"), (2, "", None)])).collect() == []


def test_merge_keeps_what_reaches_the_count():
    rng = random.Random(1)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 15))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, 5)
        want = [v for v in range(40) if sum(v in x for x in lists) >= least]
        assert list(spelling._merged(lists, least)) == want


def license_rows(docs, phrases, templates):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)

    out = []
    for i, t, _ in docs:
        ws, places, base = words(t), [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, best = set(base), 1.0 if places else 0.0
        for line, (label, template) in itertools.product((t or "").split("\n"), templates):
            want = set(words(template))
            share = len(want & set(words(line))) / len(want)
            if share * 100 >= 80:
                labels.add(label)
                best = max(best, share)
        out.append((i, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 9)))
    return sorted(out, key=str)


def scanned(df):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted(((*(r[c] for c in columns[:-1]), round(r["score"], 9)) for r in df.select(*columns).collect()), key=str)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["mit", "license", "MIT License", "cc by", "CC-BY", "Apache", "gnu general", "public license", "é", "the", "0", "[", "\x7f", "under", "licensed", "version", "2", "nc", "4", "ÀMIT license"]
    docs = [(k, "".join(rng.choice(bits) + rng.choice([" ", " ", "\n", ".", "--"]) for _ in range(rng.randint(0, 60))), None) for k in range(150)]
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        words = t.split()
        del words[len(words) // 2]
        docs += [(200 + k, f"say\n{t}\nmore", "s"), (300 + k, " ".join(words[::-1]).upper(), "s"), (400 + k, " ".join(words[: len(words) // 2]), "s")]
    docs += [(None, "mit license mit license", None), (None, "mit license", None), (5, None, None), (5, "", None), (6, "\n \n", None), (7, "the licensed under version 2 " * 3000, None), (8, "mit\nlicense", None)]
    assert scanned(license_scan.scan(frame(spark, docs))) == license_rows(docs, license_scan.PHRASES, license_scan.TEMPLATES)


def test_licenses_with_overlapping_phrases(spark):
    docs = [(1, "a b a b a", None), (2, "B a", None), (3, "x", None)]
    phrases, templates = {"a b a": "one", "b a": "two", "a": "one"}, [("t", "a b c d e"), ("u", "x")]
    assert scanned(license_scan.scan(frame(spark, docs), phrases, templates)) == license_rows(docs, phrases, templates)
    assert license_scan.scan(frame(spark, [])).collect() == []


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, t, s, text):
    n = None if t is None else len(t)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, "x", n, text)))


def tree_of(leaves, fanout):
    """Root, and for each leaf the steps (left, right) up to it."""
    steps, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p - p % fanout : p - p % fanout + fanout]
            steps[k].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
            at[k] = p // fanout
        nodes = [digest(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], steps


def manifest(docs, fanout=16):
    by = {}
    for row in docs:
        by.setdefault(row[2], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        rows = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r[0], r[1], s, r[1])))
        trees[s] = (rows, *tree_of([leaf_of(i, t, s, t) for i, t, _ in rows], fanout))
    root, upper = tree_of([trees[s][1] for s in names], fanout)
    out = []
    for s, above in zip(names, upper):
        rows, subroot, steps = trees[s]
        for (i, t, _), own in zip(rows, steps):
            odd = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t is not None
            x = leaf_of(i, t, s, "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if odd else t)
            for left, right in own + above:
                x = digest(left, x, right)
            proof = digest(*(a + b for a, b in own + above))
            out.append((i, leaf_of(i, t, s, t), subroot, root, proof, x, x == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("sources", "n"), [(["a", "b", None, "É", "z"], 700), ([None], 1), (["only"], 300), ([f"s{k}" for k in range(40)], 60)])
def test_manifest_equals_plain_trees(spark, sources, n):
    rng = random.Random(n)
    # The first source holds most rows: more than one superblock of superblocks' worth of leaves.
    docs = [(k, rng.choice(["Text", "text é", "", None, "A" * 3000]), sources[0] if rng.random() < 0.6 else rng.choice(sources)) for k in range(n)]
    if n > 500:
        docs += [(None, "Same", None), (None, "Same", None), (3, "Same", "a"), (3, "Same", "a"), (-4, "X", "")]
    got = merkle.digests(frame(spark, docs)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=str) == manifest(docs)
    tampered = [r for r in got if not r["verified"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in tampered)


def test_manifest_of_narrow_trees(spark):
    docs = [(k, "T", "a") for k in range(37)] + [(k, "T", f"b{k}") for k in range(5)]
    proved = merkle.proofs(frame(spark, docs), list(merkle.COLUMNS), "source", "doc_id", fanout=2, levels=3).collect()
    want = {(r[0], r[1]): r[3] for r in manifest(docs, 2)}
    assert {(r["doc_id"], r["leaf"]): r["root"] for r in proved} == want
    for r in proved:
        x = r["leaf"]
        for s in r["steps"]:
            x = digest(s["left"], x, s["right"])
        assert x == r["root"]


def test_manifest_of_nothing(spark):
    assert merkle.digests(frame(spark, [])).collect() == []
