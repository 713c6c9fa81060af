"""The pipeline's stages against brute force on the smallest table."""

import hashlib
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from quillspark.llm import byte_bpe, toxicity

DIR = "/root/testdata/sf0.001"


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def shingles(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def single(rows):
    """Ids that stay of {id: text}: the smallest of each group of similar texts."""
    sets, up = {k: shingles(t) for k, t in rows.items()}, {k: k for k in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k for k in rows if find(k) == k}


def cut(rows):
    """{id: words left} without the passages of smaller ids."""
    first, out = {}, {}
    for k in sorted(rows):
        w = words(rows[k])
        gone = set()
        for j in range(len(w) - corpus_pipeline.PASSAGE + 1):
            g = tuple(w[j : j + corpus_pipeline.PASSAGE])
            if first.setdefault(g, k) < k:
                gone |= set(range(j, j + corpus_pipeline.PASSAGE))
        out[k] = [x for j, x in enumerate(w) if j not in gone]
    return out


def leaked(rows, items):
    asked = [shingles(t) for t in items]
    return {k for k, t in rows.items() if any(i and 100 * len(i & shingles(t)) >= 80 * len(i) for i in asked)}


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "decontamination", "byte_bpe"]

    clean = corpus_pipeline.drop_toxic(spark, docs, DIR)
    toxic = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(rows) - toxic and clean.columns == docs.columns

    one = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
    assert {r["doc_id"] for r in one.collect()} == single(rows) and one.columns == docs.columns

    kept = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, DIR).collect()}
    assert {k: words(r["text"]) for k, r in kept.items()} == cut(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())

    items = [r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    found = leaked(rows, items)
    assert found and {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, DIR).collect()} == set(rows) - found

    # the stages one after the other
    left = {k: t for k, t in rows.items() if k not in toxic}
    left = {k: left[k] for k in single(left)}
    left = {k: b" ".join(w).decode() for k, w in cut(left).items()}
    left = {k: t for k, t in left.items() if k not in leaked(left, items)}
    enc, _ = byte_bpe.encoding(corpus_pipeline.RANKS, public_tokenizers.PATTERN)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(out) == set(left)
    for k, r in out.items():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"] and len(ids) == r["n_tokens"]
        assert words(enc.decode(ids)) == words(left[k])


def test_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated ids and rows, ties, long texts, and further columns of clashing names."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, None), (4, ""), (5, " \n"), (None, "a b c d e f g h"), (None, None)]
    rows += [(6, f"first {passage}"), (7, f"{passage} {' '.join(f'z{k}' for k in range(200))}"), (8, "long " * 50_000), (9, f"{'q ' * 30}leaked test item of quite some words here")]
    data = [(k, t, 0, 7, "t", 1, 0.5, "dot") for k, t in rows]
    schema = "doc_id long, text string, n_chars long, i int, t string, y int, score double, `row.k` string"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "leaked test item of quite some words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "n_chars", "i", "t", "y", "score", "row.k"]
    assert {r["row.k"] for r in docs.collect()} == {"dot"}
    out = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"] > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == [((False, 1), True), ((False, 3), False), ((False, 4), False), ((False, 5), True), ((False, 6), True), ((False, 7), True), ((False, 8), True), ((True, 0), False), ((True, 0), True)]

    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
