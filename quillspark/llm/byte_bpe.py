"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries, a blank between two characters that are no white space: the
pattern's matches never cross the place before such a blank, so the ids of the pieces, put together,
are those of the whole text. Decoding gathers the raw bytes of each id, so that ids that split a
character still give the exact bytes.

Defined cases: a null text is an empty one; an empty text has no ids. Rows with null or repeated ids
are encoded each on its own. Other columns of the input are not read. An id outside the vocabulary
raises KeyError in decoding. Very long texts are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.text_kernels import batches_by_bytes

#: Characters from which a text is cut into pieces.
CHUNK = 1 << 16
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


@lru_cache(4)
def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file: (encoding, bytes of each id)."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), {i: b for b, i in ranks.items()}


def pieces(text: str, chunk: int = CHUNK) -> list[str]:
    """The text cut before safe blanks, in pieces of about chunk characters; longer where none is near."""
    out, lo = [], 0
    while len(text) - lo > chunk:
        cut = _SAFE.search(text, lo + chunk)
        if not cut:
            break
        out.append(text[lo : cut.start()])
        lo = cut.start()
    out.append(text[lo:])
    return out


def encode_text(enc, text: str, chunk: int = CHUNK) -> list[int]:
    """Ids of a whole text, without special tokens."""
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, chunk) for i in enc.encode_ordinary(p)]


def _encoded(enc, texts: list[str | None], chunk: int) -> list[np.ndarray]:
    return [np.asarray(encode_text(enc, t or "", chunk), "<u4") for t in texts]


def _decoded(raw: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs -> (id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in a binary column."""
    scratch.few_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc, _ = encoding(ranks_path, pattern)
        for b in batches_by_bytes(batches, "t"):
            ids = _encoded(enc, b.column(1).to_pylist(), chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["i", "n_tokens", "ids"])

    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind.simpleString()}, n_tokens long, ids binary")
    return out.withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the raw bytes of the ids; bytes, as they need not be whole characters."""
    at = encoded.columns.index(ids_col)
    schema = encoded.selectExpr("*", f"CAST(NULL AS BINARY) AS `{out_col}`").schema

    def run(batches):
        _, raw = encoding(ranks_path, pattern)
        for b in batches:
            made = [None if x is None else _decoded(raw, x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs -> (id, n_tokens, ids, decoded): decode(encode(docs)) in one pass of one worker a task, which holds the vocabulary once."""
    scratch.few_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc, raw = encoding(ranks_path, pattern)
        for b in batches_by_bytes(batches, "t"):
            ids = [x.tobytes() for x in _encoded(enc, b.column(1).to_pylist(), chunk)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([_decoded(raw, x) for x in ids], pa.binary())], ["i", "n_tokens", "ids", "decoded"])

    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind.simpleString()}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("i", id_col)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the token count and the digests of the ids and of the decoded bytes."""
    both = encode_and_decode(docs, ranks_path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
