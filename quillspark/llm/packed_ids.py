"""Token ids in files of fixed-width bit packing, in ascending document order, with random access.

File: blocks of packed ids one after another, then a footer and a trailer. Each id takes the minimum
bits of the vocabulary; eight ids take as many bytes as an id has bits, so a block of a multiple of
eight ids is whole bytes and unpacks with a few numpy operations on columns. The footer holds the byte
offset of every block, the first id of every document and the document ids; the trailer holds counts.
Files are named by partition and attempt; only those in the returned rows count, so repeated tasks do no
harm.

Words cut at ASCII white space, and between a Latin letter and a comma or full stop, are encoded once each
and kept in a bounded cache, ASCII capitals made small as the tokenizer makes them: neither its normaliser
nor its pattern looks across such places. Words of the generation before stay at hand. Texts in which the string
of a special token may stand go to the library as they are.

Defined cases: null texts are empty and hold the end id alone; null document ids come first; repeated
rows are each written, equal ids in the order of their texts; very long texts are written whole; columns beside
id and text are not read; an empty table makes no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.text_kernels import batches_by_bytes

#: Ids of a block (a multiple of 8), words kept in the cache of a worker, ids read at once.
BLOCK, CACHED_WORDS, READ_IDS = 4096, 300_000, 1 << 21
_JOINT = re.compile(rb"([a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([.,])")
_TRAILER = struct.Struct("<QQQIB3x4s")
_MAGIC = b"QPK1"
_NO_ID = -(2**63)


def width_of(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids packed with the lowest bit first; the last group of eight is filled with zeros."""
    n = -(-len(ids) // 8)
    lanes = np.zeros((n, 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, width), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        moved = lanes[:, j] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, first + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint32)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        got = np.zeros(len(rows), np.uint64)
        for k in range(-(-(shift + width) // 8)):
            got |= rows[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (got >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n]


class Writer:
    """Appends documents to one file."""

    def __init__(self, stream, width: int, block: int = BLOCK):
        self.stream, self.width, self.block = stream, width, block
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, 0
        self.offsets, self.starts, self.docs = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> int:
        """Appends one document and returns the place of its first id in this file."""
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"id {ids.max()} needs more than {self.width} bits")
        start = self.n_ids
        self.starts.append(start)
        self.docs.append(_NO_ID if doc_id is None else doc_id)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= 64 * self.block:
            self._flush(False)
        return start

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        if whole:
            size = self.block * self.width // 8
            self.offsets += range(self.at, self.at + -(-whole // self.block) * size, size)
            data = pack(ids[:whole], self.width)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for x, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.docs, "<i8")):
            self.stream.write(np.asarray(x, kind).tobytes())
        self.stream.write(_TRAILER.pack(self.n_ids, len(self.docs), len(self.offsets), self.block, self.width, _MAGIC))
        self.stream.close()


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, path: str):
        system, at = scratch.store(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        self.n_ids, n_docs, n_blocks, self.block, self.width, magic = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} holds no packed ids")
        n = 8 * (n_blocks + 2 * n_docs)
        table = self.file.read_at(n, size - _TRAILER.size - n)
        self.data_end = size - _TRAILER.size - n
        self.offsets = np.frombuffer(table, "<u8", n_blocks)
        self.starts = np.append(np.frombuffer(table, "<u8", n_docs, 8 * n_blocks), self.n_ids).astype(np.int64)
        self.docs = np.frombuffer(table, "<i8", n_docs, 8 * (n_blocks + n_docs))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi-1 of the file; reads only the blocks that hold them."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.data_end
        base = first * self.block
        return unpack(self.file.read_at(end - begin, begin), self.width, min(self.n_ids, (last + 1) * self.block) - base)[lo - base : hi - base]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


_MARK = regex.compile(r"\p{M}")


def _marked(text: str) -> bool:
    try:
        text.encode("latin-1")  # far faster than a search, and holds no marks
    except UnicodeEncodeError:
        return _MARK.search(text) is not None
    return False


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), [{}, {}]


def encode_texts(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of whole texts, as the library gives them with add_special_tokens=False."""
    tokenizer, cache = _tokenizer(path)
    # Whole texts go to the library where they may hold the string of a special token, which is one token, or marks: those
    # compose with letters before letters are made small, and a small letter may compose where its capital doesn't.
    special = {k for k, t in enumerate(texts) if t and ("<|" in t or _marked(t))}
    whole = tokenizer.encode_batch_fast([texts[k] for k in special], add_special_tokens=False) if special else ()
    split = [() if k in special else _JOINT.sub(rb"\1 \2", (t or "").encode().lower()).split() for k, t in enumerate(texts)]
    missing = set().union(*split).difference(cache[0])
    if len(cache[0]) + len(missing) > CACHED_WORDS:
        cache[:] = [{}, cache[0]]
        missing = set().union(*split)
    now, before = cache
    todo = []
    for word in missing:
        if word in before:
            now[word] = before[word]
        else:
            todo.append(word)
    for word, got in zip(todo, tokenizer.encode_batch_fast([w.decode() for w in todo], add_special_tokens=False), strict=True):
        now[word] = array("I", got.ids).tobytes()
    get = now.__getitem__
    out = [np.frombuffer(b"".join(map(get, w)), "<u4") for w in split]
    for k, got in zip(special, whole, strict=True):
        out[k] = np.array(got.ids, "<u4")
    return out


def vocabulary_of(path: str) -> int:
    return _tokenizer(path)[0].get_vocab_size()


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every document and returns the index: (file_no, file, doc, start in the file, n_tokens).

    The index is a stored table; the files are those it names. Rows are dealt by ranges of document ids, so
    file numbers follow the ids.
    """
    spark = docs.sparkSession
    width = width_of(max(vocabulary_of(tokenizer_path), end_id + 1))

    def run(batches):
        writer, end = None, np.array([end_id], np.uint32)
        no = TaskContext.get().partitionId()
        path = f"{folder}/ids-{no:06d}-{uuid.uuid4().hex}.qpk"
        for b in batches_by_bytes(batches, "t"):
            if writer is None:
                system, at = scratch.store(path)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                writer = Writer(system.open_output_stream(at), width)
            keys, starts, counts = b.column(0).to_pylist(), [], []
            for k, ids in zip(keys, encode_texts(tokenizer_path, b.column(1).to_pylist()), strict=True):
                starts.append(writer.add(k, np.append(ids, end)))
                counts.append(len(ids) + 1)
            yield pa.RecordBatch.from_arrays([pa.array([no] * len(keys), pa.int64()), pa.array([path] * len(keys)), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["file_no", "file", "doc", "start", "n_tokens"])
        if writer is not None:
            writer.close()

    dealt = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).repartitionByRange("i").sortWithinPartitions("i", "t")
    return scratch.saved(dealt.mapInArrow(run, "file_no long, file string, doc long, start long, n_tokens long"), "packed-index")


def read(index: DataFrame) -> DataFrame:
    """Documents read back from the files: (doc_id, start among all ids, n_tokens, ids_crc32)."""
    spark = index.sparkSession
    files = index.groupBy("file_no", "file").agg(F.sum("n_tokens").alias("n")).orderBy("file_no").collect()  # a row for each file
    base = np.cumsum([0, *(f["n"] for f in files)]).tolist()
    todo = spark.createDataFrame([(f["file"], b) for f, b in zip(files, base, strict=False)], "file string, base long")

    def run(batches):
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(path)
                lo, n = 0, len(reader.docs)
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(reader.starts, reader.starts[lo] + READ_IDS, "right")) - 1)
                    hi = min(hi, n)
                    at = reader.starts[lo : hi + 1]
                    data = memoryview(reader.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                    cut = 4 * (at - at[0])
                    crc = [zlib.crc32(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    docs = reader.docs[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == _NO_ID), pa.array(at[:-1] + first, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi

    return todo.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
