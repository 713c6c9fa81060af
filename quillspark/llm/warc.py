"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole records, and the seek table of the
public seekable format in a skippable frame at its end; any Zstandard reader reads it. The index maps
each record identifier to bundle, frame and offset in the unpacked frame, so one record costs one frame.
Records whose payload another record holds are revisits of that record and carry no payload.

Bundles are named by partition and attempt, and only those in the index count. Payloads are matched by
SHA-1: only digests that several pages share are a table, stored before pages meet it. It is broadcast if it has
few rows; else pages are joined with it, where Spark splits the partition of a payload that many pages share.

Defined cases: null html is an empty payload; a null url gives no target; a null page id sorts after all
others; repeated ids with one payload are all responses; very long payloads are one record in a frame of its
own; columns beside page_id, url and html are not read; an empty table makes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch
from quillspark.llm.text_kernels import batches_by_bytes

#: Unpacked bytes at which a frame ends, packed bytes at which a bundle ends, and the level of packing.
FRAME, BUNDLE, LEVEL = 1 << 18, 1 << 26, 3
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX = "urn:page:"
#: Shared digests up to which they are broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000
INDEX = "page_id long, record_id string, record_type string, bundle string, frame long, offset long, length long"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; refers_to makes it a revisit, which states its payload's length but does not hold it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{PREFIX}{'none' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PREFIX}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at a place in unpacked bytes."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    begin = head + 4
    end = begin + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end where its length says")
    return fields, data[begin:end], end + 4


def opened(fields: dict[str, str], block: bytes) -> tuple[int | None, str, int | None, int, str, bytes | None]:
    """(page_id, type, refers_to, payload_bytes, payload_digest, payload); the digest of a response is of the bytes read."""
    number = lambda x: None if x.endswith(":none>") else int(x.rpartition(":")[2][:-1])
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    if kind == "revisit":
        return number(fields["WARC-Record-ID"]), kind, number(fields["WARC-Refers-To"]), length, stated, None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated or len(payload) != length:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload read differs from the one written")
    return number(fields["WARC-Record-ID"]), kind, None, length, digest, payload


class Bundle:
    """Writes records into the frames of one bundle."""

    def __init__(self, path: str, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        system, at = scratch.store(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.frame, self.out, self.pack = path, frame, system.open_output_stream(at, compression=None), zstandard.ZstdCompressor(level=level)
        self.held, self.size, self.sizes, self.written = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Appends a record and returns its frame and its offset in the unpacked frame."""
        if self.size and self.size + len(data) > self.frame:
            self.flush()
        at = self.size
        self.held.append(data)
        self.size += len(data)
        return len(self.sizes), at

    def flush(self) -> None:
        if self.size:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, path: str):
        import zstandard

        system, at = scratch.store(path)
        self.file, self.unpack = system.open_input_file(at), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        data = self.unpack.decompress(self.file.read_at(self.sizes[k][0], self.starts[k]))
        if len(data) != self.sizes[k][1]:
            raise ValueError(f"frame {k} is not as long as the seek table says")
        return data

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages -> (page_id, url, html, digest, refers_to): refers_to is null for responses.

    Equal payloads of at least min_bytes refer to the one with the smallest page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = scratch.saved(first.where("n > 1").drop("n"), "warc-shared")
    return rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page and returns the stored index from record identifiers to frames and offsets."""
    scratch.few_rows(pages.sparkSession)

    def run(batches):
        out = None
        for b in batches_by_bytes(batches, "html"):
            rows = []
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = Bundle(f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", frame, level)
                data = record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers, date)
                rows.append((page_id, f"{PREFIX}{'none' if page_id is None else page_id}", "response" if refers is None else "revisit", out.path, *out.add(data), len(data)))
                if out.written >= bundle:
                    out.close()
                    out = None
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return scratch.saved(with_revisits(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that an index names, read back through their seek tables and verified."""
    bundles = scratch.saved(index.select("bundle").distinct(), "warc-bundles")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                bundle = BundleReader(path)
                for k in range(len(bundle.sizes)):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        fields, block, at = parse(data, at)
                        rows.append(opened(fields, block))
                    columns = list(zip(*rows, strict=True))
                    if not payloads:
                        columns[5] = [None] * len(rows)
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return bundles.repartition(max(1, bundles.count())).mapInArrow(run, RECORDS)


def fetch(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records of a set of identifiers (record_id), each read from its own frame alone."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame", "offset").sort("bundle", "frame", "offset")

    def run(batches):
        held = (None, None, None)
        for b in batches:
            rows = []
            for path, k, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held[0] != path:
                    held = (path, BundleReader(path), None)
                if held[2] is None or held[2][0] != k:
                    held = (*held[:2], (k, held[1].frame(k)))
                rows.append(opened(*parse(held[2][1], at)[:2]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return wanted.mapInArrow(run, RECORDS)
