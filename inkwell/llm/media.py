"""Operator 6: content-addressed media payloads in tar shards, with metadata columns filled by header-only range reads."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet, ship

WIDTH = 64  # samples in a row of the stored image
HEADER_BYTES = 33  # signature and IHDR chunk
SHARD_BYTES = 256 << 20
LEVEL = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, padded with zero bytes up to a positive multiple of WIDTH; their number unpadded."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of WIDTH columns whose samples are the payload; equal payloads give equal files."""
    rows = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // WIDTH, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> str:
    """The metadata that the first HEADER_BYTES bytes hold."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        return "unknown"
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return f"png {width}x{height} {bits}-bit colour {colour}"


def decode_image(data: bytes) -> bytes:
    """The samples of a file that encode_image wrote."""
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = zlib.decompress(body)
    return b"".join(rows[i + 1 : i + 1 + WIDTH] for i in range(0, len(rows), WIDTH + 1))


_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and its path there; Spark's names of stores count as well as Arrow's."""
    scheme, _, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}" if rest else folder)


class ShardWriter:
    """Appends files to tar shards in a folder of any store; a shard gets its final name only when it is whole."""

    def __init__(self, folder: str):
        self.fs, self.base = _store(folder)
        self.tar = None

    def _open(self) -> None:
        self.fs.create_dir(self.base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.sink = self.fs.open_output_stream(f"{self.base}/{self.name}.part")
        self.tar, self.at = tarfile.open(fileobj=self.sink, mode="w|", format=tarfile.USTAR_FORMAT), 0

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        if self.tar is None:
            self._open()
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        self.tar.addfile(info, io.BytesIO(data))
        begin = self.at + tarfile.BLOCKSIZE
        self.at = begin + len(data) + -len(data) % tarfile.BLOCKSIZE
        return self.name, begin

    def full(self) -> bool:
        return self.tar is not None and self.at >= SHARD_BYTES

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.sink.close()
            self.fs.move(f"{self.base}/{self.name}.part", f"{self.base}/{self.name}")
            self.tar = None


def write_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each document's payload in tar shards under ``folder``; rows (id, n_bytes, digest, shard, begin, length).

    A task stores equal payloads once. A task that is run anew writes shards of other names, and its rows point there;
    what a lost attempt left is not pointed at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, where, rows = ShardWriter(folder), {}, []

        def flush() -> pa.RecordBatch:
            writer.close()
            ids, *cols = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=[id_col, "n_bytes", "digest", "shard", "begin", "length"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                payload, n = payload_of(text)
                data = encode_image(payload)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in where:
                    where[digest] = (*writer.add(digest, data), len(data))
                rows.append((i, n, digest, *where[digest]))
                if writer.full():
                    yield flush()
                    where.clear()  # bounds what a task remembers
        if rows:
            yield flush()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, n_bytes long, digest string, shard string, begin long, length long")


def _reader(folder: str):
    store, base = _store(folder)
    files: dict[str, object] = {}

    def read(shard: str, begin: int, length: int) -> bytes:
        if shard not in files:
            files.clear()
            files[shard] = store.open_input_file(f"{base}/{shard}")
        return files[shard].read_at(length, begin)

    return read


def read_metadata(blobs: DataFrame, folder: str) -> DataFrame:
    """Add ``feature`` to rows (digest, shard, begin, length), reading the first HEADER_BYTES bytes of each only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for b in batches:
            x = b.to_pydict()
            out = [read_header(read(s, o, min(n, HEADER_BYTES))) for s, o, n in zip(x["shard"], x["begin"], x["length"], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "feature"])

    return blobs.select("digest", "shard", "begin", "length").mapInArrow(run, "digest string, shard string, begin long, length long, feature string")


def read_back(blobs: DataFrame, folder: str) -> DataFrame:
    """Read whole stored files and describe their payloads: rows as given, with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for b in batches:
            x = b.to_pydict()
            out = []
            for s, o, n in zip(x["shard"], x["begin"], x["length"], strict=True):
                data = read(s, o, n)
                payload = decode_image(data)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*b.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blobs.schema.fields)
    return blobs.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, shard, begin) per document.

    Null text counts as empty and gives a payload of WIDTH zero bytes. Equal texts share one stored file and have equal
    values throughout. Repeated rows give repeated rows; other columns are not read; an empty table gives an empty one.
    The shards stay in the shared folder beside the index table. The rows of a text that very many rows hold are dealt over tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    at = Scratch(spark, "media")
    folder = at.path("shards") if "://" in at.root or at.root.startswith("/") else "file://" + at.path("shards").removeprefix("file:")
    index = at.put(write_payloads(docs, folder, id_col, text_col), "index")
    # tasks may have stored equal payloads: the first place counts
    blobs = index.groupBy("digest").agg(F.min(F.struct("shard", "begin", "length")).alias("at"), F.count(F.lit(1)).alias("n")).select("digest", "at.*", "n")
    described = at.put(read_back(read_metadata(blobs, folder), folder).join(blobs.select("digest", "n"), "digest"), "blobs")
    rows = meet(index.select(F.col(id_col).alias("_id"), "n_bytes", "digest"), described, ["digest"], ["_id"]).withColumnRenamed("_id", id_col)
    return rows.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "begin")
