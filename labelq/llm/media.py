"""Media columns: content-addressed payloads in tar shards (operator 9).

A payload is stored once per digest, as a lossless 8-bit greyscale PNG, in tar
shards of the shared folder. Rows carry digest, shard, offset and length; a
range read of the first bytes fills the metadata columns, a range read of the
whole member gives the samples back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelq.llm.common import materialise, maybe_broadcast, shared_dir, small_batches, table

#: Payloads are padded with byte 255 to rows of this many samples.
ROW = 576
#: Bytes that hold a PNG's signature and header.
HEADER = 33
#: Bytes of stored members that one shard holds on average.
SHARD_BYTES = 64 << 20
_SIGN = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """8-bit greyscale PNG, one row for each ROW samples, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER bytes."""
    if data[:8] != _SIGN or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> bytes:
    """The samples of a PNG that encode() made."""
    width, height, _ = header(data)
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at:at + 4])
        if data[at + 4:at + 8] == b"IDAT":
            packed.append(data[at + 8:at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and entropy (bits) of the samples, as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, v = counts.sum(), np.arange(256)
    mean = (counts * v).sum() / n
    p = counts[counts > 0] / n
    return f"{n // ROW}:{mean:.4f}:{max(0.0, (counts * v * v).sum() / n - mean * mean) ** 0.5:.4f}:{max(0.0, float(-(p * np.log2(p)).sum())):.4f}"


def _filesystem(uri: str):
    """A pyarrow file system and path for a folder URI; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Encode (digest, text) rows and write them to tar shards where they are read, without
    a shuffle; returns digest, shard, offset, length.

    A task writes each digest once. A shard's name is unique to the attempt that wrote
    it and the index names it, so a retried task cannot mix up two attempts' offsets.
    Run this once and materialise it."""

    def write(batches):
        f, base = _filesystem(folder)
        f.create_dir(base, recursive=True)
        name, out, seen = None, None, set()
        for b in batches:
            index = []
            for digest, text in zip(b.digest, b.text):
                if digest in seen:
                    continue
                media = encode(pad(text.encode("utf-8", "surrogatepass")))
                if out is None:
                    name = f"{uuid.uuid4().hex}.tar"
                    out = f.open_output_stream(f"{base}/{name}")
                seen.add(digest)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                at = out.tell() + len(head)
                out.write(head + media + b"\0" * (-len(media) % 512))
                index.append((digest, name, at, len(media)))
            yield pd.DataFrame(index, columns=["digest", "shard", "offset", "length"])
            if out is not None and out.tell() >= SHARD_BYTES:
                out.write(b"\0" * 1024)
                out.close()
                out = None
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return rows.mapInPandas(write, "digest string, shard string, offset long, length long")


def _reader(folder: str):
    f, base = _filesystem(folder)
    files: dict = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in files:
            files.clear()  # one open shard at a time
            files[shard] = f.open_input_file(f"{base}/{shard}")
        return files[shard].read_at(length, offset)

    return read


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """Metadata columns of stored members, from range reads of HEADER bytes."""

    def read(batches):
        get = _reader(folder)
        for b in batches:
            meta = [header(get(s, o, HEADER)) for s, o in zip(b.shard, b.offset)]
            yield b.assign(width=[m[0] for m in meta], height=[m[1] for m in meta], bits=[m[2] for m in meta])

    return index.mapInPandas(read, "digest string, shard string, offset long, length long, width int, height int, bits int")


def read_payloads(index: DataFrame, folder: str) -> DataFrame:
    """What the stored members hold, from range reads: (digest, payload digest, checksum
    of the last 32 bytes, stored bytes, their digest, feature)."""

    def read(batches):
        get = _reader(folder)
        for b in batches:
            out = []
            for digest, shard, offset, length, height in zip(b.digest, b.shard, b.offset, b.length, b.height):
                media = get(shard, offset, length)
                payload = decode(media)
                out.append((digest, height * ROW, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            yield pd.DataFrame(out, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return index.mapInPandas(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame, str]:
    """Rows (doc_id, n_bytes, digest), the shard index with metadata, and the folder.

    Every whole text is a payload: UTF-8, padded with byte 255. A null text is an
    empty one, whose payload is 576 bytes of 255. Rows that repeat a text share
    one stored member (rows that repeat id and text in several tasks may leave further
    ones, which the index does not name). An empty table gives no shard; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"), "text")

    # Of several documents with one digest, the one whose id sorts first as text owns the member.
    d = d.withColumn("who", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    copies = materialise(d.groupBy("digest").agg(F.min("who").alias("owner"), F.max("who").alias("last")).where("owner <> last").select("digest", "owner"))
    other = materialise(d.select("digest", "who").join(copies, "digest").where("who <> owner").select(F.col("who").alias("copy_who"), F.col("digest").alias("copy_digest")).distinct())
    other = maybe_broadcast(other, other.count(), 96)
    own = d.join(other, (d.who == other.copy_who) & (d.digest == other.copy_digest), "left_anti")
    index = materialise(write_shards(own.select("digest", "text"), folder))
    index = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    index = index.repartition("shard").sortWithinPartitions("shard", "offset")
    index = materialise(read_headers(index, folder))
    return d.drop("text", "who"), index, folder


def op9_media_columns(spark, sf_dir):
    rows, index, folder = media_columns(table(spark, sf_dir, "documents"))
    found = read_payloads(index.select("digest", "shard", "offset", "length", "height"), folder)
    return rows.join(found, "digest").drop("digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
