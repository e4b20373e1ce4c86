"""Token ids in sorted-string-table shards.

A shard holds documents in key order, in blocks of about BLOCK bytes.  File layout, numbers little-endian:

    block*   zstd( entry* )        entry: varint shared, varint new, varint size, new key bytes, ids
    index    (uint16 size, last key, uint64 offset, uint32 length) for each block
    bloom    uint8 hashes, then the bits
    footer   uint64 index offset, uint64 bloom offset, uint64 documents, uint64 ids, uint8 width, 7 bytes "SSTIDS1"

A key is 13 bytes, ordered as documents are: 0 for a null id or 1, the id as a big-endian number with its sign bit turned, and
a big-endian count among equal ids in the shard.  A key shares its beginning with the key before it in the block.  A lookup asks
the Bloom filter, finds the block by binary search over the index, and reads that block alone.

Shards are ranges of doc_id, so their concatenation is the corpus in ascending order.  A shard is written under another
name and renamed, and writing it again gives the same bytes, so a lost task can be run again.

Defined results: a null or empty text is its end id alone; null doc_ids come first; rows that share a doc_id follow each other
by a hash of their text, then the text, and are kept each; no rows, no shard and no result rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_batches, shared_dir
from .tokens import WordBpe, loaded

BLOCK = 64 << 10
SHARD_BYTES = 16 << 20
BITS_PER_KEY, HASHES = 10, 7
END = 1
MAGIC = b"SSTIDS1"
FOOTER = struct.Struct("<QQQQB7s")
_INDEX = struct.Struct("<QI")


def key_of(doc_id: int | None, count: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63) if doc_id is not None else 0, count)


def doc_of(key: bytes) -> int | None:
    known, value, _ = struct.unpack(">BQI", key)
    return value - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _bloom_places(doc_id: int | None, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key_of(doc_id))
    return [((h & (1 << 64) - 1) + i * (h >> 64 | 1)) % bits for i in range(HASHES)]


def local_or_remote(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.previous = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.docs: list[int | None] = []
        self.n_ids = self.count = 0
        self.codec = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.count = self.count + 1 if self.docs and self.docs[-1] == doc_id else 0
        key = key_of(doc_id, self.count)
        shared = len(os.path.commonprefix([self.previous, key])) if self.block else 0
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.block.append(entry)
        self.size += len(entry)
        self.previous = key
        self.docs.append(doc_id)
        self.n_ids += len(ids) // self.width
        if self.size >= BLOCK:
            self._flush()

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _flush(self) -> None:
        if self.block:
            raw = self.codec.compress(b"".join(self.block))
            self.index.append((self.previous, self.at, len(raw)))
            self._write(raw)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(struct.pack("<H", len(k)) + k + _INDEX.pack(o, n) for k, o, n in self.index))
        bloom_at, bits = self.at, max(64, len(self.docs) * BITS_PER_KEY)
        places = np.zeros(bits, bool)
        for d in self.docs:
            places[_bloom_places(d, bits)] = True
        self._write(bytes([HASHES]) + struct.pack("<Q", bits) + np.packbits(places).tobytes())
        self._write(FOOTER.pack(index_at, bloom_at, len(self.docs), self.n_ids, self.width, MAGIC))


class ShardReader:
    """Random access to a shard; only footer, index, Bloom filter and the blocks asked for are read."""

    def __init__(self, uri: str):
        fs, path = local_or_remote(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, bloom_at, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        raw, at, self.keys, self.places = self.file.read_at(bloom_at - index_at, index_at), 0, [], []
        while at < len(raw):
            n = struct.unpack_from("<H", raw, at)[0]
            self.keys.append(raw[at + 2 : at + 2 + n])
            self.places.append(_INDEX.unpack_from(raw, at + 2 + n))
            at += 2 + n + _INDEX.size
        bloom = self.file.read_at(size - FOOTER.size - bloom_at, bloom_at)
        self.bits = struct.unpack_from("<Q", bloom, 1)[0]
        self.bloom = bloom[9:]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length = self.places[i]
        raw, at, key = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            new, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + new]
            yield key, raw[at + new : at + new + size]
            at += new + size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.places)):
            for key, ids in self._block(i):
                yield doc_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The first document of this id, or None."""
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(doc_id, self.bits)):
            return None
        key = key_of(doc_id)
        i = bisect_left(self.keys, key)
        return next((np.frombuffer(ids, f"<u{self.width}") for k, ids in (self._block(i) if i < len(self.places) else ()) if k == key), None)

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: tuple, folder: str | None = None, end: int = END) -> list[tuple[int, str, int, int]]:
    """Write the corpus; (number, path, documents, ids) of each shard that has documents, in order.  The driver gets a row for each shard."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-tables")
    fs, path = local_or_remote(folder)
    fs.create_dir(path, recursive=True)
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(n_batches(docs, SHARD_BYTES), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    tail = np.array([end], "<u2").tobytes()

    def run(batches):
        encoder, task = loaded(WordBpe, *tokenizer), TaskContext.get()
        number = task.partitionId()
        fs, path = local_or_remote(f"{folder}/ids-{number:06d}.sst")
        writer = None
        for b in batches:
            if b.num_rows and writer is None:
                part = f"{path}.{task.taskAttemptId()}"
                out = fs.open_output_stream(part)
                writer = ShardWriter(out, 2)
            for doc, ids in zip(b["doc_id"].to_pylist(), encoder.encode_batch([t or "" for t in b["text"].to_pylist()]), strict=True):
                writer.add(doc, ids + tail)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{folder}/ids-{number:06d}.sst"]), pa.array([len(writer.docs)]), pa.array([writer.n_ids])], names=["number", "path", "n_docs", "n_ids"])

    return sorted(tuple(r) for r in ordered.mapInArrow(run, "number long, path string, n_docs long, n_ids long").collect())


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    starts = np.cumsum([0, *(s[3] for s in shards)]).tolist()
    rows = [(s[1], start) for s, start in zip(shards, starts, strict=False)]

    def run(batches):
        for b in batches:
            for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                reader, out = ShardReader(path), []
                for doc, raw in reader:
                    ids = np.frombuffer(raw, f"<u{reader.width}").astype("<u4")
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)

    files = spark.createDataFrame(rows, "path string, start long")
    return files.repartition(max(1, len(rows)), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
