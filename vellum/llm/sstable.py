"""Token shards as sorted string tables, written and read by executors in a shared folder.

A shard holds documents in ascending order of their key: blocks of entries with prefix-compressed
keys and restart points, a sparse index with each block's first key, a Bloom filter over the keys
and a footer of fixed length. A lookup asks the filter, searches the index and then the restart
points of one block.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.text import pieces as cut
from vellum.llm.text import text_bytes
from vellum.session import shared_dir, small_batches

MAGIC = b"VSST0001"
BLOCK_BYTES = 64 << 10
RESTART = 16
#: Bytes of text that a shard holds about.
SHARD_BYTES = 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: index offset and size, filter offset and size, entries, tokens, crc32 of index and filter, magic
FOOTER = struct.Struct(">QQQQQQI8s")


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes that sort as the ids do; a null id is the empty key, which comes first."""
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 0x9E3779B1 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Appends entries in ascending key order to an open binary stream."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES) -> None:
        self.out, self.block_bytes, self.at = out, block_bytes, 0
        self.block, self.restarts, self.in_block, self.last, self.first = bytearray(), [], 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = self.before = 0
        self.zip = zstandard.ZstdCompressor(level=3)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must ascend")
        narrow = not len(ids) or int(ids.max()) < 1 << 16
        value = (b"\x02" if narrow else b"\x04") + ids.astype("<u2" if narrow else "<u4").tobytes()
        if not self.in_block:
            self.first, self.before = key, self.tokens
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.tokens += len(ids)
        self.last = key
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        plain = bytes(self.block) + b"".join(struct.pack(">I", r) for r in self.restarts) + struct.pack(">I", len(self.restarts))
        data = self.zip.compress(plain)
        data += struct.pack(">I", zlib.crc32(data))
        self.out.write(data)
        self.index.append((self.first, self.at, len(data), self.before))
        self.at += len(data)
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def finish(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) + _varint(before) for k, at, size, before in self.index)
        packed = struct.pack(">Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.tokens, zlib.crc32(index + packed), MAGIC))


class Reader:
    """Random and sequential access to one shard through its index."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        at, n, bloom_at, bloom_n, self.entries, self.tokens, crc, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        tail = file.read_at(n + bloom_n, at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole shard")
        self.bits = struct.unpack(">Q", tail[n : n + 8])[0]
        self.bloom = np.unpackbits(np.frombuffer(tail[n + 8 :], np.uint8), count=self.bits).astype(bool)
        self.index, p = [], 0
        while p < n:
            k, p = _read_varint(tail, p)
            key, p = bytes(tail[p : p + k]), p + k
            a, p = _read_varint(tail, p)
            s, p = _read_varint(tail, p)
            before, p = _read_varint(tail, p)
            self.index.append((key, a, s, before))
        self.unzip = zstandard.ZstdDecompressor()

    def _block(self, number: int) -> tuple[bytes, list[int]]:
        _, at, size, _ = self.index[number]
        data = self.file.read_at(size, at)
        if zlib.crc32(data[:-4]) != struct.unpack(">I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        plain = self.unzip.decompress(data[:-4])
        n = struct.unpack(">I", plain[-4:])[0]
        return plain[: -4 - 4 * n], list(struct.unpack(f">{n}I", plain[-4 - 4 * n : -4]))

    @staticmethod
    def _entries(block: bytes, at: int, key: bytes = b"") -> Iterator[tuple[bytes, np.ndarray]]:
        while at < len(block):
            shared, at = _read_varint(block, at)
            own, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key, at = key[:shared] + block[at : at + own], at + own
            yield key, np.frombuffer(block, "<u2" if block[at] == 2 else "<u4", offset=at + 1, count=(size - 1) // block[at])
            at += size

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, tokens before it in the shard, ids) of all entries."""
        for number, (_, _, _, before) in enumerate(self.index):
            for key, ids in self._entries(self._block(number)[0], 0):
                yield key, before, ids
                before += len(ids)

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of the first entry with this key."""
        if not self.bloom[_bloom_places(key, self.bits)].all():
            return None
        number = max(0, bisect.bisect_left([k for k, *_ in self.index], key) - 1)
        for block_number in range(number, min(number + 2, len(self.index))):
            block, restarts = self._block(block_number)
            firsts = [next(self._entries(block, r))[0] for r in restarts]
            at = restarts[max(0, bisect.bisect_left(firsts, key) - 1)]
            for k, ids in self._entries(block, at):
                if k >= key:
                    if k == key:
                        return ids
                    return None
        return None


def _qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as the session's default file system has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vellum.llm.tokens import encoder

        shard, writer, enc = TaskContext.get().partitionId(), None, None
        fs, root = _open(folder)
        name = f"{root}/shard-{shard:06d}.sst"
        own = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"  # an attempt's own file, named as whole at its end
        for batch in cut(batches, 1, 1 << 20):
            if writer is None:
                stream, enc = fs.open_output_stream(own), encoder(path)
                writer = Writer(stream)
            ids, at = enc.encode(*text_bytes(batch.column(1)))
            for r, doc in enumerate(batch.column(0).to_pylist()):
                writer.add(key_of(doc), np.append(ids[at[r] : at[r + 1]], end_id))
        if writer is not None:
            writer.finish()
            stream.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{folder}/{PurePosixPath(name).name}"]), pa.array([len(writer.keys)]), pa.array([writer.tokens])], ["shard", "path", "entries", "tokens"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the texts' ids in ascending id order; the manifest has shard, path, entries, tokens, start.

    Null texts are empty, a null id comes first, rows that repeat an id stay side by side in the
    order of their texts. Shards are ranges of ids (and of the texts' beginnings where many rows have
    one id), as many as the bytes of all texts ask for; the manifest has one row for each. Texts of
    any length are written whole, an empty table gives an empty manifest, extra columns are not read.
    A `folder` must name its scheme, as a plain path would be each executor's own disk; without one
    a new folder in the shared one is taken. Shards stay there until the caller removes them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if folder and "://" not in folder:
        raise ValueError("name the folder with its scheme")
    folder = folder or _qualified(spark, f"{shared_dir(spark).rstrip('/')}/sst-{uuid.uuid4().hex}")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    shards = shards or 1 + int(size) // SHARD_BYTES
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    made = sorted(tuple(r) for r in dealt.mapInArrow(_write(folder, tokenizer, end_id), "shard long, path string, entries long, tokens long").collect())
    before, out = 0, []
    for shard, path, entries, tokens in made:
        out.append((shard, path, entries, tokens, before))
        before += tokens
    return spark.createDataFrame(out, "shard long, path string, entries long, tokens long, start long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, name = _open(path)
            with fs.open_input_file(name) as file:
                rows: list[tuple] = []
                for key, before, ids in Reader(file).scan():
                    rows.append((id_of(key), start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _digest(rows)
                        rows = []
                yield _digest(rows)


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digest(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read from the shards of a manifest."""
    return manifest.select("path", "start").repartition(max(1, manifest.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
