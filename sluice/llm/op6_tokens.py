"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A shard holds the documents of one range of ids, in ascending order, one frame a document:

* a frame: the ids, end id last, as little-endian 16-bit integers (32-bit for vocabularies over 65,536),
* a skippable frame (0x184D2A50): document count, bytes an id, then for each document null flag, doc_id, ids,
* a skippable frame (0x184D2A5E), the seek table of the public seekable zstandard format: for each frame
  compressed size, decompressed size and the low 32 bits of XXH64 of the content; then the number of frames,
  a descriptor byte and the magic 0x8F92EAB1.

Readers that know nothing of the tables still decompress the ids.  Each task attempt writes
a file of its own name; the manifest names the files of the attempts that Spark committed,
so lost executors and repeated attempts leave unused files at most.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions
from .textbytes import pieces

SHARD_BYTES = 256 << 20  # of text in a shard
INDEX, TABLE, END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


@functools.cache
def _store(root: str):
    """The file system of ``root`` and the path in it.

    Files are written and read by the tasks with the file systems of pyarrow: local or
    mounted folders, s3 (also under the names s3a and s3n), gs, abfs, and hdfs and viewfs where libhdfs is installed.
    """
    from pyarrow import fs

    scheme = root.partition("://")[0]
    if scheme in ("s3a", "s3n"):
        root = "s3" + root[3:]
    found, path = fs.FileSystem.from_uri(root)
    found.create_dir(path)
    return found, path


class Shard:
    """Reads one shard: the tables when opened, then only the frames asked for."""

    def __init__(self, root: str, name: str):
        import zstandard

        store, path = _store(root)
        self.file = store.open_input_file(f"{path}/{name}")
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        frames, _, end = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if end != END:
            raise ValueError(f"{name}: no seek table")
        at = size - 9 - frames * _SEEK.itemsize
        seek = np.frombuffer(self.file.read_at(frames * _SEEK.itemsize, at), _SEEK)
        self.seek, index = seek[:-1], int(seek["packed"][-1])
        self.at = np.concatenate([[0], np.cumsum(self.seek["packed"].astype(np.int64))])
        raw = self.file.read_at(index, int(self.at[-1]))
        n, self.width = struct.unpack_from("<IB", raw, 8)
        self.docs = np.frombuffer(raw, _ENTRY, n, 13)

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        import xxhash

        data = self.unpack(frame, max_output_size=int(self.seek["size"][k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.seek["sum"][k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self._ids(k, self.file.read_at(int(self.seek["packed"][k]), int(self.at[k])))

    def all(self):
        """The ids of each document; the file is read in steps of a few MB."""
        k, n = 0, len(self.docs)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.at, self.at[k] + (4 << 20))) - 1)
            raw, base = self.file.read_at(int(self.at[to] - self.at[k]), int(self.at[k])), int(self.at[k])
            for i in range(k, to):
                yield self._ids(i, raw[int(self.at[i]) - base : int(self.at[i + 1]) - base])
            k = to

    def of(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents of this id, without reading any other frame."""
        return [self.ids(int(k)) for k in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["null"] == 0))]


class _Writer:
    def __init__(self, root: str, width: int):
        import zstandard

        store, path = _store(root)
        self.name, self.width = f"shard-{uuid.uuid4().hex}.zst", width
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        self.docs, self.seek = bytearray(), bytearray()  # 25 bytes a document
        self.n = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        data = ids.astype(f"<u{self.width}").tobytes()
        frame = self.pack(data)
        self.out.write(frame)
        self.docs += struct.pack("<BqI", doc_id is None, doc_id or 0, len(ids))
        self.seek += struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        self.n += 1
        self.tokens += len(ids)

    def close(self) -> None:
        body = struct.pack("<IB", self.n, self.width) + self.docs
        index = struct.pack("<II", INDEX, len(body)) + body
        seek = self.seek + struct.pack("<III", len(index), 0, 0)
        table = seek + struct.pack("<IBI", self.n + 1, 0x80, END)
        self.out.write(index + struct.pack("<II", TABLE, len(table)) + table)
        self.out.close()


def write_ids(docs: DataFrame, tokenizer: str, root: str, end_id: int = 0, n_shards: int | None = None) -> DataFrame:
    """Encode every whole text and write shards under ``root``; lazily returns the manifest.

    ``docs``: doc_id (long) and text; other columns are not read.  Null texts count as
    empty, so they hold the end id alone.  Null ids come first; documents with equal ids
    stay separate, in the order of their text, in one shard.  An empty table gives no shard.
    Without ``n_shards`` there is one for each shuffle partition, and more for over ``SHARD_BYTES`` of text a shard.
    Manifest: first_null, first_id, name, n_docs, n_tokens.  Persist it before reading it
    twice: each run of its plan writes files anew.
    """
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    n = n_shards or max(partitions(docs.sparkSession), 8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    schema = "first_null boolean, first_id long, name string, n_docs long, n_tokens long"

    def run(batches):
        from .bpe import words_of

        words, out, first = words_of(tokenizer), None, None
        for part in pieces(batches):
            keys = part.column("doc_id").to_pylist()
            texts = ["" if x is None else x for x in part.column("text").to_pylist()]
            for key, ids in zip(keys, words.batch(texts), strict=True):
                if out is None:
                    out, first = _Writer(root, width), key
                out.add(key, np.append(ids, np.uint32(end_id)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first is None]), pa.array([first], pa.int64()), pa.array([out.name]), pa.array([out.n], pa.int64()), pa.array([out.tokens], pa.int64())], ["first_null", "first_id", "name", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)


def read_digests(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files of a persisted manifest."""
    # One row a shard: the running sum is over as many rows as there are files.
    before = Window.orderBy(F.col("first_null").desc(), "first_id", "name").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("name", "start")

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(root, name)
                sums = [zlib.crc32(x.tobytes()) for x in shard.all()]
                n = shard.docs["n"].astype(np.int64)
                starts = start + np.cumsum(n) - n
                ids = pa.array(shard.docs["doc_id"], pa.int64(), mask=shard.docs["null"] == 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(n), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(partitions(spark), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
