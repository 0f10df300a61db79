"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised, so a cosine bounds the Euclidean distance.  Each of ``tables``
hash tables quantises ``width`` random projections; vectors in one bucket of any table are
compared by cosine in double precision.  At cosine 0.9 (distance 0.447) a pair has no
common bucket in 40 tables of 8 projections with a probability of 1e-4, at 0.95 of 1e-7.

Rows of a bucket first carry a sketch of 128 signs of other random projections instead of
the vector.  At most as many signs differ in a pair of the cosine asked for as are stated
by ``_most_signs`` (but for one pair in ten million), so members without such a partner go.
What is left is compared block by block as matrix products, with vectors.  Nothing is emitted for a
pair: a block gives each vector the number of its links and the smallest id of its local
component.  A pair that shares buckets in several tables counts in the first of them
only.  Equal vectors are one weighted representative, and a bucket larger than ``block``
is split into parts that meet pairwise in tasks of their own.  A row of a bucket carries the
components as they were stored and the hashes of the tables before its own, nothing else.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import Scratch, blocks, few, partitions

TABLES, WIDTH, STEP, BLOCK = 40, 8, 2.0, 1500
SIGNS = 128


def _vectors(column) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Each row's finite non-zero vector in double precision, else None."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out: list[np.ndarray | None] = []
    offsets, values = np.asarray(column.offsets), column.values
    numbers = np.asarray(values.cast(pa.float64()).fill_null(float("nan")))
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        x = numbers[offsets[i] : offsets[i + 1]] if valid[i] else None
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out, valid


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of unit length."""
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(data: list[bytes], kind: str) -> np.ndarray:
    """Normalised vectors in double precision, of one dimension."""
    return _normal(np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64))


def _hashes(x: np.ndarray, tables: int, width: int, step: float) -> np.ndarray:
    """A 31-bit bucket for each table, from normalised vectors of one dimension."""
    random = np.random.default_rng([x.shape[1], 2024])
    a = random.standard_normal((x.shape[1], tables * width))
    q = np.floor((x @ a + random.random(tables * width) * step) / step).astype(np.int64).astype(np.uint64)
    h = np.full((len(x), tables), np.uint64(x.shape[1]))
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + q.reshape(len(x), tables, width)[:, :, k]
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int32)


def _signs(x: np.ndarray) -> np.ndarray:
    """The signs of ``SIGNS`` random projections, as two 64-bit integers a row."""
    a = np.random.default_rng([x.shape[1], 77]).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ a > 0, axis=1).view(np.int64)


def _most_signs(cosine: float) -> int:
    """So many signs differ in a pair of this cosine or more, at most: the mean and 5.2 standard deviations."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + 5.2 * math.sqrt(SIGNS * p * (1 - p))))


def _stored(table: DataFrame) -> str:
    """The type that holds every component exactly: float32 if the column does, else float64."""
    return "float32" if isinstance(table.schema["embedding"].dataType.elementType, T.FloatType) else "float64"


def _prepare(table: DataFrame, kind: str) -> DataFrame:
    """vec_id, key (of equal vectors; null if the vector links with nothing) and v (components as bytes)."""

    def run(batches):
        for batch in batches:
            vectors, _ = _vectors(batch.column("embedding"))
            data = [None if x is None else (x + 0.0).astype(kind).tobytes() for x in vectors]
            keys = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "key", "v"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, key binary, v binary")


def _hashed(reps: DataFrame, kind: str, tables: int, width: int, step: float) -> DataFrame:
    """id, weight, v and h (the buckets, as bytes of 32-bit integers) with their list, and the signs."""

    def run(batches):
        for batch in batches:
            x = batch.column("v").to_pylist()
            h, signs = np.zeros((len(x), tables), np.int32), np.zeros((len(x), 2), np.int64)
            size = np.array([len(v) for v in x])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                unit = _rows([x[i] for i in at], kind)
                h[at], signs[at] = _hashes(unit, tables, width, step), _signs(unit)
            both = h.astype(np.int64) | (np.arange(tables, dtype=np.int64) << 32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), batch.column("v"), pa.array([r.tobytes() for r in h], pa.binary()), lists, *(pa.array(signs[:, k]) for k in (0, 1))], ["id", "weight", "v", "h", "buckets", "s1", "s2"])

    return reps.mapInArrow(run, "id long, weight long, v binary, h binary, buckets array<long>, s1 long, s2 long")


def _dealt(members: DataFrame, more: list, block: int, tasks: int, scratch: Scratch) -> DataFrame:
    """Stored rows of buckets (bucket, id) with the columns ``more``, sorted for ``blocks``; a bucket over ``block`` in parts that meet pairwise."""
    hot, n = few(scratch.keep(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block), "hot"))
    spread = members.join(hot, "bucket", "left") if n else members.withColumn("size", F.lit(None).cast("long"))
    parts = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = spread.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", *more)
    return dealt.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _likely(dealt: DataFrame, cosine: float) -> DataFrame:
    """(bucket, id) of the members that differ from another member of their bucket in few signs."""
    most = _most_signs(cosine)

    def run(batches):
        for (bucket, i, j), held in blocks(batches, ("bucket", "i", "j")):
            rows = pa.Table.from_batches(held)
            s, side = np.stack([rows.column(c).to_numpy() for c in ("s1", "s2")]).view(np.uint64), rows.column("part").to_numpy()
            some = np.zeros(rows.num_rows, bool)
            for a in range(0, rows.num_rows, 512):
                far = np.bitwise_count(s[0, a : a + 512, None] ^ s[0, a:]) + np.bitwise_count(s[1, a : a + 512, None] ^ s[1, a:])
                near = far <= most
                np.fill_diagonal(near, False)
                if i != j:
                    near &= side[a : a + 512, None] != side[a:]
                some[a : a + 512] |= near.any(1)
                some[a:] |= near.any(0)
            ids = rows.column("id").to_numpy()[some]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bucket)), pa.array(ids)], ["bucket", "id"])

    return dealt.mapInArrow(run, "bucket long, id long").distinct()


def _compare(block: dict, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: ids with links, the weights of their partners, and the least id of the local component."""
    table = int(block["bucket"]) >> 32
    x, h, ids, weight, side = block["x"], block["h"], block["id"], block["weight"], block["side"]
    n = len(ids)
    links, root = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(ids, kind="stable")
    x, h, ids, weight, side = x[order], h[order], ids[order], weight[order], side[order]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, n, 512):
        rows, cols = np.nonzero(x[a : a + 512] @ x[a:].T >= cosine)
        rows, cols = rows + a, cols + a
        keep = rows < cols
        if block["cross"]:
            keep &= side[rows] != side[cols]
        rows, cols = rows[keep], cols[keep]
        for t in range(table):
            new = h[rows, t] != h[cols, t]
            rows, cols = rows[new], cols[new]
        links += np.bincount(rows, weight[cols], n).astype(np.int64) + np.bincount(cols, weight[rows], n).astype(np.int64)
        # Join components: labels first, so that a group of copies costs few steps.
        while len(rows):
            low = np.full(n, n)
            np.minimum.at(low, cols, rows)
            for c in np.flatnonzero(low < n).tolist():
                i, j = find(int(low[c])), find(c)
                root[max(i, j)] = min(i, j)
            label = root.copy()
            while (label != label[label]).any():
                label = label[label]
            rest = label[rows] != label[cols]
            rows, cols = rows[rest], cols[rest]
    while (root != root[root]).any():
        root = root[root]
    got = np.flatnonzero(links)
    return ids[got], links[got], ids[root[got]]


def near_duplicates(table: DataFrame, cosine: float = 0.9, tables: int = TABLES, width: int = WIDTH, step: float = STEP, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept, one row for each row of ``table``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing.  Vectors of different lengths never link.  Repeated rows are vectors of
    their own that link with each other.  A null vec_id is left out of the links and has a null component.
    Columns other than vec_id and embedding are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = _stored(table)
    every = scratch.keep(_prepare(table, kind), "vectors")
    reps = every.where("key is not null and vec_id is not null").groupBy("key").agg(F.min(F.struct("vec_id", "v")).alias("r"), F.count(F.lit(1)).alias("weight"))
    reps = reps.select("key", F.col("r.vec_id").alias("id"), "weight", F.col("r.v").alias("v"))
    keys = scratch.keep(reps, "representatives")
    hashed = scratch.keep(_hashed(keys.select("id", "weight", "v"), kind, tables, width, step), "hashed")
    tasks = partitions(spark) * 2
    every_bucket = hashed.select("id", "s1", "s2", F.explode("buckets").alias("bucket"))
    members = scratch.keep(_likely(_dealt(every_bucket, ["s1", "s2"], block, tasks, scratch), cosine), "members")
    before = F.expr("substring(h, 1, 4 * cast(shiftright(bucket, 32) as int))").alias("h")
    dealt = _dealt(members.join(hashed.select("id", "weight", "v", "h"), "id"), ["weight", "v", before], block, tasks, scratch)

    def run(batches):
        for (bucket, i, j), held in blocks(batches, ("bucket", "i", "j")):
            if sum(b.num_rows for b in held) < 2:
                continue
            rows = pa.Table.from_batches(held)
            v = rows.column("v").to_pylist()
            size = np.array([len(b) for b in v])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                data = {
                    "bucket": bucket, "cross": i != j, "x": _rows([v[k] for k in at], kind),
                    "h": np.frombuffer(b"".join(rows.column("h").take(pa.array(at)).to_pylist()), np.int32).reshape(len(at), bucket >> 32),
                    "id": rows.column("id").to_numpy()[at], "weight": rows.column("weight").to_numpy()[at], "side": rows.column("part").to_numpy()[at],
                }
                ids, links, root = _compare(data, cosine)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], ["id", "links", "root"])

    found = scratch.keep(dealt.mapInArrow(run, "id long, links long, root long"), "links")
    group = scratch.keep(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch), "groups")
    scratch.clear(every, keys, found, group)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = keys.select("key", "id", "weight").join(links, "id", "left").join(group, "id", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = every.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
