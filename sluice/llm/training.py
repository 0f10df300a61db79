"""Training rows: all of them, in blocks, read by sums alone.

Whatever is learned from the rows (thresholds between quantiles, histograms of trees,
gradients and curvatures of a regression, counts above a score) is a sum of whole numbers
over them, so it is the same for any order, partitioning or cluster.  Few rows are summed
on the driver; more stay in a stored table, and each sum is a pass over it whose parts are
added up in tasks before the driver sees them.  No row is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

ONE = 1 << 24  # what stands for 1 in sums of fractions; 2**53 such fractions' sums stay whole
BLOCK = 1 << 13  # rows of a block
LOCAL = 1 << 17  # rows that are summed on the driver: 4 MB
FILE = 1 << 16  # about the rows of a task otherwise
PARTS = 64  # partial sums that the driver adds up
RAW = "n long, x binary, y binary, part binary"


@dataclass
class Block:
    """Binned features (uint8), labels 0 or 1, and a byte of marks for each row; ``f`` keeps sums of the first trees."""

    x: np.ndarray
    y: np.ndarray
    part: np.ndarray
    f: tuple[int, np.ndarray] | None = None


def raw(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Rows as one record of a table of type ``RAW``."""
    values = (np.ascontiguousarray(x, np.float64), y.astype(np.uint8), part.astype(np.uint8))
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["n", "x", "y", "part"])


def _records(batches, kind, n_features: int):
    for batch in batches:
        for x, y, part in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "part")), strict=True):
            yield np.frombuffer(x, kind).reshape(-1, n_features), np.frombuffer(y, np.uint8), np.frombuffer(part, np.uint8)


def _keys(x: np.ndarray) -> np.ndarray:
    """The leading 20 bits of numbers, in their order."""
    b = (x + 0.0).view(np.uint64)
    return (np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63)) >> np.uint64(44)).astype(np.int64)


def _counted(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(feature, leading bits, rows, largest value) of all ``parts``."""
    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for x in parts:
        j = np.tile(np.arange(x.shape[1]), len(x))
        v = np.ascontiguousarray(x).ravel()
        j, k, n, most = (np.concatenate(p) for p in zip(held, (j, _keys(v), np.ones(len(v), np.int64), v), strict=True))
        order = np.lexsort((k, j))
        j, k, n, most = j[order], k[order], n[order], most[order]
        first = np.flatnonzero(np.append(True, (j[1:] != j[:-1]) | (k[1:] != k[:-1]))) if len(j) else np.zeros(0, np.int64)
        held = (j[first], k[first], np.add.reduceat(n, first), np.maximum.reduceat(most, first)) if len(j) else held
    return held


def _cuts(counted: tuple[np.ndarray, ...], n_features: int, bins: int = 32) -> list[np.ndarray]:
    """Thresholds of each feature between its quantiles; numbers that agree to 0.4 % are not parted."""
    j, k, n, most = counted
    order = np.lexsort((k, j))
    out = []
    for f in range(n_features):
        mine = order[j[order] == f]
        if not len(mine):
            out.append(np.zeros(0))
            continue
        upto = np.cumsum(n[mine])
        at = np.arange(1, bins) * (int(upto[-1]) - 1) // bins
        q = np.unique(most[mine][np.searchsorted(upto, at, "right")])
        out.append(q[q < most[mine][-1]])
    return out


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8) if len(cuts) else np.zeros(x.shape, np.uint8)


def _blocks(records):
    """Records joined and cut to blocks of ``BLOCK`` rows."""
    held, n = [], 0
    for r in records:
        held.append(r)
        n += len(r[1])
        if n >= BLOCK:
            x, y, part = (np.concatenate(v) for v in zip(*held, strict=True))
            full = n - n % BLOCK
            for a in range(0, full, BLOCK):
                yield Block(x[a : a + BLOCK], y[a : a + BLOCK], part[a : a + BLOCK])
            held, n = [(x[full:], y[full:], part[full:])], n - full
    if n:
        yield Block(*(np.concatenate(v) for v in zip(*held, strict=True)))


class Rows:
    """Rows on the driver; ``cuts`` are the thresholds that their features are binned by."""

    def __init__(self, blocks: list[Block], cuts: list[np.ndarray]):
        self.blocks, self.cuts = blocks, cuts

    def total(self, of: Callable[[Block], np.ndarray]) -> np.ndarray:
        """The sum of the whole numbers ``of(block)``, an array of one size, over all blocks; without rows 0."""
        out = np.zeros(1, np.int64)
        for block in self.blocks:
            out = out + of(block)
        return out


class StoredRows(Rows):
    """Rows in a stored table of blocks, in ``tasks`` files."""

    def __init__(self, table: DataFrame, tasks: int, cuts: list[np.ndarray]):
        self.table, self.tasks, self.cuts = table, tasks, cuts

    def total(self, of: Callable[[Block], np.ndarray]) -> np.ndarray:
        n_features = len(self.cuts)

        def run(batches):
            out = None
            for r in _records(batches, np.uint8, n_features):
                s = of(Block(*r))
                out = s if out is None else out + s
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

        def add(batches):
            out = None
            for batch in batches:
                for s in batch.column("s").to_pylist():
                    s = np.frombuffer(s, np.int64)
                    out = s if out is None else out + s
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

        parts, left = self.table.mapInArrow(run, "s binary"), self.tasks
        while left > PARTS:
            left = -(-left // 16)
            parts = parts.repartition(left).mapInArrow(add, "s binary")
        return sum((np.frombuffer(s, np.int64) for s in parts.toArrow().column("s").to_pylist()), np.zeros(1, np.int64))


def of_arrays(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Rows:
    cuts = _cuts(_counted([x]), x.shape[1])
    return Rows(list(_blocks([(_binned(x, cuts), y.astype(np.uint8), part.astype(np.uint8))])) if len(y) else [], cuts)


def of_table(table: DataFrame, n_features: int, scratch: Scratch, local: int = LOCAL) -> Rows:
    """All rows of ``table`` (of type ``RAW``), which is stored; at most ``local`` rows come to the driver."""

    def count(batches):
        j, k, n, most = _counted(x for x, _, _ in _records(batches, np.float64, n_features))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (j, k, n, most)], ["j", "k", "n", "most"])

    total = table.agg(F.sum("n")).first()[0] or 0
    # A feature has at most some thousand different leading bits.
    found = table.mapInArrow(count, "j long, k long, n long, most double").groupBy("j", "k").agg(F.sum("n").alias("n"), F.max("most").alias("most")).toArrow()
    cuts = _cuts(tuple(found.column(c).to_numpy() for c in ("j", "k", "n", "most")), n_features)

    def binned(batches):
        for b in _blocks((_binned(x, cuts), y, part) for x, y, part in _records(batches, np.float64, n_features)):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (b.x, b.y, b.part)], ["x", "y", "part"])

    tasks = max(1, -(-total // FILE))
    rows = table.select("x", "y", "part").coalesce(tasks).mapInArrow(binned, "x binary, y binary, part binary")
    if total <= local:
        return Rows(list(_blocks(_records(rows.toArrow().to_batches(), np.uint8, n_features))), cuts)
    return StoredRows(scratch.keep(rows, "blocks"), tasks, cuts)
