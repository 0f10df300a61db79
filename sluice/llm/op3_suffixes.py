"""Duplicate strings across all texts by a distributed difference-cover suffix algorithm.

A difference cover modulo v holds, for any two positions i and j, a shift below v that
brings both into the sampled residues.  So two texts that share a string of ``length``
bytes share a sampled position whose next ``length - v + 1`` bytes, its name, agree, and
the bytes around it decide the rest.

* Sampled positions (9 % of all) whose name stands nowhere else are left out first; this
  filter works on 64-bit hashes and can only keep too many.
* The sampled suffixes that remain are sorted, with the bytes before them, and named by
  rank: neighbours are compared by their common prefix.  A string that starts d bytes
  before a sampled position is known by the rank of the d bytes before it and the rank of
  the ``length - d`` bytes after it, so the other suffixes are merged in without sorting them.
* Names that too many positions share are named anew, by recursion: strings that start in
  the first half of the shifts by the bytes that all of these contain, about twice as
  many, and those of the second half likewise, down to one shift if need be.  So no name
  gathers more than ``HOT`` positions in one task, however frequent a line is.
* Bytes that equal strings cover are removed.

Suffixes are told apart up to ``length`` bytes only, as longer ones need not be.  Hashes
deal rows over tasks and make the filter; the result is decided by bytes.  Nothing longer
than a few hundred bytes around a repeated name is shuffled, besides the texts themselves.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, few, join_split, partitions
from .textbytes import hashes, mix, pieces, prefix, slices, utf8

LENGTH = 200
SAMPLES_A_TASK = 2_000_000
HOT = 4000  # positions of one name that meet in one task
SEEN = 1 << 16  # texts that a task remembers, so that copies are not sent twice
# A perfect difference set modulo 133: each non-zero difference occurs exactly once.
PERFECT = (133, (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121))


@functools.cache
def cover(length: int) -> tuple[int, np.ndarray]:
    """v and the sampled residues for strings of ``length`` bytes: v is 133 for 200 bytes and more, else two thirds."""
    v = 133 if length >= 200 else max(1, length * 2 // 3)
    if v == 133 and _covers(PERFECT[1], v):
        return v, np.array(PERFECT[1])
    d = [0]
    missing = set(range(1, v))
    while missing:
        best = max(range(v), key=lambda c: len({(c - x) % v for x in d} & missing | {(x - c) % v for x in d} & missing))
        missing -= {(best - x) % v for x in d} | {(x - best) % v for x in d}
        d.append(best)
    return v, np.array(sorted(set(d)))


def _covers(d, v: int) -> bool:
    return {(a - b) % v for a in d for b in d} == set(range(v))


def _key(data: np.ndarray) -> bytes:
    return hashlib.sha256(data.tobytes()).digest()[:16]


def _distinct(part: pa.RecordBatch, seen: set, length: int):
    """Bytes and offsets of the texts of a piece that are long enough and not among the last that this task saw, and their keys."""
    if len(seen) > SEEN:
        seen.clear()
    data, offsets = utf8(part.column("text"))
    keep, keys = [], []
    for i in range(len(offsets) - 1):
        if offsets[i + 1] - offsets[i] >= length:
            k = _key(data[offsets[i] : offsets[i + 1]])
            if k not in seen:
                seen.add(k)
                keep.append(i)
                keys.append(k)
    if len(keep) < len(offsets) - 1:
        data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in keep]) if keep else data[:0]
        offsets = np.concatenate([[0], np.cumsum([offsets[i + 1] - offsets[i] for i in keep])]).astype(np.int64)
    return data, offsets, keys


def _sampled(offsets: np.ndarray, keys: list[bytes], v: int, residues: np.ndarray, window: int) -> np.ndarray:
    """Sampled positions that have ``window`` bytes in their text; each text starts at a residue of its own."""
    shift = np.array([int.from_bytes(k[:4], "little") % v for k in keys], np.int64)
    first = (residues[None, :] - shift[:, None]) % v
    room = np.diff(offsets)[:, None] - window - first
    count = np.maximum(0, room // v + 1).ravel()
    start = (first + offsets[:-1, None]).ravel()
    at = np.repeat(start - v * (np.cumsum(count) - count), count) + v * np.arange(count.sum())
    return at


def _names(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Rows for the task that finds repeated names.

    kind 0: piece and packed names, marks of text and position, and steps of the offsets in
    the piece, to part; kind 1: offsets already repeated in the piece; kind 2: the piece's
    text offsets and keys.  A name that repeats in a piece is sent on once only, so frequent
    passages do not gather in one task.  Copies of one text have equal marks, so that a name
    that only they hold does not count as repeated.
    """
    v, residues = cover(length)
    window = length - v + 1

    def run(batches):
        task, number, seen = TaskContext.get().partitionId(), 0, set()
        for part in pieces(batches):
            data, offsets, keys = _distinct(part, seen, length)
            if not keys:
                continue
            piece, number = (task << 32) | number, number + 1
            at = _sampled(offsets, keys, v, residues, window)
            h = slices(prefix(data), at, at + window)
            of = np.searchsorted(offsets, at, "right") - 1
            seeds = np.array([int.from_bytes(k[4:12], "little") for k in keys], np.uint64)
            mark = mix(seeds[of] + (at - offsets[of]).astype(np.uint64))
            order = np.argsort(h, kind="stable")
            h, at, mark = h[order], at[order].astype(np.uint32), mark[order]
            new = np.append(True, h[1:] != h[:-1])
            more = np.append(new[1:], True)
            again = ~(new & more)
            h, once, mark = h[new], at[new], mark[new]
            to = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((once, to))
            cut = np.searchsorted(to[order], np.arange(parts + 1))
            name, once, mark = h.astype(np.uint32)[order], once[order], mark[order]
            step = np.diff(once, prepend=np.uint32(0))
            step[cut[:-1][cut[1:] > cut[:-1]]] = once[cut[:-1][cut[1:] > cut[:-1]]]
            rows = [(0, k, name[a:b].tobytes() + mark[a:b].tobytes() + step[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            if again.any():
                rows.append((1, piece % parts, at[again].tobytes()))
            rows.append((2, piece % parts, offsets.astype("<i8").tobytes() + b"".join(keys)))
            yield pa.RecordBatch.from_arrays([pa.array([piece] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["piece", "kind", "part", "data"])

    return docs.select("text").mapInArrow(run, "piece long, kind int, part int, data binary")


def _repeated(rows: DataFrame) -> DataFrame:
    """piece, kind (1: offsets of repeated names, 2: the piece's texts) and data."""

    def run(batches):
        pieces_, packed = [], []
        for b in batches:
            kind = np.asarray(b.column("kind"))
            rest = b.filter(pa.array(kind > 0))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column("piece"), rest.column("kind"), rest.column("data")], ["piece", "kind", "data"])
            for i in np.flatnonzero(kind == 0).tolist():
                pieces_.append(b.column("piece")[i].as_py())
                packed.append(b.column("data")[i].as_py())
        if not packed:
            return
        size = np.array([len(x) // 16 for x in packed])
        name = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(packed, size.tolist(), strict=True)])
        mark = np.concatenate([np.frombuffer(x[4 * n : 12 * n], np.uint64) for x, n in zip(packed, size.tolist(), strict=True)])
        offset = np.concatenate([np.cumsum(np.frombuffer(x, np.uint32, n, 12 * n), dtype=np.uint32) for x, n in zip(packed, size.tolist(), strict=True)])
        of = np.repeat(np.arange(len(packed)), size)
        del packed
        order = np.argsort(name, kind="stable")
        names, mark = name[order], mark[order]
        begin = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        several = np.minimum.reduceat(mark, begin) != np.maximum.reduceat(mark, begin)
        found = np.sort(order[np.repeat(several, np.diff(np.append(begin, len(names))))])
        of, at = of[found], offset[found]
        cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
        for a in range(0, len(cut) - 1, 4096):
            to = min(a + 4096, len(cut) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([pieces_[of[cut[k]]] for k in range(a, to)], pa.int64()), pa.array([1] * (to - a), pa.int32()), pa.array([at[cut[k] : cut[k + 1]].tobytes() for k in range(a, to)], pa.binary())], ["piece", "kind", "data"])

    return rows.mapInArrow(run, "piece long, kind int, data binary")


def _by_text(repeated: DataFrame) -> DataFrame:
    """key and packed positions of repeated names in each text.

    Copies of a text give rows of their own wherever they stand; these are merged in two
    steps, so that the rows of a text with very many copies do not meet in one task.
    """
    tables = repeated.where("kind = 2").select("piece", F.col("data").alias("texts"))
    both = repeated.where("kind = 1").select("piece", "data").join(tables, "piece")

    def run(batches):
        for b in batches:
            keys, data, salts = [], [], []
            for i in range(b.num_rows):
                texts = b.column("texts")[i].as_py()
                n = (len(texts) - 8) // 24
                offsets = np.frombuffer(texts, "<i8", n + 1)
                at = np.sort(np.frombuffer(b.column("data")[i].as_py(), np.uint32).astype(np.int64))
                of = np.searchsorted(offsets, at, "right") - 1
                cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    k = int(of[a])
                    keys.append(texts[8 * (n + 1) + 16 * k :][:16])
                    data.append((at[a:z] - offsets[k]).astype(np.uint32).tobytes())
                    salts.append(b.column("piece")[i].as_py() % 64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(salts, pa.int64()), pa.array(data, pa.binary())], ["key", "salt", "at"])

    def merge(batches):
        for b in batches:
            data = [np.unique(np.frombuffer(b"".join(x), np.uint32)).tobytes() for x in b.column("ats").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(data, pa.binary())], ["key", "at"])

    parts = both.mapInArrow(run, "key binary, salt long, at binary").groupBy("key", "salt").agg(F.collect_set("at").alias("ats")).drop("salt")
    return parts.mapInArrow(merge, "key binary, at binary").groupBy("key").agg(F.collect_list("at").alias("ats"))


def _packed_texts(docs: DataFrame, length: int) -> DataFrame:
    """key and compressed text, each text once a task."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for part in pieces(batches):
            data, offsets, keys = _distinct(part, seen, length)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["key", "z"])

    return docs.select("text").mapInArrow(run, "key binary, z binary")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """name, key, position, bytes before it, data, whether the same bytes were met again in the batch (kind 2), and all shifts from lo to hi.

    ``data`` holds up to v - 1 bytes before the position and ``length`` after it.  All strings
    of bytes that were met before repeat, so these are sent as covered spans at once (kind 3).
    """
    v, _ = cover(length)
    window, left = length - v + 1, v - 1

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for a in range(0, b.num_rows, 200):
                part = b.slice(a, 200)
                once: dict[bytes, int] = {}
                rows: list[list] = []
                for key, z, ats in zip(part.column("key").to_pylist(), part.column("z").to_pylist(), part.column("ats").to_pylist(), strict=True):
                    text = unpack(z)
                    at = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in ats])).astype(np.int64)
                    p = prefix(np.frombuffer(text, np.uint8))
                    names = slices(p, at, at + window).view(np.int64)
                    known: list[tuple[int, int, int]] = []
                    for name, i in zip(names.tolist(), at.tolist(), strict=True):
                        s = max(0, i - left)
                        c = text[s : i + length]
                        k = once.get(c)
                        if k is not None and rows[k][3] == i - s:
                            rows[k][5] = 2
                            known.append((i, i - s, len(c)))
                        else:
                            once[c] = len(rows)
                            rows.append([name, key, i, i - s, c, 1])
                    if known:
                        spans = _spans([key], np.zeros(len(known), np.int64), *_shifts(np.array(known), length)[1:])
                        rows.append([int(names[0]), key, 0, 0, spans.column("spans")[0].as_py() if spans.num_rows else b"", 3])
                if rows:
                    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([0] * len(rows), pa.int32()), pa.array([left] * len(rows), pa.int32())], _FIELDS)

    return texts.mapInArrow(run, _SCHEMA)


_KINDS = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
_FIELDS = ["name", "key", "at", "back", "data", "kind", "lo", "hi"]
_SCHEMA = "name long, key binary, at int, back int, data binary, kind int, lo int, hi int"


def _shifts(known: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end covered by all strings of ``length`` around positions (at, bytes before, bytes in all)."""
    at, back, size = known.T
    lo, hi = np.maximum(0, length - (size - back)), np.minimum(back, length)
    row = np.flatnonzero(hi >= lo)
    return row, at[row] - hi[row], at[row] - lo[row] + length


def _named_anew(hot: DataFrame, length: int) -> DataFrame:
    """Positions of frequent names, once for each half of their shifts, named by the bytes that all strings of that half contain."""

    def run(batches):
        for b in batches:
            column = b.column("data").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data, offsets = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
            back, lo, hi = (np.asarray(b.column(c)).astype(np.int64) for c in ("back", "lo", "hi"))
            size, middle = np.diff(offsets), (lo + hi) // 2
            for first, last in ((lo, middle), (middle + 1, hi)):
                begin, end = back - first, back + length - last
                ok = np.flatnonzero((first <= last) & (begin >= 0) & (end <= size))
                if len(ok):
                    names = mix(hashes(data, offsets[ok] + begin[ok], offsets[ok] + end[ok]) + (first[ok] * 1024 + last[ok]).astype(np.uint64))
                    rows = b.take(pa.array(ok))
                    columns = [pa.array(names.view(np.int64)), *(rows.column(c) for c in _FIELDS[1:6]), pa.array(first[ok], pa.int32()), pa.array(last[ok], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, _FIELDS)

    return hot.mapInArrow(run, _SCHEMA)


def _whole_spans(rows: DataFrame, length: int) -> DataFrame:
    """key and packed spans of all strings at the shifts lo to hi of each row."""

    def run(batches):
        for b in batches:
            key, at, back, size, lo, hi = (np.asarray(b.column(c)) if c != "key" else b.column(c).to_pylist() for c in ("key", "at", "back", "size", "lo", "hi"))
            lo, hi = np.maximum(lo, length - (size - back)), np.minimum(hi, back)
            row = np.flatnonzero(hi >= lo)
            yield _spans(key, row, at[row] - hi[row], at[row] - lo[row] + length)

    return rows.select("key", "at", "back", F.octet_length("data").alias("size"), "lo", "hi").mapInArrow(run, "key binary, spans binary")


def _dealt(contexts: DataFrame, length: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows whose names at most ``HOT`` positions share, and spans that are known to be covered already.

    In each round the rows of a more frequent name are named anew for each half of their
    shifts.  Positions with equal bytes all around are one row from then on.  Strings of a
    single shift are counted, not compared.
    """
    cold, known = [], [contexts.where("kind = 3").select("key", F.col("data").alias("spans"))]
    contexts = contexts.where("kind < 3")
    for depth in range(32):
        counts = contexts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("name")
        hot, n = few(scratch.keep(counts, "hot"))
        if not n:
            return [*cold, contexts], known
        cold.append(contexts.join(hot, "name", "left_anti"))
        rows = contexts.join(hot, "name", "left_semi")
        if not depth:
            same = scratch.keep(rows.groupBy("data", "back").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "key", "at", "kind", "lo", "hi")).alias("r"), F.max("kind").alias("kind")), "equal")
            several, _ = few(scratch.keep(same.where("n > 1").select("data", "back"), "several"))
            known.append(_whole_spans(rows.join(several, ["data", "back"], "left_semi"), length))
            rows = same.select("r.name", "r.key", "r.at", "back", "data", F.when(F.col("n") > 1, 2).otherwise(F.col("kind")).cast("int").alias("kind"), "r.lo", "r.hi")
        halves = scratch.keep(_named_anew(rows, length), "halves")
        one = halves.where("lo = hi").withColumn("s", F.expr(f"substring(data, back - lo + 1, {length})"))
        often = one.groupBy("s", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("k")).where("n > 1 or k = 2").select("s", "lo")
        often, _ = few(scratch.keep(often, "often"))
        known.append(_whole_spans(one.join(often, ["s", "lo"], "left_semi"), length))
        contexts = halves.where("lo < hi")
    raise RuntimeError("names do not settle")


def _ranked(strings: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of ``strings`` within each place, and the common prefix of each with the one before; -1 at a new place."""
    n, width = strings.shape
    keyed = np.empty((n, width + 4), np.uint8)
    keyed[:, :4] = place.astype(">u4").view(np.uint8).reshape(n, 4)
    keyed[:, 4:] = strings
    order = np.argsort(keyed.view(f"S{width + 4}").ravel(), kind="stable")
    keyed = keyed[order]
    differs = keyed[1:] != keyed[:-1]
    common = np.full(n, -1)
    first = differs.argmax(1) if n > 1 else np.zeros(0, np.int64)
    common[1:] = np.where(differs[np.arange(n - 1), first], first - 4, width)
    return order, np.where(common < 0, -1, common)


def _neighbour(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with any other of its place."""
    most = np.empty(len(order), np.int64)
    most[order] = np.maximum(common, np.append(common[1:], -1))
    return most


def _repeats(place: np.ndarray, m: np.ndarray, left: int, length: int, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """At which shifts (a matrix of rows and 0 to ``left``) the string of ``length`` bytes stands in another row of the place too.

    ``m`` has ``left`` bytes before and ``length`` after the sampled position in each row;
    shifts from ``low`` to ``high`` lie within the bytes of the row.  A row of weight 2 repeats at all of these.
    """
    n, shifts = len(m), np.arange(left + 1)
    after, common_after = _ranked(np.ascontiguousarray(m[:, left:]), place)
    before, common_before = _ranked(np.ascontiguousarray(m[:, :left][:, ::-1]), place) if left else (after, np.where(common_after < 0, -1, 0))
    lo, hi = np.maximum(low, length - _neighbour(after, common_after)), np.minimum(high, _neighbour(before, common_before))
    size = np.bincount(place)[place]
    good = (shifts >= low[:, None]) & (shifts <= high[:, None]) & (weight > 1)[:, None]
    asked = (shifts >= lo[:, None]) & (shifts <= hi[:, None]) & (size > 1)[:, None]
    pair = size == 2  # both have the other as their only neighbour
    good |= asked & pair[:, None]
    row, shift = np.nonzero(asked & ~pair[:, None])
    if len(row):
        # The rank of a string of d bytes: how many rows before it in the order differ in those from the one before.
        rank_after, rank_before = np.empty((n, left + 1), np.int32), np.empty((n, left + 1), np.int32)
        rank_after[after] = np.cumsum(common_after[:, None] < length - shifts, axis=0)
        rank_before[before] = np.cumsum(common_before[:, None] < shifts, axis=0)
        key = (rank_after[row, shift].astype(np.int64) * (n + 1) + rank_before[row, shift]) * (left + 1) + shift
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        often = np.add.reduceat(weight[row[order]], begin) > 1
        hit = order[np.repeat(often, np.diff(np.append(begin, len(key))))]
        good[row[hit], shift[hit]] = True
    return good


def _covered(contexts: DataFrame, length: int) -> DataFrame:
    """key and packed (start, end) covered by strings that occur again, from contexts sorted by name."""
    v, _ = cover(length)
    left = v - 1

    def group(rows: pa.Table, names: np.ndarray):
        at, back, kind, lo, hi = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "back", "kind", "lo", "hi"))
        data = rows.column("data").to_pylist()
        size = np.array([len(d) for d in data])
        flat = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(at)), size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left - back, size)
        m = np.zeros((len(at), left + length), np.uint8)
        m[row, column] = flat
        place = np.cumsum(np.append(False, names[1:] != names[:-1]))
        good = _repeats(place, m, left, length, np.maximum(lo, length - (size - back)), np.minimum(hi, back), np.minimum(kind, 2))
        edge = np.zeros((len(good), 1), bool)
        change = np.diff(np.concatenate([edge, good, edge], 1).astype(np.int8), axis=1)
        row, first = np.nonzero(change == 1)
        _, last = np.nonzero(change == -1)
        return _spans(rows.column("key").to_pylist(), row, at[row] - (last - 1), at[row] - first + length)

    def run(batches):
        held: list[pa.RecordBatch] = []
        waiting = 0
        for b in [*_rest(batches), None]:
            if b is not None:
                held.append(b)
                waiting += b.num_rows
            if b is not None and waiting < 6000:
                continue
            if not waiting:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            names = rows.column("name").to_numpy()
            cut = len(names) if b is None else int(np.searchsorted(names == names[-1], True))
            held = [] if cut == len(names) else rows.slice(cut).to_batches()
            waiting = len(names) - cut
            if cut:
                yield group(rows.slice(0, cut), names[:cut])

    return contexts.mapInArrow(run, "key binary, spans binary")


def _rest(batches):
    for b in batches:
        for a in range(0, b.num_rows, 3000):
            yield b.slice(a, 3000)


def _spans(key: list[bytes], row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans by key, those that meet as one: key and packed (start, end)."""
    number = {k: i for i, k in enumerate(dict.fromkeys(key))}
    of = np.array([number[k] for k in key], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order].astype(np.int64), end[order].astype(np.int64)
    apart = of << 33
    reach = np.maximum.accumulate(apart + end) if len(of) else apart
    new = np.append(True, (apart + start)[1:] > reach[:-1]) if len(of) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    both = np.stack([start[begin], (reach - apart)[np.append(begin[1:], len(of)) - 1]], 1).astype(np.uint32) if len(of) else np.zeros((0, 2), np.uint32)
    of = of[begin]
    cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
    names = list(number)
    return pa.RecordBatch.from_arrays([pa.array([names[of[a]] for a in cut[:-1]], pa.binary()), pa.array([both[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["key", "spans"])


def _cut(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans and kept_sha256 of texts with their covered spans."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for key, z, spans in zip(b.column("key").to_pylist(), b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = np.frombuffer(unpack(z), np.uint8)
                both = np.concatenate([np.frombuffer(s, np.uint32).reshape(-1, 2) for s in spans]).astype(np.int64)
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, both[:, 0], 1)
                np.add.at(depth, both[:, 1], -1)
                gone = np.cumsum(depth[:-1]) > 0
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((key, int(gone.sum()), starts, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string")


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches):
        for part in pieces(batches):
            data, offsets = utf8(part.column("text"))
            sums = [hashlib.sha256(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array([s.digest()[:16] for s in sums], pa.binary()), pa.array([s.hexdigest() for s in sums])], ["doc_id", "n_bytes", "key", "sha"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, key binary, sha string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in any
    row or in the same, is removed.  Null texts count as empty; texts shorter than
    ``length`` stay whole.  Rows with equal texts are copies of each other, whatever their
    ids; ids may repeat or be null.  Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    every = scratch.keep(_digests(docs), "digests")
    total, rows_in_all = every.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    v, residues = cover(length)
    tasks = max(partitions(spark), int(total * len(residues) / v) // SAMPLES_A_TASK)
    rows = _names(docs, length, 4 * tasks).repartition(tasks, "part")
    repeated = scratch.keep(_repeated(rows), "names")
    # Texts that hold repeated names; the compressed text is shuffled once.
    texts = scratch.keep(_packed_texts(docs, length).join(_by_text(repeated), "key").dropDuplicates(["key"]), "texts")
    cold, known = _dealt(scratch.keep(_contexts(texts, length), "contexts"), length, scratch)
    dealt = functools.reduce(DataFrame.unionByName, cold).repartition(tasks, "name").sortWithinPartitions("name")
    covered = scratch.keep(functools.reduce(DataFrame.unionByName, [_covered(dealt, length), *known]), "covered")
    spans = covered.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    cut = scratch.keep(_cut(texts.select("key", "z").join(spans, "key")).distinct(), "cut")
    scratch.clear(every, cut)
    known = every.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(cut, "key", "left")
    out = join_split(every, known, "key", "doc_id", rows_in_all)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
