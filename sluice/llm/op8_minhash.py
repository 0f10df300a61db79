"""MinHash near-dedup with fast similarity sketches, banding and exact verification.

A sketch has ``bins`` coordinates.  In each round every element is placed in one bin by a
hash of its own; a bin keeps the least (round, value) it saw.  After ``bins`` such rounds,
further rounds place all elements in one given bin each, so every coordinate fills.  Equal
coordinates of two sketches estimate the Jaccard similarity with strong concentration, at
a cost of about ``bins * log(bins) + n`` instead of ``bins * n``.

Sketches are cut into bands.  Documents that share a band are candidates, and links are
confirmed on full shingle sets.  With 60 bands of 7 coordinates a pair of similarity 0.8
has no common band with a probability under one in a million.

Groups of copies cost no pairs: equal sets become one representative first; then each
representative is held against the least member of its bands; then only buckets that
still hold several components are searched, and only between components: block by block,
first by sketches alone, then by full sets for those documents that a sketch left over, so
that a large bucket of dissimilar documents emits no pairs and moves no sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, blocks, few, join_split, partitions
from .textbytes import lists, mix, pieces, utf8, words

BANDS, ROWS = 60, 7
BLOCK = 1000  # members of a bucket that meet in one task


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and how many each has.

    A text with fewer than ``width`` words has its whole sequence as one; one without words has none.
    """
    data, offsets = utf8(column)
    n = len(offsets) - 1
    _, _, row, h = words(data, offsets)
    count = np.bincount(row, minlength=n)
    start = np.cumsum(count) - count
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(n), size)
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    length = np.minimum(count, width)[of]
    out = mix(length.astype(np.uint64))
    for k in range(width):
        inside = k < length
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + k])
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.append(True, (out[1:] != out[:-1]) | (of[1:] != of[:-1])) if len(out) else np.zeros(0, bool)
    return out[new], np.bincount(of[new], minlength=n)


def sketches(sets: np.ndarray, count: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketches (round << 32 | value) of consecutive non-empty sets."""
    n = len(count)
    empty = np.uint64(1 << 63)
    out = np.full(n * bins, empty)
    live, of = sets, np.repeat(np.arange(n), count)
    at = 0
    while len(live):
        several = max(1, min(32, 60_000 // len(live), 2 * bins - at))
        r = np.arange(at, at + several, dtype=np.uint64)[:, None]
        v = mix(live[None, :] ^ mix(r + np.uint64(77)))
        value = (r << np.uint64(32)) | (v & np.uint64(0xFFFFFFFF))
        free = ((v >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        where = np.where(r < bins, free, r - np.uint64(bins)).astype(np.int64) if at + several > bins else free.astype(np.int64)
        np.minimum.at(out, (of[None, :] * bins + where).ravel(), value.ravel())
        at += several
        open_rows = (out.reshape(n, bins) == empty).any(1)
        keep = open_rows[of]
        if not keep.all():
            live, of = live[keep], of[keep]
        if at >= 2 * bins:
            break
    return out.reshape(n, bins)


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (a 128-bit hash of the set) and the band hashes of each row."""

    def run(batches):
        for part in pieces(batches):
            sets, count = shingles(part.column("text"), width)
            full = np.flatnonzero(count)
            edge = np.cumsum(count[full]) - count[full]
            keys = np.zeros((2, len(count)), np.uint64)
            hashes = np.zeros(0, np.uint64)
            if len(full):
                for k in (0, 1):
                    keys[k, full] = np.add.reduceat(mix(sets ^ np.uint64(0x51ED27 + k)), edge)
                s = sketches(sets, count[full], bands * rows).reshape(len(full), bands, rows)
                h = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)), (len(full), bands))
                for k in range(rows):
                    h = mix(h ^ s[:, :, k])
                hashes = h.ravel()
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists(hashes.view(np.int64), np.where(count > 0, bands, 0), pa.int64())], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_in.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, width: int, bins: int) -> DataFrame:
    """id, full set and the low bytes of its sketch."""

    def run(batches):
        for part in pieces(batches):
            sets, count = shingles(part.column("text"), width)
            short = np.zeros((len(count), bins), np.uint8)
            full = np.flatnonzero(count)
            short[full] = sketches(sets, count[full], bins).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("id"), lists(sets.view(np.int64), count, pa.int64()), pa.array([s.tobytes() for s in short], pa.binary())], ["id", "set", "short"])

    return docs.mapInArrow(run, "id long, set array<long>, short binary")


def _dealt(rows: DataFrame, more: list[str], tasks: int) -> DataFrame:
    """Rows of buckets (band, size, id and ``more``) for ``blocks``: a large bucket is split into parts that meet pairwise in tasks of their own."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", *more)
    return dealt.repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j")


def _likely(rows: pa.Table, cross: bool, percent: int, bins: int):
    """Index arrays of the pairs of a block between different components that may have this similarity.

    A pair is left out if its sketches agree on so few coordinates that a pair of this
    similarity does so with a probability under one in ten million.
    """
    share = percent / 100
    least = int(bins * share - 5.2 * np.sqrt(bins * share * (1 - share)))
    ids, n, c, major, part = (rows.column(k).to_numpy() for k in ("id", "n", "c", "major", "part"))
    if (c == c[0]).all():
        return
    short = np.frombuffer(b"".join(rows.column("short").to_pylist()), np.uint8).reshape(len(ids), bins)
    minor = np.flatnonzero(c != major)
    for at in range(0, len(minor), 16):
        m = minor[at : at + 16]
        ok = (c[m][:, None] != c[None, :]) & ((c == major)[None, :] | (ids[m][:, None] < ids[None, :]))
        ok &= (n[m][:, None] * 100 >= n[None, :] * percent) & (n[None, :] * 100 >= n[m][:, None] * percent)
        if cross:
            ok &= part[m][:, None] != part[None, :]
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 20_000):
            u, w = m[x[k : k + 20_000]], y[k : k + 20_000]
            good = (short[u] == short[w]).sum(1) >= least
            yield u[good], w[good]


def _candidates(rows: DataFrame, percent: int, bins: int, tasks: int) -> DataFrame:
    """(band, id) of the rows (band, size, id, n, c: component, major: that of the bucket's least member, short) that sketches cannot tell from one of another component."""

    def run(batches):
        for (band, i, j), held in blocks(batches, ("band", "i", "j")):
            rows = pa.Table.from_batches(held)
            some = np.zeros(rows.num_rows, bool)
            for u, w in _likely(rows, i != j, percent, bins):
                some[u] = some[w] = True
            ids = rows.column("id").to_numpy()[some]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), band)), pa.array(ids)], ["band", "id"])

    return _dealt(rows, ["n", "c", "major", "short"], tasks).mapInArrow(run, "band long, id long").distinct()


def _between(rows: DataFrame, percent: int, bins: int, tasks: int) -> DataFrame:
    """Links (a, b) between different components within one bucket, enough of them to join the same documents.

    ``rows``: those of ``_candidates`` and set.  Pairs that links found before join are left
    out; all other likely ones are confirmed on full sets here, so no candidate pair is emitted.
    """

    def run(batches):
        for (_, i, j), held in blocks(batches, ("band", "i", "j")):
            rows = pa.Table.from_batches(held)
            ids, c = rows.column("id").to_numpy(), rows.column("c").to_numpy()
            column = rows.column("set").combine_chunks()
            edge, values = np.asarray(column.offsets), np.asarray(column.values)
            root = {int(v): int(v) for v in np.unique(c)}

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            links = []
            for u, w in _likely(rows, i != j, percent, bins):
                for p, q in zip(u.tolist(), w.tolist(), strict=True):
                    f, g = find(int(c[p])), find(int(c[q]))
                    if f == g:
                        continue
                    one, two = values[edge[p] : edge[p + 1]], values[edge[q] : edge[q + 1]]
                    both = np.sort(np.concatenate([one, two]))
                    same = int((both[1:] == both[:-1]).sum())
                    if same * 100 >= percent * (len(both) - same):
                        root[max(f, g)] = min(f, g)
                        links.append((int(ids[p]), int(ids[q])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links, strict=True)], ["a", "b"])

    return _dealt(rows, ["n", "c", "major", "short", "set"], tasks).mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one, two = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    n = pairs.count()
    # A document has few partners b, but one b may be the partner of very many: these are dealt over tasks before they get their sets.
    both = join_split(pairs, two, "b", "a", n).join(one, "a").select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("i"))
    return both.where(F.col("i") * 100 >= percent * (F.col("n") - F.col("i"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row for each row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct shingles
    of ``width`` words.  Null, empty and blank texts have no shingle and link with nothing.
    Rows with equal sets are linked; rows of one doc_id are one document whose texts all
    count.  A null doc_id links with nothing and has a null component, kept is true.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    every = scratch.keep(signatures(docs, width, bands, rows), "signatures")
    # Equal sets: one representative, the smallest id.
    full = every.where("n_shingles > 0 and doc_id is not null")
    best = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    reps = scratch.keep(best.select("k1", "k2", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")), "representatives")
    spread = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("band", "size", "pivot")
    shared = scratch.keep(shared, "buckets")
    members = scratch.keep(join_split(spread, shared, "band", "id", bands * reps.count(), shared.select("band", F.col("size").alias("_n"))), "members")
    wanted = members.select("id").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = scratch.keep(_sets(text.join(wanted, "id"), width, bands * rows), "sets")
    # First: the member of its bands that each representative has most in common with.
    stars = members.where("id != pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("c"))
    first = stars.groupBy("id").agg(F.max_by("pivot", F.struct("c", (-F.col("pivot")).alias("p"))).alias("b")).select(F.col("id").alias("a"), "b")
    first = scratch.keep(first, "first")
    links = scratch.keep(_confirmed(first, sets, percent), "links")
    group = scratch.keep(components(links, scratch), "groups")
    # Then: all other least members, where the components still differ.
    of = lambda df, key, name: df.join(group.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    second = of(of(members.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "a", "ca"), "b", "cb").where("ca != cb").select("a", "b")
    second = second.join(first, ["a", "b"], "left_anti")
    more = scratch.keep(_confirmed(scratch.keep(second, "second"), sets, percent), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        group = scratch.keep(components(links, scratch), "groups")
    # Last: buckets of three and more that hold several components, between components.
    placed = of(of(members.where("size > 2"), "id", "c"), "pivot", "major")
    placed = scratch.keep(placed.select("band", "size", "id", "n", "c", "major"), "placed")
    mixed, _ = few(scratch.keep(placed.where("c != major").select("band").distinct(), "mixed"))
    tasks = 2 * partitions(spark)
    some = scratch.keep(_candidates(placed.join(mixed, "band", "left_semi").join(sets.select("id", "short"), "id"), percent, bands * rows, tasks), "candidates")
    sizes, _ = few(scratch.keep(some.groupBy("band").agg(F.count(F.lit(1)).alias("size")), "sizes"))
    left = placed.drop("size").join(some, ["band", "id"]).join(sizes, "band")
    more = scratch.keep(_between(left.join(sets, "id"), percent, bands * rows, tasks), "links")
    if more.limit(1).count():
        group = scratch.keep(components(links.unionByName(more), scratch), "groups")
    scratch.clear(every, reps, group)
    same = reps.select("k1", "k2", "id").join(group, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    out = every.select("doc_id", "n_shingles", "k1", "k2").join(same, ["k1", "k2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("component").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component"))))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that with the smallest doc_id; all columns stay."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
