"""Quality classifier: conjunctive rules from trees, lasso logistic weights, compiled to Spark columns.

Statistics of whole texts come from one vectorised pass.  Boosted trees on all labelled
rows that are not held out give the rules (the conditions on the way to each node), a
lasso logistic regression on the same rows keeps a sparse weighted set of them, and the
ensemble becomes one Spark expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import training
from .shared import Scratch, join_split
from .textbytes import pieces, utf8, words
from .trees import boost, holds, lasso, together

STATS = (
    "log_words", "word_length", "upper", "digits", "symbols", "commas", "stops", "other_bytes", "lines", "line_words",
    "distinct", "adjacent", "odd_ends", "shouted", "bare_symbols", "longest_word",
)

_KIND = np.full(256, 4, np.int64)  # 0 upper, 1 lower, 2 digit, 3 blank, 4 symbol, 5 comma etc., 6 stop, 7 beyond ASCII, 8 line end, 9 continuation
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 3, 8
_KIND[[ord(c) for c in ",;:'\"()-"]], _KIND[[ord(c) for c in ".!?"]] = 5, 6
_KIND[128:192], _KIND[192:] = 9, 7


def statistics(column) -> np.ndarray:
    """One row of ``STATS`` for each text; null counts as empty, and an empty text has finite values too."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 10 + _KIND[data], minlength=n * 10).reshape(n, 10).astype(float)
    s, e, of, h = words(data, offsets)
    count = np.bincount(of, minlength=n).astype(float)
    one = np.maximum(count, 1)
    letters = np.maximum(kinds[:, [0, 1, 7]].sum(1), 1)
    chars = np.maximum(size - kinds[:, 9], 1)
    per = lambda mask: np.bincount(of[mask], minlength=n) / one
    key = np.sort((of.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n) / one
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    upper, lower = np.append(0, np.cumsum(_KIND[data] == 0)), np.append(0, np.cumsum((_KIND[data] == 1)))
    ups, lows = upper[e] - upper[s], lower[e] - lower[s]
    last = _KIND[data[e - 1]] if len(e) else np.zeros(0, np.int64)
    longest = np.zeros(n)
    np.maximum.at(longest, of, e - s)
    lines = kinds[:, 8] + 1
    solid = np.append(0, np.cumsum(np.isin(_KIND[data], (0, 1, 2, 7))))
    bare = solid[e] == solid[s]
    out = [
        np.log1p(count), (size - kinds[:, 3] - kinds[:, 8]) / one, kinds[:, 0] / letters, kinds[:, 2] / chars, kinds[:, 4] / chars, kinds[:, 5] / one,
        kinds[:, 6] / one, kinds[:, 7] / letters, np.log1p(lines), np.log1p(count / lines), np.where(count > 0, distinct, 1.0), per(again),
        per(last == 4), per((ups > 1) & (lows == 0)), per(bare), np.log1p(longest),
    ]
    return np.stack(out, 1)


def free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have, in any case."""
    name, taken = "_q", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text", name: str = "_q") -> DataFrame:
    """The ``keep`` columns and a column ``name`` with a field for each statistic."""
    schema = StructType([*(docs.schema[c] for c in keep), StructField(name, StructType([StructField(c, DoubleType()) for c in STATS]))])
    read = [*keep, *([] if text in keep else [text])]
    at = read.index(text)

    def run(batches):
        for part in pieces(batches, column=at):
            x = statistics(part.column(at))
            both = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(STATS))], list(STATS))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], both], [f.name for f in schema])

    return docs.select(*read).mapInArrow(run, schema)


@dataclass
class Rules:
    """``intercept`` plus the weights of the rules that hold; each rule is a conjunction of (statistic, ``<=``, threshold)."""

    intercept: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def column(self, name: str = "_q") -> Column:
        """The score, 0 to 1, as an expression over the fields of the column ``name``."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = None
            for j, low, t in rule:
                c = F.col(name)[STATS[j]] <= t if low else F.col(name)[STATS[j]] > t
                holds = c if holds is None else holds & c
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 30, depth: int = 3, seed: int = 0) -> Rules:
    """``fit_rows`` on arrays."""
    return fit_rows(training.of_arrays(x, y, np.random.default_rng(seed).random(len(y)) < 0.2), n_trees, depth)


def fit_rows(rows: training.Rows, n_trees: int = 30, depth: int = 3) -> Rules:
    """Rules of boosted trees, weighted by a lasso on all rows; its penalty is the best on the rows with mark 1 (about a fifth) after a fit on the others.

    Without rows, or with one class alone, the score is the share of label 1 (0.5 without rows).
    """
    start, trees = boost(rows, n_trees, depth)
    paths = list(dict.fromkeys(p for t in trees for p in t.paths()))
    bins = [{float(t): i for i, t in enumerate(c)} for c in rows.cuts]
    by_bin = lambda path: tuple((j, low, bins[j][t]) for j, low, t in path)

    def classes(mark: int) -> int:
        got = np.resize(rows.total(lambda b: np.bincount(b.y[b.part == mark], minlength=2).astype(np.int64)), 2)
        return int((got > 0).sum())

    if not paths or classes(0) < 2:
        return Rules(start, [])
    both = together(rows, [by_bin(p) for p in paths])
    count = np.diag(both)
    # Of paths that hold for the same rows the first one stays.
    same = (both == count[:, None]) & (both == count[None, :])
    first = [k for k in range(1, len(count)) if not same[k, 1:k].any() and 0 < count[k] < count[0]]
    paths, share = [paths[k - 1] for k in first], count[first] / count[0]
    scale, binned = np.maximum(np.sqrt(share * (1 - share)), 0.05), [by_bin(p) for p in paths]
    w, best = np.append(start, np.zeros(len(paths))), (np.inf, 0.01)
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w, loss = lasso(rows, binned, scale, penalty, w, skip=1)
        if loss < best[0] * 0.98:
            best, at = (loss, penalty), w
    w, _ = lasso(rows, binned, scale, best[1], at)
    return Rules(float(w[0]), [(p, float(v)) for p, v, s in zip(paths, w[1:], scale, strict=True) if abs(v * s) > 1e-6])


def held_out(doc_id: Column) -> Column:
    """Rows that are never used for fitting: crc32 of the id as text, modulo 4, is 2.  False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, local: int = training.LOCAL) -> Rules:
    """Fit on all labelled rows that are not held out; of up to ``local`` rows the binned statistics come to the driver."""
    scratch = Scratch(docs.sparkSession, "rules")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("long").alias("y"))
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Statistics first, so that no text is shuffled.
    rows = scratch.keep(with_statistics(rows, ["doc_id"]), "statistics")
    total = rows.count()
    rows = join_split(rows, known, "doc_id", "_q", total).withColumn("part", (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(5)) == 0).cast("long"))

    def pack(batches):
        for b in batches:
            x = np.stack([np.asarray(b.column(c)) for c in STATS], 1)
            if len(x):
                yield training.raw(x, np.asarray(b.column("y")), np.asarray(b.column("part")))

    table = scratch.keep(rows.select("y", "part", *(F.col("_q")[c].alias(c) for c in STATS)).mapInArrow(pack, training.RAW), "rows")
    rules = fit_rows(training.of_table(table, len(STATS), scratch, local))
    scratch.clear()
    return rules


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), limit: float = 0.7) -> DataFrame:
    """The ``keep`` columns, held_out, score (0 to 1) and predicted (1 if score >= limit), for each row of ``docs``.

    Labels, lang, source and doc_id are no inputs of the score.  Null and empty texts are
    scored by their statistics (all counts 0).  Repeated rows get equal scores.  An empty
    table of labels gives 0.5 for every text.
    """
    rules = train(docs, labels)
    name = free_name(docs)
    scored = with_statistics(docs, list(keep), name=name).select(*keep, rules.column(name).alias(f"{name}score"))
    score = F.col(f"{name}score")
    return scored.select(*keep, held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= limit, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose score is below ``limit``; all columns stay, whatever their names."""
    rules, name = train(docs, labels), free_name(docs)
    return with_statistics(docs, docs.columns, name=name).where(rules.column(name) >= limit).select(*(F.col(f"`{c}`") for c in docs.columns))
