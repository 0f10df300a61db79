"""Scratch tables in the folder that driver and executors share, and small Spark helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import release


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Unset only in local tests: then a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written once under the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []  # of tables that are still there

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back.  Its ``scratch_path`` names the folder."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no plan reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(conf).delete(path, True)
            if t.scratch_path in self.paths:
                self.paths.remove(t.scratch_path)

    def clear(self, *stay: DataFrame) -> None:
        """Delete all tables but those that the result still reads; what stays is the caller's to delete with the folder ``root``."""
        left = {t.scratch_path for t in stay}
        for path in [p for p in self.paths if p not in left]:
            table = self.spark.range(0)
            table.scratch_path = path
            self.drop(table)


FEW = 20_000  # rows of a table that may be sent to all executors; more are joined by shuffle


def few(table: DataFrame) -> tuple[DataFrame, int]:
    """A stored table with its number of rows; if these are at most ``FEW`` it is broadcast in joins."""
    n = table.count()
    return (F.broadcast(table) if n <= FEW else table), n


PART = 500  # rows of one key that a join leaves together


def join_split(left: DataFrame, right: DataFrame, key: str, by: str, total: int, sizes: DataFrame | None = None) -> DataFrame:
    """Inner join of ``left`` (``total`` rows) with ``right`` (one row a key); the rows of a frequent key are dealt over tasks by column ``by``.

    ``sizes`` may give the rows of each key as (key, _n); else they are counted.

    Frequent are keys with more than ``PART`` rows and more than one row in ``FEW``: at most
    ``FEW`` keys, whatever the input, so they may be broadcast.
    """
    limit = max(PART, total // FEW)
    if total <= limit:
        return left.join(right, key)
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    hot = sizes.where(F.col("_n") > limit)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    one = left.join(hot, key, "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64(by), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    two = right.join(hot, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return one.join(two, [key, "_s"]).drop("_s")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, spark: SparkSession, key: str, least: int = 0) -> DataFrame:
    """Deal rows by a unique key over tasks, so that few large input files do not bound the parallelism."""
    return df.repartition(max(least, partitions(spark)), F.col(key))


def blocks(batches, names: tuple[str, ...]):
    """From Arrow batches sorted by integer columns ``names``: each key and its batches, also across batch limits."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(c)) for c in names]
        change = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], 0)) + 1).tolist()
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            now = tuple(int(c[a]) for c in cols)
            if now != key and held:
                yield key, held
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held
    del held
    release()
