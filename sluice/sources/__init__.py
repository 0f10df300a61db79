"""Reading and writing of tables: folders of Parquet or CSV files, catalog tables, JDBC and SQL text."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import FlowError


def simple_name(name: str) -> str:
    """The last part of a qualified name: [dbo].[orders] is orders."""
    return re.findall(r"\[[^\]]*\]|\"[^\"]*\"|[^.\[\]\"]+", name.strip())[-1].strip('[]"')


def strip_order(sql: str) -> tuple[str, bool]:
    """A query without its outermost trailing ORDER BY, and whether there was one.  TOP or OFFSET keep it."""
    text, depth, quote, found = sql.strip().rstrip(";"), 0, "", -1
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif not depth and c in "oO" and re.match(r"order\s+by\b", text[i:], re.I) and not re.match(r"\w", text[i - 1 : i] or " "):
            found = i
    tail = text[found:] if found >= 0 else ""
    if found < 0 or re.search(r"\b(offset|fetch|limit)\b", tail, re.I) or re.match(r"\s*select\s+top\b", text, re.I):
        return text, False
    return text[:found].rstrip(), True


def spark_sql(sql: str) -> str:
    """SQL-Server spelling to Spark's: bracketed names, N'..', dbo., TOP n, GETDATE(), ISNULL(a, b), LEN.  Other text passes as it is."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0][1:] if m[0][0] in "Nn" else m[0])
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"\bN'(?:[^']|'')*'|'(?:[^']|'')*'", keep, sql.strip().rstrip(";"))
    text = re.sub(r"\[([^\]]+)\]", lambda m: "`" + m[1] + "`", text)
    text = re.sub(r"`?\bdbo`?\.", "", text, flags=re.I)
    top = re.match(r"(\s*select\s+)top\s*\(?(\d+)\)?\s+", text, re.I)
    if top:
        text = f"{top[1]}{text[top.end() :]} LIMIT {top[2]}"
    for old, new in ((r"\bgetdate\s*\(\s*\)", "localtimestamp()"), (r"\bisnull\s*\(", "coalesce("), (r"\blen\s*\(", "length("), (r"\bgetutcdate\s*\(\s*\)", "to_utc_timestamp(current_timestamp(), current_timezone())")):
        text = re.sub(old, new, text, flags=re.I)
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], text)


def qualified(name: str, database: str) -> str:
    """A name of one or two parts under ``database``, with schema dbo if it has none; longer names stay."""
    parts = [p.strip('[]"') for p in re.findall(r"\[[^\]]*\]|\"[^\"]*\"|[^.\[\]\"]+", name.strip())]
    if not database or len(parts) >= 3:
        return ".".join(parts)
    return ".".join([database, *(["dbo"] if len(parts) == 1 else []), *parts])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; in local tests without it a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise FlowError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass
class Tables:
    """Where tables are: ``known`` data sets by name first, then ``folder``, then JDBC, then the catalog (under ``namespace``).

    With ``qualify`` names are looked up under the database of their connection.  With ``files``
    flat files lie in that folder, under the last part of the path that their connection names.
    """

    spark: SparkSession
    folder: str | None = None
    known: dict[str, DataFrame] = field(default_factory=dict)
    namespace: str = ""
    jdbc: dict[str, str] | None = None
    qualify: bool = False
    files: str = ""

    def file(self, path: str) -> str:
        return f"{self.files.rstrip('/')}/{re.split(r'[/' + chr(92) * 2 + ']', path)[-1]}" if self.files else path

    def read(self, name: str, database: str = "") -> DataFrame:
        short = simple_name(name)
        known = {k.lower(): v for k, v in self.known.items()}
        if self.qualify and database:
            name = qualified(name, database)
            if name.lower() in known:
                return known[name.lower()]
            if not self.folder and not self.jdbc:
                return self.spark.table(f"{database}.{short}")
        if short.lower() in known:
            return known[short.lower()]
        if self.folder:
            return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{short}.parquet")
        if self.jdbc:
            return self.spark.read.format("jdbc").options(**self.jdbc, dbtable=name).load()
        return self.spark.table(f"{self.namespace}.{short}" if self.namespace else short)

    def query(self, sql: str) -> DataFrame:
        """SQL over the tables; names after FROM and JOIN become temporary views of this resolver's tables."""
        text = spark_sql(sql)
        for name in dict.fromkeys(re.findall(r"\b(?:from|join)\s+(`?\w[\w.`]*)", text, re.I)):
            if self.folder or simple_name(name.replace("`", "")).lower() in {k.lower() for k in self.known}:
                self.read(name.replace("`", "")).createOrReplaceTempView(simple_name(name.replace("`", "")))
        return self.spark.sql(text)

    def csv(self, options: dict[str, Any]) -> DataFrame:
        """Flat file: ``path`` and ``schema``, with ``header``, ``sep`` and ``null_value``."""
        if not options.get("path"):
            raise FlowError("a flat file needs a path")
        reader = self.spark.read.option("header", options.get("header", True)).option("sep", options.get("sep", ",")).option("nullValue", options.get("null_value", "")).option("quote", options.get("quote", '"') or "\0")
        return (reader.schema(options["schema"]) if options.get("schema") else reader).csv(self.file(options["path"]))

    def write(self, df: DataFrame, options: dict[str, Any]) -> None:
        """Append to a table, or write files: ``path`` with ``format`` (parquet or csv, with ``header``, ``sep`` and ``quote``)."""
        database = options.get("database", "") if self.qualify else ""
        if options.get("path"):
            writer = df.write.mode(options.get("mode", "append"))
            if options.get("format") == "csv":
                writer.option("header", options.get("header", True)).option("sep", options.get("sep", ",")).option("quote", options.get("quote", '"') or "\0").csv(self.file(options["path"]))
            else:
                writer.parquet(self.file(options["path"]))
        elif self.jdbc:
            df.write.format("jdbc").options(**self.jdbc, dbtable=qualified(options["table"], database) if database else options["table"]).mode("append").save()
        else:
            short, space = simple_name(options["table"]), database or self.namespace
            df.write.mode("append").saveAsTable(f"{space}.{short}" if space else short)

    def execute(self, sql: str) -> None:
        """A statement for its effect."""
        self.spark.sql(spark_sql(sql))
