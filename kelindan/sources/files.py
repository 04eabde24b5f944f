"""CSV and JSON in and out, atomic exports, resumable logs, graph files."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOM = "﻿"


def csv_header(path: str) -> list[str]:
    """Column names of a local CSV file (the first one of a folder), without byte order mark. Raises FileNotFoundError."""
    if os.path.isdir(path):
        files = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
        if not files:
            raise FileNotFoundError(path)
        path = os.path.join(path, files[0])
    with open(path, encoding="utf-8-sig", newline="") as f:
        return next(csv.reader(f), [])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, blanks: str = "null", schema: StructType | None = None, multiline: bool = True) -> DataFrame:
    """A CSV file or folder as strings, or by an explicit schema; nothing is inferred.

    ``columns`` names what the header has, for paths that the driver can't open. ``blanks``: "null" reads an empty field as
    null, "empty" keeps it as an empty text (texts like NA are never null). Quoted fields may span lines with ``multiline``, but then
    one task reads a whole file; without it large files are split. A byte order mark before the first name is dropped.
    """
    names = list(columns) if columns is not None else csv_header(path)
    fields = schema or StructType([StructField(n.lstrip(BOM), StringType()) for n in names])
    reader = spark.read.schema(fields).option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", True)
    if blanks == "empty":
        reader = reader.option("emptyValue", "").option("nullValue", "\x00")
    df = reader.csv(path)
    return df.na.fill("") if blanks == "empty" else df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of JSON lines by an explicit schema; lines that don't parse come as nulls."""
    return spark.read.schema(schema).json(path)


def first_document(paths: Iterable[str]) -> tuple[str | None, dict]:
    """The first of several JSON documents that exists, and its path; (None, {}) without any."""
    for p in paths:
        if os.path.exists(p):
            with open(p, encoding="utf-8-sig") as f:
                return p, json.load(f)
    return None, {}


class OutputPolicy:
    """Exports may go below the allowed roots only (K2)."""

    def __init__(self, roots: Sequence[str]) -> None:
        self.roots = [os.path.realpath(r) for r in roots]

    def check(self, path: str) -> str:
        real = os.path.realpath(path)
        if not any(real == r or real.startswith(r + os.sep) for r in self.roots):
            raise PermissionError(f"{path} lies outside the allowed roots")
        return real


def write_atomic(path: str, data: bytes, policy: OutputPolicy | None = None) -> None:
    """Write a small local file so that readers see the old or the new content, never a part (K2)."""
    path = policy.check(path) if policy else path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_manifest(path: str, values: Mapping, policy: OutputPolicy | None = None) -> None:
    """A JSON manifest, keys sorted (K3)."""
    write_atomic(path, (json.dumps(values, indent=2, sort_keys=True, default=str) + "\n").encode(), policy)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """The primary sink: Parquet, partitioned for pruning, each task's rows sorted for row-group statistics (K1)."""
    out = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str, order: Sequence[str] = (), bom: bool = False, most: int = 1_000_000, policy: OutputPolicy | None = None) -> int:
    """A single CSV file for people, at most ``most`` rows (more is an error, not a cut); returns the rows (K1, K6)."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).toLocalIterator()
    n = 0
    buffer = io.StringIO()
    out = csv.writer(buffer, lineterminator="\n")
    out.writerow(df.columns)
    for r in rows:
        n += 1
        if n > most:
            raise ValueError(f"more than {most} rows: write a table instead")
        out.writerow(["" if v is None else v for v in r])
    write_atomic(path, ((BOM if bom else "") + buffer.getvalue()).encode("utf-8"), policy)
    return n


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str, policy: OutputPolicy | None = None) -> dict[str, int]:
    """Node and edge files as graph tools read them: Id, Label and Source, Target, Type, Weight (K6)."""
    n = nodes.select(F.col("node").alias("Id"), F.coalesce("label", "node").alias("Label"), *[c for c in nodes.columns if c not in ("node", "label")])
    e = edges.select(F.col("source").alias("Source"), F.col("target").alias("Target"), F.lit("Undirected").alias("Type"), F.col("weight").alias("Weight"), *[c for c in edges.columns if c not in ("source", "target", "weight")])
    return {"nodes": export_csv(n, os.path.join(folder, "nodes.csv"), ["Id"], policy=policy), "edges": export_csv(e, os.path.join(folder, "edges.csv"), ["Source", "Target"], policy=policy)}


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown (K4); more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    clean = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(map(clean, r)) + " |" for r in rows]) + "\n"


class StatusLog:
    """An append-only log of finished ids, and what is still to do (K5)."""

    def __init__(self, path: str, key: str) -> None:
        self.path, self.key = path, key

    def append(self, done: DataFrame) -> None:
        done.select(self.key, F.current_timestamp().alias("logged_at")).write.mode("append").parquet(self.path)

    def pending(self, work: DataFrame) -> DataFrame:
        """Work whose key isn't logged; all of it before the first append."""
        spark = work.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return work
        return work.join(spark.read.parquet(self.path).select(self.key), self.key, "left_anti")
