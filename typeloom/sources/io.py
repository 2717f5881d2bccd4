"""Readers and writers by suffix, guards for existing outputs, and the keyed checkpoint of slow checks."""

from __future__ import annotations

import json
import math
import tarfile
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None, split: str | None = None) -> DataFrame:
    """Parquet, JSON lines, CSV or ORC by suffix; a folder without one is read as Parquet (or its `split` folder).

    Names of a remote hub are refused: there is no network here.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix in (".jsonl", ".json"):
        return reader.option("allowNonNumericNumbers", True).json(path)
    if suffix == ".csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if suffix == ".orc":
        return reader.orc(path)
    at = f"{path}/{split}" if split and exists(spark, f"{path}/{split}") else path
    if not exists(spark, at):
        raise FileNotFoundError(f"{path} is no table here; datasets of a remote hub can't be read")
    return reader.parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def save_dataset(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write by suffix; an existing output is refused unless overwrite is given."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if suffix in (".jsonl", ".json"):
        writer.option("ignoreNullFields", False).json(path)
    elif suffix == ".csv":
        writer.option("header", True).csv(path)
    elif suffix == ".orc":
        writer.orc(path)
    else:
        writer.parquet(path)


def guard_absent(spark: SparkSession, paths: Iterable[str]) -> None:
    """Refuse to go on if an output is there already."""
    found = [p for p in paths if exists(spark, p)]
    if found:
        raise FileExistsError(f"outputs exist already: {', '.join(found)}")


def existing_or(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made and written first if it isn't there."""
    if not exists(spark, path):
        save_dataset(make(), path)
    return load_dataset(spark, path)


def small_rows(df: DataFrame, most: int = 10_000) -> list[dict[str, Any]]:
    """Rows of a report table for the driver-side writers; raises if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are not a report")
    return [r.asDict(recursive=True) for r in rows]


def write_jsonl(path: str, rows: Iterable[dict[str, Any]]) -> None:
    """One JSON object a line; NaN is written bare."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, default=lambda x: x.item() if hasattr(x, "item") else sorted(x) if isinstance(x, set) else str(x)) + "\n" for r in rows)


def read_jsonl(path: str) -> list[dict[str, Any]]:
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def markdown(rows: list[dict[str, Any]]) -> str:
    """A table with a column for each row: names down the side, as summaries are read."""
    if not rows:
        return ""
    names = list(rows[0])
    head = [str(r[names[0]]) for r in rows]
    cell = lambda x: f"{x:.4f}" if isinstance(x, float) and not math.isnan(x) else str(x)
    body = [[name, *(cell(r[name]) for r in rows)] for name in names[1:]]
    return "\n".join("| " + " | ".join(x) + " |" for x in [[names[0], *head], ["---"] * (len(rows) + 1), *body]) + "\n"


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus as Parquet, a file or a folder; JSON lines and other forms are refused."""
    if PurePosixPath(path.rstrip("/")).suffix not in ("", ".parquet"):
        raise ValueError(f"a corpus is read from Parquet, not from {path}")
    return load_dataset(spark, path)


def extract_tar(archive: str, folder: str) -> list[str]:
    """Unpack an archive of type declarations, and say which files it held. Members that lead out of the folder are refused."""
    with tarfile.open(archive) as tar:
        tar.extractall(folder, filter="data")
        return sorted(m.name for m in tar.getmembers() if m.isfile())


def scratch(spark: SparkSession) -> str:
    """A new, empty folder under the one in spark.checkpoint.dir, or a temporary one on local masters where none is set.

    It goes when the session's JVM ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(found or 'file://' + tempfile.gettempdir()).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done, key, "left_anti")


def passed(rows: DataFrame, done: DataFrame, key: str, ok: str = "ok") -> DataFrame:
    """Rows whose result is good; raises if one has no result yet."""
    if pending(rows, done, key).limit(1).count():
        raise KeyError("some rows have not been checked")
    return rows.join(done.where(F.col(ok)), key, "left_semi")


class Checkpoint:
    """Results of a slow check keyed by a unique column, appended as Parquet, so a stopped run goes on."""

    def __init__(self, spark: SparkSession, path: str, key: str = "hexsha"):
        self.spark, self.path, self.key = spark, path, key

    def done(self) -> DataFrame:
        """key, ok of all finished rows; a key that was checked twice counts once, and must agree."""
        try:
            table = self.spark.read.schema(f"{self.key} string, ok boolean").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], f"{self.key} string, ok boolean")
        return table.groupBy(self.key).agg({"ok": "min"}).toDF(self.key, "ok")

    def pending(self, rows: DataFrame) -> DataFrame:
        return pending(rows, self.done(), self.key)

    def append(self, results: DataFrame) -> None:
        results.select(self.key, "ok").write.mode("append").parquet(self.path)

    def passed(self, rows: DataFrame) -> DataFrame:
        """Rows whose check was good; raises if one has no result yet."""
        return passed(rows, self.done(), self.key)
