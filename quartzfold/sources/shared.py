"""Small text files on the file system that Spark uses, and where a run's results go."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, None if it is missing."""
    if not exists(spark, path):
        return None
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_csv(spark: SparkSession, path: str, rows: Iterable[Mapping], columns: Sequence[str]) -> str:
    """The few rows of a report as one CSV file with a header; returns its path."""
    field = lambda v: "" if v is None else f'"{v}"' if isinstance(v, str) and any(c in v for c in ',"\n') else str(v)
    lines = [",".join(columns), *[",".join(field(r[c]) for c in columns) for r in rows]]
    write_text(spark, path, "\n".join(lines) + "\n")
    return path


@dataclass(frozen=True)
class FoldPaths:
    """Folders of a base's inner and outer folds, and what is added to the names of its result folders."""

    inner: str
    outer: str
    suffix: str = ""

    def results_dir(self, root: str, name: str) -> str:
        return f"{str(root).rstrip('/')}/{name}{self.suffix}"


def fold_paths(root: str, base: str) -> FoldPaths:
    """Where the folds of a base lie below ``root``."""
    root = str(root).rstrip("/")
    if base == "full":
        return FoldPaths(f"{root}/processed/inner_folds", f"{root}/processed/outer_folds")
    if base == "undersampled":
        return FoldPaths(f"{root}/undersampled/inner_folds", f"{root}/undersampled/outer_folds", "_undersampled")
    raise ValueError(f"unknown base {base!r}")
