"""Stored tables by logical name, as Parquet under one root."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, NullType, StructType

ROOT_SETTING = "spark.touchline.root"


class Catalog:
    """Names such as a/b stand for ROOT/a/b.parquet; the root is given or read from the session's ROOT_SETTING."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get(ROOT_SETTING, None) or os.path.join(os.getcwd(), "data")).rstrip("/")

    def path_for(self, name: str) -> str:
        parts = name.split("/")
        if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts):
            raise ValueError(f"not a table name: {name!r}")
        return f"{self.root}/{name}.parquet"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str) -> str:
        """Write under a name of its own, then rename.

        A failed write leaves the old table. Between the two renames, or
        where a writer was lost there, the old one stands beside it as
        NAME.parquet.old-TIME, which readers then take.
        """
        path = self.path_for(name)
        fresh, old = f"{path}.new-{time.time_ns()}", f"{path}.old-{time.time_ns()}"
        storable(df).write.parquet(fresh)
        fs, target = self._fs(path)
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        if fs.exists(target):
            fs.rename(target, jpath(old))
        if not fs.rename(jpath(fresh), target):
            raise OSError(f"could not put {path} in place")
        for s in fs.globStatus(jpath(f"{path}.old-*")) or []:
            fs.delete(s.getPath(), True)
        return path

    def append(self, df: DataFrame, name: str, **part: str) -> str:
        """Write df as one partition (taken="...") of a table, in place of that partition if there is one; the others are not read."""
        ((key, value),) = part.items()
        path = f"{self.path_for(name)}/{key}={value}"
        storable(df).write.mode("overwrite").parquet(path)
        return path

    def replace(self, df: DataFrame, name: str, by: str, **counts) -> dict[str, int]:
        """Write df in place of those partitions (values of the column `by`) that it has rows of; the others keep their files.

        counts are aggregates of df that are observed while it is written, so that no second job reads it.
        """
        seen, rows = Observation(), storable(df).repartition(by)
        if counts:
            # Last of all, where no rewrite of an empty input drops it.
            rows = rows.observe(seen, *[c.alias(k) for k, c in counts.items()])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path_for(name))
        return seen.get if counts else {}

    def load(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise FileNotFoundError(f"no table {name!r} under {self.root}")
        return self.spark.read.parquet(self._current(name))

    def _current(self, name: str) -> str | None:
        """Where the table lies: in its place, or set aside by a save that is not done."""
        path = self.path_for(name)
        fs, p = self._fs(path)
        if fs.exists(p):
            return path
        aside = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-*")) or []
        return max((s.getPath().toString() for s in aside), key=lambda a: int(a.rsplit("-", 1)[1]), default=None)

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def age_days(self, name: str) -> float | None:
        if not self.exists(name):
            return None
        fs, p = self._fs(self._current(name))
        return max(0.0, time.time() - fs.getFileStatus(p).getModificationTime() / 1000.0) / 86400.0

    def names(self) -> list[str]:
        fs, root = self._fs(self.root)
        if not fs.exists(root):
            return []
        found, todo = [], [(root, "")]
        while todo:
            at, prefix = todo.pop()
            for s in fs.listStatus(at):
                leaf = s.getPath().getName()
                if leaf.endswith(".parquet") or ".parquet.old-" in leaf:
                    found.append(prefix + leaf.partition(".parquet")[0])
                elif s.isDirectory() and ".parquet." not in leaf:
                    todo.append((s.getPath(), f"{prefix}{leaf}/"))
        return sorted(set(found))

    def describe(self) -> list[tuple[str, int, int]]:
        """(name, rows, columns) of every table."""
        return [(n, (df := self.load(n)).count(), len(df.columns)) for n in self.names()]

    def newest(self, folder: str) -> str | None:
        """Name of the most recently written table of a folder."""
        own = [n for n in self.names() if n.startswith(f"{folder}/")]
        return min(own, key=self.age_days, default=None)


def key_range(df: DataFrame, column: str) -> DataFrame:
    """One row (rows, first, last) as text: the span of days of a time column, or of a column's values; null where it has none."""
    kind = dict(df.dtypes)[column]
    c = F.date_format(column, "yyyy-MM-dd") if kind.startswith(("timestamp", "date")) else F.col(column)
    return df.agg(F.count("*").alias("rows"), F.min(c).cast("string").alias("first"), F.max(c).cast("string").alias("last"))


def storable(df: DataFrame) -> DataFrame:
    """df with columns that have no Parquet type as text."""
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, NullType) else F.col(f"`{f.name}`") for f in df.schema])


def stringified(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text."""
    nested = (StructType, ArrayType, MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])
