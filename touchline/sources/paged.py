"""Landed pages of standings as a data source: a partition a page, a row for each that is broken."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "landed_pages"


@dataclass
class Page(InputPartition):
    path: str


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def page_paths(folder: str) -> list[str]:
    """Files of pages below a folder, in order of their names; what starts with a dot or underscore is none."""
    store, root = _opened(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/")))


def rows_of(folder: str, path: str) -> Iterator[tuple]:
    """(page, entry, rank, total, error) of a page's results; one row with the error where the page cannot be read."""
    try:
        store, _ = _opened(folder)
        with store.open_input_stream(path) as f:
            page = json.loads(f.read().decode())
        standings = page["standings"]
        rows = [(int(standings["page"]), int(r["entry"]), int(r["rank"]), int(r["total"]), None) for r in standings["results"]]
    except (OSError, ValueError, KeyError, TypeError) as e:
        rows = [(None, None, None, None, f"{path.rsplit('/', 1)[-1]}: {type(e).__name__}")]
    yield from rows


class _Pages:
    def __init__(self, folder: str):
        self.folder = folder

    def read(self, partition: Page | None) -> Iterator[tuple]:
        # Without partitions Spark reads one that is None.
        return iter(()) if partition is None else rows_of(self.folder, partition.path)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(p) for p in page_paths(self.folder)]


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets are numbers of pages in order of their names: pages land under rising names and are never changed."""

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": len(page_paths(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p) for p in page_paths(self.folder)[start["pages"] : end["pages"]]]

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    """spark.read.format(NAME).option("path", folder): {"standings": {"page", "has_next", "results": [{"entry", "rank", "total"}]}} a file.

    Folders must have a path that every worker can open (file, hdfs, s3 and gs as pyarrow knows them). An empty folder gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page int, entry bigint, rank bigint, total bigint, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
