"""A catalogue that comes page by page, as a Spark data source over landed page files.

A folder holds one pass: ``page-00000.json``, ``page-00001.json`` and so on, each ``{"count": total, "items": [...]}``.
Every page is one partition. As a stream, the offset is the number of pages read, with the moment at which the pass
began and the last item's id: a stream that stops and starts again goes on with the pages that are missing, under the
first ``observed_at``, and fails if the page before them is no longer the one it read.

``observed_at`` is written beside the pages when a pass is first read, and read from there ever after.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tenderloom.operators.quality import same_pass

SCHEMA = "page int, position int, id string, item string, observed_at timestamp"
BEGUN = "_observed_at"


class PageError(ValueError):
    """A page that is not what the source promises."""


@dataclass
class Page(InputPartition):
    number: int
    observed_at: str


class _Folder:
    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def text(self, name: str) -> str:
        with self.files.open_input_stream(f"{self.path}/{name}") as f:
            return f.read().decode()

    def pages(self) -> int:
        """Pages landed without a gap."""
        found = {i.base_name for i in self.files.get_file_info(fs.FileSelector(self.path)) if i.is_file}
        n = 0
        while f"page-{n:05d}.json" in found:
            n += 1
        return n

    def items(self, number: int) -> list[dict]:
        try:
            page = json.loads(self.text(f"page-{number:05d}.json"))
        except ValueError as e:
            raise PageError(f"page {number} is no JSON") from e
        if not isinstance(page, dict) or not isinstance(page.get("items"), list) or not isinstance(page.get("count"), int) or isinstance(page["count"], bool) or page["count"] < 0:
            raise PageError(f"page {number} has no count or no items")
        if any(not isinstance(i, dict) or "id" not in i for i in page["items"]):
            raise PageError(f"page {number} holds an item without an id")
        return page["items"]

    def last_id(self, pages: int) -> str:
        items = self.items(pages - 1) if pages else []
        return str(items[-1]["id"]) if items else ""

    def observed_at(self) -> str:
        """When the pass began: now, if nobody has asked before."""
        name = f"{self.path}/{BEGUN}"
        if self.files.get_file_info(name).type == fs.FileType.NotFound:
            with self.files.open_output_stream(name) as f:
                f.write(datetime.now(UTC).isoformat().encode())
        return self.text(BEGUN)

    def read(self, page: Page) -> Iterator[tuple]:
        at = datetime.fromisoformat(page.observed_at)
        for i, item in enumerate(self.items(page.number)):
            yield page.number, i, str(item["id"]), json.dumps(item, ensure_ascii=False, sort_keys=True), at


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        folder = _Folder(self.path)
        at = folder.observed_at()
        return [Page(n, at) for n in range(folder.pages())] or [Page(-1, at)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _Folder(self.path).read(partition) if partition.number >= 0 else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _offset(self, pages: int) -> dict:
        folder = _Folder(self.path)
        return {"pages": pages, "observed_at": folder.observed_at(), "last_id": folder.last_id(pages)}

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        return self._offset(_Folder(self.path).pages())

    def partitions(self, start: dict, end: dict) -> list[Page]:
        if start["last_id"] != _Folder(self.path).last_id(start["pages"]):
            raise PageError(f"page {start['pages'] - 1} is not the one that was read before")
        return [Page(n, start["observed_at"]) for n in range(start["pages"], end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _Folder(self.path).read(partition)


class LandedPages(DataSource):
    """``spark.read.format("landed_pages").load(path)``, and the same as a stream."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(page, position, id, item, observed_at) of the pass in the folder ``path``."""
    spark.dataSource.register(LandedPages)
    return (spark.readStream if stream else spark.read).format("landed_pages").load(path)


def publish_pass(first: DataFrame, second: DataFrame, total: int, path: str) -> bool:
    """Write the first pass to ``path`` if both gave the same items, each once and ``total`` in all; else write nothing."""
    if not same_pass(first, second, "id", total) or not same_pass(first, second, "item", total):
        return False
    first.write.mode("overwrite").parquet(path)
    return True
