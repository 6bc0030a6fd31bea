"""A registry of shop adapters as a Python data source: spark.read.format("shop_pages").option("shop", name).option("path", folder).

Each adapter turns one saved page into rows; the reader gives every page file a task of its own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Row = tuple[str, int, str, str | None]
ADAPTERS: dict[str, Callable[[str, str], Iterator[Row]]] = {}


def adapter(name: str):
    """Registers a function (file name, text) -> rows (file, position, title, price)."""

    def keep(f):
        ADAPTERS[name] = f
        return f

    return keep


@adapter("json")
def json_page(name: str, text: str) -> Iterator[Row]:
    """Products of a JSON page; a page that is no JSON has none."""
    try:
        products = json.loads(text).get("products") or []
    except (ValueError, AttributeError):
        return
    for i, p in enumerate(products):
        if p.get("title"):
            yield name, i, p["title"], str(p["price"]) if p.get("price") is not None else None


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.shop = options["path"], options.get("shop", "json")

    def partitions(self) -> list[InputPartition]:
        return [_Page(os.path.join(self.folder, f)) for f in sorted(os.listdir(self.folder)) if not f.startswith(".")]

    def read(self, partition: InputPartition) -> Iterator[Row]:
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield from ADAPTERS[self.shop](os.path.basename(partition.path), f.read())


class ShopPages(DataSource):
    """The registered adapters over a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "shop_pages"

    def schema(self) -> str:
        return "file string, position int, title string, price string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
