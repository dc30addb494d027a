"""A paged REST search as a Spark data source: one input partition per page.

The transport is named by import path (``module:function``) and gets (filters, size, offset), so that
a deployment plugs in its HTTP client and tests a fixture.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "identifier string, name string, artifact_url string, board array<string>, grade_level array<string>, subject array<string>, medium array<string>, license string, mime_type string"


def as_list(value) -> list | None:
    """Fields come as one value or as a list of them."""
    return None if value is None else value if isinstance(value, list) else [value]


class Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch = options["transport"]
        self.filters = json.loads(options.get("filters", "{}"))
        self.size = int(options.get("pagesize", 100))
        self.limit = int(options.get("limit", 200))

    def _call(self, size: int, offset: int):
        module, name = self.fetch.split(":")
        return getattr(importlib.import_module(module), name)(self.filters, size, offset)

    def partitions(self) -> list[Page]:
        count, _ = self._call(1, 0)
        most = min(count, self.limit)
        return [Page(o, min(self.size, most - o)) for o in range(0, most, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        _, items = self._call(partition.size, partition.offset)
        for c in items:
            yield c.get("identifier"), c.get("name"), c.get("artifactUrl"), *(as_list(c.get(k)) for k in ("board", "gradeLevel", "subject", "medium")), c.get("license"), c.get("mimeType")


class CatalogueSearch(DataSource):
    """``spark.read.format("catalogue_search").option("transport", "module:function").load()``."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)
