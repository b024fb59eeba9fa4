"""A paged record API as a Spark data source: one partition a category.

Usable with any fetcher ``page(category, start, size) -> list[dict]`` that can
be pickled; the network one belongs to the application.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition


def pages(fetch: Callable[[str, int, int], list], category: str, most: int, size: int, pause: float = 0.0) -> Iterator[dict]:
    """Records of one category until ``most``, an empty page or a short page; the last page asks for the rest only."""
    start = 0
    while start < most:
        n = min(size, most - start)
        got = fetch(category, start, n)
        if not got:
            return
        yield from got
        start += len(got)
        if len(got) < n:
            return
        if start < most and pause:
            time.sleep(pause)


class Category(InputPartition):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def paged_source(name: str, schema: str, fetch: Callable[[str, int, int], list], category: str = "category") -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(paged_source(...))``.

    Options: categories (comma-separated), per_category, batch_size, pause_sec.
    An equality or IN on the column ``category`` is pushed down: other categories are not
    asked for (``spark.sql.python.filterPushdown.enabled``).
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.codes = sorted({c.strip() for c in options.get("categories", "").split(",") if c.strip()})
            self.most, self.size, self.pause = int(options.get("per_category", 300)), int(options.get("batch_size", 100)), float(options.get("pause_sec", 0))

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, (EqualTo, In)) and f.attribute == (category,):
                    asked = f.value if isinstance(f, In) else (f.value,)
                    self.codes = [c for c in self.codes if c in asked]
                else:
                    yield f

        def partitions(self):
            return [Category(c) for c in self.codes]

        def read(self, partition):
            if partition is None or not hasattr(partition, "code"):
                return
            for record in pages(fetch, partition.code, self.most, self.size, self.pause):
                yield tuple(record.get(c) for c in columns)

    columns = [c.split()[0] for c in schema.split(",")]

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Source
