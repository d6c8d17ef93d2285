"""Sources that answer page by page, as data sources of Spark: a partition a page, a stream with offsets.

The caller gives fetch(start, limit) -> list of texts and size() -> number of
items there are; both go to the executors by value. A batch read asks all pages
in parallel; a stream remembers how many items it has seen, asks for those that
came since, a bounded number of pages at a time, and goes on from there after a
restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..ship import ship


class Page(InputPartition):
    def __init__(self, start: int, limit: int):
        self.start, self.limit = start, limit


def pages(start: int, end: int, limit: int) -> list[Page]:
    return [Page(at, min(limit, end - at)) for at in range(start, end, limit)]


def source_of(name: str, fetch, size) -> type[DataSource]:
    """A data source of that name with rows (position long, content string); options: limit (items a page), pages (in a batch of a stream)."""

    class Reader(DataSourceReader):
        def __init__(self, limit):
            self.limit = limit

        def partitions(self):
            return pages(0, size(), self.limit)

        def read(self, partition):
            if partition is None:  # no page at all
                return
            for i, text in enumerate(fetch(partition.start, partition.limit)):
                yield partition.start + i, text

    class StreamReader(DataSourceStreamReader):
        def __init__(self, limit, most):
            self.limit, self.most, self.seen = limit, most, None

        def initialOffset(self):
            return {"items": 0}

        def latestOffset(self):
            there = size()
            self.seen = there if self.seen is None else min(there, self.seen + self.limit * self.most)
            return {"items": self.seen}

        def partitions(self, start, end):
            return pages(start["items"], end["items"], self.limit)

        def read(self, partition):
            for i, text in enumerate(fetch(partition.start, partition.limit)):
                yield partition.start + i, text

        def commit(self, end):
            pass

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "position long, content string"

        def _limit(self):
            return int(self.options.get("limit", 100))

        def reader(self, schema):
            return Reader(self._limit())

        def streamReader(self, schema):
            return StreamReader(self._limit(), int(self.options.get("pages", 100)))

    return Paged


def register(spark, name: str, fetch, size) -> None:
    ship(spark)
    spark.dataSource.register(source_of(name, fetch, size))


def read(spark, name: str, fetch, size, limit: int = 100) -> DataFrame:
    """All items (position, content) of a source."""
    register(spark, name, fetch, size)
    return spark.read.format(name).option("limit", limit).load()


def follow(spark, name: str, fetch, size, limit: int = 100) -> DataFrame:
    """A stream of the items (position, content) of a source that grows."""
    register(spark, name, fetch, size)
    return spark.readStream.format(name).option("limit", limit).load()


def of_records(df: DataFrame, fetch, fields: str, defaults: dict | None = None) -> DataFrame:
    """A source for each record: fetch(parameters) -> records; a record's fields come before the defaults.

    The record's own fields stay where the fetched record does not have them. Records are
    dealt evenly over tasks, so that thousands of small sources are read side by side.
    """
    from ..plans.hooks import resolve

    given = defaults or {}

    def one(record):
        return fetch(given | {k: v for k, v in record.items() if v is not None})

    return resolve(df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism)), one, fields)
