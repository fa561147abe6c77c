"""Pull sources: services that answer in pages, as a data source with a partition for each connection.

``read_services`` reads them through ``spark.read``. What fetches a page is given: ``transport(connection, page, size)``
returns the body of an answer, or raises. A connection that fails gives a row with the error, after the pages that came
before it, and the others are read all the same. A condition on ``connection`` leaves out partitions before they are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "connection string, page int, body string, error string"
PAGE = 200
Transport = Callable[[str, int, int], str]


class Connection(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class ServiceReader(DataSourceReader):
    def __init__(self, connections: Sequence[str], transport: Transport, size: int):
        self.connections, self.transport, self.size = list(connections), transport, size

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("connection",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.connections = [c for c in self.connections if c in wanted]
            else:
                yield f

    def partitions(self) -> list[Connection]:
        return [Connection(c) for c in self.connections]

    def read(self, partition: Connection | None) -> Iterator[tuple]:
        page, seen = 1, 0
        while partition is not None:
            try:
                body = self.transport(partition.name, page, self.size)
                answer = json.loads(body)
                total, n = int(answer.get("totalRecords", 0)), len(answer.get("records", ()))
            except Exception as error:  # noqa: BLE001  whatever a service does, the others are read
                yield partition.name, page, None, f"{type(error).__name__}: {error}"[:500]
                return
            yield partition.name, page, body, None
            seen += n
            if not n or seen >= total:
                return
            page += 1


def service_source(transport: Transport, connections: Sequence[str], size: int = PAGE) -> type[DataSource]:
    """A data source of these connections, to be registered under the name ``services``."""
    names = list(connections)

    class Services(DataSource):
        @classmethod
        def name(cls) -> str:
            return "services"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> ServiceReader:
            return ServiceReader(names, transport, int(self.options.get("pagesize", size)))

    return Services


def read_services(spark: SparkSession, transport: Transport, connections: Sequence[str], size: int = PAGE) -> DataFrame:
    """(connection, page, body, error): a row a page, or an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(service_source(transport, connections, size))
    return spark.read.format("services").load()


def file_transport(folder: str) -> Transport:
    """Answers that were captured: connection=NAME/page=N below a folder that all executors see, one text file each."""

    def fetch(connection: str, page: int, size: int) -> str:
        from pathlib import Path

        found = sorted(Path(folder.removeprefix("file://"), f"connection={connection}", f"page={page}").glob("part-*"))
        if not found:
            raise FileNotFoundError(f"no answer of {connection} for page {page}")
        return found[0].read_text()

    return fetch
