"""References as a Spark data source: ``spark.read.format("references").option("targets", ...).load()``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Target(InputPartition):
    def __init__(self, number: int, target: str):
        super().__init__(number)
        self.number, self.target = number, target


def register(spark: SparkSession, resolve: Callable[[str], list[dict]]) -> None:
    """Register the format with ``resolve``; executors resolve targets side by side, one partition each.

    ``targets`` is a JSON list. Rows: target (its number), doc (number within the target), source, label, content, prose,
    prose_authors, metadata.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.targets = json.loads(options["targets"])

        def partitions(self) -> list[InputPartition]:
            return [_Target(k, t) for k, t in enumerate(self.targets)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for k, doc in enumerate(resolve(partition.target) or []):
                metadata = {a: str(b) for a, b in (doc.get("metadata") or {}).items() if b}
                yield partition.number, k, doc.get("source"), doc.get("label"), doc.get("content"), doc.get("prose"), list(doc.get("prose_authors") or []), metadata

    class References(DataSource):
        @classmethod
        def name(cls) -> str:
            return "references"

        def schema(self) -> str:
            return "target int, doc int, source string, label string, content string, prose string, prose_authors array<string>, metadata map<string,string>"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    spark.dataSource.register(References)
