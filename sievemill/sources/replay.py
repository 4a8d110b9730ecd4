"""A data source over recorded payloads: one file a board, many boards a partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "kind string, token string, company string, ok boolean, error string, payload string"


class Batch(InputPartition):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class BoardReader(DataSourceReader):
    """Reads <path>/<kind>/<token>.json, '%2F' in names for '/'. A file that cannot be read or parsed becomes a
    row that says so, so one board fails alone."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("boardsperpartition", "64"))
        self.kinds: set[str] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        kinds = sorted(k for k in os.listdir(self.path) if os.path.isdir(os.path.join(self.path, k)))
        files = [(k, f) for k in kinds if self.kinds is None or k in self.kinds for f in sorted(os.listdir(os.path.join(self.path, k))) if f.endswith(".json")]
        return [Batch(files[i : i + self.size]) for i in range(0, len(files), self.size)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for kind, name in partition.files:
            token = name[: -len(".json")].replace("%2F", "/")
            try:
                with open(os.path.join(self.path, kind, name), encoding="utf-8") as f:
                    recorded = json.load(f)
                company = recorded.get("company") if isinstance(recorded, dict) else None
                payload = recorded.get("payload", recorded) if isinstance(recorded, dict) else recorded
                yield kind, token, company, True, None, json.dumps(payload, ensure_ascii=False)
            except (OSError, ValueError) as e:
                yield kind, token, None, False, str(e)[:300], None


class FilteringReader(BoardReader):
    """Takes filters on ``kind`` into the listing."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {f.value} & (self.kinds or {f.value})
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds = set(f.value) & (self.kinds or set(f.value))
            else:
                yield f


class BoardSource(DataSource):
    """Options: ``path``; ``boardsPerPartition``; ``pushFilters`` = true reads only the kinds asked for. Then
    each filter needs a load of its own, as Spark keeps one reader a loaded table and a second scan of it
    would see the first one's filter."""

    @classmethod
    def name(cls) -> str:
        return "boards_replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (FilteringReader if options.get("pushfilters", "").lower() == "true" else BoardReader)(options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BoardSource)
