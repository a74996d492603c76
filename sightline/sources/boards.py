"""Board connectors as a Python data source: one partition per board.

Without network the connector reads landed payloads from a folder; a fetcher with the same
signature, given by option, may call an API instead. Failed boards give no rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def retrying(fetch: Callable[[], object], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Calls ``fetch`` until it succeeds, waiting twice as long each time (or as long as it says)."""
    for n in range(tries):
        try:
            return fetch()
        except OSError as e:
            if n == tries - 1:
                raise
            sleep(float(getattr(e, "retry_after", None) or wait * 2**n))
    raise ValueError("tries must be positive")


class BoardReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.boards = options["folder"], [b for b in options.get("boards", "").split(",") if b]
        self.page = int(options.get("pagesize", "100"))

    def partitions(self) -> list[InputPartition]:
        names = self.boards or sorted(p.stem.removesuffix("_jobs") for p in Path(self.folder).glob("*.json"))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        board = partition.value
        for name in (f"{board}.json", f"{board}_jobs.json"):
            path = Path(self.folder, name)
            if path.exists():
                try:
                    payload = json.loads(retrying(path.read_text))
                except ValueError:
                    return
                jobs = payload if isinstance(payload, list) else payload.get("jobs", [])
                # Offset pagination, as the board APIs do it.
                for start in range(0, len(jobs), self.page):
                    for i, job in enumerate(jobs[start : start + self.page]):
                        yield board, start + i, json.dumps(job, ensure_ascii=False)
                return


class BoardSource(DataSource):
    """``spark.read.format("boards").option("folder", ...)``: board, position, payload."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "board string, position int, payload string"

    def reader(self, schema: object) -> BoardReader:
        return BoardReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoardSource)
