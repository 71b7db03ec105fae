"""A paged service as a Spark source, by the Python Data Source API.

Pages are asked for in ranges of offsets, a partition each; transport is a
function, so that tests and replays read recorded pages and a live run passes
one that calls the service. Failures are retried with doubling waits. Options:
pages (how many there are), offset (the first to read), maxPages (at most so
many), pagesPerTask; stopField and stopAt end a task's reading at the first row
whose field is not above the cursor of the last run (pages come newest first).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], str], options: dict):
        self.fetch = fetch
        self.first, self.per_task = int(options.get("offset", 0)), int(options.get("pagesPerTask", 10))
        self.last = min(int(options.get("pages", 1)), self.first + int(options.get("maxPages", 1 << 62)))
        self.stop_field, self.stop_at = options.get("stopField"), options.get("stopAt")
        self.retries, self.wait_ms = int(options.get("retries", 3)), int(options.get("waitMs", 1000))

    def partitions(self) -> list[InputPartition]:
        return [Pages(a, min(self.last, a + self.per_task)) for a in range(self.first, self.last, self.per_task)]

    def _page(self, n: int) -> str:
        for attempt in range(self.retries + 1):
            try:
                return self.fetch(n)
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(min(self.wait_ms * 2**attempt, 30_000) / 1000)
        raise AssertionError

    def read(self, partition: Pages) -> Iterator[tuple]:
        for n in range(partition.first, partition.last):
            page = json.loads(self._page(n))
            for row in page.get("results", []):
                if self.stop_field and str(row.get(self.stop_field) or "") <= self.stop_at:
                    return
                yield n, json.dumps(row)
            if not page.get("next"):
                return


def paged_source(name: str, fetch: Callable[[int], str]) -> type[DataSource]:
    """A data source to register: page int, row string (JSON). ``fetch``: page number -> body."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, row string"

        def reader(self, schema) -> PagedReader:
            return PagedReader(fetch, self.options)

    return Paged
