"""Paged services as streams: positions are Spark's offsets, so a query that dies goes on where it was.

``planned_pages``: pages of each of a list of subjects (tags, artists), a batch some
pages long. A subject ends at its first page that is not full; pages after it are
not asked for again.

``newest_first_feed``: a service that lists its newest rows first, under page
numbers that shift as rows arrive. A batch is a range of times, (start, end], logged
before it is read: whatever a run that stopped half-way had read, the next one reads
the whole range. The cursor never passes rows that were not delivered.

A batch that is run again asks for the same pages. Requests are spaced by ``intervalMs``
over all tasks of a batch, failures are retried with doubling waits. ``state`` names a
folder that driver and executors share, one for each query; it keeps how far batches
were planned, as a reader is not told where its query starts, and which subjects have ended.

Defined results: no subjects or an empty service give no rows; a page without
results is an empty one; rows of a feed without a time are left out; a row that
moves to the next page while a range is read comes once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Most subjects of a plan: the list is part of every reader.
MAX_SUBJECTS = 1_000_000


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if ":" in path else (pa.fs.LocalFileSystem(), path)


class State:
    """Small JSON values by name in a shared folder; a value is written beside its place and moved there."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self, name: str) -> tuple[pa.fs.FileSystem, str]:
        fs, top = located(self.path)
        return fs, f"{top}/{name}.json"

    def get(self, name: str):
        fs, at = self._at(name)
        if fs.get_file_info(at).type == pa.fs.FileType.NotFound:
            return None
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def put(self, name: str, value) -> None:
        fs, at = self._at(name)
        half = f"{at}.{uuid.uuid4().hex}"
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(half) as f:
            f.write(json.dumps(value).encode())
        fs.move(half, at)


@dataclass
class Pace:
    """Spaced requests of one of ``tasks`` tasks, so that all together keep the interval; retries wait longer and longer."""

    interval: float
    retries: int = 3
    wait: float = 1.0
    task: int = 0
    tasks: int = 1

    def __post_init__(self) -> None:
        self.due = None

    def ask(self, fetch: Callable[..., str], *what) -> dict:
        for attempt in range(self.retries + 1):
            now = time.monotonic()
            self.due = now + self.task * self.interval if self.due is None else self.due
            time.sleep(max(0.0, self.due - now))
            self.due = max(self.due, time.monotonic()) + self.tasks * self.interval
            try:
                return json.loads(fetch(*what))
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(min(self.wait * 2**attempt, 30.0))
        raise AssertionError


@dataclass
class Stretch(InputPartition):
    """Pages [first, last) of one subject after another: (subject number, first, last)."""

    pages: list[tuple[int, int, int]]
    task: int
    tasks: int


class _Reader(DataSourceStreamReader):
    def __init__(self, fetch: Callable[..., str], options: dict):
        self.fetch, self.state = fetch, State(options["state"])
        self.interval = int(options.get("intervalMs", 1000)) / 1000
        self.retries, self.wait = int(options.get("retries", 3)), int(options.get("waitMs", 1000)) / 1000

    def pace(self, task: int = 0, tasks: int = 1) -> Pace:
        return Pace(self.interval, self.retries, self.wait, task, tasks)


class PlanReader(_Reader):
    def __init__(self, fetch: Callable[[str, int, int], str], subjects: Sequence[str], options: dict):
        super().__init__(fetch, options)
        if len(subjects) > MAX_SUBJECTS:
            raise ValueError(f"{len(subjects)} subjects; {MAX_SUBJECTS} at most")
        self.subjects, self.size = subjects, int(options.get("pageSize", 100))
        self.each = -(-int(options.get("perSubject", 5000)) // self.size)
        self.limit = int(options.get("perSubject", 5000))
        self.step, self.tasks = int(options.get("pagesPerBatch", 50)), int(options.get("tasks", 1))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        at, total = self.state.get("planned") or 0, len(self.subjects) * self.each
        while at < total and at % self.each and self.state.get(f"ended/{at // self.each}"):
            at += self.each - at % self.each  # to the next subject
        return {"page": min(total, at + self.step)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.state.put("planned", max(end["page"], self.state.get("planned") or 0))
        pages, at = [], start["page"]
        while at < end["page"]:
            subject, first = divmod(at, self.each)
            last = min(self.each, first + end["page"] - at)
            ended = self.state.get(f"ended/{subject}")
            stop = last if ended is None else min(last, ended)
            if first < stop:
                pages.append((subject, first, stop))
            at += last - first
        tasks = max(1, min(self.tasks, len(pages)))
        return [Stretch(pages[i::tasks], i, tasks) for i in range(tasks)] if pages else []

    def read(self, partition: Stretch) -> Iterator[tuple]:
        pace = self.pace(partition.task, partition.tasks)
        for subject, first, last in partition.pages:
            for n in range(first, last):
                want = min(self.size, self.limit - n * self.size)
                rows = pace.ask(self.fetch, self.subjects[subject], n * self.size, want).get("results") or []
                for row in rows[:want]:
                    yield self.subjects[subject], n, json.dumps(row)
                if len(rows) < want:
                    self.state.put(f"ended/{subject}", n + 1)  # asked again, if the batch is run again
                    break


class FeedReader(_Reader):
    def __init__(self, fetch: Callable[[int], str], options: dict):
        super().__init__(fetch, options)
        self.field, self.key, self.after = options["timeField"], options["keyField"], options.get("after", "")

    def initialOffset(self) -> dict:
        return {"after": self.after}

    def latestOffset(self) -> dict:
        rows = self.pace().ask(self.fetch, 0).get("results") or []
        times = [str(r[self.field]) for r in rows if r.get(self.field) is not None]
        return {"after": max([self.state.get("planned") or self.after, *times])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.state.put("planned", max(end["after"], self.state.get("planned") or ""))
        return [InputPartition((start["after"], end["after"]))] if start["after"] < end["after"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        pace, n, before, seen = self.pace(), 0, set(), set()
        while True:
            page = pace.ask(self.fetch, n)
            for row in page.get("results") or []:
                at, key = row.get(self.field), row.get(self.key)
                if at is None or str(at) > high:
                    continue
                if str(at) <= low:
                    return
                seen.add(key)
                if key not in before:
                    yield n, json.dumps(row)
            if not page.get("next"):
                return
            n, before, seen = n + 1, seen, set()


def planned_pages(name: str, fetch: Callable[[str, int, int], str], subjects: Sequence[str]) -> type[DataSource]:
    """A streaming source to register: subject, page int, row string (JSON).

    ``fetch``: (subject, offset, limit) -> body. Options: state, pageSize (100), perSubject (most rows of a
    subject, 5000), pagesPerBatch (50), tasks (1), intervalMs (1000), retries (3), waitMs (1000).
    """

    class Planned(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "subject string, page int, row string"

        def streamReader(self, schema) -> PlanReader:
            return PlanReader(fetch, subjects, self.options)

    return Planned


def newest_first_feed(name: str, fetch: Callable[[int], str]) -> type[DataSource]:
    """A streaming source to register: page int, row string (JSON).

    ``fetch``: page number -> body. Options: state, timeField (ISO times, compared as text), keyField, after
    (start), intervalMs, retries, waitMs. A row that appears later with a time not above the newest is not seen.
    """

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, row string"

        def streamReader(self, schema) -> FeedReader:
            return FeedReader(fetch, self.options)

    return Feed
