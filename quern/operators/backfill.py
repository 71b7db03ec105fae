"""Filling what rows of a stored table lack, a group of buckets after the other, so that a run can stop anywhere.

A group's rows are filled and put in place by one change of the table, which writes
these buckets only. The table itself is the ledger: what is filled no longer lacks
anything, so a run that comes later passes over it, and only the group that a crash
cut short is filled again. Each row is written once, however many groups there are.

A row that ``fill`` leaves as it was, or does not return, is asked for again by the
next run. Rows that others fill meanwhile are not touched, as the change is made
for the version it read; a change of theirs in between raises ``Conflict``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from quern.sources.keyed_table import KeyedTable


def backfilled(table: KeyedTable, lacking: Column, fill: Callable[[DataFrame], DataFrame], group: int = 16, most: int | None = None) -> int:
    """Groups filled in this run, ``most`` of them at most. ``fill``: rows that lack something -> keys and new columns."""
    done = 0
    for first in range(0, table.manifest()["buckets"], group):
        if done == most:
            break
        version = table.version()
        rows = table.read(version, range(first, first + group)).where(lacking)
        if not rows.isEmpty():
            table.update(fill(rows), since=version)
            done += 1
    return done
