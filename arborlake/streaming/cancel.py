"""Queries in phases that can be cancelled: between phases by a flag, within one by the tag of its Spark jobs. Other queries of the session go on."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    pass


class Cancellation:
    """The running queries of a session, by tag. Threads that run queries and those that cancel share one."""

    def __init__(self, spark: SparkSession):
        self.spark, self._running, self._lock = spark, {}, threading.Lock()

    def run(self, tag: str, phases: list[tuple[str, Callable]], given=None):
        """Give each phase what the one before it gave, under the tag; Cancelled before the next phase, or in the place of what a cancelled job raises. A tag is used by one query at a time."""
        flag = threading.Event()
        with self._lock:
            if tag in self._running:
                raise ValueError(f"a query runs as {tag}")
            self._running[tag] = flag
        context = self.spark.sparkContext
        context.addJobTag(tag)
        try:
            for name, phase in phases:
                if flag.is_set():
                    raise Cancelled(f"{tag}: cancelled before {name}")
                try:
                    given = phase(given)
                except Exception as e:
                    if flag.is_set():
                        raise Cancelled(f"{tag}: cancelled in {name}") from e
                    raise
            return given
        finally:
            context.removeJobTag(tag)
            with self._lock:
                del self._running[tag]

    def cancel(self, tag: str) -> bool:
        """Stop the query that runs as tag, its jobs too; whether there was one."""
        with self._lock:
            flag = self._running.get(tag)
        if flag is None:
            return False
        flag.set()
        self.spark.sparkContext.cancelJobsWithTag(tag)
        return True

    def cancel_all(self) -> int:
        """Stop all queries; how many there were."""
        with self._lock:
            tags = list(self._running)
        return sum(map(self.cancel, tags))
