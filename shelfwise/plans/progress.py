"""Progress of scans and copies: counts that tasks add to while they run, and exact ones that Spark observes on the result."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.files import ByteSize


class Progress:
    """Items, bytes and failures that running tasks have reported, for a reader. Once the observed result has been written, its
    own figures take their place: these count every row of the result once, whatever ran again."""

    def __init__(self, spark: SparkSession, what: str):
        self.what, self.seen = what, None
        self.items, self.bytes, self.failures = (spark.sparkContext.accumulator(0) for _ in range(3))

    def add(self, items: int, size: int = 0, failures: int = 0) -> None:
        """Called by tasks."""
        self.items.add(items)
        self.bytes.add(size)
        self.failures.add(failures)

    def observed(self, result: DataFrame, size: str | None = None) -> DataFrame:
        """result (with a column status), whose rows, bytes (column size) and failures are counted by its first action."""
        self.seen = Observation()
        total = F.coalesce(F.sum(size), F.lit(0)).cast("long") if size else F.lit(0).cast("long") + F.sum(F.lit(0))
        return result.observe(self.seen, F.count(F.lit(1)).alias("items"), total.alias("bytes"), F.count_if(F.col("status") != "OK").alias("failures"))

    def figures(self) -> tuple[int, int, int]:
        """Exact items, bytes and failures; only after the observed result's first action."""
        got = self.seen.get
        return got["items"], got["bytes"] or 0, got["failures"]

    def line(self, seconds: float, exact: bool = False) -> str:
        items, size, failures = self.figures() if exact else (self.items.value, self.bytes.value, self.failures.value)
        return f"{self.what}: {items} items, {ByteSize.of(size)}, {ByteSize.of(size / max(seconds, 1e-9))}/s, {failures} failed"

    @contextmanager
    def shown(self, show: Callable[[str], None], every: float = 1.0):
        """Call show with a line now and then while the body runs, and once at its end: with exact figures if the body has written the
        observed result."""
        began, done = time.time(), threading.Event()

        def loop() -> None:
            while not done.wait(every):
                show(self.line(time.time() - began))

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()
        whole = False
        try:
            yield self
            whole = self.seen is not None
        finally:
            done.set()
            thread.join()
            show(self.line(time.time() - began, whole))
