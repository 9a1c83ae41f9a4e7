"""Progress of running jobs: a line every so many seconds, from Spark's own counts of tasks."""

from __future__ import annotations

import logging
import sys
import time
from collections.abc import Callable
from threading import Event, Thread

from pyspark.sql import SparkSession

from ..operators.telemetry import eta_seconds

log = logging.getLogger("cairn")


def line(what: str, done: int, total: int, seconds: float) -> str:
    """One line of progress; the time to go follows from the rate so far."""
    left = eta_seconds(done, total, done / seconds if seconds > 0 else 0.0)
    share = f"{100 * done // total}%" if total else "-"
    return f"{what}: {done}/{total} tasks ({share}), {seconds:.0f} s" + (f", {left:.0f} s to go" if left is not None and done < total else "")


class Ticker:
    """Reports while a block runs, such as a load, a save or a deletion, and once at its end.

    Tasks are those of the stages that were seen; a stage that begins later adds its own, so a total may grow.
    """

    def __init__(self, spark: SparkSession, what: str, seconds: float = 0.5, out=None, report: Callable[[str], None] | None = None):
        self.tracker, self.what, self.every = spark.sparkContext.statusTracker(), what, seconds
        self.report = report or (lambda text: print(text, file=out or sys.stderr))
        self.stages: dict[int, tuple[int, int]] = {}
        self.ended, self.began = Event(), 0.0

    def look(self) -> tuple[int, int]:
        """Tasks done and tasks known of."""
        active = set(self.tracker.getActiveStageIds())
        for i in active:
            info = self.tracker.getStageInfo(i)
            if info is not None:
                self.stages[i] = info.numCompletedTasks, info.numTasks
        for i in set(self.stages) - active:
            self.stages[i] = self.stages[i][1], self.stages[i][1]
        return sum(d for d, _ in self.stages.values()), sum(n for _, n in self.stages.values())

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            self.report(line(self.what, *self.look(), time.monotonic() - self.began))

    def __enter__(self) -> Ticker:
        self.began = time.monotonic()
        self.thread = Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.ended.set()
        self.thread.join()
        seconds = time.monotonic() - self.began
        self.report(f"{self.what}: {'failed' if kind else 'done'} after {seconds:.1f} s")


def log_to(path: str | None, level: int = logging.INFO) -> None:
    """Send the library's log to a file, if one is named."""
    if path:
        handler = logging.FileHandler(path)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(level)
