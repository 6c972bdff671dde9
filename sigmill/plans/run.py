"""Running an action in the background: progress, completion count, cancelling."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Run:
    """An action on a thread of its own, whose jobs carry a tag. Errors are raised by result()."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any]):
        self._context, self._tag = spark.sparkContext, f"run-{uuid.uuid4().hex}"
        self._value, self._error, self.cancelled = None, None, False

        def body():
            self._context.addJobTag(self._tag)
            try:
                self._value = action()
            except BaseException as e:  # noqa: BLE001  result() raises it
                self._error = e
            finally:
                self._context.removeJobTag(self._tag)

        self._thread = InheritableThread(target=body, daemon=True)
        self._thread.start()

    def wait(self, seconds: float | None = None) -> bool:
        """Whether it has ended, after so many seconds at most."""
        self._thread.join(seconds)
        return not self._thread.is_alive()

    def progress(self) -> float:
        """The share of tasks done, of the stages known so far; 1 when it has ended."""
        if not self._thread.is_alive():
            return 1.0
        tracker, done, total = self._context.statusTracker(), 0, 0
        for job in self._context._jsc.sc().statusTracker().getJobIdsForTag(self._tag):
            info = tracker.getJobInfo(job)
            for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
                if stage:
                    done, total = done + stage.numCompletedTasks, total + stage.numTasks
        return min(done / total, 1.0) if total else 0.0

    def cancel(self) -> None:
        """Stops its jobs; result() then raises."""
        self.cancelled = True
        self._context.cancelJobsWithTag(self._tag)

    def result(self) -> Any:
        self._thread.join()
        if self._error is not None:
            raise self._error
        return self._value


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and an observation whose get["done"] is the rows that an action on it has completed."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("done")), seen
