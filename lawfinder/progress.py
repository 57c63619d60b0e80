"""Progress of the tasks of a fit, polled from Spark's status tracker."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


@contextlib.contextmanager
def tracked(spark: SparkSession, total: int, callback: Callable[[int, int, float], None] | None, every: float = 0.1):
    """While the body runs, call back with (done, total, percent) of the tasks of its jobs; errors of the callback are its own."""
    if callback is None:
        yield
        return
    context, group, ended = spark.sparkContext, uuid.uuid4().hex, threading.Event()
    context.setJobGroup(group, "fit")

    def counted() -> tuple[int, int]:
        done = all_ = 0
        tracker = context.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, all_ = done + s.numCompletedTasks, all_ + s.numTasks
        return done, all_

    def poll():
        while not ended.wait(every):
            done, all_ = counted()
            if all_:
                with contextlib.suppress(Exception):
                    callback(done, all_, 100.0 * done / all_)

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join(2)
        context._jsc.clearJobGroup()
        with contextlib.suppress(Exception):
            callback(total, total, 100.0)


def console_progress(done: int, total: int, percent: float) -> None:
    print(f"\r{done}/{total} ({percent:.0f} %)", end="\n" if done >= total else "", flush=True)
