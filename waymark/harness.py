"""Timed runs: warm-ups, repeats, a time limit, and sweeps over lengths that stop early."""

from __future__ import annotations

import statistics
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession


class TimeLimit(Exception):
    """A run took longer than it may."""


@dataclass(frozen=True)
class Timing:
    """Seconds of each timed run, and what the last one returned."""

    seconds: tuple[float, ...]
    result: object

    @property
    def summary(self) -> dict[str, float]:
        return {"avg": statistics.fmean(self.seconds), "min": min(self.seconds), "max": max(self.seconds), "median": statistics.median(self.seconds)}


def limited(spark: SparkSession, run: Callable[[], object], limit: float | None):
    """run(), whose Spark jobs are cancelled after limit seconds; then TimeLimit is raised."""
    if limit is None:
        return run()
    sc, group, late = spark.sparkContext, f"waymark-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(limit, stop)
    sc.setJobGroup(group, "timed run", True)
    timer.start()
    try:
        out = run()
    except Exception as e:
        if late.is_set():
            raise TimeLimit(f"over {limit} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeLimit(f"over {limit} s")
    return out


def measure(spark: SparkSession, run: Callable[[], object], warmups: int = 1, runs: int = 3, limit: float | None = None) -> Timing:
    """Timed runs after warm-ups; limit is that of each run."""
    for _ in range(warmups):
        limited(spark, run, limit)
    seconds, out = [], None
    for _ in range(runs):
        began = time.perf_counter()
        out = limited(spark, run, limit)
        seconds.append(time.perf_counter() - began)
    return Timing(tuple(seconds), out)


def sweep(spark: SparkSession, count: Callable[[int], int], lengths: Iterable[int], warmups: int = 1, runs: int = 3, limit: float | None = None) -> list[tuple[int, Timing | None]]:
    """(length, timing) for rising lengths; ends after one without paths, or with None for one over the limit."""
    out: list[tuple[int, Timing | None]] = []
    for n in lengths:
        try:
            out.append((n, measure(spark, lambda n=n: count(n), warmups, runs, limit)))
        except TimeLimit:
            out.append((n, None))
            break
        if not out[-1][1].result:
            break
    return out
