"""Independent driver-side jobs, a bounded number of them at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")
POOL_KEY = "spark.scheduler.pool"


def in_pool(spark: SparkSession, jobs: Iterable[Callable[[], Result]], workers: int = 4) -> list[Result]:
    """Results of the jobs in their order. Each worker has a scheduling pool of its own, so under fair scheduling none starves.

    The first error is raised once the jobs already running have ended; jobs that have not begun are not started then.
    """

    def with_pool(job: Callable[[], Result]) -> Callable[[], Result]:
        def run() -> Result:
            context = spark.sparkContext
            context.setLocalProperty(POOL_KEY, f"fit-{id(job) % workers}")
            try:
                return job()
            finally:
                context.setLocalProperty(POOL_KEY, None)

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max(1, workers)) as threads:
        running = [threads.submit(with_pool(job)) for job in jobs]
        try:
            return [r.result() for r in running]
        except BaseException:
            for r in running:
                r.cancel()
            raise
