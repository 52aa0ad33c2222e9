"""Work with a deadline: Spark jobs carry a tag, and a timer cancels the jobs of the tag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from noteloom.outage import DeadlineExceeded

#: Seconds that a search of a tool may take.
SEARCH_SECONDS = 10.0

T = TypeVar("T")


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """What work returns, or DeadlineExceeded. Its running jobs are cancelled, those of other threads go on."""
    context, tag, over = spark.sparkContext, f"noteloom-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        out = work()
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"not done within {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if over.is_set():
        raise DeadlineExceeded(f"not done within {seconds:g} s")
    return out
