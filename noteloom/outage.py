"""Which part of a run failed, told by the type of what was raised and of what caused it."""

from __future__ import annotations

from urllib.error import URLError

from noteloom.operators.points import WriteFailed
from noteloom.schemas import SchemaDrift
from noteloom.sources.embedder import EmbedderMismatch, Refused, ServiceError
from noteloom.sources.lease import LeaseLost
from noteloom.sources.snapshots import Conflict


class Interrupted(RuntimeError):
    """The run was asked to stop."""


class DeadlineExceeded(RuntimeError):
    """A search took longer than it may; its jobs were cancelled."""


class StoreDown(RuntimeError):
    """The stored collection cannot be read."""


#: Types of each part; the first that an exception or one of its causes has decides.
PARTS: tuple[tuple[str, tuple[type[BaseException], ...]], ...] = (
    ("interrupted", (Interrupted,)),
    ("deadline", (DeadlineExceeded,)),
    ("embedder", (ServiceError, Refused, EmbedderMismatch, URLError)),
    ("store", (WriteFailed, SchemaDrift, StoreDown, LeaseLost, Conflict)),
)
#: Java classes behind a Spark error that stand for the store.
STORE_CLASSES = ("java.io.", "java.nio.", "org.apache.hadoop.", "org.apache.parquet.")
#: What a worker raises reaches the driver as the name of its type.
EMBEDDER_NAMES = tuple(f"{t.__module__}.{t.__name__}" for t in (ServiceError, Refused)) + ("urllib.error.",)


def causes(problem: BaseException) -> list[BaseException]:
    out: list[BaseException] = []
    while problem is not None and problem not in out:
        out.append(problem)
        problem = problem.__cause__ or problem.__context__  # type: ignore[assignment]
    return out


def java_causes(problem: BaseException) -> list[tuple[str, str]]:
    """Class and error condition of the Java exception behind a Spark error, and of its causes."""
    java = getattr(problem, "java_exception", None) or getattr(problem, "_origin", None)
    out: list[tuple[str, str]] = []
    while java is not None and len(out) < 20:
        name, condition = java.getClass().getName(), ""
        if name.startswith("org.apache.spark."):
            try:
                condition = java.getCondition() or ""
            except Exception:  # noqa: BLE001 - not every Spark exception has a condition
                condition = ""
        out.append((name, condition))
        java = java.getCause()
    return out


#: Error conditions of Spark that stand for the store.
STORE_CONDITIONS = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "CANNOT_READ_FILE", "TASK_WRITE_FAILED")


def part_of(problem: BaseException) -> str:
    """interrupted, deadline, embedder, store or other."""
    every = causes(problem)
    for part, kinds in PARTS:
        if any(isinstance(p, kinds) for p in every):
            return part
    for p in every:
        if any(line.strip().startswith(EMBEDDER_NAMES) for line in str(p).splitlines()):
            return "embedder"
        if any(name.startswith(STORE_CLASSES) or condition.startswith(STORE_CONDITIONS) for name, condition in java_causes(p)):
            return "store"
    return "other"
