"""A lock that holds between hosts: numbered lease files in a shared folder.

A lease is a file that is created once, with the next free number, so of several hosts one gets it. Its holder renews it
until it is released; one that is not renewed in time counts as gone, and the next number takes over. The number fences
writers: whoever commits must still hold the highest one (`check`), so a holder that slept through its time is refused.
Clocks of hosts must agree to within `SLACK`.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from noteloom.sources.files import Exists, Folder
from noteloom.sources.sinks import LockHeld, scope_key

TTL, SLACK = 120.0, 2.0


class LeaseLost(RuntimeError):
    """The lease ran out or went to another run; nothing may be committed under it."""


class Lease:
    def __init__(self, folder: Folder, scope: str, number: int, ttl: float, clock: Callable[[], float]):
        self.folder, self.scope, self.number, self.ttl, self.clock = folder, scope, number, ttl, clock
        self.holder = uuid.uuid4().hex
        self.until = 0.0
        self._stop = threading.Event()

    @property
    def name(self) -> str:
        return f"{self.scope}.{self.number:012d}"

    def _said(self, until: float) -> str:
        return json.dumps({"holder": self.holder, "until": until})

    def renew(self) -> None:
        """A longer life, unless it is over already."""
        self.check()
        self.until = self.clock() + self.ttl
        self.folder.replace(self.name, self._said(self.until), f"_{self.name}.{self.holder}")

    def check(self) -> None:
        """Whether this run may still commit."""
        if self.clock() > self.until - SLACK:
            raise LeaseLost(f"lease {self.number} ran out")
        if highest(self.folder, self.scope) != self.number:
            raise LeaseLost(f"lease {self.number} went to another run")

    def release(self) -> None:
        self._stop.set()
        if self.until and highest(self.folder, self.scope) == self.number:
            self.folder.replace(self.name, self._said(0.0), f"_{self.name}.{self.holder}")
        self.until = 0.0

    def keep_alive(self) -> None:
        """Renew from a thread until released; a renewal that fails ends the lease."""

        def run() -> None:
            while not self._stop.wait(self.ttl / 3):
                try:
                    self.renew()
                except Exception:  # noqa: BLE001 - whatever it was, the lease is not held any more
                    self.until = 0.0
                    return

        threading.Thread(target=run, daemon=True).start()


def highest(folder: Folder, scope: str) -> int:
    return max((int(n.rpartition(".")[2]) for n in folder.names(f"{scope}.*")), default=0)


def acquire(spark: SparkSession, root: str, *scope: str, ttl: float = TTL, clock: Callable[[], float] = time.time) -> Lease:
    """The lease of a scope, or LockHeld. A file without content was just created and counts as held."""
    folder, key = Folder(spark, root), scope_key(*scope)
    last = highest(folder, key)
    if last:
        said = folder.read(f"{key}.{last:012d}")
        if not said or json.loads(said)["until"] + SLACK > clock():
            raise LockHeld("another run holds the lock")
    lease = Lease(folder, key, last + 1, ttl, clock)
    lease.until = clock() + ttl
    try:
        folder.create(lease.name, lease._said(lease.until))
    except Exists as e:
        raise LockHeld("another run holds the lock") from e
    for n in folder.names(f"{key}.*"):
        if int(n.rpartition(".")[2]) < last:  # the last one but one and older are of no use
            folder.delete(n)
    return lease


@contextmanager
def held(spark: SparkSession, root: str, *scope: str, ttl: float = TTL) -> Iterator[Lease]:
    lease = acquire(spark, root, *scope, ttl=ttl)
    lease.keep_alive()
    try:
        yield lease
    finally:
        lease.release()
