"""One writer per table.

A writer holds a lock file in the shared root while it merges and records. The file is made
only if it is absent, and touched while its owner lives; one that has not been touched for a
while belongs to a job that is gone and is taken over.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .runtime import filesystem

WAIT_SECONDS = 3600.0
STALE_SECONDS = 120.0
_POLL_SECONDS = 0.2

#: Writers of one driver wait for each other here: local file systems make no file atomically.
_WRITERS: dict[str, threading.Lock] = defaultdict(threading.Lock)
_GUARD = threading.Lock()


def _age(store, place) -> float | None:
    """Seconds since the lock was touched; None if it is gone."""
    try:
        return time.time() - store.getFileStatus(place).getModificationTime() / 1000
    except Exception as error:
        if "FileNotFound" in str(error):
            return None
        raise


def _made(store, place) -> bool:
    try:
        return bool(store.createNewFile(place))
    except Exception as error:
        if "AlreadyExists" in str(error):
            return False
        raise


def _take_over(spark: SparkSession, store, place, stale: float) -> None:
    """Move a stale lock away. Of several writers only one can move it; a fresh one that was moved is put back."""
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{place.toString()}-{uuid.uuid4().hex}")
    if store.rename(place, aside):
        age = _age(store, aside)
        if age is not None and age < stale and not store.exists(place):
            store.rename(aside, place)
        else:
            store.delete(aside, False)


@contextmanager
def table_lock(spark: SparkSession, root: str, name: str, wait: float = WAIT_SECONDS, stale: float = STALE_SECONDS) -> Iterator[None]:
    """Holds the table's lock; waits for another writer at most `wait` seconds."""
    path = f"{root.rstrip('/')}/locks/{name}"
    with _GUARD:
        own = _WRITERS[path]
    deadline = time.time() + wait
    if not own.acquire(timeout=wait):
        raise TimeoutError(f"another writer of {name} has held its lock for {wait:.0f} s")
    try:
        store, place = filesystem(spark, path)
        while not _made(store, place):
            age = _age(store, place)
            if age is not None and age >= stale:
                _take_over(spark, store, place, stale)
            elif time.time() > deadline:
                raise TimeoutError(f"another writer of {name} has held its lock for {wait:.0f} s: {path}")
            else:
                time.sleep(_POLL_SECONDS)
        done = threading.Event()

        def touch() -> None:
            while not done.wait(stale / 4):
                store.setTimes(place, int(time.time() * 1000), -1)

        living = threading.Thread(target=touch, daemon=True)
        living.start()
        try:
            yield
        finally:
            done.set()
            living.join()
            store.delete(place, False)
    finally:
        own.release()
