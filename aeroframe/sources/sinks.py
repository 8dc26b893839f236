"""Single files written through Hadoop's file systems, so that a path may lie on any store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


# Bytes that go to the store in one call.
PIECE = 1 << 22


@contextmanager
def opened(spark: SparkSession, path) -> Iterator[Callable[[bytes], None]]:
    """A function that appends bytes to a new file at ``path``; folders are made.
    Each call to the store takes some milliseconds, so small contents go together."""
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() == "file":
        # no checksum files beside local ones
        store = store.getRawFileSystem()
    out = store.create(target, True)
    waiting = bytearray()

    def write(content: bytes) -> None:
        waiting.extend(content)
        while len(waiting) >= PIECE:
            out.write(waiting[:PIECE])
            del waiting[:PIECE]

    try:
        yield write
        if waiting:
            out.write(waiting)
    finally:
        out.close()
