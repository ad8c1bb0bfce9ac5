"""Small text files beside tables: what a folder holds, written last and whole.

They go through Hadoop's file system, so they lie wherever Spark's tables may lie.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_note(spark: SparkSession, path: str, content: str) -> None:
    """Write a note under another name and rename it: it is there completely or not at all.

    An older note goes first; a reader that finds none in between begins anew.
    """
    system, place = _opened(spark, path)
    part = place.suffix(f"-{uuid.uuid4().hex}.part")
    stream = system.create(part, True)
    try:
        stream.write(content.encode())
    finally:
        stream.close()
    system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"cannot write {path}")


def read_note(spark: SparkSession, path: str) -> str | None:
    """A note's text, or None where there is none."""
    system, place = _opened(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_sizes(spark: SparkSession, pattern: str) -> dict[str, int]:
    """Bytes of the files a pattern names, and of those in the folders it names; hidden ones aside."""
    system, place = _opened(spark, pattern)
    sizes: dict[str, int] = {}
    open_ = list(system.globStatus(place) or [])
    while open_:
        status = open_.pop()
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if status.isDirectory():
            open_ += list(system.listStatus(status.getPath()))
        else:
            sizes[status.getPath().toString()] = status.getLen()
    return sizes


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none where it does not exist."""
    system, place = _opened(spark, path)
    if not system.exists(place):
        return []
    return sorted(found.getPath().getName() for found in system.listStatus(place) if found.isDirectory())
