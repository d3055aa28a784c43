"""Numbered snapshot files: what a table consists of, published in one step.

Data is written to new folders first. Then a small file that names the folders is written aside
and renamed to the next number. A reader takes the highest number there is and opens only what
it names, so it sees the table before a write or after it, and a write that is lost on the way
leaves nothing but folders that no snapshot names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Names in a folder that match a glob pattern, sorted; a failure to look raises."""
    files, place = files_of(spark, f"{path.rstrip('/')}/{pattern}")
    return sorted(s.getPath().getName() for s in files.globStatus(place) or [])


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder with all in it; a folder that stays raises."""
    files, place = files_of(spark, path)
    if not files.delete(place, True) and files.exists(place):
        raise OSError(f"{path} could not be deleted")


def _number(name: str) -> int:
    return int(name.removesuffix(".json"))


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number and content of the latest snapshot; 0 and nothing before the first."""
    names = names_in(spark, path, "[0-9]*.json")
    if not names:
        return 0, {}
    return _number(names[-1]), read(spark, path, _number(names[-1]))


def read(spark: SparkSession, path: str, number: int) -> dict:
    files, place = files_of(spark, f"{path}/{number:020d}.json")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Make ``content`` the snapshot of that number; one that exists already raises.

    The rename is the commit. A table has one writer at a time; where a second one has published the
    same number first, this write fails and has to be made again.
    """
    files, aside = files_of(spark, f"{path}/_{uuid.uuid4().hex}")
    _, place = files_of(spark, f"{path}/{number:020d}.json")
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if files.exists(place) or not files.rename(aside, place):
        files.delete(aside, False)
        raise FileExistsError(f"snapshot {number} of {path} has been published by another writer")


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[dict]:
    """Delete all snapshots but the last ``keep``, and return the contents of these.

    Readers that resolved one of them before a later one came still find what it names.
    """
    numbers = [_number(n) for n in names_in(spark, path, "[0-9]*.json")]
    for number in numbers[:-keep]:
        remove_folder(spark, f"{path}/{number:020d}.json")
    return [read(spark, path, n) for n in numbers[-keep:]]
