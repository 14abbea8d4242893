"""Questions to the file system that Spark's readers don't answer.

The only module that reaches into the JVM, through Hadoop's file systems; they
open whatever store the session can read. It needs a classic session.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target, system = _open(spark, path)
    return system.exists(target)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path with wildcards names anything."""
    target, system = _open(spark, pattern)
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def oldest_match(spark: SparkSession, pattern: str) -> str | None:
    """The path that matches a pattern and changed first, ties by name; None without any."""
    target, system = _open(spark, pattern)
    found = system.globStatus(target) or []
    return min(((one.getModificationTime(), one.getPath().toString()) for one in found), default=(0, None))[1]


def matching_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match a pattern, in order of their names."""
    target, system = _open(spark, pattern)
    return sorted(one.getPath().toString() for one in system.globStatus(target) or [] if one.isDirectory())


def roots(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """What a path, with wildcards or without, names, and whether it is a folder."""
    target, system = _open(spark, pattern)
    return [(one.getPath().toString(), one.isDirectory()) for one in system.globStatus(target) or []]


def has_files(spark: SparkSession, folder: str, suffix: str) -> bool:
    """Whether a scan of a folder for a suffix would list anything.

    The names are compared where they are listed; a folder of other files costs one call.
    """
    target, system = _open(spark, f"{literally(folder)}/[^._]*{literally(suffix)}")
    return any(one.isFile() and one.getLen() > 0 for one in system.globStatus(target) or [])


def literally(path: str) -> str:
    """A path whose wildcard characters stand for themselves."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def create_empty(spark: SparkSession, path: str) -> None:
    """Create an empty file; an error where there is one already."""
    target, system = _open(spark, path)
    system.create(target, False).close()


def file_facts(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of change of every file at or below a path, in order of the names."""
    target, system = _open(spark, path)
    found, facts = system.listFiles(target, True), []
    while found.hasNext():
        one = found.next()
        facts.append([one.getPath().toString(), one.getLen(), one.getModificationTime()])
    return sorted(facts)


def unlisted_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that Spark's file sources pass over: hidden and empty files."""
    target, system = _open(spark, folder)
    found = _listed_by_arrow(system.makeQualified(target).toUri().toString())
    if found is None:
        found = [(e.getPath().getName(), e.isFile() and e.getLen() == 0) for e in system.listStatus(target)]
    return sorted(n for n, empty in found if (empty or n.startswith((".", "_"))) and not n.endswith(".crc"))


def _listed_by_arrow(folder: str) -> list[tuple[str, bool]] | None:
    """Names in a folder and whether they are empty files, listed without a call to the JVM per file.

    None where Arrow can't open the store.
    """
    from pyarrow import ArrowException, fs

    try:
        system, place = fs.FileSystem.from_uri(folder)
        found = system.get_file_info(fs.FileSelector(place))
    except (ArrowException, OSError):
        return None
    return [(one.base_name, one.is_file and one.size == 0) for one in found]


def delete_folder(spark: SparkSession, path: str) -> None:
    target, system = _open(spark, path)
    system.delete(target, True)
