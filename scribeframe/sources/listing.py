"""Folders of any number of files, listed and read by the tasks.

Spark's own file scans keep an entry for every file on the driver. Here the
driver names folders; the files in them are rows of a staged table, and tasks
read what these name. Files are those that Spark's scans would list: direct
children, not empty, not hidden.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby, islice
from operator import itemgetter
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.session import spread, stage
from scribeframe.storage import has_files, literally, roots, unlisted_files

# So few files are left to Spark's own scan.
FEW = 100

# A reading task gets so many files or bytes, on average; names and contents
# leave a task in batches of so many rows or bytes.
SHARE_FILES, SHARE_BYTES = 5_000, 64 << 20
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20

_ENTRY = "folder string, name string, size bigint"
_ENTRIES = {"folder": pa.string(), "name": pa.string(), "size": pa.int64()}
_FILE = "path string, content binary"
_FILES = {"path": pa.string(), "content": pa.binary()}

#: Instead of a size: the entry isn't a file.
NO_FILE = -1

#: A folder and None, or the folder of a file and its name.
Place = tuple[str, str | None]


def is_hidden(name: str) -> bool:
    """Whether Spark's file sources pass over a file of that name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _opened(path: str):
    """Arrow's file system for a path of Hadoop's, and the path on it."""
    from pyarrow import fs

    address = quote(path, safe="/:@+=,")
    return fs.FileSystem.from_uri(address if ":" in address.partition("/")[0] else f"file://{address}")


def _entries(folder: str, only: str | None) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with the sizes of files, None where the size isn't known yet, ``NO_FILE`` for others.

    A local folder is read entry by entry; other stores answer for a whole folder at once.
    """
    from pyarrow import fs

    system, place = _opened(folder)
    if only is not None:
        yield only, None
    elif isinstance(system, fs.LocalFileSystem):
        with os.scandir(place) as found:
            for one in found:
                yield one.name, None if one.is_file() else NO_FILE
    else:
        for one in system.get_file_info(fs.FileSelector(place)):
            yield one.base_name, one.size if one.is_file else NO_FILE


def _measured(rows: Sequence[tuple[str, str, int | None]]) -> Iterator[tuple[str, str, int]]:
    """Listed entries of one folder with their sizes; without those that are gone since."""
    from pyarrow import fs

    unknown = [name for _, name, size in rows if size is None]
    if unknown:
        system, place = _opened(rows[0][0])
        facts = iter(system.get_file_info([f"{place}/{name}" for name in unknown]))
    for folder, name, size in rows:
        if size is None:
            fact = next(facts)
            if fact.type == fs.FileType.NotFound:
                continue
            size = fact.size if fact.is_file else NO_FILE
        yield folder, name, size


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batch(rows: Sequence[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _named(spark: SparkSession, places: Sequence[Place], names: Callable[[Iterator], Iterator]) -> DataFrame:
    """What ``names`` makes of the folders and files in Arrow batches; one task lists a folder."""
    context = spark.sparkContext
    slices = min(len(places), 4 * context.defaultParallelism)
    given = spark.createDataFrame(context.parallelize(places, slices), "folder string, only string")
    return given.mapInArrow(names, _ENTRY)


def _listed(
    spark: SparkSession, places: Sequence[Place], named: Callable[[str], bool], keep: Callable[[str, int], bool]
) -> DataFrame:
    """``folder, name, size`` of the entries to keep: those ``named`` so, and then by their size.

    A folder's names come from one task; their sizes are asked for by all.
    """

    def names(batches):
        for folder, only in _rows(batches):
            found = ((folder, n.encode("utf-8", "replace").decode(), s) for n, s in _entries(folder, only) if named(n))
            while rows := list(islice(found, BATCH_ROWS)):
                yield _batch(rows, _ENTRIES)

    def sizes(batches):
        for batch in batches:
            listed = sorted(_rows([batch]), key=itemgetter(0))
            kept = [row for _, part in groupby(listed, itemgetter(0)) for row in _measured(list(part)) if keep(*row[1:])]
            if kept:
                yield _batch(kept, _ENTRIES)

    found = _named(spark, places, names)
    return spread(found, "folder", "name", partitions=spark.sparkContext.defaultParallelism).mapInArrow(sizes, _ENTRY)


def _places(spark: SparkSession, folders: Sequence[str]) -> list[Place] | None:
    """What folders or patterns name; None where that is nothing or a store that Arrow can't open."""
    from pyarrow import ArrowException, fs

    found = []
    for pattern in folders:
        if not (here := roots(spark, pattern)):
            return None
        try:
            system, place = _opened(here[0][0])
            if system.get_file_info(place).type == fs.FileType.NotFound:
                return None
        except (ArrowException, OSError):
            return None
        found += [(path, None) if is_folder else tuple(path.rsplit("/", 1)) for path, is_folder in here]
    return found


def _contents(listing: DataFrame, partitions: int) -> DataFrame:
    """``path, content`` of listed files, dealt out by their paths; the contents are never shuffled."""

    def read(batches):
        stores, rows, held = {}, [], 0
        for folder, name, _ in _rows(batches):
            if folder not in stores:
                stores[folder] = _opened(folder)
            system, place = stores[folder]
            with system.open_input_stream(f"{place}/{name}", compression=None) as stream:
                rows.append((f"{folder}/{name}", stream.read()))
            held += len(rows[-1][1])
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows, _FILES)
                rows, held = [], 0
        if rows:
            yield _batch(rows, _FILES)

    return spread(listing, "folder", "name", partitions=partitions).mapInArrow(read, _FILE)


def _wanted(suffix: str) -> Callable[[str], bool]:
    return lambda name: name.endswith(suffix) and not is_hidden(name)


def scan_files(spark: SparkSession, folders: Sequence[str], suffix: str) -> DataFrame:
    """``path, content``: one row for each file in the folders whose name ends in ``suffix``.

    The listing is staged. Spark's own scan takes what is in stores that Arrow
    can't open, and up to ``FEW`` files.
    """
    places = _places(spark, folders)
    if places:
        listing = stage(_listed(spark, places, _wanted(suffix), lambda name, size: size > 0), "listing")
        files, size = listing.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if files > FEW:
            shares = max(-(-files // SHARE_FILES), -(-size // SHARE_BYTES))
            return _contents(listing, max(shares, min(files, spark.sparkContext.defaultParallelism)))
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{literally(suffix)}").load(list(folders))
    return found.select("path", "content")


def unlisted_names(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` of what ``unlisted_files`` returns, listed by a task."""
    places = _places(spark, [literally(folder)])
    if places is None:
        return spark.createDataFrame([(name,) for name in unlisted_files(spark, folder)], "name string")
    found = _listed(spark, places, lambda n: not n.endswith(".crc"), lambda n, size: size == 0 or is_hidden(n))
    return found.select("name")


def folders_with(spark: SparkSession, folders: Sequence[str], suffix: str) -> list[str]:
    """Those of the folders in which a scan for a suffix would list anything; each is listed as far as the first such file."""
    if not folders:
        return []
    wanted = _wanted(suffix)

    def first(batches):
        for folder, only in _rows(batches):
            found = ((folder, n, s) for n, s in _entries(folder, only) if wanted(n))
            if one := next((row for entry in found for row in _measured([entry]) if row[2] > 0), None):
                yield _batch([one], _ENTRIES)

    places = _places(spark, [literally(folder) for folder in folders])
    if places is None:
        return [folder for folder in folders if has_files(spark, folder, suffix)]
    return sorted(row.folder for row in _named(spark, places, first).select("folder").collect())
