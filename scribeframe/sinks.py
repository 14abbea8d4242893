"""Writers for scores, metadata, reports and references."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.storage import create_empty, delete_folder, file_facts, oldest_match

SCORE_COLUMNS = ("subset", "audio_file", "reference", "hypothesis", "wer", "cer")


def write_scores_csv(scored: DataFrame, path: str | None) -> None:
    """Scored rows as CSV with a header; nothing without a path.

    Quotes inside texts are doubled and line breaks stay inside their field.
    """
    if path is None:
        return
    scored.select(*SCORE_COLUMNS).write.option("header", True).option("escape", '"').csv(path)


def write_metadata_json(metadata: DataFrame, path: str) -> None:
    """One JSON object per line, accents as they are."""
    metadata.write.json(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """A one-row report as one indented JSON object."""
    pretty = F.to_json(F.struct(*report.columns), {"pretty": "true", "ignoreNullFields": "false"})
    report.select(pretty.alias("value")).coalesce(1).write.text(path)


def write_references(references: DataFrame, path: str) -> None:
    """References as a table ``id, text``, the form to use at scale."""
    references.select("id", "text").write.parquet(path)


def safe_name(identifier) -> str:
    """An id as a file name: no separators, and nothing that a scan takes for a hidden file.

    Such characters become ``%XX``, and so does ``%`` itself, so different ids keep different names.
    """
    return re.sub(r"[%/\\\x00-\x1f]|\A[._]", lambda found: f"%{ord(found[0]):02X}", str(identifier))


def id_of_stem(stem: Column) -> Column:
    """The id that ``safe_name`` was given, from the stem of the file."""
    return F.try_url_decode(F.regexp_replace(stem, r"\+", "%2B"))


def _export(rows: DataFrame, folder: str, suffix: str) -> None:
    """One file per row of ``place, content`` (null: an empty file), written by the tasks.

    A task that runs again writes the same files again. A null place is an error.
    """
    from pyarrow import fs

    def write(part) -> None:
        target, root = fs.FileSystem.from_uri(folder)
        made = set()
        for place, content in part:
            path = "/".join([root, *map(safe_name, place)]) + suffix
            parent = path.rpartition("/")[0]
            if parent not in made:
                target.create_dir(parent, recursive=True)
                made.add(parent)
            with target.open_output_stream(path) as out:
                out.write(bytes(content or b""))

    rows.foreachPartition(write)


def _place(folders: Sequence[str | Column]) -> Column:
    """Names of the folders and of the file, all of them there."""
    names = [*folders, "id"]
    columns = [F.col(name) if isinstance(name, str) else name for name in names]
    given = [F.when(c.isNull(), F.raise_error(F.lit("a row to export has no name"))).otherwise(c.cast("string")) for c in columns]
    return F.array(*given)


def export_reference_files(
    references: DataFrame, folder: str, suffix: str = ".txt", folders: Sequence[str | Column] = ()
) -> None:
    """One file per row of ``id, text`` in UTF-8, written through Arrow's file systems.

    ``folder`` is a URI; ``folders`` are columns that name folders below it.
    Null texts give empty files, which scans don't list.
    """
    _export(references.select(_place(folders), F.encode("text", "UTF-8")), folder, suffix)


def export_binary_files(contents: DataFrame, folder: str, suffix: str) -> None:
    """One file per row of ``id, content``; null gives an empty file."""
    _export(contents.select(_place(()), "content"), folder, suffix)


#: Name of the empty file that makes a finished build visible.
PUBLISHED = "_PUBLISHED"


def materialize_once(
    spark: SparkSession,
    folder: str,
    inputs: dict,
    build: Callable[[], DataFrame],
    data: Sequence[str] = (),
) -> DataFrame:
    """Compute a table once per description of its inputs, afterwards read it.

    The path holds a digest of ``inputs`` and of the files below the ``data``
    paths (name, size, time of change), so a changed configuration or changed
    input is a new table.

    Every build writes to a folder of its own and is seen only once its mark
    exists, an empty file whose creation is atomic on any store. Callers that
    build at the same time never touch one another's files: whoever finds a
    mark when done drops the own unseen build and reads the published one; if
    two publish in the same moment, the oldest mark counts for all. A build
    that broke off has no mark and is never read.
    """
    described = {"inputs": inputs, "data": [file_facts(spark, path) for path in data]}
    digest = hashlib.sha256(json.dumps(described, sort_keys=True).encode()).hexdigest()[:16]
    marks = f"{folder.rstrip('/')}/{digest}/*/{PUBLISHED}"
    if oldest_match(spark, marks) is None:
        own = f"{folder.rstrip('/')}/{digest}/{uuid.uuid4().hex}"
        build().write.parquet(own)
        if oldest_match(spark, marks) is None:
            create_empty(spark, f"{own}/{PUBLISHED}")
        else:
            delete_folder(spark, own)
    return spark.read.parquet(oldest_match(spark, marks).removesuffix(f"/{PUBLISHED}"))
