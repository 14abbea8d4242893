"""Session helpers: shared work folder, staged tables, shipping the package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.storage import delete_folder

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_shipped: set[str] = set()
_own_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder of
    its own, kept per application and removed at exit. The setting itself is
    never written: Spark refuses changes to it on a running session.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        folder = tempfile.mkdtemp(prefix="scribeframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folders[application] = folder
    return _own_folders[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the work folder that no other call gets."""
    return f"{work_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the work folder and read it back.

    Cuts the lineage so that partition numbers inside it are facts, lost
    executors cost nothing, and the planner knows the size on disk when it
    chooses between a broadcast and a shuffled join.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(staged: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    for folder in {name.rpartition("/")[0] for name in staged.inputFiles()}:
        delete_folder(staged.sparkSession, folder)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scribeframe-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "scribeframe.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def spread(df: DataFrame, *keys: str | Column, partitions: int | None = None) -> DataFrame:
    """Deal rows out by a unique key before a CPU-heavy step, always.

    The number of scan splits says nothing about where the rows are: one row
    group is one split's work however many splits the file has.
    ``partitions`` None leaves the count to ``spark.sql.shuffle.partitions``.
    """
    columns = [F.col(key) if isinstance(key, str) else key for key in keys]
    if partitions is None:
        return df.repartition(*columns)
    return df.repartition(partitions, *columns)
