"""Places of rows in split files: numbers, neighbours and order across splits.

A split file is read by many tasks, and only the order inside one split is
known to the task that reads it. Rows are numbered inside their split; one row
per split then says how many rows and which last row come before it. No file
is gathered anywhere: a window holds one split, whose size the reader bounds
(``spark.sql.files.maxPartitionBytes``), and the chain over splits holds one
small row for each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that ``with_places`` adds: the file, the start of the split in it and the row's rank in its task.
PATH, SPLIT, RANK = "file_path", "split_start", "rank_in_task"


def with_places(rows: DataFrame) -> DataFrame:
    """Add the place of each row to a frame straight from a file scan.

    The ranks grow along each split but have gaps, and they depend on how the
    scan was planned. Write the rows (``session.stage``) before using the ranks
    more than once.
    """
    return rows.withColumns(
        {
            PATH: F.col("_metadata.file_path"),
            SPLIT: F.col("_metadata.file_block_start"),
            RANK: F.monotonically_increasing_id(),
        }
    )


def numbered(
    rows: DataFrame,
    groups: Sequence[str] = (PATH,),
    splits: Sequence[str] = (SPLIT,),
    rank: str = RANK,
    number: str = "number",
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Number rows 1, 2, 3... along each group's splits, and look at the row before.

    ``groups`` name one file each (none: the whole table is one sequence, whose
    files follow one another if ``splits`` begins with the path). ``previous``
    adds columns that hold an expression's value in the row before, also across
    splits; null in the first row. Rows must come from a written table, and
    equal ranks inside a split are not allowed. An empty frame stays empty;
    groups and splits are never null.
    """
    previous = dict(previous or {})
    keys = [*groups, *splits]
    inside = Window.partitionBy(*keys).orderBy(rank)
    local = {"_place": F.row_number().over(inside)}
    local |= {f"_before_{name}": F.lag(value).over(inside) for name, value in previous.items()}
    last = F.max_by(F.struct(F.lit(True).alias("_any"), *[v.alias(n) for n, v in previous.items()]), F.col(rank))
    parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), last.alias("_last"))
    chain = Window.partitionBy(*groups).orderBy(*splits)
    starts = parts.select(
        *keys,
        F.coalesce(F.sum("_rows").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.lag("_last").over(chain).alias("_last"),
    )
    first = F.col("_place") == 1
    return rows.withColumns(local).join(starts, keys).select(
        *[F.col(c) for c in rows.columns],
        (F.col("_start") + F.col("_place")).alias(number),
        *[F.when(first, F.col("_last")[n]).otherwise(F.col(f"_before_{n}")).alias(n) for n in previous],
    )


def order_breaks(written: DataFrame, *keys: str) -> DataFrame:
    """Rows of a written report that come after a greater row: ``number``, ``keys`` and the row before.

    ``written`` comes from ``with_places`` and a staged table. Files follow one
    another by name, as Spark names them when it writes a sorted frame. Nulls
    come first, as in ``orderBy``. No rows: the report is in order from its
    first file to its last.
    """
    own = F.struct(*[F.col(k) for k in keys])
    found = numbered(written, groups=(), splits=(PATH, SPLIT), previous={"row_before": own})
    return found.filter(own < F.col("row_before")).select("number", *keys, "row_before")
