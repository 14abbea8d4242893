"""Length-grouped batches and label padding for training tables.

Rows are hashed into chunks of about fifty batches, evenly because ids are
unique. All steps after that ask for the same chunk distribution, so the table
is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH_SIZE = 24
BATCHES_PER_CHUNK = 50
IGNORED_LABEL = -100
_SEED = 42

_BATCH = ("chunk", "batch")


def length_groups(
    df: DataFrame,
    key: str,
    length: str = "input_length",
    batch_size: int = BATCH_SIZE,
    rows: int | None = None,
) -> DataFrame:
    """Add ``chunk`` and ``batch``: rows of similar length share a batch.

    ``rows`` saves the count when the number of rows is known.
    """
    rows = df.count() if rows is None else rows
    chunks = max(1, rows // (batch_size * BATCHES_PER_CHUNK))
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{_SEED}")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    order = Window.partitionBy("chunk").orderBy(F.desc(length), F.asc(key))
    place = F.row_number().over(order) - 1
    return df.withColumn("chunk", F.pmod(number, F.lit(chunks))).withColumn(
        "batch", F.floor(place / batch_size)
    )


def _over_batch() -> Window:
    return Window.partitionBy(*_BATCH)


def pad_labels(df: DataFrame, labels: str = "labels", filler: int = IGNORED_LABEL) -> DataFrame:
    """Bring all labels of a batch to the same length with ``filler``; null labels stay null."""
    longest = F.max(F.array_size(labels)).over(_over_batch())
    return df.withColumn("_longest", longest).withColumn(
        labels,
        F.concat(labels, F.array_repeat(F.lit(filler), F.col("_longest") - F.size(labels))),
    ).drop("_longest")


def drop_start_token(df: DataFrame, token: int, labels: str = "labels") -> DataFrame:
    """Remove the first label of a batch when every row of the batch starts with ``token``.

    Rows without labels have no say; a batch of them alone stays as it is.
    """
    first = F.coalesce(F.get(F.col(labels), F.lit(0)) == token, F.lit(False))
    starts = F.when(F.col(labels).isNotNull(), first)
    everywhere = F.every(starts).over(_over_batch())
    rest = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    return df.withColumn("_all", everywhere).withColumn(
        labels, F.when(F.col("_all"), rest).otherwise(F.col(labels))
    ).drop("_all")


def unmask_labels(labels: Column, pad_id: int, filler: int = IGNORED_LABEL) -> Column:
    """Put the padding id back in place of the ignored label."""
    return F.transform(labels, lambda x: F.when(x == filler, pad_id).otherwise(x))


def padding_waste(df: DataFrame, length: str = "input_length") -> DataFrame:
    """Rows, real and padded units over all batches, and the share that is padding."""
    per_batch = df.groupBy(*_BATCH).agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("real"), F.max(length).alias("longest")
    )
    totals = per_batch.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("n").alias("rows"),
        F.sum("real").alias("real_units"),
        F.sum(F.col("n") * F.col("longest")).alias("padded_units"),
    )
    waste = 1 - F.try_divide(F.col("real_units"), F.col("padded_units"))
    return totals.withColumn("waste", waste)
