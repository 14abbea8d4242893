"""Vectors of integers, dealt in blocks of candidates against blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.session import stage

SCALE = 256
#: Larger components count as this large, so that sums over 2048 components fit 64 bits.
LARGEST = 1 << 26
#: Candidates, and queries, of one task.
BLOCK = 8192
#: Below every score.
LEAST = -(1 << 63)


def integers(embedding: Column) -> Column:
    """``floor(256 * x)`` of every component; null if the vector or a component is null or not finite."""
    def whole(x: Column) -> Column:
        wide = x.cast("double")
        return F.least(F.greatest(F.floor(wide * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")

    def lost(x: Column) -> Column:
        wide = x.cast("double")
        return x.isNull() | F.isnan(wide) | (F.abs(wide) == float("inf"))

    return F.when(~F.exists(embedding, lost), F.transform(embedding, whole))


def integer_rows(vectors: DataFrame, *columns: str) -> DataFrame:
    """``vec_id``, ``x`` (of equal lengths), the columns and a number ``node`` for every distinct usable row.

    Rows whose ``vec_id`` or vector is null, or whose vector holds null or
    non-finite components, take no part; shorter vectors are padded with zeros;
    equal rows are one. Staged, so the numbers stay.
    """
    usable = vectors.select("vec_id", integers(F.col("embedding")).alias("x"), *columns)
    usable = stage(usable.where("vec_id is not null and x is not null").distinct(), "integer-vectors")
    width = usable.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("x")))
    rows = usable.withColumn("x", padded).withColumn("node", F.monotonically_increasing_id())
    return stage(rows, "numbered-vectors")


def foremost(rows: DataFrame, kind: list[str], most: int) -> DataFrame:
    """The rows with the ``most`` smallest ids of each kind.

    Rows of one kind score alike against any query and ties go to the smaller
    id, so no other row of the kind can be among the first ``most``. The rank
    is limited in every task before rows of a kind meet.
    """
    place = F.row_number().over(Window.partitionBy(*kind).orderBy("vec_id", "node"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def blocks_of(count: int, block: int) -> int:
    return max(1, -(-count // block))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")


def matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of a table as rows; doubles where every inner product stays exact in them."""
    flat = table["x"].combine_chunks()
    flat = flat.flatten().to_numpy() if len(flat) else np.empty(0, np.int32)
    return flat.reshape(len(table), width)


def exact_kind(*parts: np.ndarray) -> type:
    """Doubles where every inner product of two rows stays exact in them, else 64-bit integers."""
    most = 1
    for part in parts:
        most *= max(1, int(np.abs(part).max(initial=0)))
    width = parts[0].shape[1] if parts else 1
    return np.float64 if most * max(1, width) < 1 << 52 else np.int64


def first_by_score(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
