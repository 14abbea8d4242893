"""Corpus tables: one split as a frame, fall-backs between sources, reference preparation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.operators.curate import select_corpus
from scribeframe.operators.sampling import first_n, sample_ids
from scribeframe.session import stage

Reader = Callable[[SparkSession], DataFrame]


def read_corpus(
    spark: SparkSession, path: str, audio: str = "audio", text: str = "transcript"
) -> DataFrame:
    """A stored split with exactly the columns ``audio`` and ``text``."""
    return select_corpus(spark.read.parquet(path), audio, text)


@dataclass(frozen=True)
class Source:
    """A named reader; ``takes_over`` says for which errors it may replace the one before."""

    name: str
    read: Reader
    takes_over: Callable[[Exception], bool] = lambda error: True


def disk_is_full(error: Exception) -> bool:
    message = str(error).lower()
    return "no space" in message or "disk" in message


def read_first_available(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The first source that can be read, with its name in ``actual_source``.

    Reading means resolving the schema; rows are not touched. When a source may
    not take over from the error before it, that error is raised.
    """
    failure: Exception | None = None
    for source in sources:
        if failure is not None and not source.takes_over(failure):
            raise failure
        try:
            found = source.read(spark)
            found.schema  # noqa: B018 - resolves the plan, so a missing table fails here
        except Exception as error:  # noqa: BLE001 - any failure hands over to the next source
            failure = error
            continue
        return found.withColumn("actual_source", F.lit(source.name))
    raise failure if failure is not None else ValueError("no sources given")


def read_first_whole(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The first source whose rows can all be read, with its name in ``actual_source``.

    Each source in turn is written to a place of its own in the work folder. One that fails
    halfway, in its schema or in any row, leaves nothing behind that is read, so
    the result never mixes two sources. When a source may not take over from
    the error before it, that error is raised; without sources a ``ValueError``.
    """
    failure: Exception | None = None
    for source in sources:
        if failure is not None and not source.takes_over(failure):
            raise failure
        try:
            found = stage(source.read(spark), "source")
        except Exception as error:  # noqa: BLE001 - any failure hands over to the next source
            failure = error
            continue
        return found.withColumn("actual_source", F.lit(source.name))
    raise failure if failure is not None else ValueError("no sources given")


def first_valid(
    df: DataFrame, key: str, n: int, valid: Column, look_at: int | None = None
) -> DataFrame:
    """The first ``n`` valid rows in key order; ``look_at`` limits how many rows are tried."""
    tried = df if look_at is None else first_n(df, key, look_at)
    return first_n(tried.filter(valid), key, n)


def references_from_corpus(
    df: DataFrame,
    key: str,
    predicate: Column | None = None,
    audio: str = "audio",
    text: str = "transcript",
) -> DataFrame:
    """``id, audio, reference`` with ids ``sample_0000`` onwards, counted after the filter.

    The text is kept as it is.
    """
    chosen = df if predicate is None else df.filter(predicate)
    ids = sample_ids(chosen.select(key), "sample", key, width=4, first=0)
    return chosen.join(ids, key).select(
        "id", F.col(audio).alias("audio"), F.col(text).alias("reference")
    )
