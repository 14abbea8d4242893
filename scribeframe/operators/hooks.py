"""Caller-supplied models inside ``mapInPandas``.

A hook is a factory: it is called once per task and returns the function that
handles the batches of that task. A row that fails carries its error; it does
not fail the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from scribeframe.session import stage

Transcriber = Callable[[object], str]
Encoder = Callable[[object, str], tuple[list | None, list[int]]]

_MODEL_ROW = [
    StructField("input_features", ArrayType(ArrayType(FloatType()))),
    StructField("labels", ArrayType(IntegerType())),
    StructField("error", StringType()),
]


def transcribe(
    df: DataFrame,
    factory: Callable[[], Transcriber],
    key: str = "sample_id",
    audio: str = "content",
    batch_size: int = 1,
) -> DataFrame:
    """``key, hypothesis, error``: the stripped output of the model for each row.

    ``factory`` builds the model once per task. With a ``batch_size`` above 1 the
    model takes a list of that many contents at most and returns as many texts;
    a batch that fails is tried again row by row, so the error stays with its row.
    """
    narrow = df.select(key, audio)
    schema = StructType(
        [narrow.schema[key], StructField("hypothesis", StringType()), StructField("error", StringType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if model is None:
                model = factory()
            contents = list(batch[audio])
            heard = []
            for at in range(0, len(contents), batch_size):
                heard += _heard(model, contents[at : at + batch_size], batch_size > 1)
            rows = [(name, *result) for name, result in zip(batch[key], heard, strict=True)]
            yield pd.DataFrame(rows, columns=schema.names)

    return narrow.mapInPandas(run, schema)


def _heard(model, contents: list, many: bool) -> list[tuple[str | None, str | None]]:
    """Text and error of each content; any model failure belongs to its row."""
    try:
        texts = list(model(contents)) if many else [model(contents[0])]
        if len(texts) != len(contents):
            raise ValueError(f"{len(texts)} texts for {len(contents)} rows")
        return [(text.strip(), None) for text in texts]
    except Exception as error:  # noqa: BLE001
        if len(contents) == 1:
            return [(None, str(error))]
    return [pair for content in contents for pair in _heard(model, [content], many)]


def pseudo_references(df: DataFrame, factory: Callable[[], Transcriber], **names: str) -> DataFrame:
    """Model output to be used as references, marked as not being ground truth."""
    return (
        transcribe(df, factory, **names)
        .filter("error is null")
        .drop("error")
        .withColumnRenamed("hypothesis", "reference")
        .withColumn("is_pseudo", F.lit(True))
    )


def encode_rows(
    df: DataFrame,
    factory: Callable[[], Encoder],
    key: str = "sample_id",
    audio: str = "audio",
    text: str = "text",
    samples: str = "array",
) -> DataFrame:
    """``key, input_length, input_features, labels, error``; the input columns are dropped.

    ``audio`` is a struct with the samples in the field ``samples``; the length
    is taken from it without leaving the JVM.
    """
    source = df.select(
        key, F.size(F.col(audio)[samples]).cast("bigint").alias("input_length"),
        F.col(audio)[samples].alias("_samples"), F.col(text).alias("_text"),
    )
    schema = StructType(
        [source.schema[key], StructField("input_length", LongType()), *_MODEL_ROW]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = factory()
            rows = []
            for name, length, array, words in zip(
                batch[key], batch["input_length"], batch["_samples"], batch["_text"]
            ):
                try:
                    rows.append((name, length, *encoder(array, words), None))
                except Exception as error:  # noqa: BLE001 - any model failure belongs to its row
                    rows.append((name, length, None, None, str(error)))
            yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(run, schema)


def evaluate_model(
    df: DataFrame,
    factory: Callable[[], Transcriber],
    key: str = "sample_id",
    audio: str = "content",
    reference: str = "reference",
    profile: str = "basic",
    n: int | None = None,
    batch_size: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Transcribe, then score against the reference; at most the first ``n`` rows if given.

    Returns the scored rows and, as ``key, reason``, those the model failed on.
    The model runs once: its output is staged in the work folder.
    """
    from scribeframe.operators.sampling import first_n
    from scribeframe.operators.scoring import score_pairs

    chosen = df if n is None else first_n(df, key, n)
    heard = stage(transcribe(chosen, factory, key=key, audio=audio, batch_size=batch_size), "heard")
    pairs = chosen.select(key, F.col(reference).alias("reference"))
    pairs = pairs.join(heard.filter("error is null").drop("error"), key)
    rejects = heard.filter("error is not null").select(key, F.col("error").alias("reason"))
    return score_pairs(pairs, profile=profile), rejects
