"""Training job: a corpus split into model-ready, batched and padded tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.operators.batches import drop_start_token, length_groups, pad_labels
from scribeframe.operators.curate import drop_empty_text
from scribeframe.operators.hooks import encode_rows
from scribeframe.operators.sampling import SEED, TRAIN_SHARE, exact_split, hash_split
from scribeframe.sinks import materialize_once


@dataclass(frozen=True)
class TrainingTables:
    train: DataFrame
    test: DataFrame
    rejects: DataFrame


def prepare_training(
    spark: SparkSession,
    corpus: DataFrame,
    key: str,
    factory,
    folder: str,
    inputs: dict,
    exact: bool = False,
    train_share: float = TRAIN_SHARE,
    seed: int = SEED,
    data: Sequence[str] = (),
) -> TrainingTables:
    """Drop empty texts, split, encode once, and read the encoded sides back.

    ``inputs`` describes the corpus and the encoder and ``data`` names the files
    it was read from; another description or changed files are another table.
    Rows that the encoder failed on are rejects, ``key, split, reason``.
    """
    described = {**inputs, "exact": exact, "train_share": train_share, "seed": seed}

    def build() -> DataFrame:
        spoken = drop_empty_text(corpus)
        side = (
            exact_split(spoken.select(key), key, train_share, seed)
            if exact
            else hash_split(key, train_share, seed)
        )
        return encode_rows(spoken, factory, key=key).withColumn("split", side)

    tables = materialize_once(spark, folder, described, build, data)
    encoded = tables.filter("error is null").drop("error")
    return TrainingTables(
        train=encoded.filter("split = 'train'").drop("split"),
        test=encoded.filter("split = 'test'").drop("split"),
        rejects=tables.filter("error is not null").select(key, "split", F.col("error").alias("reason")),
    )


def training_batches(
    encoded: DataFrame, key: str, batch_size: int, start_token: int, rows: int | None = None
) -> DataFrame:
    """Batches of similar length with padded labels and without a common start token."""
    grouped = length_groups(encoded, key, batch_size=batch_size, rows=rows)
    return drop_start_token(pad_labels(grouped), start_token)
