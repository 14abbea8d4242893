"""Order, positions, quotas, seeded shuffles and splits.

A table has no order of its own, so every positional operator takes a key that
is unique together with its group. None of them sorts a table in one task:
positions come from a range-partitioned sort and per-partition counts, exact
splits from a histogram that narrows down to one threshold key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.session import release, stage

SEED = 42
TRAIN_SHARE = 0.95

# Digits of the shuffle hash looked at per histogram: at most 16**4 counts
# reach the driver, whatever the table holds.
_DIGITS = 4
_FEW_ROWS = 10_000


def with_position(
    df: DataFrame, key: str | Sequence[str], within: str | Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Number the rows from 0 in key order, over the table or within groups.

    One range shuffle spreads even a single hot group over many tasks; the rows
    are staged with their place in their partition, and an offset per group and
    partition is added. Pass only the columns needed afterwards.
    """
    keys = [key] if isinstance(key, str) else list(key)
    groups = [within] if isinstance(within, str) else list(within)
    row = F.monotonically_increasing_id()
    placed = stage(
        df.repartitionByRange(*groups, *keys)
        .sortWithinPartitions(*groups, *keys)
        .withColumn("_part", F.shiftright(row, 33))
        .withColumn("_row", row),
        "positions",
    )
    counts = placed.groupBy(*groups, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    # One row per group and partition it touches; without groups one per partition.
    before = (
        Window.partitionBy(*groups)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = counts.select(*groups, "_part", shift.alias("_shift")).alias("offsets")
    rows = placed.alias("rows")
    same = F.col("rows._part") == F.col("offsets._part")
    for group in groups:
        same &= F.col(f"rows.{group}").eqNullSafe(F.col(f"offsets.{group}"))
    position = (F.col("_row") + F.col("_shift")).alias(name)
    return rows.join(offsets, same).select(*[F.col(f"rows.{c}") for c in df.columns], position)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in key order, exactly ``n`` if there are as many.

    A top-k: every task keeps ``n`` rows and one merges them. Null keys come
    first; which of several rows with the last key stay is not defined. To cut
    a table at a position too large for one task, filter ``with_position``.
    """
    return df.orderBy(key).limit(n)


def positional_slice(df: DataFrame, key: str, n: int = 8, part: int = 3) -> DataFrame:
    """Rows ``[N // part, N // part + n)`` in key order, with their position in the slice.

    Only keys are sorted. The limits of the slice become literals, so the scan of
    the whole rows prunes by them and nothing wide is shuffled.
    """
    ranked = with_position(df.select(key), key)
    start = ranked.count() // part
    chosen = stage(
        ranked.filter(F.col("position").between(start, start + n - 1)).select(
            key, (F.col("position") - start).alias("position")
        ),
        "slice",
    )
    ends = chosen.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    within = df.filter(F.col(key).between(F.lit(ends["low"]), F.lit(ends["high"])))
    return within.join(chosen, key)


def quota_per_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows per group, the first ones in key order.

    ``key`` is unique together with its group; nulls count as values of both.
    Only group and key are ranked. A first rank per slice of a group keeps ``n``
    rows each before the slices meet, so a hot group sends a bounded number of
    rows to its final task.
    """
    sliced = df.select(group, key).withColumn("_salt", F.pmod(F.xxhash64(group, key), F.lit(64)))
    chosen = _top(_top(sliced, [group, "_salt"], key, n), [group], key, n)
    chosen = chosen.select(F.col(group).alias("_group"), F.col(key).alias("_key"))
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col(key).eqNullSafe(F.col("_key"))
    return df.join(chosen, same, "left_semi")


def _top(df: DataFrame, groups: list[str], key: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(key))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def quota(
    df: DataFrame, group: str, key: str, n: int, valid: Column, when: str = "before"
) -> DataFrame:
    """Quota per group and validity filter, in the order asked for.

    ``before`` limits first, so a rejected row is not replaced; ``after`` fills
    the quota with valid rows.
    """
    if when not in ("before", "after"):
        raise ValueError("when is 'before' or 'after'")
    if when == "before":
        return quota_per_group(df, group, key, n).filter(valid)
    return quota_per_group(df.filter(valid), group, key, n)


def shuffle_hash(key: str, seed: int = SEED) -> Column:
    """Place of a row in the seeded shuffle: the same on every run and partitioning."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """The whole table in seeded random order (a range-partitioned sort)."""
    return df.orderBy(shuffle_hash(key, seed), key)


def hash_split(key: str, train_share: float = TRAIN_SHARE, seed: int = SEED) -> Column:
    """``test`` when the hash of the key falls below the test share, else ``train``.

    A null key has no hash and goes to ``train``.

    No shuffle and no counting. Each row keeps its side when others come and go;
    the size of the test set is only right on average.
    """
    bound = int((1 - train_share) * 2**32)
    place = F.conv(F.substring(shuffle_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return F.when(place < bound, "test").otherwise("train")


def exact_split(
    df: DataFrame, key: str, train_share: float = TRAIN_SHARE, seed: int = SEED
) -> Column:
    """Side of each row of ``df`` with exactly ``ceil((1 - train_share) * rows)`` test rows.

    The rows are not shuffled: histograms of the hash find the last test row, and
    the column returned compares with it. A null key has no place in the order
    and raises a ``ValueError``.
    """
    hashed = df.select(shuffle_hash(key, seed).alias("_hash"), F.col(key).alias("_key"))
    hashed = stage(hashed, "hashed-keys")
    last = _last_of_first(hashed, train_share)
    release(hashed)
    if last is None:
        return F.lit("train")
    place = shuffle_hash(key, seed)
    is_test = (place < last["_hash"]) | (
        (place == last["_hash"]) & (F.col(key) <= F.lit(last["_key"]))
    )
    return F.when(is_test, "test").otherwise("train")


def train_test_split(
    df: DataFrame,
    key: str,
    train_share: float = TRAIN_SHARE,
    seed: int = SEED,
    exact: bool = False,
) -> DataFrame:
    """Add ``split``, by hash or with an exact number of test rows."""
    side = exact_split(df, key, train_share, seed) if exact else hash_split(key, train_share, seed)
    return df.withColumn("split", side)


def _last_of_first(hashed: DataFrame, train_share: float):
    """The row at the end of the test share in hash order, by narrowing hash prefixes."""
    prefix, wanted = "", None
    while True:
        within = hashed.filter(F.col("_hash").startswith(prefix)) if prefix else hashed
        size = len(prefix) + _DIGITS
        histogram = dict(
            within.groupBy(F.substring("_hash", 1, size).alias("p")).count().collect()
        )
        if None in histogram:
            raise ValueError("rows with a null key can't be split exactly; reject them first")
        if wanted is None:
            wanted = math.ceil((1 - train_share) * sum(histogram.values()))
            if wanted == 0:
                return None
        for candidate in sorted(histogram):
            if wanted <= histogram[candidate]:
                prefix = candidate
                break
            wanted -= histogram[candidate]
        if histogram[prefix] <= _FEW_ROWS or size >= 32:
            inside = hashed.filter(F.col("_hash").startswith(prefix))
            return inside.orderBy("_hash", "_key").offset(wanted - 1).limit(1).first()


def sample_ids(
    df: DataFrame,
    prefix: str,
    key: str,
    width: int = 2,
    first: int = 1,
    within: str | Sequence[str] = (),
    name: str = "id",
) -> DataFrame:
    """Readable ids from the position in key order, such as ``edu_07``.

    Ids have gaps when rows are dropped afterwards and are dense when they are
    dropped before.
    """
    placed = with_position(df, key, within)
    number = F.col("position") + first
    return placed.withColumn(name, F.format_string(f"{prefix}_%0{width}d", number)).drop("position")
