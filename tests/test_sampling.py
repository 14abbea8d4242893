"""Order, quotas, splits and ids, on few and many partitions, with ties and null keys."""

import math

import pytest
from pyspark.sql import functions as F

from scribeframe.operators import sampling
from scribeframe.session import CHECKPOINT_SETTING, release, stage, work_folder

KEYED = "key int, name string"


def rows(spark, values, partitions=1):
    frame = spark.createDataFrame([(k, f"n{i}") for i, k in enumerate(values)], KEYED)
    return frame.repartition(partitions)


def test_work_folder_without_a_setting(spark):
    given = spark.conf.get(CHECKPOINT_SETTING, None)
    folder = work_folder(spark)
    assert folder == (given.rstrip("/") if given else folder) == work_folder(spark)
    assert spark.conf.get(CHECKPOINT_SETTING, None) == given
    staged = stage(spark.range(5), "five")
    assert staged.count() == 5
    release(staged)
    with pytest.raises(Exception, match="(?i)not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(staged.inputFiles()[0]).count()


def test_own_work_folder_of_a_local_master(spark, monkeypatch):
    from scribeframe import session

    class Conf:
        def get(self, name, default):
            return None

    class Plain:
        conf = Conf()
        sparkContext = spark.sparkContext

    monkeypatch.setattr(session, "_own_folders", {})
    assert session.work_folder(Plain()) == session.work_folder(Plain())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 20_000])
def test_first_n_with_ties_and_nulls(spark, n):
    got = sampling.first_n(rows(spark, [1, 2, 2, 2, None]), "key", n).collect()
    assert sorted(r.key or 0 for r in got) == [0, 1, 2, 2, 2][:n]


def test_quota_with_keys_that_recur_between_groups(spark):
    data = [(k, g) for g, keys in {"a": (1, 3, 9), "b": (2, 3, 0), None: (None, 5, 1)}.items() for k in keys]
    frame = spark.createDataFrame(data, KEYED)
    got = sampling.quota_per_group(frame, "name", "key", 2).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(
        map(str, [(1, "a"), (3, "a"), (0, "b"), (2, "b"), (None, None), (1, None)])
    )


@pytest.mark.parametrize("partitions", [1, 8])
def test_quota_before_and_after(spark, partitions):
    frame = rows(spark, range(40), partitions).withColumn("g", F.lit("hot"))
    valid = F.col("key") % 2 == 0
    before = sampling.quota(frame, "g", "key", 15, valid, "before").collect()
    after = sampling.quota(frame, "g", "key", 15, valid, "after").collect()
    assert sorted(r.key for r in before) == list(range(0, 15, 2))
    assert sorted(r.key for r in after) == list(range(0, 30, 2))
    with pytest.raises(ValueError):
        sampling.quota(frame, "g", "key", 1, valid, "never")


@pytest.mark.parametrize("partitions", [1, 8])
def test_positions_slices_and_ids(spark, partitions):
    frame = rows(spark, reversed(range(30)), partitions)
    placed = sampling.with_position(frame, "key").collect()
    assert all(r.position == r.key for r in placed)
    part = sampling.positional_slice(frame, "key").collect()
    assert sorted((r.key, r.position) for r in part) == [(10 + k, k) for k in range(8)]
    ids = sampling.sample_ids(frame, "edu", "key").collect()
    assert all(r.id == f"edu_{r.key + 1:02d}" for r in ids)
    within = frame.withColumn("g", F.col("key") % 3)
    grouped = sampling.sample_ids(within, "s", "key", width=4, first=0, within="g").collect()
    assert all(r.id == f"s_{r.key // 3:04d}" for r in grouped)


def test_splits(spark):
    frame = rows(spark, range(1013))
    sides = []
    for partitions in (1, 8):
        again = frame.repartition(partitions)
        exact = {r.key: r.split for r in sampling.train_test_split(again, "key", exact=True).collect()}
        assert sum(s == "test" for s in exact.values()) == math.ceil(0.05 * 1013)
        by_hash = {r.key: r.split for r in sampling.train_test_split(again, "key").collect()}
        sides.append((exact, by_hash))
    assert sides[0] == sides[1]
    assert math.ceil((1 - sampling.TRAIN_SHARE) * 258_213) == 12_911
    order = [r.key for r in sampling.shuffled(frame, "key").collect()]
    assert sorted(order) == list(range(1013)) != order
    with pytest.raises(ValueError, match="null key"):
        sampling.train_test_split(rows(spark, [1, None, 3]), "key", exact=True)
    hashed = sampling.train_test_split(rows(spark, [None]), "key").first()
    assert hashed.split == "train"
