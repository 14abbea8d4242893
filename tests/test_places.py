"""Places of rows across splits, tables saved once, exported files, sources that fail halfway."""

import pytest
from pyspark.sql import functions as F

from scribeframe import sinks
from scribeframe.operators.places import PATH, RANK, SPLIT, numbered, order_breaks, with_places
from scribeframe.session import stage
from scribeframe.sources import corpus, files
from scribeframe.storage import unlisted_files


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_cues_keep_their_order_over_many_splits(spark, tmp_path, small_splits):
    times = [(k * 1.0, k + 0.5 + (k % 4) * 0.25) for k in range(300)]
    lines = [f"talk 1 spk {a} {b} mot{k}" + ("\n;; remark\nshort line" if k % 3 == 0 else "") for k, (a, b) in enumerate(times)]
    (tmp_path / "long.stm").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "odd.stm").write_text("x 1 s 1 2 un\nx 1 s ? 3 deux\nx 1 s 4 5 trois\n", encoding="utf-8")
    (tmp_path / "none.stm").write_text(";; nothing said\n", encoding="utf-8")
    assert spark.read.text(f"{tmp_path}/long.stm").rdd.getNumPartitions() > 8
    rows = files.scan_stm_cues(spark, str(tmp_path)).orderBy("stem", "cue").collect()
    long = [r for r in rows if r.stem == "long"]
    assert [(r.cue, r.text) for r in long] == [(k + 1, f"mot{k}") for k in range(300)]
    assert [r.gap for r in long] == [None] + [times[k][0] - times[k - 1][1] for k in range(1, 300)]
    assert [(r.cue, r.gap) for r in rows if r.stem == "odd"] == [(1, None), (2, None), (3, 1.0)]
    assert {r.stem for r in rows} == {"long", "odd"}


def test_numbers_with_empty_splits_null_values_and_no_rows(spark):
    made = [("f", 0, 5, None), ("f", 0, 9, "b"), ("f", 40, 2, None), ("g", 0, 7, "d")]
    rows = spark.createDataFrame(made, f"{PATH} string, {SPLIT} long, {RANK} long, word string")
    got = numbered(rows, previous={"before": F.col("word")}).orderBy(PATH, "number").collect()
    assert [(r.number, r.word, r.before) for r in got] == [(1, None, None), (2, "b", None), (3, None, "b"), (1, "d", None)]
    whole = numbered(rows, groups=(), splits=(PATH, SPLIT)).orderBy("number").collect()
    assert [r.word for r in whole] == [None, "b", None, "d"]
    assert numbered(rows.limit(0)).count() == 0


def test_order_of_a_written_report(spark, tmp_path):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("key"), F.col("id").alias("extra"))
    frame.repartition(6).orderBy("key").write.parquet(f"{tmp_path}/sorted")
    frame.repartition(3).sortWithinPartitions("key").write.parquet(f"{tmp_path}/parts")
    def breaks(name):
        return order_breaks(stage(with_places(spark.read.parquet(f"{tmp_path}/{name}")), "places"), "key")
    assert breaks("sorted").count() == 0
    assert breaks("parts").count() == 2  # sorted files that don't follow one another
    spark.createDataFrame([(1,), (None,), (2,), (2,)], "key int").coalesce(1).write.parquet(f"{tmp_path}/nulls")
    assert [(r.number, r.key, r.row_before.key) for r in breaks("nulls").collect()] == [(2, None, 1)]


def test_a_table_is_saved_once_whoever_is_first(spark, tmp_path):
    folder, built = f"{tmp_path}/out", []

    def save(inside=None):
        def build():
            built.append(1)
            if inside is not None:
                inside()
            return spark.range(100)

        return sinks.materialize_once(spark, folder, {"x": 1}, build)

    inner = []
    outer = save(lambda: inner.append(save()))
    assert outer.count() == inner[0].count() == 100 and len(built) == 2
    assert outer.inputFiles() == inner[0].inputFiles()  # the slower build read the other's and dropped its own
    assert save().count() == 100 and len(built) == 2
    assert len(list((tmp_path / "out").glob("*/*"))) == 1


def test_unfinished_builds_are_never_read(spark, tmp_path):
    def save(build):
        return sinks.materialize_once(spark, f"{tmp_path}/out", {"x": 1}, build)

    def breaks_off():
        return spark.range(100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("no")).cast("bigint")).otherwise(F.col("id")))

    with pytest.raises(Exception, match="no"):
        save(breaks_off)
    done = save(lambda: spark.range(7))
    assert done.count() == 7
    half = next((tmp_path / "out").glob("*")) / "half"
    spark.range(3).write.parquet(str(half))  # written, never published
    assert save(lambda: spark.range(1)).count() == 7


def test_exported_names_and_texts_come_back(spark, tmp_path):
    texts = {"a/b": "un", "../up": "deux", ".hidden": "trois", "_under": "quatre", "100%": "cinq", "a%2Fb": "six",
             "é+ à.x": "sept", "empty": "", "null": None}
    frame = spark.createDataFrame(list(texts.items()), "id string, text string").withColumn("place", F.lit("extra"))
    sinks.export_reference_files(frame, f"file://{tmp_path}/refs")
    read = files.scan_references(spark, f"{tmp_path}/refs").select(sinks.id_of_stem(F.col("stem")).alias("id"), "reference")
    assert dict(map(tuple, read.collect())) == {k: v for k, v in texts.items() if v}
    assert unlisted_files(spark, f"{tmp_path}/refs") == ["empty.txt", "null.txt"]
    assert [p.name for p in tmp_path.iterdir()] == ["refs"]
    sinks.export_reference_files(frame.limit(0), f"file://{tmp_path}/nothing")
    with pytest.raises(Exception, match="no name"):
        sinks.export_reference_files(spark.createDataFrame([(None, "x")], "id string, text string"), f"file://{tmp_path}/bad")


def test_courses_with_timed_files_leave_the_others_unlisted(spark, tmp_path):
    said = "assez de mots pour compter"
    for course, names in {
        "both [1]": {"a.stm": f"f 1 s 0 1 {said}", "a.trs": "<broken"},
        "hidden": {".b.stm": f"f 1 s 0 1 {said}", "empty.stm": "", "b.trs": f"<T><Turn>{said}</Turn></T>"},
        "plain": {"c.trs": f"<T><Turn>{said}</Turn></T>"},
        ".away": {"d.trs": "<broken"},
    }.items():
        folder = tmp_path / "data" / course / "trs_manu"
        folder.mkdir(parents=True)
        for name, text in names.items():
            (folder / name).write_text(text, encoding="utf-8")
    found = files.discover_courses(spark, str(tmp_path))
    assert {(r.course, r.stem, r.text, r.reason) for r in found.collect()} == {
        ("both [1]", "a", said, None), ("hidden", "b", said, None), ("plain", "c", said, None)
    }
    read = {name.rpartition("/")[2] for name in found.inputFiles()}
    assert read == {"a.stm", "b.trs", "c.trs"}


def test_sources_that_break_off_are_replaced_whole(spark):
    torn = F.when(F.col("id") == 9, F.raise_error(F.lit("disk gone")).cast("bigint")).otherwise(F.col("id"))
    bad = corpus.Source("bad", lambda s: s.range(10).select(torn.alias("id")))
    good = corpus.Source("good", lambda s: s.range(5), corpus.disk_is_full)
    rows = corpus.read_first_whole(spark, [bad, good]).collect()
    assert {r.id for r in rows} == set(range(5)) and {r.actual_source for r in rows} == {"good"}
    never = corpus.Source("never", lambda s: s.range(5), lambda error: False)
    with pytest.raises(Exception, match="disk gone"):
        corpus.read_first_whole(spark, [bad, never])
    with pytest.raises(ValueError, match="no sources"):
        corpus.read_first_whole(spark, [])
