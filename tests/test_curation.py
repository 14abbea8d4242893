"""Predicates, rejects, metadata, validation, mixtures, matching and batches."""

import pytest
from pyspark.sql import functions as F

from scribeframe.operators import batches, compare, curate, match
from scribeframe.plans.corpus_build import SOURCE_QUOTAS, build_corpus


def test_duration_and_length_limits(spark):
    frame = spark.createDataFrame([(d,) for d in (9.99, 10.0, 600.0, 600.01)], "duration double")
    assert [r[0] for r in curate.duration_in_range(frame).collect()] == [10.0, 600.0]
    texts = spark.createDataFrame([(" " + "x" * n,) for n in (9, 10)], "text string")
    assert curate.minimum_length(texts).count() == 1


def test_reasons_in_order(spark):
    rows = [(None, 20.0, None), (" \t", 20.0, "bad"), ("!!!", 20.0, None), ("word", 1.0, "bad"), ("word", None, None),
            ("word", 700.0, None), ("word", 20.0, None)]
    frame = spark.createDataFrame(rows, "text string, duration double, err string").coalesce(1)
    got = [r.reason for r in curate.label_rejects(frame, audio_error="err").collect()]
    assert got == ["empty text", "empty text", "empty after normalisation", "audio error", "too short", "too long", None]


def test_required_and_resolved_columns(spark):
    frame = spark.createDataFrame([("", "b", "s"), ("a", None, "s")], "transcription string, sentence string, speech string")
    assert [r.text for r in curate.resolve_columns(frame.coalesce(1)).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="missing"):
        curate.require_columns(frame, "missing")


def test_validation_compares_plain_paths(spark):
    metadata = spark.createDataFrame(
        [("a", "/c/audio/a.wav", "/c/refs/a.txt", 20.0), ("b", "c/audio/b.wav", "c/refs/b.txt", None)],
        "id string, audio_path string, ref_path string, duration double",
    )
    audio = spark.createDataFrame([("file:/c/audio/a.wav",), ("file:///root/c/audio/b.wav",)], "path string")
    refs = spark.createDataFrame([("hdfs://host:8020/c/refs/a.txt",)], "path string")
    got = {r.error for r in curate.validate(metadata, audio, refs, root="file:/root").collect()}
    assert got == {"Missing reference: c/refs/b.txt", "Invalid duration for b: 0.0s"}
    assert curate.validity(curate.validate(metadata, audio, refs, "/root")).first().is_valid is False


def test_mixture_meets_its_targets(spark):
    rows = spark.createDataFrame([("SUMM-RE",)] * 2 + [("PASTEL",)] + [("VoxPopuli",)], "source string")
    got = {r.source: (r.files, r.share, r.target) for r in curate.mixture_report(rows).collect()}
    assert got == {"SUMM-RE": (2, 0.5, 0.4), "PASTEL": (1, 0.25, 0.4), "VoxPopuli": (1, 0.25, 0.2)}


def source(spark, n):
    rows = [(i, f"text number {i}" if i % 5 else "!!", 16_000 * 20) for i in range(n)]
    return spark.createDataFrame(rows, "key int, text string, frames bigint")


def test_build_corpus(spark):
    sources = {"SUMM-RE": source(spark, 40), "PASTEL": source(spark, 30), "VoxPopuli": source(spark, 9)}
    full = build_corpus(sources, "key")
    assert full.metadata.count() + full.rejects.count() == 79
    limited = build_corpus(sources, "key", SOURCE_QUOTAS, dense=["PASTEL"])
    ids = sorted(r.id for r in limited.metadata.collect())
    assert len(ids) == 12 + 12 + 6
    assert [i for i in ids if i.startswith("pastel")] == [f"pastel_{k:02d}" for k in range(1, 13)]
    assert "summre_01" not in ids and "summre_02" in ids and "summre_16" not in ids
    assert [r.source for r in limited.summary.collect()] == ["PASTEL", "SUMM-RE", "VoxPopuli", "TOTAL"]
    assert {r.source: r.target for r in limited.mixture.collect()}["PASTEL"] == 0.4


def test_size_report(spark):
    frame = spark.createDataFrame([("a", "train"), (" ", "train"), ("b", "test")], "text string, split string")
    observed, seen = curate.size_report(frame, split="split")
    observed.count()
    assert seen.get == {"loaded": 3, "kept": 2, "train": 1, "test": 1}


def test_audio_preference(spark):
    audio = spark.createDataFrame(
        [("x", "mp3", "x.mp3"), ("x", "wav", "x.wav"), ("y", "ogg", "y.ogg")], "stem string, extension string, path string"
    )
    texts = spark.createDataFrame([("x",), ("y",)], "stem string")
    got = {r.stem: (r.audio_path, r.reason) for r in match.attach_preferred_audio(texts, audio).collect()}
    assert got == {"x": ("x.wav", None), "y": (None, "no audio")}
    assert [r.stem for r in match.texts_without_audio(texts, audio).collect()] == ["y"]


def batch(spark, labels):
    rows = [(k, 0, 0, v) for k, v in enumerate(labels)]
    return spark.createDataFrame(rows, "id int, chunk int, batch int, labels array<int>")


@pytest.mark.parametrize(
    ("labels", "wanted"),
    [
        ([[7, 8, 9], [7]], [[8, 9], [-100, -100]]),
        ([[7, 8, 9], [5]], [[7, 8, 9], [5, -100, -100]]),
        ([[7, 1, 2], [7, 3], None], [[1, 2], [3, -100], None]),
        ([[], [7]], [[-100], [7]]),
        ([None, None], [None, None]),
    ],
)
def test_padding_and_start_token(spark, labels, wanted):
    out = batches.drop_start_token(batches.pad_labels(batch(spark, labels)), 7)
    assert [r.labels for r in out.orderBy("id").collect()] == wanted


def test_unmask(spark):
    got = batch(spark, [[1, -100]]).select(batches.unmask_labels(F.col("labels"), 0)).first()[0]
    assert got == [1, 0]


def test_pairs_scored_in_one_pass_or_joined(spark):
    from scribeframe.operators.scoring import score_pairs

    rows = [(1, "a b c", "a b", "a b c"), (2, "x", "y", None), (3, None, "q", "q"), (4, "", "", "z")]
    both = spark.createDataFrame(
        rows, "sample_id int, reference string, baseline_hypothesis string, candidate_hypothesis string"
    )
    side = compare.score_both(both, "strict")
    joined = compare.pair_models(
        *(score_pairs(both.select("sample_id", "reference", F.col(f"{m}_hypothesis").alias("hypothesis")), "strict")
          for m in ("baseline", "candidate"))
    )
    columns = ["sample_id", "baseline_word_edits", "baseline_wer", "candidate_word_edits", "candidate_wer"]
    assert sorted(map(str, side.select(columns).collect())) == sorted(map(str, joined.select(columns).collect()))
    assert [r.sample_id for r in compare.worst_examples(side, n=1).collect()] == [4]
    plan = compare.worst_examples(side)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2


def test_pairs_that_one_model_lacks(spark):
    schema = "sample_id int, reference string, hypothesis string, word_edits long, ref_words long, wer double"
    first = spark.createDataFrame([(1, "a b", None, None, 2, None), (2, "x", "x", 0, 1, 0.0), (None, "n", "n", 0, 1, 0.0)], schema)
    second = spark.createDataFrame([(2, "x", "y", 1, 1, 1.0), (3, "z", "z", 0, 1, 0.0), (None, "n", "n", 0, 1, 0.0)], schema)
    paired = compare.pair_with_reason(first, second)
    found = sorted(((r.sample_id, r.reference, r.reason) for r in paired.collect()), key=str)
    want = [(1, "a b", "baseline only"), (2, "x", None), (3, "z", "candidate only")]
    want += [(None, "n", "baseline only"), (None, "n", "candidate only")]
    assert found == sorted(want, key=str)
    report = compare.pairing_report(paired).first()
    assert tuple(report) == (5, 1, 2, 2, 0.0, 1.0)
    empty = first.limit(0)
    assert compare.pair_with_reason(empty, empty).count() == 0
    assert compare.pair_models(first, second).columns == [c for c in paired.columns if c != "reason"]


def test_sizes_are_counted_by_the_write(spark):
    rows = spark.createDataFrame([("a", "train"), (" ", "train"), (None, "test"), ("b", "test"), ("c", None)], "text string, split string")
    counted, seen = curate.size_report(rows, split="split")
    assert "CollectMetrics" in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.count() == 5
    assert seen.get == {"loaded": 5, "kept": 3, "train": 1, "test": 1}
