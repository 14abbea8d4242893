"""Scans, sinks and jobs over real folders."""

import io
import json
import wave

import pytest
from pyspark.sql import functions as F

from scribeframe import sinks, storage
from scribeframe.functions.audio import HEAD_BYTES
from scribeframe.operators.curate import metadata_rows, validate
from scribeframe.operators.hooks import evaluate_model, transcribe
from scribeframe.plans.benchmark import run_benchmark
from scribeframe.plans.training import prepare_training, training_batches
from scribeframe.sources import corpus, files, listing
from scribeframe.storage import unlisted_files


def wav(frames=1600, rate=16_000, padding=0):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * frames)
    raw = out.getvalue()
    if padding:  # a chunk before the samples makes the header long
        chunk = b"LIST" + padding.to_bytes(4, "little") + b"\0" * padding
        raw = raw[:36] + chunk + raw[36:]
        raw = raw[:4] + (len(raw) - 8).to_bytes(4, "little") + raw[8:]
    return raw


@pytest.fixture
def tree(tmp_path):
    for subset in ("meetings", "telephone"):
        (tmp_path / subset / "audio").mkdir(parents=True)
        (tmp_path / subset / "refs").mkdir()
    (tmp_path / "accents" / "audio").mkdir(parents=True)
    for name, content in {"a.wav": wav(), "b.MP3": b"x", "c.wav": b"broken", "_d.wav": wav(), "n.txt": b""}.items():
        (tmp_path / "meetings" / "audio" / name).write_bytes(content)
    (tmp_path / "telephone" / "audio" / "e f+g.wav").write_bytes(wav())
    (tmp_path / "meetings" / "refs" / "a.txt").write_text(" Bonjour à tous \n", encoding="utf-8")
    (tmp_path / "meetings" / "refs" / "c.txt").write_text("un deux", encoding="utf-8")
    (tmp_path / "meetings" / "refs" / "z.txt").write_text("seul", encoding="utf-8")
    (tmp_path / "telephone" / "refs" / "e f+g.txt").write_text("oui", encoding="utf-8")
    return tmp_path


def test_scans_of_a_benchmark_tree(spark, tree):
    audio, references, warnings = files.scan_benchmark(spark, str(tree), ["meetings", "telephone", "accents"])
    assert {(r.subset, r.stem, r.extension) for r in audio.collect()} == {
        ("meetings", "a", "wav"), ("meetings", "b", "MP3"), ("meetings", "c", "wav"), ("telephone", "e f+g", "wav")
    }
    assert {r.stem: r.reference for r in references.collect()}["a"] == "Bonjour à tous"
    told = {(r.subset, r.warning.split(":")[0]) for r in warnings.collect()}
    assert told == {("accents", "folder not found"), ("meetings", "file not listed")}
    assert unlisted_files(spark, f"{tree}/meetings/audio") == ["_d.wav", "n.txt"]
    assert files.scan_benchmark(spark, str(tree), ["accents"])[0] is None


def test_a_model_hears_every_file_once(spark, tree, tmp_path_factory):
    calls = tmp_path_factory.mktemp("calls")

    def factory():
        import uuid

        def model(content):
            (calls / uuid.uuid4().hex).touch()
            if bytes(content[:4]) != b"RIFF":
                raise ValueError("can't decode")
            return " Bonjour tous "

        return model

    result, _ = run_benchmark(spark, str(tree), factory, ["meetings", "telephone"])
    scored = {r.audio_file: r.wer for r in result.scored.collect()}
    assert scored == {"a.wav": pytest.approx(1 / 3), "e f+g.wav": pytest.approx(2.0)}
    assert {(r.audio_file, r.reason) for r in result.rejects.collect()} == {
        ("b.MP3", "no reference"), ("c.wav", "can't decode")
    }
    assert [r.subset for r in result.summary.collect()] == ["meetings", "telephone", "GLOBAL AVG"]
    assert len(list(calls.iterdir())) == 3


def test_batched_models_and_their_failures(spark):
    frame = spark.createDataFrame([(k, b"%d" % k) for k in range(7)], "sample_id int, content binary").coalesce(1)

    def factory():
        def model(contents):
            if b"5" in contents:
                raise ValueError("five")
            return [f" {bytes(c).decode()} " for c in contents]

        return model

    got = {r.sample_id: (r.hypothesis, r.error) for r in transcribe(frame, factory, batch_size=3).collect()}
    assert got == {k: (str(k), None) for k in range(7) if k != 5} | {5: (None, "five")}
    rows = frame.withColumn("reference", F.lit("1"))
    scored, rejects = evaluate_model(rows, factory, batch_size=3)
    assert scored.count() == 6 and [tuple(r) for r in rejects.collect()] == [(5, "five")]


def test_inventory_and_metadata_of_pairs(spark, tree):
    audio = files.scan_audio(spark, f"{tree}/meetings/audio", content=True)
    facts = {r.stem: (r.duration, r.audio_error is None) for r in files.audio_inventory(audio).collect()}
    assert facts["a"] == (0.1, True) and facts["c"][0] is None and not facts["c"][1]
    refs = files.scan_references(spark, f"{tree}/meetings/refs")
    found = files.metadata_from_pairs(audio, refs)
    assert {(r.id, r.duration) for r in found.collect()} == {("a", 0.1), ("c", 0.0)}
    listed = files.scan_audio(spark, f"{tree}/meetings/audio"), refs
    plain = found.withColumn("audio_path", F.regexp_replace("audio_path", "^file:", "")).withColumn("duration", F.lit(20.0))
    assert validate(plain, *listed).count() == 0
    kept = spark.createDataFrame([("a", "s", 320_000), ("gone", "s", 320_000)], "id string, source string, frames bigint")
    rows = metadata_rows(kept, root=f"{tree}/meetings")
    assert {r.id for r in validate(rows, *listed).collect()} == {"gone"}


def test_long_wave_headers_are_read_whole(spark):
    raw = wav(3200, padding=HEAD_BYTES + 100)
    frame = spark.createDataFrame([("x", raw)], "stem string, content binary")
    assert files.audio_inventory(frame).first().duration == pytest.approx(0.2)


def test_stm_trs_subtitles_and_courses(spark, tmp_path):
    long = "un deux trois quatre cinq"
    for course, names in {
        "one": {"a.stm": f";; c\nf 1 spk 3 4 {long}  merci \nf 1 spk 2.5 3\n", "b.stm": "f 1 s 1 2 court", "x.trs": "<a/>"},
        "two": {"t.trs": f'<Trans><Turn><Sync time="0"/>{long}</Turn></Trans>', "u.trs": "<Trans><Turn>", "v.trs": "<Trans/>"},
        "cours_incomplets": {"i.stm": f"f 1 spk 3 4 {long}"},
    }.items():
        folder = tmp_path / "data" / course / "trs_manu"
        folder.mkdir(parents=True)
        for name, text in names.items():
            (folder / name).write_text(text, encoding="utf-8")
    (tmp_path / "data" / "one" / "audio").mkdir()
    (tmp_path / "data" / "one" / "audio" / "a.mp3").write_bytes(b"x")
    (tmp_path / "audio" / "one").mkdir(parents=True)
    (tmp_path / "audio" / "one" / "a.wav").write_bytes(b"x")
    got = {(r.course, r.stem): r for r in files.course_samples(spark, str(tmp_path)).collect()}
    assert set(got) == {("one", "a"), ("one", "b"), ("two", "t"), ("two", "u"), ("two", "v")}
    assert got["one", "a"].text == f"{long}  merci" and got["one", "a"].audio_path.endswith("data/one/audio/a.mp3")
    assert {k: r.reason for k, r in got.items()} == {
        ("one", "a"): None, ("one", "b"): "too short", ("two", "t"): "no audio", ("two", "u"): "unreadable",
        ("two", "v"): "too short",
    }
    assert files.discover_courses(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "s.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\n<i>Bonjour</i>\nà  tous\n\n2\n00:01 --> 00:02\n42\n", encoding="utf-8")
    assert files.scan_subtitles(spark, str(tmp_path)).first().text == "Bonjour à tous 42"


def test_sinks(spark, tmp_path):
    row = ("s", "a.wav", 'say "hi"\nnow', "é", 0.5, None)
    scored = spark.createDataFrame([row], "subset string, audio_file string, reference string, hypothesis string, wer double, cer double")
    sinks.write_scores_csv(scored, None)
    sinks.write_scores_csv(scored, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert back.reference == 'say "hi"\nnow'
    sinks.write_report_json(spark.createDataFrame([(1, None, "é")], "a int, b string, c string"), f"{tmp_path}/json")
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None, "c": "é"} and "\n" in text.strip()
    sinks.export_reference_files(spark.createDataFrame([("x", "à")], "id string, text string"), f"file://{tmp_path}/refs")
    assert (tmp_path / "refs" / "x.txt").read_text(encoding="utf-8") == "à"


def test_materialised_tables_follow_their_data(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1")
    for content, runs in (("1", 1), ("1", 1), ("22", 2)):
        (tmp_path / "in" / "a").write_text(content) if content != "1" else None
        table = sinks.materialize_once(spark, f"{tmp_path}/out", {"x": 1}, build, [f"{tmp_path}/in"])
        assert table.count() == runs == len(built)


def test_training_tables(spark, tmp_path):
    rows = [(k, ([0.0] * (k + 1), 16_000), f"t{k}" if k % 7 else " ") for k in range(60)]
    frame = spark.createDataFrame(rows, "sample_id int, audio struct<array:array<float>,sampling_rate:int>, text string")

    def factory():
        def encode(array, words):
            if len(array) == 10:
                raise ValueError("ten")
            return None, [1, *map(ord, words)]

        return encode

    tables = prepare_training(spark, frame, "sample_id", factory, str(tmp_path), {"v": 1}, exact=True)
    assert [(r.sample_id, r.reason) for r in tables.rejects.collect()] == [(9, "ten")]
    assert tables.train.count() + tables.test.count() == 60 - 9 - 1
    out = training_batches(tables.train, "sample_id", 8, 1).collect()
    assert all(1 not in r.labels[:1] for r in out)
    assert len({(r.chunk, r.batch, len(r.labels)) for r in out}) == len({(r.chunk, r.batch) for r in out})


def test_sources_take_over(spark, tmp_path):
    spark.createDataFrame([("a", "t")], "audio string, transcript string").write.parquet(f"{tmp_path}/mls")
    full = corpus.Source("full", lambda s: (_ for _ in ()).throw(OSError("No space left")))
    other = corpus.Source("mls", lambda s: corpus.read_corpus(s, f"{tmp_path}/mls"), corpus.disk_is_full)
    assert corpus.read_first_available(spark, [full, other]).first().actual_source == "mls"
    broken = corpus.Source("broken", lambda s: (_ for _ in ()).throw(OSError("denied")))
    with pytest.raises(OSError, match="denied"):
        corpus.read_first_available(spark, [broken, other])
    rows = spark.createDataFrame([(k, k % 10 == 0) for k in range(100)], "key int, ok boolean")
    assert [r.key for r in corpus.first_valid(rows, "key", 4, F.col("ok")).collect()] == [0, 10, 20, 30]
    assert corpus.first_valid(rows, "key", 4, F.col("ok"), look_at=8).count() == 1


def test_listings_need_no_call_per_file(spark, tmp_path, monkeypatch):
    folder = tmp_path / "m*ny [files]"
    folder.mkdir()
    for k in range(300):
        (folder / f"{k}.trs").write_text("x" if k % 100 else "")
    (folder / "empty.stm").touch()
    (folder / ".hidden.stm").write_text("x")
    (folder / "below.stm").mkdir()
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: calls.append(1) or send(*a, **k))
    assert not storage.has_files(spark, str(folder), ".stm")
    assert storage.unlisted_files(spark, str(folder)) == [".hidden.stm", "0.trs", "100.trs", "200.trs", "empty.stm"]
    assert len(calls) < 150
    (folder / "full.stm").write_text("x")
    assert storage.has_files(spark, str(folder), ".stm")


def test_listing_of_a_store_that_arrow_cannot_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").touch()
    monkeypatch.setattr(storage, "_listed_by_arrow", lambda folder: None)
    assert storage.unlisted_files(spark, str(tmp_path)) == ["a.txt"]
    monkeypatch.undo()
    assert storage._listed_by_arrow("nosuch://store/folder") is None


def test_many_references_are_listed_and_read_by_tasks(spark, tmp_path):
    texts = {f"{k}": f" un {k}" if k % 100 else "" for k in range(300)}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    (tmp_path / ".hidden.txt").write_text("x")
    found = files.scan_references(spark, str(tmp_path))
    assert not [name for name in found.inputFiles() if name.endswith(".txt")]  # the driver holds no file of the folder
    assert {r.stem: r.reference for r in found.collect()} == {k: v.strip() for k, v in texts.items() if v}
    assert {r.path for r in found.select("path").limit(300).collect()} == {f"file://{tmp_path}/{k}.txt" for k, v in texts.items() if v}
    assert sorted(r.name for r in listing.unlisted_names(spark, str(tmp_path)).collect()) == unlisted_files(spark, str(tmp_path))


def test_courses_of_many_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    said = "assez de mots pour compter"
    for course, suffixes in {"timed": (".stm", ".trs"), "plain [1]": (".trs",), "empty": (".trs",)}.items():
        folder = tmp_path / "data" / course / "trs_manu"
        folder.mkdir(parents=True)
        for suffix in suffixes:
            form = "f 1 s 0 1 %s" if suffix == ".stm" else "<T><Turn>%s</Turn></T>"
            for k in range(150):
                (folder / f"{k}{suffix}").write_text(form % (said if k % 50 else "non"), encoding="utf-8")
    (tmp_path / "data" / "empty" / "trs_manu" / "0.stm").touch()
    (tmp_path / "data" / "empty" / "trs_manu" / ".1.stm").write_text("x")

    def on_the_driver(*_):
        raise AssertionError("a folder is listed on the driver")

    for module in (files, listing, storage):
        for name in ("has_files", "unlisted_files", "file_facts"):
            monkeypatch.setattr(module, name, on_the_driver, raising=False)
    found = files.discover_courses(spark, str(tmp_path))
    assert not [name for name in found.inputFiles() if name.endswith((".stm", ".trs"))]
    assert {(r.course, r.stem, r.text, r.reason) for r in found.collect()} == {
        (course, f"{k}", said if k % 50 else "non", None if k % 50 else "too short")
        for course in ("timed", "plain [1]", "empty")
        for k in range(150)
    }


def test_tasks_list_what_sparks_scan_lists(spark, tmp_path, monkeypatch):
    names = ["a.txt", "é+ %2F[x]{y}.txt", "_hidden.txt", ".dot.txt", "_k=v.txt", "empty.txt", "o.TXT", "b.text", "z._COPYING_", "q?#&.txt"]
    for folder in ("x y", "x z%20", "é [1]"):
        (tmp_path / folder / "below.txt").mkdir(parents=True)
        (tmp_path / folder / "below.txt" / "c.txt").write_text("below")
        for name in names:
            (tmp_path / folder / name).write_bytes(b"" if name == "empty.txt" else f"{folder}\r\n{name}".encode() + b"\xff")
        (tmp_path / folder / "link.txt").symlink_to(tmp_path / folder / "a.txt")
        (tmp_path / folder / "gone.txt").symlink_to(tmp_path / "nothing")
    literal = storage.literally(str(tmp_path / "é [1]"))
    for given in ([f"{tmp_path}/x*"], [literal, f"{tmp_path}/x y"], [f"{tmp_path}/x y/*.txt"], [f"file://{tmp_path}/x y/a.txt"]):
        both = []
        for few in (-1, 10**9):
            monkeypatch.setattr(listing, "FEW", few)
            found = listing.scan_files(spark, given, ".txt")
            assert any(name.endswith(".txt") for name in found.inputFiles()) == (few > 0)
            both.append(sorted((r.path, bytes(r.content)) for r in found.collect()))
        assert both[0] == both[1] and both[0]
    assert listing.folders_with(spark, [f"{tmp_path}/x y", f"{tmp_path}/é [1]", f"{tmp_path}/x y/below.txt"], ".text") == sorted(
        f"file:{tmp_path}/{folder}" for folder in ("x y", "é [1]")
    )
    for few in (-1, 10**9):
        monkeypatch.setattr(listing, "FEW", few)
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            listing.scan_files(spark, [f"{tmp_path}/absent"], ".txt")


def test_stores_that_arrow_cannot_open_are_left_to_spark(spark, tmp_path, monkeypatch):
    for name, text in {"a.txt": "un", "b.txt": "", "c.stm": "x"}.items():
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(listing, "FEW", -1)
    monkeypatch.setattr(listing, "_opened", lambda path: (_ for _ in ()).throw(OSError("no such store")))
    assert [r.reference for r in files.scan_references(spark, str(tmp_path)).collect()] == ["un"]
    assert [r.name for r in listing.unlisted_names(spark, str(tmp_path)).collect()] == ["b.txt"]
    assert listing.folders_with(spark, [str(tmp_path)], ".stm") == [str(tmp_path)]
    assert listing.folders_with(spark, [], ".stm") == []
