"""The URL filter, the toxicity classifier and the pipeline."""

import random
import zlib

import pytest
from frames import documents, prose

import corpus_pipeline
from scribeframe.llm.q_urls import RULES
from scribeframe.llm.toxicity import drop_toxic, fit, score_toxicity, train, windows
from scribeframe.llm.url_filter import ALLOWED, BLOCKED, grams, judge_urls, split_url
from scribeframe.llm.url_filter import train as train_urls

PAGES = "page_id bigint, url string, host string, score double, html string"


def judged(spark, urls):
    frame = spark.createDataFrame([(k, u, "x", 0.5, "y") for k, u in enumerate(urls)], PAGES)
    return [r for r in judge_urls(frame, RULES).orderBy("page_id").collect()]


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://a.ORG/x?q#f": ("a.org", "/x", "org/", "allow"),
        "https://www.example.org/es/9": ("www.example.org", "/es/9", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "http://xcom/de/": ("xcom", "/de/", None, None),
        "a://b://org/c": ("b:", "//org/c", None, None),
        "http://org": ("org", "", None, None),
        "http://É.Org?x/y": ("É.org", "", None, None),
        "://": ("", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://h.org/a\nb?c": ("h.org", "/a\nb", "org/", "allow"),
        "http://" + "h" * 5000 + "/" + "p" * 5000: ("h" * 5000, "/" + "p" * 5000, None, None),
    }
    for row, (url, (host, path, rule, verdict)) in zip(judged(spark, list(cases)), cases.items(), strict=True):
        assert (row.host, row.path, row.rule) == (host, path, rule), url
        assert row.verdict == (verdict or ("block" if row.score >= 0.5 else "allow"))
        assert split_url(url or "") == (host, path)
    assert judged(spark, []) == []


def test_scores_equal_a_plain_sum(spark):
    import numpy as np

    weights = train_urls()
    for row in judged(spark, [*ALLOWED[:5], *BLOCKED[:5]]):
        found = grams(row.host, row.path)
        z = sum(weights[g] for g in found) / np.sqrt(len(found)) + weights[-1]
        assert row.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_urls():
    right = total = 0
    for k in range(5):
        allowed = [u for i, u in enumerate(ALLOWED) if i % 5 != k]
        blocked = [u for i, u in enumerate(BLOCKED) if i % 5 != k]
        weights = train_urls(allowed, blocked)
        rest = [(u, False) for u in ALLOWED if u not in allowed] + [(u, True) for u in BLOCKED if u not in blocked]
        for url, bad in rest:
            found = grams(*split_url(url))
            right += (weights[found].sum() / len(found) ** 0.5 + weights[-1] >= 0) == bad
        total += len(rest)
    assert total == len(ALLOWED) + len(BLOCKED) and right / total >= 0.8


INSULTS = ["blockhead", "nincompoop", "numbskull", "dunderhead"]


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeinorstl", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(800, 1)
    docs = documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    held = [(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == t for i, t in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_insults_in_ordinary_rows_and_wrong_labels():
    rng = random.Random(4)
    rows = corpus(1200, 6)
    learnt, held = rows[:800], rows[800:]
    marks = {0: [], 1: []}
    for k, (_, text, toxic) in enumerate(learnt):
        if not toxic and k % 50 == 1:  # 2 % quote an insult
            text += " " + rng.choice(INSULTS)
        marks[1 - toxic if k % 67 == 0 else toxic].append(text)  # 1.5 % are labelled wrongly
    model = fit(marks[1], marks[0], 0.25)
    assert all(word.encode()[1:] in model.toxic[:-len(model.ordinary)] for word in INSULTS)
    scorer = model.open()
    assert sum((scorer(text) >= 0.5) == toxic for _, text, toxic in held) / len(held) > 0.9


def test_windows_that_the_ordinary_dictionary_is_trained_on(monkeypatch):
    from scribeframe.llm import toxicity

    seen = []
    given = toxicity._trained
    monkeypatch.setattr(toxicity, "_trained", lambda *x: seen.append(x) or given(*x))
    ordinary = [text for _, text, toxic in corpus(40, 7) if not toxic]
    ordinary.append(" ".join(ordinary))
    for most, n in ((toxicity.BASE_WINDOWS, None), (10**9, 1)):
        seen.clear()
        fit(["you blockhead"] * 4, ordinary, 0.1, base_windows=most)
        samples = [s for s, size, _ in seen if size == toxicity.BASE_BYTES][-1]
        assert samples == [w for v in map(windows, ordinary) for w in v[:: n or max(1, len(v) // most)]]


def test_labels_of_held_out_rows_are_never_learnt(spark):
    rows = corpus(200, 2)
    docs = documents(spark, [r[:2] for r in rows])

    def scores(flip):
        marks = [(i, 1 - t if flip and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in rows]
        model = train(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
        return {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}

    assert scores(False) == scores(True)


def test_toxicity_edges(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = score_toxicity(docs, train(docs, none)).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.0}
    model = fit(["you blockhead " * 9] * 4, ["a fine day out " * 9] * 6, 0.4)
    got = score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(documents(spark, []), model).count() == 0
    assert windows("") == [b""] and b"".join(windows("x" * 500 + " Y z" * 99)) == ("x" * 500 + " y z" * 99).encode()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = corpus(400, 3)
    passage = prose(rng, 70)
    extra = [(1000, rows[1][1]), (1001, rows[1][1]), (1002, rows[2][1] + " " + passage), (1003, rows[3][1] + " " + passage)]
    extra += [(1004, None), (1005, "")]
    docs = documents(spark, [r[:2] for r in rows] + extra).selectExpr("doc_id", "text", "lang", "lang as source", "bigint(length(text)) as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "packing"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for name, step in corpus_pipeline.STAGES:
        step(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(frame)
    clean, single, cut, pieces = steps
    assert clean.columns == single.columns == cut.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    ordinary = [i for i, _, t in rows if not t]
    assert sum(i in ids for i in ordinary) / len(ordinary) > 0.97
    assert sum(i in ids for i, _, t in rows if t) / (len(rows) - len(ordinary)) < 0.2
    kept = {r.doc_id: r.text for r in single.collect()}
    assert not {1000, 1001, 1005} & set(kept)
    after = {r.doc_id: r.text for r in cut.collect()}
    assert set(after) == set(kept)
    assert sum(passage in (t or "") for t in after.values()) == 1
    assert {r.doc_id for r in pieces.collect()} == set(after)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id", "offset", "padded_length").collect())) == sorted(
        map(str, pieces.drop("sequence_id", "offset", "padded_length").collect())
    )
