"""Importance resampling, exact search and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from frames import documents, prose, texts

from scribeframe.llm import importance as importance_module
from scribeframe.llm.hard_negatives import mine_negatives
from scribeframe.llm.importance import composed, feature_buckets, resample
from scribeframe.llm.topk_search import top_scores

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def slow_buckets(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    pairs = [a + b" " + b for a, b in zip(words, words[1:])]
    return len(words), sorted(zlib.crc32(f) % 10_000 for f in words + pairs)


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_features(monkeypatch, block):
    monkeypatch.setattr(importance_module, "BLOCK_BYTES", block)
    given = [t or "" for _, t in texts()] + ["x" * 700 + " y " + "x" * 700, "a a a", "é\x7fé{ж}A1"]
    given = [t[:4000] for t in given]
    words, found = feature_buckets([t.encode() for t in given])
    for text, n, own in zip(given, words, found, strict=True):
        assert (n, sorted(own.tolist())) == slow_buckets(text)


def test_composed_checksums():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.randint(0, 3000))
        got = composed(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)


def slow_resample(rows, aims):
    source, target = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, text in rows:
        np.add.at(source, slow_buckets(text)[1], 1)
    for text in aims:
        np.add.at(target, slow_buckets(text)[1], 1)
    gains = [
        math.floor(1000 * math.log((t + 1) * (source.sum() + 10_000) / ((s + 1) * (target.sum() + 10_000))))
        for s, t in zip(source, target, strict=True)
    ]
    out = []
    for doc, text in rows:
        n, own = slow_buckets(text)
        weight = sum(gains[b] for b in own) // len(own) if own else 0
        name = f"7:{'' if doc is None else doc}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None, n >= 20])
    enough = [r for r in out if r[5]]
    enough.sort(key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    for place, row in enumerate(enough[: 25 * len(enough) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling(spark):
    rng = random.Random(4)
    rows = texts() + [(100 + k, prose(rng, rng.randint(15, 60))) for k in range(30)]
    aims = [rows[0][1], rows[5][1], None, ""]
    target = spark.createDataFrame([(t,) for t in aims], "text string")
    got = resample(documents(spark, rows), target).collect()
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == slow_resample(rows, aims)
    assert resample(documents(spark, []), target).count() == 0
    assert resample(documents(spark, rows), target.limit(0)).count() == len(rows)


VECTORS = "vec_id bigint, embedding array<float>, label int, node int, x string, block int, part int"


def vector_rows(rng, n=160, width=6):
    centres = rng.normal(size=(4, width))
    points = centres[rng.integers(0, 4, n)] + 0.3 * rng.normal(size=(n, width))
    rows = [(k, p.astype(np.float32).tolist(), int(rng.integers(0, 3))) for k, p in enumerate(points)]
    same = rows[5][1]
    rows += [(200 + k, same, k % 2) for k in range(30)]  # ties, some of them queries
    rows += [(300, [0.0] * width, 1), (301, None, 1), (302, [None] * width, 1), (303, [float("nan")] * width, 0)]
    rows += [(304, [float("-inf")] * width, 0), (305, same, None), (None, same, 1), rows[7], rows[10]]
    return rows


def usable(rows):
    out = []
    for vec, x, label in rows:
        if vec is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            out.append((vec, tuple(math.floor(256 * float(np.float32(v))) for v in x), label))
    return out


def dot(a, b):
    return sum(p * q for p, q in zip(a, b, strict=True))


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], VECTORS)


@pytest.mark.parametrize("block", [8192, 25])
def test_search_is_exact(spark, block):
    rows = vector_rows(np.random.default_rng(3))
    held = sorted({r[:2] for r in usable(rows)})
    want = []
    for query, x in held:
        if query % 10 == 0:
            scored = sorted((-dot(x, y), vec) for vec, y in held if vec != query)
            want += [(query, k + 1, vec, -score) for k, (score, vec) in enumerate(scored[:5])]
    got = top_scores(frame_of(spark, rows), 10, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("block", [8192, 25])
def test_mined_negatives(spark, block):
    rows = vector_rows(np.random.default_rng(9))
    held = sorted({r for r in usable(rows) if r[2] is not None})
    want = []
    for anchor, x, label in held:
        if anchor % 10:
            continue
        first = sorted((-dot(x, y), vec) for vec, y, own in held if own == label and vec != anchor)[:5]
        other = sorted((-dot(x, y), vec) for vec, y, own in held if own != label)
        for positive, pos in ((-s, v) for s, v in first):
            inside = [(-s, v) for s, v in other if 50 * positive <= -100 * s <= 95 * positive]
            want += [(anchor, pos, k + 1, v, positive, s) for k, (s, v) in enumerate(inside[:3])]
    got = mine_negatives(frame_of(spark, rows), 10, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) > 50


def test_empty_and_tiny_tables(spark):
    empty = frame_of(spark, [])
    assert top_scores(empty, 10).count() == mine_negatives(empty, 10).count() == 0
    unusable = frame_of(spark, [(0, None, 1), (10, [None], 1)])
    assert top_scores(unusable, 10).count() == mine_negatives(unusable, 10).count() == 0
    pair = frame_of(spark, [(0, [1.0, 2.0], 1), (1, [0.5], 2)])
    assert [tuple(r) for r in top_scores(pair, 10).collect()] == [(0, 1, 1, 256 * 128)]
