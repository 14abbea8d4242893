"""SimHash, vectors, components and suffix order against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from frames import documents, prose, texts

from scribeframe.llm import simhash as simhash_module
from scribeframe.llm import suffix_dedup as suffix_module
from scribeframe.llm.components import components, spanning_forest
from scribeframe.llm.embedding_dedup import build_index, near_duplicate_vectors
from scribeframe.llm.simhash import drop_near_duplicates, near_duplicates, simhash
from scribeframe.llm.suffix_dedup import FIRST, NONE, remove_repeats, removal_digests, suffix_runs


def reach(n, links):
    """Smallest index reachable from each."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)],
        "none": [],
    }[shape]
    frame = spark.createDataFrame([*links, *links[:5], *((b, a) for a, b in links[:5]), (None, 4)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(frame).collect()}
    label = reach(400, links)
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    for a in got:
        assert label[got[a]] == label[a]
        for b in got:
            assert (got[a] == got[b]) == (label[a] == label[b])


def test_spanning_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    left, right = spanning_forest(200, a, b)
    assert len(left) < 200
    assert reach(200, list(zip(left, right))) == reach(200, list(zip(a, b)))


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("piece", [1 << 20, 50, 1])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash_module, "PIECE_BYTES", piece)
    for _, text in texts():
        text = (text or "")[:20_000]
        assert int.from_bytes(simhash(text), "big") == slow_simhash(text)


def test_vantage_point_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(simhash_module, "SHARD_POINTS", 16)
    monkeypatch.setattr(simhash_module, "SAMPLE_PER_SHARD", 8)
    monkeypatch.setattr(simhash_module, "DIRECT", 64)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for p in base[:60] for k in (1, 3, 4)]
    same_half = (base[0] & simhash_module.HALVES[0]) | rng.integers(0, 2**32, 200, dtype=np.uint64)
    dense = [base[1] ^ np.uint64(1 << i | 1 << j) for i in range(12) for j in range(12)]
    points = np.unique(np.concatenate([base, near, same_half, dense, [np.uint64(0), np.uint64(7)]]).astype(np.uint64))
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    label = reach(len(points), list(zip(*np.nonzero(close), strict=True)))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    at = {int(p): k for k, p in enumerate(points.view(np.int64))}
    found = [(at[r.a], at[r.b]) for r in simhash_module.links(frame).collect()]
    assert all(close[a, b] or label[a] == label[b] for a, b in found)
    assert reach(len(points), found) == label


def test_near_duplicates_of_the_small_table(spark):
    rows = texts()
    got = near_duplicates(documents(spark)).collect()
    prints = [slow_simhash((t or "")[:10**6]) for _, t in rows]
    label = reach(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    want = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want.append((doc, prints[k], min(ids, default=None)))
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in got], key=str) == sorted(want, key=str)
    kept = drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    assert {2, 7, 14} <= {r.doc_id for r in kept.collect()}
    assert not {3, 8, 10} & {r.doc_id for r in kept.collect()}
    assert near_duplicates(documents(spark, [])).count() == 0
    assert drop_near_duplicates(documents(spark, [])).count() == 0


def test_clashing_names_and_small_ids(spark):
    rows = [(1, "same words here again"), (2, "same words here again"), (3, "other"), (3, "other")]
    frame = spark.createDataFrame(
        [(i, t, "x", 1, 2, 3) for i, t in rows],
        "doc_id smallint, text string, kept_id string, kept_id_ int, component_id int, given int",
    )
    assert sorted(r.doc_id for r in drop_near_duplicates(frame).collect()) == [1, 3, 3]
    assert drop_near_duplicates(frame).columns == frame.columns


VECTORS = "vec_id bigint, embedding array<float>, raw string, node int, links int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 32))
    near = base[:200] + rng.standard_normal((200, 32)) * 0.08 * np.linalg.norm(base[:200], axis=1)[:, None] ** 0.5
    hot = np.repeat(base[300:301], 150, 0)
    tight = base[301] + rng.standard_normal((120, 32)) * 0.05
    x = np.concatenate([base, near, hot, tight, 3 * base[400:410]]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    close = wide @ wide.T >= 0.9
    label = reach(len(x), list(zip(*np.nonzero(close), strict=True)))
    least = {}
    for k, i in enumerate(ids):
        least[label[k]] = min(least.get(label[k], i), i)
    for block in (4096, 64):
        got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, zip(ids, x.tolist())), block=block).collect()}
        links = sum(r.n_links for r in got.values())
        assert links >= 0.9 * (close.sum() - len(x))
        assert all(got[i].n_links <= close[k].sum() - 1 for k, i in enumerate(ids))
        assert np.mean([got[i].component_id == least[label[k]] for k, i in enumerate(ids)]) > 0.98
        assert got[ids[1105]].n_links >= 149


def test_a_dense_group_of_distinct_vectors_keeps_its_links(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(64) / 8
    x = rng.standard_normal((30_000, 64)) / 8
    x[:10_000] = centre + x[:10_000] * 0.2
    x = x.astype(np.float32)
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    close = np.concatenate([(wide[i : i + 2000] @ wide.T >= 0.9).sum(1) for i in range(0, len(x), 2000)]) - 1
    assert close[:10_000].mean() > 9000
    got = near_duplicate_vectors(vectors(spark, enumerate(x.tolist()))).select("vec_id", "n_links").collect()
    found = np.zeros(len(x), int)
    for r in got:
        found[r.vec_id] = r.n_links
    assert (found <= close).all()
    assert found.sum() >= 0.9 * close.sum()


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0]),
        (5, [float("inf"), 1.0, 0.0]), (6, []), (7, one), (8, one), (8, [0.0, 1.0, 0.0]), (9, [2.0, 0.0]), (None, one),
    ]
    got = sorted([tuple(r) for r in near_duplicate_vectors(vectors(spark, rows)).collect()], key=str)
    alone = [(i, 0, i) for i in range(1, 7)]
    assert got == sorted([*alone, (7, 2, 7), (8, 2, 7), (8, 0, 8), (9, 2, 7), (None, 0, None)], key=str)
    assert near_duplicate_vectors(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in near_duplicate_vectors(vectors(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_coding_error_bounds_the_lookup():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = build_index(x, 4)
    lists = index.probes(x, 1)[:, 0]
    codes, errors = index.code(x, lists)
    for number in range(4):
        mine = lists == number
        near = index.lookup(x, index.centroids[number], codes[mine])
        assert (np.abs(near - x @ x[mine].T) <= errors[mine] + 1e-9).all()


def slow_removed(rows, length, keep):
    """Which bytes of every row go, by a table of all strings."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    seen = {}
    for k in order:
        raw = rows[k][1].encode()
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], []).append((k, i))
    gone = [np.zeros(len(t.encode()), bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places[keep == FIRST :]:
                gone[k][i : i + length] = True
    return gone


@pytest.mark.parametrize(("keep", "most_kinds"), [(NONE, 2048), (NONE, 1), (FIRST, 2048), (FIRST, 1)])
def test_repeats_against_brute_force(spark, keep, most_kinds, monkeypatch):
    monkeypatch.setattr(suffix_module, "CHUNK_BYTES", 2000)
    rng = random.Random(8)
    line = prose(rng, 60)[:260]
    rows = [(i, t) for i, t in texts() if t and i not in (None, 13, 14)]
    rows += [(100 + k, f"{prose(rng, rng.randint(0, 40))}{line}{prose(rng, 30)}") for k in range(30)]
    rows += [(200, line * 4), (201, "ab" * 400), (202, line[:199]), (203, "xy" + line[:200] + "é"), (204, "é" * 300)]
    gone = slow_removed(rows, 200, keep)
    got = {r.doc_id: r for r in removal_digests(documents(spark, rows), keep=keep, most_kinds=most_kinds).collect()}
    for (doc, text), out in zip(rows, gone, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert got[doc].n_bytes == len(raw)
        assert got[doc].n_removed == out.sum(), doc
        assert got[doc].n_spans == (np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum()
        assert got[doc].kept_sha256 == hashlib.sha256(raw[~out].tobytes()).hexdigest()


SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_an_anchor_is_sorted_whole_where_joins_split_keys(spark):
    """Some anchors have too many kinds of context for a chunk, another is a hot key of the others."""
    rng = random.Random(31)
    common, busy = ("".join(rng.choices("abcdefgh", k=190)) for _ in range(2))
    ends = ["".join(rng.choices("ijklm", k=30)) for _ in range(18)]
    rows = [(k, common + ends[k % 18] + "".join(rng.choices("nopq", k=300))) for k in range(36)]
    rows += [(100 + k, busy + ends[k % 18] + "".join(rng.choices("rstu", k=300))) for k in range(60)]
    rng.shuffle(rows)
    gone = {row[0]: out.sum() for row, out in zip(rows, slow_removed(rows, 200, NONE), strict=True)}
    before = {name: spark.conf.get(name) for name in SPLITTING}
    try:
        for name, value in SPLITTING.items():
            spark.conf.set(name, value)
        got = removal_digests(documents(spark, rows).repartition(8), most_kinds=40).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {r.doc_id: r.n_removed for r in got} == gone


def test_removing_repeats_keeps_rows_and_whole_characters(spark):
    docs = documents(spark).withColumnRenamed("length", "n_chars")
    out = remove_repeats(docs).collect()
    assert len(out) == len(texts()) and list(out[0].asDict()) == docs.columns
    by = {r.doc_id: r.text for r in out}
    given = dict(texts())
    assert by[2] == given[2] and by[3] == "" and by[8] is None and by[7] == ""
    assert len(by[4]) < len(given[4]) and by[5] == given[5] and len(by[6]) < len(given[6])
    assert {r.lang for r in out} == {"en"} and {r.spans for r in out} == {"x"}
    shifted = documents(spark, [(1, "aé" * 150), (2, "b" + "é" * 199), (3, "é" * 200)])
    assert all("�" not in r.text for r in remove_repeats(shifted).collect())


def test_repeats_of_nulls_repeated_rows_and_nothing(spark):
    got = removal_digests(documents(spark)).collect()
    assert len(got) == len(texts())
    twice = [r for r in got if r.doc_id == 14]
    assert [r.n_removed for r in twice] == [r.n_bytes for r in twice] != [0, 0]
    assert removal_digests(documents(spark, [])).count() == 0
    assert remove_repeats(documents(spark, [])).count() == 0


def test_a_document_that_is_there_many_times(spark):
    rng = random.Random(21)
    text, other = prose(rng, 400), prose(rng, 100)
    rows = [(1, text)] * 2000 + [(2, other + text[500:900] + other[::-1]), (3, "short"), (3, "short"), (4, other)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id smallint, text string, n int, given string")
    spans = suffix_module._with_spans(frame, 200, NONE, 2048).where("doc_id = 1").limit(1).first()
    assert spans["starts"] == [0] and spans["ends"] == [len(text)]
    got = removal_digests(frame).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    size = len(other) * 2 + 400
    want = [(1, len(text), len(text), 1, 2000), (3, 5, 0, 0, 2), (4, len(other), len(other), 1, 1)]
    by_doc = {r.doc_id: tuple(r) for r in got}
    assert [by_doc[k[0]] for k in want] == want and by_doc[2][1] == size
    assert by_doc[2][2] >= 400 + len(other)
    first = remove_repeats(frame).groupBy("doc_id", "text").count().collect()
    assert {r.text: r["count"] for r in first if r.doc_id == 1} == {text: 2000}
    assert remove_repeats(frame).columns == frame.columns


def test_suffix_order():
    rng = random.Random(0)
    parts = ["".join(rng.choices("ab", k=rng.randint(0, 60))).encode() for _ in range(20)]
    for length in (1, 5, 8, 13, 30):
        text, offset, runs = suffix_runs(parts, length)
        heads = [parts[t][o : o + length] for t, o in zip(text, offset, strict=True)]
        assert heads == sorted(heads) and all(len(h) == length for h in heads)
        every = [p[i : i + length] for p in parts for i in range(len(p) - length + 1)]
        assert heads == sorted(h for h in every if every.count(h) > 1)
        assert [a == b for a, b in zip(heads, heads[1:])] == [a == b for a, b in zip(runs, runs[1:])]
