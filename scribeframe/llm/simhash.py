"""SimHash near-duplicates through vantage-point trees.

Fingerprints that differ in at most three bits agree, in one of their two
32-bit halves, to at most one bit. So each half gets a vantage-point tree with
search radius one: an inner node splits its points by their Hamming distance
to a vantage point, and by the triangle inequality a query visits only the
sides that its radius can reach. The upper tree is built from a bounded sample
and its leaves are the shards; every fingerprint lives in one shard and visits
those across whose boundary its radius reaches. A shard goes on splitting by
further vantage points, over its half with radius one and then over all bits
with radius three, and compares what remains bit by bit. The result is exact.

Only distinct fingerprints are compared, and a shard answers with a spanning
forest of the links it finds, never with all pairs of a dense group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.llm.components import components, spanning_forest
from scribeframe.llm.names import free_name
from scribeframe.session import stage

WORDS = 3
SEED = 42
BITS = 3
#: Distinct fingerprints a shard is meant to hold, and sample points per shard.
SHARD_POINTS = 4096
SAMPLE_PER_SHARD = 64
#: Shards per tree at most; with it the sample that the driver sees is bounded.
MOST_SHARDS = 1 << 14
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Comparisons that are made directly instead of splitting further.
DIRECT = 1 << 16
_ROWS = 1 << 14
PIECE_BYTES = 1 << 20
_WHITE = re.compile(rb"[ \t-\r]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE_BYTES`` that end before white space."""
    start = 0
    while start < len(raw):
        found = _WHITE.search(raw, start + PIECE_BYTES)
        end = found.start() if found else len(raw)
        yield raw[start:end]
        start = end


def _bit_counts(words: list[bytes], width: int) -> np.ndarray:
    """How often each bit is set among the hashes of all runs of ``width`` words."""
    import xxhash

    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    counts = np.zeros(64, np.int64)
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(first), _ROWS):
        spans = zip(first[at : at + _ROWS], last[at : at + _ROWS], strict=True)
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return counts


def simhash(text: str) -> bytes:
    """The 64-bit fingerprint of a whole text, most significant byte first.

    A-Z are lower-cased, words are runs without ASCII white space, features are
    all shingles of three words with repeats; fewer words are one feature, and
    no words give zero. Long texts go piece by piece.
    """
    counts, features, tail = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + piece.split()
        if len(words) >= WORDS:
            counts += _bit_counts(words, WORDS)
            features += len(words) - WORDS + 1
        tail = words[1 - WORDS :]
    if not features and tail:
        counts, features = _bit_counts(tail, len(tail)), 1
    return np.packbits(2 * counts > features).tobytes() if features else bytes(8)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed 64-bit number) of every row.

    A null text is empty and has fingerprint zero. ``doc_id`` is passed
    through; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = b"".join([simhash(value.as_py() or "") for value in batch.column(1)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))],
                ["doc_id", "fp"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _vantage(points: np.ndarray, mask: np.uint64, tries: int = 8) -> tuple[np.uint64, int] | None:
    """A point from which the distances spread widest, and a radius that splits them in two."""
    best = None
    for k in np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int):
        far = np.bitwise_count((points ^ points[k]) & mask)
        radius = int(np.median(far))
        if radius == far.max():
            radius -= 1
        if radius >= far.min():
            spread = float(far.std())
            if best is None or spread > best[0]:
                best = spread, points[k], radius
    return best and best[1:]


class Tree:
    """An upper vantage-point tree over masked bits; leaves are numbered shards."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, radius: int, shards: int):
        self.mask, self.radius, self.shards = mask, radius, 0
        self.root = self._grow(sample, max(1, shards))

    def _grow(self, points: np.ndarray, shards: int):
        chosen = _vantage(points, self.mask) if shards > 1 and len(points) > 1 else None
        if chosen is None:
            self.shards += 1
            return self.shards - 1
        vantage, radius = chosen
        inside = np.bitwise_count((points ^ vantage) & self.mask) <= radius
        return (
            vantage,
            radius,
            self._grow(points[inside], shards // 2),
            self._grow(points[~inside], shards // 2),
        )

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of a point, a shard it reaches, and whether it lives there."""
        out = []

        def visit(node, index, home):
            if not len(index):
                return
            if not isinstance(node, tuple):
                out.append((index, np.full(len(index), node), home))
                return
            vantage, radius, inner, outer = node
            far = np.bitwise_count((points[index] ^ vantage) & self.mask).astype(int)
            near = far <= radius + self.radius
            visit(inner, index[near], home[near] & (far[near] <= radius))
            away = far > radius - self.radius
            visit(outer, index[away], home[away] & (far[away] > radius))

        visit(self.root, np.arange(len(points)), np.ones(len(points), bool))
        if not out:
            return np.empty(0, int), np.empty(0, int), np.empty(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Shard:
    """Links between the points of a shard that live there and all that reach it."""

    def __init__(self, points: np.ndarray, home: np.ndarray, mask: np.uint64):
        self.points = points
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.split(np.arange(len(points)), home, mask, 1)

    def split(self, index: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int) -> None:
        lives = index[home]
        if not len(lives) or len(index) < 2:
            return
        if len(lives) * len(index) <= DIRECT:
            self.compare(lives, index)
            return
        chosen = _vantage(self.points[lives], mask, 3)
        if chosen is None:
            if mask != WHOLE:
                self.split(index, home, WHOLE, BITS)
            else:
                self.compare(lives, index)
            return
        vantage, middle = chosen
        far = np.bitwise_count((self.points[index] ^ vantage) & mask).astype(int)
        near, away = far <= middle + radius, far > middle - radius
        if near.all() and away.all():
            if mask != WHOLE:
                self.split(index, home, WHOLE, BITS)
            else:
                self.compare(lives, index)
            return
        self.split(index[near], home[near] & (far[near] <= middle), mask, radius)
        self.split(index[away], home[away] & (far[away] > middle), mask, radius)

    def compare(self, lives: np.ndarray, index: np.ndarray) -> None:
        others = self.points[index]
        rows = max(1, DIRECT // len(index))
        for at in range(0, len(lives), rows):
            block = lives[at : at + rows]
            close = np.bitwise_count(self.points[block][:, None] ^ others[None, :]) <= BITS
            i, j = np.nonzero(close)
            a, b = block[i], index[j]
            apart = a != b
            self.links.append((a[apart], b[apart]))
            self.held += int(apart.sum())
            if self.held > 1 << 20:
                self.thin()

    def thin(self) -> None:
        a, b = (np.concatenate(x) for x in zip(*self.links, strict=True))
        self.links = [spanning_forest(len(self.points), a, b)]
        self.held = len(self.links[0][0])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.links:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.thin()
        a, b = self.links[0]
        return self.points[a], self.points[b]


def links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect distinct ``fp`` exactly as all pairs within three bits do."""
    count = prints.count()
    shards = 1
    while shards < MOST_SHARDS and shards * SHARD_POINTS < count:
        shards *= 2
    # A sample of SAMPLE_PER_SHARD points per shard, bounded by MOST_SHARDS.
    sample = prints.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_PER_SHARD * shards)
    points = np.array([r[0] for r in sample.collect()], np.int64).astype(np.uint64)
    trees = [Tree(points, half, 1, shards) for half in HALVES]

    def route(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, tree in enumerate(trees):
                index, shard, home = tree.route(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard * 2 + k, pa.int64()),
                        pa.array(own[index], pa.int64()),
                        pa.array(home, pa.bool_()),
                    ],
                    ["shard", "fp", "home"],
                )

    def search(table: pa.Table) -> pa.Table:
        half = HALVES[table["shard"][0].as_py() % 2]
        own = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = _Shard(own, table["home"].to_numpy(), half).forest()
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    routed = prints.select("fp").mapInArrow(route, "shard bigint, fp bigint, home boolean")
    return routed.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row.

    Rows whose fingerprints differ in at most three bits are linked, and
    ``component_id`` is the smallest ``doc_id`` reachable, a row's own
    included. Empty and null texts share fingerprint zero and are linked like
    any other; rows that share a ``doc_id`` stay apart as rows; null ids are
    reachable but never the smallest, so a component of null ids alone has a
    null id. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Staged, so that the join beside it can split a fingerprint that very many rows share.
    by_print = stage(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "by-print")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of one document per group, all their columns unchanged.

    Groups are the components of ``near_duplicates``; the document with the
    smallest id of its component stays. ``doc_id`` names a document: rows that share one stay or go together, and null ids
    stay only in a group without any other.
    """
    found = near_duplicates(docs)
    name = free_name(docs, "kept_id")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name))
    return docs.join(stage(kept.distinct(), "kept"), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
