"""Importance resampling of documents towards a target distribution.

Words are runs of letters, digits and non-ASCII characters; features are all
runs of one and two consecutive words. A feature's bucket is the CRC of its
bytes modulo ``BUCKETS``, and no feature is ever spelled out: the distinct words
of a block of texts, each between delimiters, form an Aho-Corasick dictionary
whose entries carry the CRC and the length of the word. A scan emits these
payloads word by word, and the payloads of neighbours compose to the CRC of the
pair, because a CRC followed by further bytes is a linear shift of it and the
CRC of those bytes combined.

Each text is scanned once. Its buckets are staged, counted over all documents
and over all target texts, and the counts give every bucket a gain; a document
weighs the mean gain of its features. Gumbel noise from a hash of the id turns
the highest scores into a draw without replacement, and ranks come from a
range-partitioned sort.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.llm.arrow_parts import parts
from scribeframe.operators.sampling import with_position
from scribeframe.session import stage

BUCKETS = 10_000
#: Share drawn, in hundredths, of the documents that have this many words; seed of the noise.
DRAWN, LEAST_WORDS, SEED = 25, 20, 7
#: Bytes of text whose distinct words form one dictionary.
BLOCK_BYTES = 1 << 22
#: A longer word enters the dictionary under a short name that no word has.
LONG_WORD = 256

_SPACE = ord(" ")
#: A-Z lower-cased, every ASCII byte that no word holds a space, all others as they are.
_BARE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else _SPACE for b in range(256)
)
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))
_NAME = b"\x01"
_LOW = np.int64(0xFFFFFFFF)
#: Fixed value: the polynomial of this CRC, lowest degree in the highest bit.
_POLYNOMIAL = 0xEDB88320


def _step(crc: int) -> int:
    """The register after one more zero byte."""
    for _ in range(8):
        crc = crc >> 1 ^ (_POLYNOMIAL if crc & 1 else 0)
    return crc


@lru_cache(None)
def _shift(level: int) -> np.ndarray:
    """The shift by ``2 ** level`` zero bytes: what each byte of a register adds (4 x 256)."""
    if level:
        half = _shift(level - 1)
        images = _apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        images = np.array([_step(1 << bit) for bit in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    value = np.arange(256)
    for bit in range(32):
        out[bit // 8][value >> bit % 8 & 1 == 1] ^= images[bit]
    return out


def _apply(shift: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return shift[0][crc & 255] ^ shift[1][crc >> 8 & 255] ^ shift[2][crc >> 16 & 255] ^ shift[3][crc >> 24]


def composed(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of two byte strings joined, from their CRCs and the length of the second."""
    out, left, level = crc.astype(np.uint32), np.array(length, np.int64), 0
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = _apply(_shift(level), out[some])
        left >>= 1
        level += 1
    return out ^ after.astype(np.uint32)


class Dictionary:
    """An automaton over distinct words between delimiters; matches emit CRC and length."""

    def __init__(self, blocks: Iterable[bytes]):
        import ahocorasick

        self.names: dict[bytes, bytes] = {}
        self.blocks = [_LONG.sub(self._named, block) for block in blocks]
        words: set[bytes] = set()
        for block in self.blocks:
            words.update(block.split())
        long_words = {name: word for word, name in self.names.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for word in words:
            spelled = long_words.get(word, word)
            payload = len(spelled) << 32 | zlib.crc32(spelled)
            self.automaton.add_word(f" {word.decode('utf-8', 'surrogatepass')} ", payload)
        if words:
            self.automaton.make_automaton()

    def _named(self, word: re.Match) -> bytes:
        return self.names.setdefault(word[0], _NAME + b"%d" % len(self.names))

    def scans(self) -> Iterator[list[int]]:
        """The payloads of every block, in order."""
        for block in self.blocks:
            if block.strip():
                text = f" {block.decode('utf-8', 'surrogatepass')} "
                yield [payload for _, payload in self.automaton.iter(text)]
            else:
                yield []


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text without other delimiters than spaces, in pieces that end before a space."""
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + BLOCK_BYTES) if len(raw) - start > BLOCK_BYTES else -1
        end = len(raw) if end < 0 else end
        yield raw[start:end]
        start = end


def _blocks(texts: Iterable[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces with the number of their text, as many together as fill a block."""
    held, size = [], 0
    for number, raw in enumerate(texts):
        for piece in _pieces(raw.translate(_BARE)):
            if held and size + len(piece) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((number, piece))
            size += len(piece)
    if held:
        yield held


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and the buckets of its features with repeats, in no order."""
    space = np.uint32(zlib.crc32(b" "))
    owners, found = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    words = np.zeros(len(texts), np.int64)
    last_owner, last_crc = -1, np.uint32(0)
    for held in _blocks(texts):
        scans = list(Dictionary(piece for _, piece in held).scans())
        payloads = np.array([p for scan in scans for p in scan], np.int64)
        if not len(payloads):
            continue
        owner = np.repeat([number for number, _ in held], [len(scan) for scan in scans])
        crc, length = (payloads & _LOW).astype(np.uint32), payloads >> 32
        words += np.bincount(owner, minlength=len(texts))
        # The word before, also across the edge of a piece, if it is of the same text.
        paired = np.append(last_owner, owner[:-1]) == owner
        before = np.append(last_crc, crc[:-1]).astype(np.uint32)[paired]
        one = np.ones(len(before), np.int64)
        joined = composed(composed(before, np.full(len(before), space), one), crc[paired], length[paired])
        owners += [owner, owner[paired]]
        found += [crc % np.uint32(buckets), joined % np.uint32(buckets)]
        last_owner, last_crc = owner[-1], crc[-1]
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return words, np.split(bucket[order], ends[:-1])


def scan_features(docs: DataFrame, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """The given columns, ``n_words``, ``n_features`` and the features' ``buckets`` of every row's ``text``."""
    kept = [docs.schema[c] for c in columns]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept])
    names = [*columns, "n_words", "n_features", "buckets"]

    def run(batches):
        for batch in parts(batches):
            texts = [value.as_py() or b"" for value in batch.column(0).cast(pa.binary())]
            words, found = feature_buckets(texts, buckets)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(words, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()),
                ],
                names,
            )

    added = "n_words bigint, n_features bigint, buckets binary"
    return docs.select("text", *columns).mapInArrow(run, f"{schema}, {added}" if schema else added)


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; ``buckets`` numbers reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in parts(batches):
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), "<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = scanned.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of each bucket's share in the target over that in the source, floored."""
    whole, aimed, extra = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (whole + extra) / ((s + 1) * (aimed + extra))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def _scored(scanned: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """Weight and score of every scanned row."""
    kind = scanned.schema["doc_id"].dataType.simpleString()
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        for batch in parts(batches):
            weights, scores = [], []
            for raw, h in zip(batch.column(3), batch.column(4).to_pylist(), strict=True):
                own = np.frombuffer(raw.as_py(), "<u4")
                weights.append(int(gains[own].sum()) // len(own) if len(own) else 0)
                scores.append(weights[-1] + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], names
            )

    return scanned.select("doc_id", "n_words", "n_features", "buckets", noise.alias("h")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    drawn: int = DRAWN,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``doc_id``, ``text``.

    ``target`` has ``text``. Of the documents with at least ``least_words``
    words, ``drawn`` hundredths (rounded down) are drawn: the highest scores,
    ties to the smaller ``doc_id``, ranked from 1; all other rows have a null
    rank. Null texts have no words and weigh 0, as do texts without words; a
    null ``doc_id`` comes first among ties and its noise is that of an empty
    id. Rows that share an id have the same noise and are ranked one by one.
    No target texts make all gains depend on the documents alone. Other columns
    are ignored; an empty table gives no rows.
    """
    scanned = stage(scan_features(docs, "doc_id", buckets=buckets), "features")
    gains = bucket_gains(bucket_counts(scanned, buckets), bucket_counts(scan_features(target, buckets=buckets), buckets))
    scored = stage(_scored(scanned, gains, seed), "weighed")
    enough = F.col("n_words") >= least_words
    eligible = scored.where(enough).withColumn("below", -F.col("score"))
    limit = drawn * eligible.count() // 100
    placed = with_position(eligible, ["below", "doc_id", "n_features"]).withColumn("rank", F.col("position") + 1)
    rank = F.when(F.col("rank") <= limit, F.col("rank")).cast("bigint").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    left = scored.where(~enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return placed.select(*columns, rank).unionByName(left)
