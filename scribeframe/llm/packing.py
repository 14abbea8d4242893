"""Harmonic packing: reciprocal-capacity classes, a fixed count of pieces per bin.

A class holds pieces of exactly ``capacity // k`` tokens and its bins take
``k`` of them. Documents may be cut, so each is cut into full sequences and
then, greedily, into the largest class sizes; every length up to the square
root of the capacity is a class of its own, so nothing is left over. Full bins
thus waste less than ``k`` tokens.

Workers fill bins on their own while they read. What is left of a class on a
worker, fewer than ``k`` pieces, is numbered across workers by a running sum
over (class, worker) counts and fills bins in the same way. Then fewer than
``k`` pieces per class remain in the whole corpus, a number bounded by the
capacity alone; first-fit decreasing closes those.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scribeframe.llm.arrow_parts import parts
from scribeframe.llm.tokenizers_io import cut_before_spaces, json_tokenizer, rank_encoding
from scribeframe.session import stage

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = (("<|endoftext|>", 50256),)
CAPACITY = 1024
PART_CHARS = 1 << 18
#: Characters whose Unicode class has been settled so long that both libraries
#: split words there alike; other texts go through the slower one.
_SETTLED = re.compile("[\\u0000-\\u052f\\u2000-\\u2bff]*")

_BIN_BITS = 40
_FIRST_WORKER = 2 * CAPACITY


@lru_cache(maxsize=4)
def class_sizes(capacity: int) -> np.ndarray:
    """Sizes ``capacity // k``, descending."""
    return np.array(sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True))


@lru_cache(maxsize=1 << 12)
def cut_sizes(length: int, capacity: int) -> tuple[int, ...]:
    """The pieces of a rest shorter than the capacity, largest first."""
    sizes, out = class_sizes(capacity), []
    while length:
        size = int(sizes[np.searchsorted(-sizes, -length)])
        out.append(size)
        length -= size
    return tuple(out)


def token_ids(text: str) -> np.ndarray:
    """Ids as the tokenizers library gives them for ``VOCABULARY``, special strings included.

    The rank file holds the same vocabulary and merges; its encoder is several
    times faster and takes every text of settled characters.
    """
    if not _SETTLED.fullmatch(text):
        return np.array(json_tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids, np.uint32)
    encoding = rank_encoding(RANKS, SPECIAL)
    parts = [
        np.array(encoding.encode(part, allowed_special="all"), np.uint32)
        for part in cut_before_spaces(text, PART_CHARS)
    ]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


PIECES = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "worker int, rank bigint, sequence_id bigint, offset bigint, padded_length bigint"
)
_NAMES = ["doc_id", *[c.split()[0] for c in PIECES.split(", ")]]


class _Filler:
    """Bins of one worker: per class, the pieces of the bin that is being filled."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.worker = capacity, worker
        self.open: dict[int, list] = {}
        self.bins = 0

    def add(self, piece: list, size: int) -> list:
        """The rows of the bin that this piece completes, or none."""
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) < self.capacity // size:
            return []
        self.open[size] = []
        sequence = ((self.worker + _FIRST_WORKER) << _BIN_BITS) + self.bins
        self.bins += 1
        used = len(held) * size
        padded = _padded(used, self.capacity)
        return [[*p, self.worker, None, sequence, k * size, padded] for k, p in enumerate(held)]

    def rest(self) -> list:
        return [
            [*p, self.worker, k, None, None, None]
            for held in self.open.values()
            for k, p in enumerate(held)
        ]


def _padded(used: int, capacity: int) -> int:
    """A sequence is padded to the capacity, except at a power of two."""
    return used if used & (used - 1) == 0 else capacity


def _batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    types = [kind, *[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row's whole text.

    ``doc_id``, ``start`` (ids of the row before the piece), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the closing id 0), ``sequence_id``,
    ``offset`` in the sequence and ``padded_length`` of the sequence. A null
    text is empty and has the closing id alone. ``doc_id`` is passed through;
    repeated rows are packed one by one. Other columns are ignored. Pieces are
    staged in the shared work folder, so a lost executor can't renumber them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def cut(batches):
        filler = _Filler(capacity, TaskContext.get().partitionId())
        for batch in parts(batches):
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(value.as_py() or ""), np.uint32(0)).astype("<u4")
                full = len(ids) // capacity
                start = 0
                for size in (*[capacity] * full, *cut_sizes(len(ids) - full * capacity, capacity)):
                    crc = zlib.crc32(ids[start : start + size].tobytes())
                    rows += filler.add([doc, start, size, crc, len(ids)], size)
                    start += size
            yield _batch(rows, doc_type)
        yield _batch(filler.rest(), doc_type)

    pieces = stage(docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, {PIECES}"), "pieces")
    done = pieces.where("sequence_id is not null")
    rest = pieces.where("sequence_id is null").drop("sequence_id", "offset", "padded_length")

    # Number the rest of each class across workers.
    by_class = Window.partitionBy("length")
    counts = rest.groupBy("length", "worker").agg(F.count("*").alias("n"))
    places = counts.select(
        "length",
        "worker",
        (F.sum("n").over(by_class.orderBy("worker")) - F.col("n")).alias("before"),
        F.sum("n").over(by_class).alias("total"),
    )
    per_bin = F.floor(F.lit(capacity) / F.col("length")).cast("bigint")
    numbered = (
        rest.join(places, ["length", "worker"])
        .withColumn("place", F.col("before") + F.col("rank"))
        .withColumn("per_bin", per_bin)
        .withColumn("bin", F.floor(F.col("place") / F.col("per_bin")).cast("bigint"))
    )
    complete = (F.col("bin") + 1) * F.col("per_bin") <= F.col("total")
    used = F.col("per_bin") * F.col("length")
    shared = numbered.where(complete).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.shiftleft("length", _BIN_BITS) + F.col("bin")).alias("sequence_id"),
        (F.col("place") % F.col("per_bin") * F.col("length")).alias("offset"),
        F.when(F.bit_count(used) == 1, used).otherwise(F.lit(capacity)).cast("bigint").alias("padded_length"),
    )

    def close(pieces: pa.Table) -> pa.Table:
        """First-fit decreasing over the last pieces, fewer than ``k`` per class."""
        pieces = pieces.sort_by([("length", "descending"), ("place", "ascending")])
        used: list[int] = []
        at, offsets = [], []
        for size in pieces["length"].to_pylist():
            k = next((i for i, u in enumerate(used) if u + size <= capacity), len(used))
            if k == len(used):
                used.append(0)
            at.append(k)
            offsets.append(used[k])
            used[k] += size
        out = pieces.drop_columns(["place"])
        for name, values in (
            ("sequence_id", at),
            ("offset", offsets),
            ("padded_length", [_padded(used[k], capacity) for k in at]),
        ):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    columns = [c for c in done.columns if c not in ("worker", "rank")]
    closed = (
        numbered.where(~complete)
        .select(*columns[:5], "place")
        .groupBy()
        .applyInArrow(
            close,
            f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
            "sequence_id bigint, offset bigint, padded_length bigint",
        )
    )
    return done.select(columns).unionByName(shared).unionByName(closed)
