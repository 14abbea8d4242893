"""Document fingerprints by winnowing.

Every ``k`` consecutive code points get a rolling hash; each window of
``window`` hashes gives up its minimum, the rightmost of ties. Two texts that
share ``window + k - 1`` code points in a row share at least one chosen hash,
and the kept positions say where. Windows are clipped at the beginning of a text, so
the first k-gram is always chosen and texts that begin alike share it, however short they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.llm.rolling import kgram_hashes, sampled

K = 8
WINDOW = 10
_HASH_SHIFT = np.uint64(24)
_NULL_ID = -(2**63)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 40-bit hashes and their code point positions, in order of position.

    A window ends at every k-gram and reaches back to the beginning at most. A text
    shorter than ``k`` is one k-gram by itself; an empty text has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(codes))
    positions, _, hashes = sampled(codes, k, window)
    head = kgram_hashes(codes[: window + k - 2], k)
    clipped = np.flatnonzero(head >> _HASH_SHIFT == np.minimum.accumulate(head >> _HASH_SHIFT))
    positions, at = np.unique(np.concatenate([clipped, positions]), return_index=True)
    return np.concatenate([head[clipped], hashes])[at] >> _HASH_SHIFT, positions


def fingerprint_text(hashes: np.ndarray) -> str:
    """Ten hexadecimal digits per chosen hash, in order of position."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(left: set, right: set) -> float:
    """Shared share of two sets of chosen hashes; two empty ones are alike."""
    either = len(left | right)
    return len(left & right) / either if either else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``fingerprint`` (text) and ``positions`` of every row's whole text.

    A null text is empty and has an empty fingerprint. Rows are independent;
    ``doc_id`` is passed through; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints, places = [], []
            for value in batch.column(1):
                hashes, positions = winnow(value.as_py() or "", k, window)
                prints.append(fingerprint_text(hashes))
                places.append(positions)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(prints, pa.string()),
                    pa.array(places, pa.list_(pa.int64())),
                ],
                ["doc_id", "fingerprint", "positions"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, fingerprint string, positions array<bigint>"
    )


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_following(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt into ranges of ascending ``doc_id``, each followed by the next range's first.

    ``bucket``, ``guest`` (a copy that only serves as the last row's
    follower), ``doc_id``, ``text``. Null ids come first; rows that share an id
    are in order of their text's hash, then text. After the last row comes the
    first. One shuffle of the texts; only ``ranges`` boundaries reach the
    driver.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID))
    keyed = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = keyed.agg(F.percentile_approx("key", shares, 10 * ranges).alias("cuts")).first()["cuts"]
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "right"), dtype="int32")

    firsts = keyed.select("key").groupBy(bucket("key").alias("bucket")).agg(F.min("key").alias("key"))
    first_of = {r["bucket"]: r["key"] for r in firsts.collect()}  # one row per range
    order = sorted(first_of)
    host = {first_of[b]: order[k - 1] for k, b in enumerate(order)}

    @F.pandas_udf("array<int>")
    def buckets(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, keys.to_numpy(), "right")
        return pd.Series(
            [[b] if (h := host.get(k)) is None else [b, -1 - h] for k, b in zip(keys, own, strict=True)]
        )

    dealt = keyed.select("key", "doc_id", "text", F.explode(buckets("key")).alias("to"))
    guest = F.col("to") < 0
    return (
        dealt.select(
            F.when(guest, -1 - F.col("to")).otherwise(F.col("to")).alias("bucket"),
            guest.alias("guest"),
            "key",
            "doc_id",
            "text",
        )
        .repartition(ranges, "bucket")
        .sortWithinPartitions("bucket", "guest", "key", F.xxhash64("text"), "text")
        .select("bucket", "guest", "doc_id", "text")
    )


OUTPUT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_positions bigint"
)


def fingerprint_edits(
    docs: DataFrame, ranges: int | None = None, k: int = K, window: int = WINDOW
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text ends in the beginning of the next document's text; see
    ``edited_text`` and, for the order, nulls and ties, ``with_following``. A
    null text is empty. A single document follows itself; an empty table gives
    no rows. ``ranges`` None takes ``spark.sql.shuffle.partitions``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sketch(text: str):
        hashes, positions = winnow(text, k, window)
        return fingerprint_text(hashes), set(hashes.tolist()), len(positions)

    def compare(doc, text, own, after_text, after):
        edited = edited_text(text, after_text)
        changed, changed_set, _ = sketch(edited)
        return (
            doc,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            own[0],
            changed,
            likeness(own[1], changed_set),
            likeness(own[1], after[1]),
            own[2],
        )

    names = ["doc_id", *[c.split()[0] for c in OUTPUT.split(", ")]]

    def run(batches):
        held = None  # bucket, guest, doc_id, text, sketch of the row before
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                bucket, guest, doc, text = (c[at].as_py() for c in batch.columns)
                if guest and (held is None or held[0] != bucket or held[1]):
                    continue  # only the first guest of a range follows a row
                own = sketch(text)
                if held is not None and held[0] == bucket and not held[1]:
                    rows.append(compare(*held[2:], text, own))
                held = (bucket, guest, doc, text, own)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            types = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3]
            types += [pa.float64()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

    return with_following(docs, ranges).mapInArrow(run, f"doc_id {kind}, {OUTPUT}")
