"""Exact removal of repeated byte strings by suffix order and previous factors.

Every string of ``LENGTH`` bytes has one anchor, its least hashed
``ANCHOR``-gram, the rightmost of ties; equal strings have equal anchors. So
documents are first reduced to anchors, some one in seventy positions, each
with the strings it is the anchor of, and only anchors that recur go on. The
bytes under an anchor's strings are its context. Contexts that recur whole are
repeated whole; what is left, one context of each kind around every anchor that
has several kinds, is sorted into suffix order, truncated at ``LENGTH`` bytes.
In a run of the order whose neighbours share ``LENGTH`` bytes, the previous and
the next smaller text position of a suffix give its longest previous factor:
one of at least ``LENGTH`` exists unless the suffix is the first of its run in
the text. Mirrored, larger positions give later copies.

Suffixes are sorted in chunks of whole anchor groups. The few groups with more
kinds of context than a task should hold are decided by counting hashes
instead, of blocks of neighbouring strings first and of single strings where
blocks differ, which spreads any group over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scribeframe.llm.arrow_parts import parts
from scribeframe.llm.names import free_name
from scribeframe.llm.rolling import kgram_hashes, sampled
from scribeframe.session import release, stage

LENGTH = 200
ANCHOR = 64
#: Kinds of context that one anchor may have in a suffix-sorted chunk.
MOST_KINDS = 2048
#: Bytes of context that are suffix-sorted together.
CHUNK_BYTES = 1 << 20
#: Neighbouring strings that are counted together in such groups.
BLOCK = 16

FIRST, NONE = "first", "none"


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows with the hash of their text beside the id: together they name a document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), *columns)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """A row per anchor: its document, the bytes under its strings, hashes of both.

    ``doc_id``, ``text_hash``, ``start`` and ``end`` of the context, ``left``
    (its bytes before the anchor), ``anchor`` and ``context`` hashes.
    """
    import xxhash

    kind = docs.schema["doc_id"].dataType.simpleString()
    window = length - ANCHOR + 1
    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in parts(batches):
            rows, starts, ends, lefts, anchors, contexts = [], [], [], [], [], []
            for k, value in enumerate(batch.column(2)):
                raw = value.as_py().encode()
                if len(raw) < length:
                    continue
                found, start, hashes = sampled(np.frombuffer(raw, np.uint8), ANCHOR, window)
                end = np.append(start[1:], len(raw) - length + 1) + length - 1
                left = found - start
                rows.append(np.full(len(found), k))
                starts.append(start)
                ends.append(end)
                lefts.append(left)
                anchors.append(hashes)
                # The seed tells how much of the context stands before the anchor.
                spans = zip(start.tolist(), end.tolist(), left.tolist(), strict=True)
                contexts += [digest(raw[a:b], n) for a, b, n in spans]
            if not rows:
                continue
            own = batch.select(["doc_id", "text_hash"]).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    *own.columns,
                    *(pa.array(np.concatenate(x)) for x in (starts, ends)),
                    pa.array(np.concatenate(lefts).astype(np.int32)),
                    pa.array(np.concatenate(anchors).view(np.int64)),
                    pa.array(np.array(contexts, np.uint64).view(np.int64)),
                ],
                ["doc_id", "text_hash", "start", "end", "left", "anchor", "context"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(
        run,
        f"doc_id {kind}, text_hash bigint, start bigint, end bigint, left int, "
        "anchor bigint, context bigint",
    )


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


CONTEXT = ["anchor", "doc_id", "text_hash", "start", "left", "alone", "bytes", "busy"]


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted contexts with their bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    per_doc = wanted.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("anchor", "start", "end", "left", "alone", "busy")).alias("wanted")
    )
    joined = docs.join(per_doc, _same_document(docs, per_doc)).select(
        docs["doc_id"], docs["text_hash"], "text", "wanted"
    )

    def run(batches):
        for batch in parts(batches):
            rows = []
            for doc, text_hash, text, anchors in zip(*batch.columns, strict=True):
                raw = text.as_py().encode()
                own = doc.as_py(), text_hash.as_py()
                for a in anchors.as_py():
                    rows.append(
                        (a["anchor"], *own, a["start"], a["left"], a["alone"], raw[a["start"] : a["end"]], a["busy"])
                    )
            if rows:
                types = [pa.int64(), batch.column(0).type, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], CONTEXT
                )

    return joined.mapInArrow(
        run,
        f"anchor bigint, doc_id {kind}, text_hash bigint, start bigint, left int, "
        "alone boolean, bytes binary, busy boolean",
    )


def suffix_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that share their first ``length`` bytes with another, in suffix order.

    Returns, in that order, the text of each suffix, its offset in the text,
    and the number of its run: suffixes of a run share ``length`` bytes. Ranks
    of eight bytes are doubled until they cover ``length``; a suffix whose rank
    is its own at some length leaves the sort, as no longer prefix can recur.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.cumsum(sizes)
    joined = b"".join(texts)
    ends = np.repeat(bounds, sizes)
    at = np.arange(len(joined))
    covered = min(8, 1 << (length.bit_length() - 1))
    left = at[at + covered <= ends]
    key = np.zeros(len(left), np.uint64)
    whole = np.frombuffer(joined, np.uint8)
    if covered == 8 and len(joined) >= 8:
        every = np.ndarray(len(joined) - 7, ">u8", joined, 0, 1)
        key = every[left].astype(np.uint64)
    else:
        for k in range(covered):
            key = key << np.uint64(8) | whole[left + k]
    rank = np.zeros(len(joined), np.int64)
    recurs = np.zeros(len(joined), bool)

    def settle(positions: np.ndarray, keys: np.ndarray) -> np.ndarray:
        _, ranks, counts = np.unique(keys, return_inverse=True, return_counts=True)
        recurs[:] = False
        shared = counts[ranks] > 1
        rank[positions] = ranks
        recurs[positions[shared]] = True
        return positions[shared]

    left = settle(left, key)
    while covered < length:
        step = min(covered, length - covered)
        left = left[left + covered + step <= ends[left]]
        left = left[recurs[left + step]]
        left = settle(left, rank[left] * (len(joined) + 1) + rank[left + step])
        covered += step
    order = left[np.argsort(rank[left], kind="stable")]
    text = np.searchsorted(bounds, order, "right")
    return text, order - (bounds - sizes)[text], rank[order]


def copied(places: np.ndarray, runs: np.ndarray, keep: str) -> np.ndarray:
    """Which suffixes, in suffix order, have a previous factor that covers the run's length.

    ``places`` order the suffixes in the text; equal places are one place. A
    smaller place before or after a suffix within its run exists unless it is
    the run's smallest, so that test is the longest previous factor cut off at
    the run's length. With ``keep`` none, a later copy counts like an earlier.
    """
    if not len(runs):
        return np.empty(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    sizes = np.diff(np.append(starts, len(runs)))
    earlier = places > np.repeat(np.minimum.reduceat(places, starts), sizes)
    if keep == FIRST:
        return earlier
    return earlier | (places < np.repeat(np.maximum.reduceat(places, starts), sizes))


def _merged(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that strings of ``length`` at the ascending ``starts`` cover."""
    first = np.concatenate([[True], np.diff(starts) > length])
    return starts[first], starts[np.append(first[1:], True)] + length


def _sorted_spans(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans to remove, found by suffix order in chunks of whole anchor groups."""
    kind = contexts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "start", "end"]

    def chunk_spans(rows: list) -> pa.RecordBatch | None:
        documents = {d: k for k, d in enumerate(sorted({r[1:3] for r in rows}, key=lambda d: (d[0] is not None, d)))}
        text, offset, runs = suffix_runs([r[6] for r in rows], length)
        base = np.array([(documents[r[1:3]] << 40) + r[3] for r in rows], np.int64)
        found = copied(base[text] + offset, runs, keep)
        if keep == NONE:  # contexts that recur whole are marked already
            found &= np.array([r[5] for r in rows], bool)[text]
        text, offset = text[found], offset[found]
        order = np.lexsort((offset, text))
        text, offset = text[order], offset[order]
        out = []
        for k, part in zip(
            text[np.append(True, np.diff(text) > 0)] if len(text) else [],
            np.split(offset, np.flatnonzero(np.diff(text)) + 1),
            strict=False,
        ):
            _, doc, text_hash, start, *_ = rows[k]
            for a, b in zip(*_merged(part, length), strict=True):
                out.append((doc, text_hash, start + int(a), start + int(b)))
        if not out:
            return None
        types = [doc_type, pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names
        )

    doc_type = to_arrow_type(contexts.schema["doc_id"].dataType)

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in parts(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= CHUNK_BYTES and row[0] != last:
                    found = chunk_spans(rows)
                    if found is not None:
                        yield found
                    rows, held = [], 0
                rows.append(row)
                held += len(row[6])
                last = row[0]
        if rows:
            found = chunk_spans(rows)
            if found is not None:
                yield found

    return (
        contexts.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(run, f"doc_id {kind}, text_hash bigint, start bigint, end bigint")
    )


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts as blocks of up to ``BLOCK`` neighbouring strings, aligned to the anchor.

    ``core`` is the hash of the bytes that all strings of a block share and
    ``block`` that of all its bytes; ``strings`` are the hashes of the strings.
    """
    import xxhash

    kind = contexts.schema["doc_id"].dataType.simpleString()
    digest = xxhash.xxh3_64_intdigest
    names = ["anchor", "part", "core", "block", "doc_id", "text_hash", "start", "alone", "strings"]

    def signed(value: int) -> int:
        return value - (1 << 64) if value >> 63 else value

    def run(batches):
        for batch in parts(batches):
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchor, doc, text_hash, start, left, alone, raw = row
                hashes = kgram_hashes(np.frombuffer(raw, np.uint8), length).view(np.int64)
                first = -left
                while first < len(hashes) - left:
                    part = first // BLOCK
                    last = min((part + 1) * BLOCK, len(hashes) - left)
                    a, b = first + left, last + left
                    core = raw[(part + 1) * BLOCK - 1 + left : part * BLOCK + length + left]
                    block = raw[a : b - 1 + length]
                    rows.append(
                        (anchor, part, signed(digest(core)), signed(digest(block, a - part * BLOCK - left)),
                         doc, text_hash, start + a, alone, hashes[a:b])
                    )
                    first = last
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), batch.column(1).type]
                types += [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
                )

    return contexts.mapInArrow(
        run,
        f"anchor bigint, part int, core bigint, block bigint, doc_id {kind}, text_hash bigint, "
        "start bigint, alone boolean, strings array<bigint>",
    )


def _counted_spans(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans to remove around anchors with too many kinds of context, by counting hashes."""
    blocks = stage(_blocks(contexts, length), "blocks")
    place = F.struct("doc_id", "text_hash", "start")
    group = ["anchor", "part", "core"]
    kinds = blocks.groupBy(*group, "block").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "alone", "strings")).alias("first")
    )
    kinds = stage(kinds, "block-kinds")
    again = kinds.where("n > 1").select(*group, "block", "first.doc_id", "first.text_hash", "first.start")
    again = again.select(*group, "block", F.struct("doc_id", "text_hash", "start").alias("first"))
    copies = blocks.join(again, [*group, "block"])
    copies = copies.where("alone") if keep == NONE else copies.where(place > F.col("first"))
    whole = copies.select(
        "doc_id", "text_hash", "start", (F.col("start") + F.size("strings") - 1 + length).alias("end")
    )
    several = stage(kinds.groupBy(*group).count().where("count > 1").select(*group), "several-blocks")
    open_kinds = kinds.join(several, group, "left_semi")
    strings = open_kinds.select(
        "anchor",
        "first.doc_id",
        "first.text_hash",
        (F.col("first.alone") & (F.col("n") == 1)).alias("alone"),
        "first.start",
        F.posexplode("first.strings").alias("k", "string"),
    ).withColumn("start", F.col("start") + F.col("k"))
    counted = strings.groupBy("anchor", "string").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = stage(counted.where("first < last"), "strings")
    found = strings.join(repeated, ["anchor", "string"])
    found = found.where("alone") if keep == NONE else found.where(place > F.col("first"))
    return whole.unionByName(
        found.select("doc_id", "text_hash", "start", (F.col("start") + length).alias("end"))
    )


def repeated_spans(
    keyed: DataFrame, length: int = LENGTH, keep: str = FIRST, most_kinds: int = MOST_KINDS
) -> DataFrame:
    """Byte spans to remove: ``doc_id``, ``text_hash``, ``start``, ``end``; they may overlap.

    Contexts and counted strings are compared by an anchor's and their own
    64-bit hash, sorted ones byte by byte.
    """
    if length < ANCHOR + BLOCK:
        raise ValueError(f"strings have at least {ANCHOR + BLOCK} bytes")
    anchors = stage(_anchors(keyed, length), "anchors")
    # What a join looks up is staged: beside a plain shuffle, a hot key can be split.
    recurring = stage(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "recurring")
    shared = stage(anchors.join(recurring, "anchor", "left_semi"), "shared-anchors")
    release(anchors)
    place = F.struct("doc_id", "text_hash", "start")
    kinds = stage(
        shared.groupBy("anchor", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "end", "left")).alias("first")
        ),
        "contexts",
    )
    whole = kinds.where("n > 1").select("anchor", "context", "first.doc_id", "first.text_hash", "first.start")
    whole = whole.select("anchor", "context", F.struct("doc_id", "text_hash", "start").alias("first"))
    copies = shared.join(whole, ["anchor", "context"])
    if keep == FIRST:
        copies = copies.where(place > F.col("first"))
    covered = copies.select("doc_id", "text_hash", "start", "end")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    several = several.where(F.col("kinds") > 1)
    if keep == NONE:  # kinds that recur are marked already; they only serve as copies
        several = several.where("least = 1")
    several = stage(several, "several")
    wanted = kinds.join(several, "anchor").select(
        "anchor", "first.*", (F.col("n") == 1).alias("alone"), (F.col("kinds") > most_kinds).alias("busy")
    )
    # Told apart by a column: beside a join by anchor no repartition is made, and Spark may split the join's skewed keys.
    contexts = stage(_contexts(keyed, wanted), "context-bytes")
    found = _sorted_spans(contexts.where("not busy").select(CONTEXT[:-1]), length, keep)
    counted = _counted_spans(contexts.where("busy").select(CONTEXT[:-1]), length, keep)
    return covered.unionByName(found).unionByName(counted)


def _union(starts: np.ndarray, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of a document's spans, cut at its size."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(np.minimum(ends[order], size))
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    return list(zip(starts[first].tolist(), ends[np.append(first[1:], True)].tolist(), strict=True))


def _runs(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[list[tuple[int, int]]]:
    """The runs to remove from each text of a batch with its ``starts`` and ``ends``."""
    columns = [batch.column(batch.schema.get_field_index(name)) for name in ("starts", "ends")]
    for raw, starts, ends in zip(texts, *columns, strict=True):
        if starts.is_valid:
            yield _union(*(x.values.to_numpy() for x in (starts, ends)), len(raw))
        else:
            yield []


def _with_spans(docs: DataFrame, length: int, keep: str, most_kinds: int, *columns: str) -> DataFrame:
    keyed, single = _keyed(docs, *columns), _keyed(docs)
    repeated = single.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    repeated = stage(repeated, "repeated-rows")
    if repeated.isEmpty():
        spans = repeated_spans(single, length, keep, most_kinds)
    else:  # a document that is there several times takes part once
        same = _same_document(single, repeated)
        once = single.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        spans = repeated_spans(single.join(repeated, same, "left_anti").unionByName(once), length, keep, most_kinds)
        if keep == NONE:  # all its strings start elsewhere too
            size = F.octet_length("text").cast("bigint")
            whole = once.where(size >= length).select("doc_id", "text_hash", F.lit(0).cast("bigint").alias("start"), size.alias("end"))
            spans = spans.join(repeated, _same_document(spans, repeated), "left_anti").unionByName(whole)
    # Both lists are filled row by row, so they stay side by side.
    per_doc = spans.groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
    )
    return keyed.join(per_doc, _same_document(keyed, per_doc), "left").select(
        *[keyed[c] for c in ("doc_id", "text", *columns)], "starts", "ends"
    )


def removal_digests(
    docs: DataFrame, length: int = LENGTH, keep: str = NONE, most_kinds: int = MOST_KINDS
) -> DataFrame:
    """What removing repeated strings does to every row's whole text.

    ``doc_id``, ``n_bytes`` (UTF-8), ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept_sha256`` of the bytes that stay. With ``keep``
    none, a byte goes if a string of ``length`` bytes over it starts anywhere
    else too; with ``first``, if one starts earlier, in order of ``doc_id``
    (null first), text hash and position. Matches are judged on the input and
    never cross documents. A null text is empty; texts shorter than ``length``
    stay whole. Rows that share id and text are copies of one another under
    ``none`` and one document under ``first``. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in parts(batches):
            rows = []
            texts = [value.as_py().encode() for value in batch.column(1)]
            for raw, gone in zip(texts, _runs(batch, texts), strict=True):
                kept, at = hashlib.sha256(), 0
                for start, end in gone:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_spans(docs, length, keep, most_kinds).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = FIRST, most_kinds: int = MOST_KINDS) -> DataFrame:
    """The same rows with repeated strings cut out of ``text``; ``n_chars``, if there, follows.

    As ``removal_digests``, but a character goes only if all its bytes do, so
    texts stay valid. No row is dropped; a text that recurs whole becomes
    empty, a null text stays null, and other columns are unchanged.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    given_text = free_name(docs, "given")
    marked = docs.select("doc_id", "text", F.struct(F.col("text").alias(given_text), *others).alias("given_row"))
    joined = _with_spans(marked, length, keep, most_kinds, "given_row")
    schema = joined.select("text").schema

    def run(batches):
        for batch in parts(batches):
            texts = []
            given = [value.as_py().encode() for value in batch.column(1)]
            for raw, gone in zip(given, _runs(batch, given), strict=True):
                out, at = [], 0
                for start, end in gone:
                    while start < end and raw[start] & 0xC0 == 0x80:
                        start += 1
                    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    if end > start:
                        out.append(raw[at:start])
                        at = end
                texts.append(b"".join([*out, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(texts, pa.string())], ["doc_id", "given_row", "text"]
            )

    kept = joined.schema
    out = joined.mapInArrow(
        run,
        f"doc_id {kept['doc_id'].dataType.simpleString()}, "
        f"given_row {kept['given_row'].dataType.simpleString()}, text {schema['text'].dataType.simpleString()}",
    ).withColumn("text", F.when(F.col("given_row")[given_text].isNotNull(), F.col("text")))
    columns = {c: F.col("given_row")[c] for c in others}
    if "n_chars" in columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.coalesce(counted, columns["n_chars"])
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
