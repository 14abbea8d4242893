"""SentencePiece encoding and decoding with source offsets.

Normalisation runs twice with one result: the library normalises inside its
encoder, and ``Normalizer`` here applies the compiled character map by longest
prefix while it records from which source byte every normalised byte came.
The byte lengths of the pieces cut the normalised text, and the alignment
projects each cut back to a byte span of the original text. A text whose
pieces don't add up to its normalised length raises an error, so a wrong span
can't pass unseen.

Long texts are encoded in parts where the vocabulary proves that no piece
crosses the cut, so memory per text stays bounded.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scribeframe.llm.tokenizers_io import cut_before_spaces, vocabulary_path

MODEL = "piece_bpe_32k.model"
PART_CHARS = 1 << 16
_SPACE = "▁"


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialised protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value = message[at : at + size]
            at += size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and its replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if blob else np.empty(0, "<u4")
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        units, found = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for end in range(at, len(text)):
            node ^= text[end]
            unit = int(units[node])
            if unit & (1 << 31 | 255) != text[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = end + 1 - at, int(units[node]) & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)]


class Normalizer:
    """The model's normalisation, with the source byte of every byte it makes."""

    def __init__(self, spec: bytes):
        found = dict(_fields(spec))
        self.map = CharacterMap(found.get(2, b""))
        self.prefix = bool(found.get(3, 1))
        self.squeeze = bool(found.get(4, 1))
        self.mark = _SPACE.encode() if found.get(5, 1) else b" "

    def __call__(self, text: bytes) -> tuple[int, np.ndarray]:
        """Length of the normalised text; source offset of each of its bytes, and of its end."""
        if self.squeeze or self.map:
            return self._by_prefix(text)
        if not text:
            return 0, np.zeros(1, np.int64)
        width = np.where(np.frombuffer(text, np.uint8) == 32, len(self.mark), 1)
        source = np.repeat(np.arange(len(text)), width)
        head = np.zeros(len(self.mark) if self.prefix else 0, np.int64)
        return len(head) + len(source), np.concatenate([head, source, [len(text)]])

    def _by_prefix(self, text: bytes) -> tuple[int, np.ndarray]:
        out, source, at = bytearray(), [], 0
        while at < len(text):
            found = self.map.longest(text, at) if self.map else None
            if found is None:
                first = text[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                found = size, text[at : at + size]
            size, made = found
            if self.squeeze:
                kept = made.lstrip(b" ") if not out or out.endswith(b" ") else made
                made = kept
            out += made
            source += [at] * len(made)
            at += size
        end = len(text)
        while self.squeeze and out.endswith(b" "):
            end = source.pop()
            out.pop()
        if not out:
            return 0, np.zeros(1, np.int64)
        width = np.where(np.frombuffer(bytes(out), np.uint8) == 32, len(self.mark), 1)
        aligned = np.repeat(np.array(source, np.int64), width)
        head = np.full(len(self.mark) if self.prefix else 0, source[0], np.int64)
        return len(head) + len(aligned), np.concatenate([head, aligned, [end]])


class PieceCodec:
    def __init__(self, name: str):
        import sentencepiece

        path = vocabulary_path(name)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spec = [], b""
        with open(path, "rb") as model:
            for number, value in _fields(model.read()):
                if number == 1:
                    pieces.append(dict(_fields(value)))
                elif number == 3:
                    spec = value
        self.normalizer = Normalizer(spec)
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]  # 1 normal, 2 unknown, 3 control, 6 byte
        self.sizes = np.array(
            [{3: 0, 6: 1}.get(k, len(t.encode())) for k, t in zip(kinds, texts, strict=True)], np.int64
        )
        self.unknown = np.array([k == 2 for k in kinds])
        crossing = re.compile(f"[!-~]{_SPACE}")
        self.cuttable = (
            not self.normalizer.squeeze
            and not self.normalizer.map
            and self.normalizer.prefix
            and not any(map(crossing.search, texts))
        )
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text with begin and end."""
        if len(text) <= PART_CHARS or not self.cuttable:
            return np.array(self.library.encode(text, add_bos=True, add_eos=True, num_threads=1), np.uint32)
        parts = [np.array([self.begin], np.uint32)]
        for k, part in enumerate(cut_before_spaces(text, PART_CHARS)):
            # The dummy prefix of a later part stands for the space it starts with.
            part = part[1:] if k else part
            if part:
                found = self.library.encode(part, num_threads=1)
            else:
                found = [self.library.piece_to_id(_SPACE)]
            parts.append(np.array(found, np.uint32))
        return np.concatenate([*parts, np.array([self.end], np.uint32)])

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every id in the original text; empty for begin and end."""
        length, source = self.normalizer(text)
        cuts = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        if cuts[-1] != length and not self.unknown[ids].any():
            raise ValueError("pieces don't cover the normalised text")
        cuts = np.minimum(cuts, length)
        return source[cuts[:-1]], source[cuts[1:]]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist(), num_threads=1)


@lru_cache(maxsize=2)
def piece_codec(name: str) -> PieceCodec:
    return PieceCodec(name)


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``ids``, ``starts``, ``ends`` and ``decoded`` of every row's whole text.

    ``ids`` are the library's, with begin and end ids and without sampling;
    ``starts`` and ``ends`` are byte offsets into the UTF-8 text, empty spans
    for begin and end. A null text is empty and encodes to begin and end
    alone. ``doc_id`` is passed through, null or repeated; other columns are
    ignored. Rows are independent, so ties and copies need no rule.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids = codec.ids(text)
                    rows.append((ids, *codec.spans(text.encode(), ids), codec.decode(ids)))
                ids, starts, ends, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                        pa.array(starts, pa.list_(pa.int64())),
                        pa.array(ends, pa.list_(pa.int64())),
                        pa.array(decoded, pa.string()),
                    ],
                    ["doc_id", "ids", "starts", "ends", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, ids array<int>, starts array<bigint>, ends array<bigint>, decoded string",
    )


def encoding_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Digests of what ``encode_documents`` gives, without moving ids and spans to the JVM.

    ``doc_id``, ``n_tokens``, ``ids_sha256`` over little-endian unsigned 32-bit
    ids, ``decoded_sha256`` over the decoded text in UTF-8, and
    ``covered_bytes``, the source bytes inside some piece's span. Nulls, empty
    texts and copies as there.
    """
    import hashlib

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = piece_codec(model)
        for batch in batches:
            counts, first, second, covered = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = codec.ids(text)
                starts, ends = codec.spans(text.encode(), ids)
                counts.append(len(ids))
                first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                covered.append(int((ends - starts).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(first, pa.string()),
                    pa.array(second, pa.string()),
                    pa.array(covered, pa.int64()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint",
    )
