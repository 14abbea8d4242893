"""Token counts of a word-level BPE vocabulary, exact for texts of any length.

Short texts: the vocabulary's rules never look across an ASCII space or line
feed, so the count of a text is the sum over its space-separated fields, and
fields that recur are encoded once per worker.

Huge texts are encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced at a boundary that both prove: an ASCII space in the
overlap, with the same tokens at the same offsets around it in both
encodings. Where no such boundary lies in the overlap, the overlap is widened
until one does or the chunk reaches the end of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scribeframe.llm.tokenizers_io import json_tokenizer

VOCABULARY = "word_bpe_49k.json"
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
#: Tokens on each side of a boundary that both chunks must agree on.
AGREEMENT = 4
#: Distinct fields a worker remembers before it starts anew.
REMEMBERED = 300_000
_SPACE = re.compile("[ \n]")


class TokenCounter:
    def __init__(self, name: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.tokenizer = json_tokenizer(name)
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {"": 0}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [None if len(t) > self.chunk else t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": 0}
        known = self.known
        new = list({f for fields in split if fields for f in fields if f not in known})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            known.update(zip(part, map(len, encoded), strict=True))
        return [
            sum(map(known.__getitem__, fields)) if fields is not None else len(self.huge(text)[0])
            for text, fields in zip(texts, split, strict=True)
        ]

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], np.ndarray]:
        found = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return found.ids, np.array(found.offsets, np.int64).reshape(-1, 2) + start

    def huge(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and character offsets of a text, spliced from overlapping chunks."""
        base, end = 0, min(self.chunk, len(text))
        ids, offsets = self._encode(text, base, end)
        all_ids, all_offsets = [], []
        while end < len(text):
            overlap, cut = self.overlap, None
            while cut is None and overlap < 2 * self.chunk:
                start = max(0, end - overlap)
                stop = min(len(text), start + self.chunk + overlap)
                next_ids, next_offsets = self._encode(text, start, stop)
                cut = _common_boundary(text, start, end, (ids, offsets), (next_ids, next_offsets))
                overlap *= 2
            if cut is None:
                # No boundary even in a wide overlap: the chunk itself grows.
                end = min(len(text), end + (end - base) + self.chunk)
                ids, offsets = self._encode(text, base, end)
                continue
            left, right = (bisect_left(o[:, 0], cut) for o in (offsets, next_offsets))
            all_ids += ids[:left]
            all_offsets.append(offsets[:left])
            ids, offsets, base, end = next_ids[right:], next_offsets[right:], cut, stop
        return all_ids + ids, np.concatenate([*all_offsets, offsets])


def _common_boundary(text, start, end, left, right) -> int | None:
    """The last space in the overlap around which both encodings agree."""
    for space in reversed([m.start() for m in _SPACE.finditer(text, start, end)]):
        windows = []
        for ids, offsets in (left, right):
            at = bisect_left(offsets[:, 0], space)
            before = slice(max(0, at - AGREEMENT), at)
            after = slice(at, at + AGREEMENT)
            windows.append(
                [[(ids[i], *offsets[i]) for i in range(len(ids))[side]] for side in (before, after)]
            )
        (left_before, left_after), (right_before, right_after) = windows
        enough = len(left_before) == AGREEMENT == len(left_after)
        if enough and left_before == right_before and left_after == right_after:
            return space
    return None


@lru_cache(maxsize=2)
def token_counter(name: str) -> TokenCounter:
    return TokenCounter(name)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row's whole text.

    Counts are those of the tokenizers library without added special tokens,
    truncation or padding; special strings inside texts count as its default
    has it. A null text is empty and has no tokens. ``doc_id`` is passed
    through, null or repeated; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = token_counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
