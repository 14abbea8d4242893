"""Token counts, packing, SentencePiece and winnowing against the libraries and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from frames import documents, prose, texts
from tokenizers import Tokenizer

from scribeframe.llm.packing import cut_sizes, pack
from scribeframe.llm.rolling import kgram_hashes, sampled, window_minima, window_runs
from scribeframe.llm.sentencepiece_codec import (
    CharacterMap,
    Normalizer,
    encode_documents,
    encoding_digests,
    piece_codec,
)
from scribeframe.llm.token_counts import TokenCounter, count_tokens
from scribeframe.llm.winnowing import edited_text, fingerprint_edits, fingerprints, likeness, winnow


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = count_tokens(documents(spark)).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()]
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 8), (1000, 100)])
def test_spliced_chunks_equal_the_whole(chunk, overlap):
    import random

    rng = random.Random(chunk)
    counter = TokenCounter("word_bpe_49k.json", chunk, overlap)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = [
        prose(rng, 900),
        "x" * 5000,
        " " * 4000 + "end",
        "".join(rng.choices("ab '12.\né <|endoftext|>", k=6000)),
        ("word " * 300) + "y" * 3000 + (" more's" * 500),
        "<|endoftext|>" * 400,
    ]
    for text in long:
        ids, offsets = counter.huge(text)
        whole = library.encode(text, add_special_tokens=False)
        assert ids == whole.ids
        assert [tuple(o) for o in offsets.tolist()] == whole.offsets
        assert counter([text]) == [len(whole.ids)]


def test_pieces_partition_every_document(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in texts() if i not in (14, None)] + [(100 + k, f"{k} short") for k in range(300)]
    pieces = pack(documents(spark, rows).repartition(3)).toPandas()
    assert (pieces.length > 0).all()
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == doc].sort_values("start")
        ends = (own.start + own.length).tolist()
        assert own.start.tolist() == [0, *ends[:-1]] and ends[-1] == len(ids)
        assert (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 1024
        assert own.padded_length.nunique() == 1
        assert own.padded_length.iloc[0] == (ends[-1] if ends[-1].bit_count() == 1 else 1024)
    padded = pieces.groupby("sequence_id").padded_length.first().sum()
    assert pieces.length.sum() / padded > 0.95


def test_packing_of_repeats_nulls_and_nothing(spark):
    pieces = pack(documents(spark, [(None, "a b"), (1, None), (1, None), (2, "")])).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in pieces if r.start == 0) == [(-1, 3), (1, 1), (1, 1), (2, 1)]
    assert pack(documents(spark, [])).count() == 0


def test_cuts_waste_little():
    for length in range(1, 1024):
        sizes = cut_sizes(length, 1024)
        assert sum(sizes) == length and len(sizes) <= 5
        assert all(1024 - 1024 // s * s < 1024 // s for s in sizes)


def test_pieces_equal_the_library(spark):
    library = piece_codec("piece_bpe_32k.model").library
    got = {}
    for r in encode_documents(documents(spark)).collect():
        got.setdefault(r.doc_id, r)
    digests = {r.doc_id: r for r in encoding_digests(documents(spark)).collect()}
    for doc, text in texts():
        if doc is None:
            continue
        text = text or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        row = got[doc]
        assert row.ids == ids and row.decoded == library.decode(ids)
        assert digests[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[doc].covered_bytes == len(text.encode())
        raw = text.encode()
        assert b"".join(raw[s:e] for s, e in zip(row.starts, row.ends, strict=True)) == raw
    assert encode_documents(documents(spark, [])).count() == 0


def test_long_texts_are_cut_where_no_piece_crosses(monkeypatch):
    import random

    from scribeframe.llm import sentencepiece_codec

    monkeypatch.setattr(sentencepiece_codec, "PART_CHARS", 50)
    codec = piece_codec("piece_bpe_32k.model")
    assert codec.cuttable
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("ab  é▁.\n<s>", k=rng.randint(0, 400)))
        assert codec.ids(text).tolist() == codec.library.encode(text, add_bos=True, add_eos=True)


def _trie(keys: dict[bytes, bytes]) -> bytes:
    """A double-array character map that holds the keys, for the test."""
    import struct

    blob = b"".join(v + b"\0" for v in keys.values())
    starts, at = {}, 0
    for k, v in keys.items():
        starts[k], at = at, at + len(v) + 1
    units, used = {0: 0}, {0}

    def place(prefix: bytes, node: int) -> None:
        heads = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        want = [*heads, *([0] if leaf else [])]
        base = next(b for b in range(1, 1 << 16) if all((b ^ c) not in used for c in want) and (b ^ node) < 1 << 21)
        used.update(b for c in want for b in [base ^ c])
        units[node] |= (node ^ base) << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = starts[prefix] | 1 << 31
        for c in heads:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    trie = struct.pack(f"<{max(units) + 1}I", *[units.get(i, 0) for i in range(max(units) + 1)])
    return struct.pack("<I", len(trie)) + trie + blob


def test_longest_prefix_normalisation_keeps_source_offsets():
    blob = _trie({b"a": b"A", b"ab": b"XYZ", "ﬁ".encode(): b"fi", b"\t": b" "})
    assert CharacterMap(blob).longest(b"abc", 0) == (2, b"XYZ")
    assert CharacterMap(blob).longest(b"ac", 0) == (1, b"A")
    assert CharacterMap(blob).longest(b"c", 0) is None
    normal = Normalizer(b"")
    normal.map = CharacterMap(blob)
    normal.squeeze, normal.prefix = True, True
    length, source = normal(" ab \t ﬁac  ".encode())
    # ▁XYZ▁fiAc, each byte with the place it came from
    assert length == 3 + 3 + 3 + 2 + 2
    assert source.tolist() == [1, 1, 1, 1, 1, 1, 3, 3, 3, 6, 6, 9, 10, 11]


def _slow_winnow(codes, k, window):
    hashes = kgram_hashes(codes, k) >> np.uint64(24)
    window = min(window, len(hashes))
    out = set()
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        out.add(i + window - 1 - int(np.argmin(part[::-1])))
    return sorted(out)


def test_window_minima_take_the_rightmost_tie():
    rng = np.random.default_rng(0)
    for n, letters, k, window in ((400, 3, 4, 9), (300, 1, 5, 7), (50, 4, 8, 64), (1, 2, 1, 5)):
        codes = rng.integers(0, letters, n).astype(np.uint32)
        assert window_minima(kgram_hashes(codes, k), window).tolist() == _slow_winnow(codes, k, window)


def test_blocks_change_nothing(monkeypatch):
    from scribeframe.llm import rolling

    codes = np.random.default_rng(1).integers(0, 3, 500)
    whole = kgram_hashes(codes, 6), window_minima(kgram_hashes(codes, 6), 10)
    monkeypatch.setattr(rolling, "BLOCK", 32)
    assert (kgram_hashes(codes, 6) == whole[0]).all()
    assert window_minima(whole[0], 10).tolist() == whole[1].tolist()
    positions, firsts, hashes = sampled(codes, 6, 10)
    assert positions.tolist() == whole[1].tolist() and (hashes == whole[0][positions]).all()
    monkeypatch.setattr(rolling, "BLOCK", 1 << 20)
    assert [x.tolist() for x in window_runs(whole[0], 10)] == [positions.tolist(), firsts.tolist()]


def test_shared_passages_share_a_hash():
    passage = "".join(chr(97 + i * i % 26) for i in range(100))
    left, _ = winnow("x" * 300 + passage + "y" * 200)
    right, _ = winnow("12345" * 30 + passage)
    assert set(left.tolist()) & set(right.tolist())


def test_edited_short_texts_stay_alike():
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz      é")
    for n in range(10, 151):
        text, after = ("".join(rng.choice(letters, 200)) for _ in range(2))
        own, changed, other = (
            set(winnow(t)[0].tolist()) for t in (text[:n], edited_text(text[:n], after), after[:n])
        )
        assert likeness(own, changed) > max(0.1, likeness(own, other)), n


@pytest.mark.parametrize("following", ["", "..", "0123456789" * 20])
def test_likeness_has_no_step_at_any_length(following):
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz      é")
    for n in range(11, 151):
        alike = []
        for _ in range(5):
            text = "".join(rng.choice(letters, n))
            own, changed = (set(winnow(t)[0].tolist()) for t in (text, edited_text(text, following)))
            alike.append(likeness(own, changed))
        assert min(alike) > 0 and np.mean(alike) > 0.25, n


def test_windows_are_clipped_at_the_beginning():
    rng = np.random.default_rng(2)
    for n, k, window in ((300, 4, 6), (9, 8, 10), (30, 8, 10), (5, 8, 10), (40, 3, 1)):
        text = "".join(rng.choice(list("ab"), n))
        hashes = kgram_hashes(np.array([ord(c) for c in text], np.uint32), min(k, n)) >> np.uint64(24)
        want = set()
        for last in range(len(hashes)):
            part = hashes[max(0, last - window + 1) : last + 1]
            want.add(last - int(np.argmin(part[::-1])))
        got, positions = winnow(text, k, window)
        assert positions.tolist() == sorted(want)
        assert got.tolist() == hashes[positions].tolist()


def test_edits_against_brute_force(spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 14]
    for ranges in (1, 3, 16):
        got = {r.doc_id: r for r in fingerprint_edits(documents(spark, rows), ranges).collect()}
        assert len(got) == len(rows)
        for k, (doc, text) in enumerate(rows):
            text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[:cut]
            own, changed, following = (set(winnow(t)[0].tolist()) for t in (text, edited, after))
            row = got[doc]
            assert row.n_chars == len(text)
            assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert row.near_edited == (len(own & changed) / len(own | changed) if own | changed else 1)
            assert row.near_next == (len(own & following) / len(own | following) if own | following else 1)
        assert got[2].fingerprint == got[3].fingerprint != got[1].fingerprint
        assert got[7].fingerprint == got[8].fingerprint == ""


def test_following_rows_of_nulls_repeats_and_single_rows(spark):
    rows = fingerprint_edits(documents(spark), 4).collect()
    assert len(rows) == len(texts())
    assert len(fingerprint_edits(documents(spark, [(5, "abcd" * 20)]), 4).collect()) == 1
    assert fingerprint_edits(documents(spark, []), 4).count() == 0


def test_positions_point_at_the_hashes(spark):
    for row in fingerprints(documents(spark)).collect():
        assert len(row.fingerprint) == 10 * len(row.positions)
        assert row.positions == sorted(row.positions)
