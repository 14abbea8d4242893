"""Audio facts and PCM conversion for WAV content, Arrow-batched.

Compressed formats are listed and matched but not decoded; they come back with
a reason instead of a duration.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TARGET_RATE = 16_000
HEAD_BYTES = 65_536

_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE

WAV_FACTS = StructType(
    [
        StructField("frames", LongType()),
        StructField("sampling_rate", IntegerType()),
        StructField("channels", IntegerType()),
        StructField("reason", StringType()),
    ]
)

STANDARD_AUDIO = StructType(
    [
        StructField("content", BinaryType()),
        StructField("frames", LongType()),
        StructField("approx", BooleanType()),
        StructField("reason", StringType()),
    ]
)

_NEEDS_MORE = "header beyond the first bytes"


class UnsupportedAudio(ValueError):
    """Content that is not a WAV file this module can read."""


class TruncatedHeader(ValueError):
    """The data chunk does not start within the bytes given."""


@dataclass(frozen=True)
class WavLayout:
    code: int
    channels: int
    rate: int
    width: int
    start: int
    frames: int


def wav_layout(head: bytes, size: int) -> WavLayout:
    """Walk the RIFF chunks in ``head`` of a file of ``size`` bytes up to the samples."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise UnsupportedAudio("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(head):
        name, length = struct.unpack_from("<4sI", head, at)
        at += 8
        if name == b"fmt " and at + 16 <= len(head):
            form = struct.unpack_from("<HHIIHH", head, at)
            code = form[0]
            if code == _EXTENSIBLE and length >= 26 and at + 26 <= len(head):
                code = struct.unpack_from("<H", head, at + 24)[0]
        elif name == b"data":
            if form is None:
                raise UnsupportedAudio("samples before format")
            _, channels, rate, _, _, bits = form
            width = bits // 8
            if code not in (_PCM, _FLOAT) or not channels or not rate or not width:
                raise UnsupportedAudio("unsupported WAV encoding")
            frames = min(length, max(size - at, 0)) // (width * channels)
            return WavLayout(code, channels, rate, width, at, frames)
        at += length + length % 2
    if at + 8 > size:
        raise UnsupportedAudio("no samples")
    raise TruncatedHeader(_NEEDS_MORE)


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """Samples as float64 in [-1, 1], shaped (frames, channels), and the rate."""
    layout = wav_layout(content, len(content))
    count = layout.frames * layout.channels
    raw = content[layout.start : layout.start + count * layout.width]
    if layout.code == _FLOAT and layout.width in (4, 8):
        samples = np.frombuffer(raw, dtype=f"<f{layout.width}").astype(np.float64)
    elif layout.code == _PCM and layout.width == 1:
        samples = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128) / 128
    elif layout.code == _PCM and layout.width in (2, 4):
        samples = np.frombuffer(raw, dtype=f"<i{layout.width}") / float(1 << (8 * layout.width - 1))
    elif layout.code == _PCM and layout.width == 3:
        parts = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        samples = (((parts[:, 2] ^ 0x80) - 0x80) << 16 | parts[:, 1] << 8 | parts[:, 0]) / float(1 << 23)
    else:
        raise UnsupportedAudio("unsupported WAV encoding")
    return samples.reshape(-1, layout.channels), layout.rate


def resample(samples: np.ndarray, rate: int, target: int, taps: int = 32) -> np.ndarray:
    """Band-limited interpolation with a Hann-windowed sinc; ceil(n * target / rate) samples."""
    if rate == target or not len(samples):
        return samples
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    length = -(-len(samples) * up // down)
    cutoff = min(1.0, target / rate)
    reach = int(np.ceil(taps / cutoff))
    padded = np.pad(samples, (reach, reach + 1))
    offsets = np.arange(-reach + 1, reach + 1)
    out = np.empty(length)
    for phase in range(min(up, length)):
        index = np.arange(phase, length, up)
        position = index * down
        whole, part = position // up, (phase * down % up) / up
        distance = part - offsets
        window = np.where(np.abs(distance) < reach, np.cos(np.pi * distance / (2 * reach)) ** 2, 0)
        kernel = cutoff * np.sinc(cutoff * distance) * window
        total = np.zeros(len(index))
        for offset, weight in zip(offsets, kernel):
            total += weight * padded[whole + reach + offset]
        out[index] = total
    return out


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM WAV file."""
    pcm = np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, _PCM, 1, rate, rate * 2, 2, 16)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(pcm)) + pcm
    return struct.pack("<4sI", b"RIFF", len(body)) + body


@F.pandas_udf(WAV_FACTS)
def _probe(head: pd.Series, size: pd.Series) -> pd.DataFrame:
    facts = []
    for data, total in zip(head, size):
        if data is None:
            facts.append((None, None, None, None))
            continue
        try:
            layout = wav_layout(data, int(total))
            facts.append((layout.frames, layout.rate, layout.channels, None))
        except (UnsupportedAudio, TruncatedHeader, struct.error) as error:
            facts.append((None, None, None, str(error)))
    return pd.DataFrame(facts, columns=WAV_FACTS.names).astype(
        {"frames": "Int64", "sampling_rate": "Int32", "channels": "Int32"}
    )


def wav_head_facts(content: Column) -> Column:
    """Facts from the first bytes; most headers end there, so little data leaves the JVM."""
    return _probe(F.substring(content, 1, HEAD_BYTES), F.octet_length(content).cast("bigint"))


def wav_full_facts(content: Column, head_facts: Column) -> Column:
    """Facts from the whole content for the few rows whose header is longer."""
    unfinished = head_facts["reason"] == _NEEDS_MORE
    whole = F.when(unfinished, content)
    return F.when(unfinished, _probe(whole, F.octet_length(whole).cast("bigint"))).otherwise(head_facts)


def duration_seconds(frames: Column, sampling_rate: Column) -> Column:
    return frames / sampling_rate


def duration_rounded(frames: Column, sampling_rate: Column) -> Column:
    """Duration in hundredths, ties upwards, in integer arithmetic.

    ``round`` on a double breaks ties differently from engine to engine.
    """
    rate = sampling_rate.cast("bigint")
    return F.floor((frames * 200 + rate) / (2 * rate)) / 100


def standardize(target: int = TARGET_RATE, mono_first: bool = False):
    """Function: WAV content to mono 16-bit WAV at ``target`` Hz.

    Channels are averaged exactly. Resampling is an approximation and says so
    in ``approx``; ``mono_first`` averages before resampling instead of after.
    """

    @F.pandas_udf(STANDARD_AUDIO)
    def convert(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                samples, rate = wav_samples(data)
                if mono_first:
                    mono = resample(samples.mean(axis=1), rate, target)
                else:
                    channels = [resample(c, rate, target) for c in samples.T]
                    mono = np.mean(channels, axis=0)
                rows.append((wav_bytes(mono, target), len(mono), rate != target, None))
            except (UnsupportedAudio, TruncatedHeader, struct.error, TypeError) as error:
                rows.append((None, None, None, str(error)))
        return pd.DataFrame(rows, columns=STANDARD_AUDIO.names).astype(
            {"frames": "Int64", "approx": "boolean"}
        )

    return convert
