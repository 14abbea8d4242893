"""Timed-transcript and subtitle formats: one file's content in, its text out.

STM and subtitles are Column expressions. TRS is XML whose encoding stands in
its own declaration and which may be malformed, so it is read from bytes by a
small Arrow-batched function that yields null instead of failing the job.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scribeframe.functions.text import WS, strip, strip_markup

STM_COMMENT = ";;"
_STM_LINE = rf"(?s)\A([^{WS}]+)[{WS}]+([^{WS}]+)[{WS}]+([^{WS}]+)[{WS}]+([^{WS}]+)[{WS}]+([^{WS}]+)[{WS}]+([^{WS}].*)\z"
_STM_LABEL = rf"\A<[^>]*>[{WS}]*"
_CUE_GAP = rf"\n[{WS}]*\n"
_CUE_BODY = r"(?s)-->[^\n]*\n(.*)"


def unix_newlines(text: Column) -> Column:
    """Read ``\\r\\n`` and ``\\r`` as ``\\n``, as text files are opened elsewhere."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def lines(content: Column) -> Column:
    return F.split(unix_newlines(content), "\n")


def stm_field(line: Column, number: int) -> Column:
    """Field 1-6 of an STM line; '' for comments and lines with fewer than six parts."""
    bare = strip(line)
    return F.when(bare.startswith(STM_COMMENT), "").otherwise(
        F.regexp_extract(bare, _STM_LINE, number)
    )


def stm_text(line: Column, drop_label: bool = False) -> Column:
    """Spoken text of an STM line; the optional ``<o,f0,male>`` label stays unless dropped."""
    text = stm_field(line, 6)
    return F.regexp_replace(text, _STM_LABEL, "") if drop_label else text


def stm_transcript(content: Column, drop_label: bool = False) -> Column:
    """All spoken texts of an STM file in file order, joined by one space."""
    spoken = F.transform(lines(content), lambda line: stm_text(line, drop_label))
    return F.array_join(F.filter(spoken, lambda text: text != ""), " ")


def subtitle_transcript(content: Column) -> Column:
    """Cue texts of an SRT or VTT file, mark-up removed and white space squeezed.

    Blocks are separated by blank lines. Only what follows a ``-->`` line is
    speech, so counters, the VTT header, notes and styles drop out while spoken
    numbers survive.
    """
    blocks = F.split(strip(unix_newlines(content)), _CUE_GAP)
    cues = F.transform(blocks, lambda block: F.regexp_extract(block, _CUE_BODY, 1))
    return strip_markup(F.array_join(cues, " "))


def _trs_pieces(root: ET.Element, element_text_only: bool):
    if element_text_only:
        for element in root.iter():
            yield element.text
    else:
        for turn in root.iter("Turn"):
            yield from turn.itertext()


def _trs_reader(element_text_only: bool):
    @F.pandas_udf(StringType())
    def read(content: pd.Series) -> pd.Series:
        texts = []
        for document in content:
            try:
                root = ET.fromstring(document)
            except (ET.ParseError, ValueError, LookupError, TypeError):
                texts.append(None)
                continue
            pieces = (piece.strip() for piece in _trs_pieces(root, element_text_only) if piece)
            texts.append(" ".join(p for p in pieces if len(p) > 1 and not p.startswith("<")))
        return pd.Series(texts, dtype="object")

    return read


_trs_speech = _trs_reader(element_text_only=False)
_trs_element_text = _trs_reader(element_text_only=True)


def trs_transcript(content: Column, element_text_only: bool = False) -> Column:
    """Speech of a TRS file given as bytes; null when it is not well-formed XML.

    Speech follows empty ``<Sync/>`` marks inside ``<Turn>``. The narrower rule
    that only looks at text directly after an opening tag, and so finds no
    speech in such files, is kept as ``element_text_only``.
    """
    return (_trs_element_text if element_text_only else _trs_speech)(content)
