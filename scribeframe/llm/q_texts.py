"""Queries of the operators that read every document by itself."""

from __future__ import annotations

from scribeframe.llm.packing import pack
from scribeframe.llm.registry import query, table
from scribeframe.llm.sentencepiece_codec import encoding_digests
from scribeframe.llm.token_counts import count_tokens
from scribeframe.llm.winnowing import fingerprint_edits


@query("op6_token_counts")
def token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_packing")
def packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_sentencepiece")
def sentencepiece_codec(spark, sf_dir):
    return encoding_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_winnowing")
def winnowing(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
