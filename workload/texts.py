"""Text rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.functions import text
from workload.registry import (
    NORMALIZED_SQL,
    query,
    squeeze_sql,
    strip_sql,
    table,
)


def _normalizer(profile: str):
    @query(
        f"normalize_{profile}",
        f"SELECT doc_id, {NORMALIZED_SQL[profile]('text')} AS normalized FROM documents",
    )
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents")
        return docs.select("doc_id", text.PROFILES[profile](F.col("text")).alias("normalized"))


for _profile in text.PROFILES:
    _normalizer(_profile)


_BARE_SQL = "regexp_replace(html, '<[^>]+>', '', 'g')"


@query("strip_markup", f"SELECT page_id, {squeeze_sql(_BARE_SQL)} AS text FROM pages")
def strip_markup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query(
    "strip_text",
    f"SELECT doc_id, {strip_sql('text')} AS text, length({strip_sql('text')})::BIGINT AS chars FROM documents",
)
def strip_text(spark, sf_dir):
    stripped = text.strip(F.col("text"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", stripped.alias("text")).withColumn(
        "chars", F.length("text").cast("bigint")
    )


@query(
    "page_names",
    r"""SELECT page_id, split_part(p, '/', -1) AS file_name,
               regexp_replace(split_part(p, '/', -1), '^(.+)\.[^.]+$', '\1') AS stem
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""",
)
def page_names(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*\z", "")
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", text.file_name(path).alias("file_name"), text.file_stem(path).alias("stem")
    )
