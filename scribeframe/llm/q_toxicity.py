"""Query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.llm.registry import query, table
from scribeframe.llm.toxicity import held_out, score_toxicity, train


@query("op4_toxicity")
def toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
