"""Error rates per sample, per subset and over the corpus; model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.functions.metrics import improvement_band, improvement_percent, quality_band
from scribeframe.functions.text import PROFILES
from scribeframe.operators import compare
from scribeframe.operators.scoring import corpus_error_rate, error_rates, score_pairs
from workload.registry import (
    documents,
    micro,
    micro_sql,
    misheard,
    query,
    rate_sql,
    scored_documents_sql,
    strict_sql,
    table,
    words_sql,
)

# Two models: (every n-th word missed, every m-th not understood).
BASELINE = (7, 5)
CANDIDATE = (13, 9)

_WER = rate_sql("word_edits", "ref_words", "hyp_words")
_CER = rate_sql("char_edits", "ref_chars", "hyp_chars")


def hypotheses(
    spark: SparkSession, sf_dir: str, model: tuple[int, int], profile: str = "strict"
) -> DataFrame:
    """Every document as a reference with the model's hypothesis of the whole text."""
    normalized = PROFILES[profile](F.col("text"))
    return documents(spark, sf_dir, "text", "lang").select(
        F.col("doc_id").alias("sample_id"),
        F.col("lang").alias("subset"),
        F.col("text").alias("reference"),
        misheard(normalized, *model).alias("hypothesis"),
    )


def _per_document(profile: str):
    @query(
        f"error_rates_per_document_{profile}",
        f"""SELECT doc_id AS sample_id, '{profile}' AS profile, ref_words, hyp_words, word_edits,
                   {micro_sql(_WER)} AS wer, ref_chars, char_edits, {micro_sql(_CER)} AS cer
            FROM ({scored_documents_sql(profile, *BASELINE)})""",
    )
    def run(spark, sf_dir):
        scored = score_pairs(hypotheses(spark, sf_dir, BASELINE, profile), profile, with_cer=True)
        return scored.select(
            "sample_id", "profile", "ref_words", "hyp_words", "word_edits",
            micro(F.col("wer")).alias("wer"), "ref_chars", "char_edits",
            micro(F.col("cer")).alias("cer"),
        )


for _profile in PROFILES:
    _per_document(_profile)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a reference and the turn after it as the hypothesis.

    The join key is unique, so a conversation of any length spreads evenly.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return turns.withColumnRenamed("text", "reference").join(after, ["conv_id", "turn"])


_PAIRS = f"""
  SELECT conv_id, turn, ref, hyp, {words_sql('ref')} AS r, {words_sql('hyp')} AS h
  FROM (SELECT a.conv_id, a.turn, {strict_sql('a.text')} AS ref, {strict_sql('b.text')} AS hyp
        FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query(
    "wer_per_turn",
    # One row of the distance matrix per step; the running minimum along the row
    # stands for the insertions.
    f"""WITH RECURSIVE pairs AS MATERIALIZED ({_PAIRS}),
        matrix(conv_id, turn, i, cells) AS (
          SELECT conv_id, turn, 0::BIGINT, range(0, len(h) + 1) FROM pairs
          UNION ALL
          SELECT m.conv_id, m.turn, m.i + 1,
                 list_transform(range(1, len(p.h) + 2), lambda j: j + list_min(list_slice(
                   list_transform(range(1, len(p.h) + 2), lambda k: CASE WHEN k = 1 THEN m.cells[1] + 1
                     ELSE least(m.cells[k] + 1,
                                m.cells[k - 1] + CASE WHEN p.r[m.i + 1] = p.h[k - 1] THEN 0 ELSE 1 END)
                     END - k), 1, j)))
          FROM matrix m JOIN pairs p ON p.conv_id = m.conv_id AND p.turn = m.turn
          WHERE m.i < len(p.r))
        SELECT conv_id, turn, ref_words, word_edits, {micro_sql('word_edits::DOUBLE / ref_words')} AS wer
        FROM (SELECT p.conv_id, p.turn, len(p.r)::BIGINT AS ref_words, m.cells[-1]::BIGINT AS word_edits
              FROM matrix m JOIN pairs p ON p.conv_id = m.conv_id AND p.turn = m.turn AND m.i = len(p.r))""",
)
def wer_per_turn(spark, sf_dir):
    scored = score_pairs(turn_pairs(spark, sf_dir), "strict")
    return scored.select(
        "conv_id", "turn", "ref_words", "word_edits", micro(F.col("wer")).alias("wer")
    )


def _bytes_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, ''), "
        f"lambda c: chr(list_position(alphabet, c)::INTEGER)), '')"
    )


@query(
    "cer_per_turn",
    # DuckDB's distance counts bytes, so each character of a pair becomes one byte.
    f"""SELECT conv_id, turn, length(ref)::BIGINT AS ref_chars, char_edits,
               {micro_sql('char_edits::DOUBLE / length(ref)')} AS cer
        FROM (SELECT *, levenshtein({_bytes_sql('ref')}, {_bytes_sql('hyp')})::BIGINT AS char_edits
              FROM (SELECT *, list_distinct(string_split(ref || hyp, '')) AS alphabet FROM ({_PAIRS})))""",
)
def cer_per_turn(spark, sf_dir):
    scored = score_pairs(turn_pairs(spark, sf_dir), "strict", with_cer=True)
    return scored.select(
        "conv_id", "turn", "ref_chars", "char_edits", micro(F.col("cer")).alias("cer")
    )


@query(
    "subset_error_rates",
    f"""SELECT CASE WHEN grouping(lang) = 1 THEN 'GLOBAL AVG' ELSE lang END AS subset,
               grouping(lang) = 1 AS is_total, count(*) AS samples,
               {micro_sql(f'avg({_WER})')} AS avg_wer, {micro_sql(f'avg({_CER})')} AS avg_cer,
               {micro_sql('sum(word_edits)::DOUBLE / sum(ref_words)::DOUBLE')} AS corpus_wer,
               {micro_sql('sum(char_edits)::DOUBLE / sum(ref_chars)::DOUBLE')} AS corpus_cer
        FROM ({scored_documents_sql('strict', *BASELINE)}) GROUP BY ROLLUP (lang)""",
)
def subset_error_rates(spark, sf_dir):
    scored = score_pairs(hypotheses(spark, sf_dir, BASELINE), "strict", with_cer=True)
    report = error_rates(scored)
    rates = ["avg_wer", "avg_cer", "corpus_wer", "corpus_cer"]
    return report.select(
        "subset", "is_total", "samples", *[micro(F.col(r)).alias(r) for r in rates]
    )


@query(
    "corpus_error_rate",
    f"""SELECT count(*) AS samples, sum(word_edits)::BIGINT AS word_edits,
               sum(ref_words)::BIGINT AS ref_words,
               {micro_sql('sum(word_edits)::DOUBLE / sum(ref_words)::DOUBLE')} AS corpus_wer
        FROM ({scored_documents_sql('basic', *BASELINE)})""",
)
def corpus_rate(spark, sf_dir):
    scored = score_pairs(hypotheses(spark, sf_dir, BASELINE, "basic"), "basic")
    return corpus_error_rate(scored).withColumn("corpus_wer", micro(F.col("corpus_wer")))


def paired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' hypotheses of every document, scored side by side in one pass."""
    normalized = PROFILES["strict"](F.col("text"))
    docs = documents(spark, sf_dir, "text", "lang").select(
        F.col("doc_id").alias("sample_id"),
        F.col("lang").alias("subset"),
        F.col("text").alias("reference"),
        misheard(normalized, *BASELINE).alias("baseline_hypothesis"),
        misheard(normalized, *CANDIDATE).alias("candidate_hypothesis"),
    )
    return compare.score_both(docs, "strict", shared=["reference", "subset"])


_BOTH = f"""
  SELECT b.doc_id, b.lang, b.text, b.ref_words, b.hyp AS b_hyp, c.hyp AS c_hyp,
         b.word_edits AS b_edits, c.word_edits AS c_edits, b.wer AS b_wer, c.wer AS c_wer
  FROM (SELECT *, {_WER} AS wer FROM ({scored_documents_sql('strict', *BASELINE)})) b
  JOIN (SELECT *, {_WER} AS wer FROM ({scored_documents_sql('strict', *CANDIDATE)})) c USING (doc_id)"""

_TOTALS = """
  SELECT sum(b_edits)::DOUBLE / sum(ref_words)::DOUBLE AS bw,
         sum(c_edits)::DOUBLE / sum(ref_words)::DOUBLE AS cw, count(*) AS n"""


@query(
    "compare_models",
    f"""SELECT {micro_sql('bw')} AS baseline_wer, {micro_sql('cw')} AS candidate_wer,
               n AS test_samples, n AS paired_samples, {micro_sql('bw - cw')} AS improvement,
               {micro_sql('(bw - cw) / bw * 100')} AS improvement_percent
        FROM ({_TOTALS} FROM ({_BOTH}))""",
)
def compare_models(spark, sf_dir):
    rates = ["baseline_wer", "candidate_wer", "improvement", "improvement_percent"]
    compared = compare.compare(paired_models(spark, sf_dir)).drop("multilingual_preserved")
    return compared.withColumns({r: micro(F.col(r)) for r in rates})


#: Every seventh sample goes by an id of its own in the baseline's table, every eleventh in the candidate's.
_APART = {"baseline": (7, 1), "candidate": (11, 2)}


def _scored_apart(spark, sf_dir, name: str, model: tuple[int, int]) -> DataFrame:
    every, place = _APART[name]
    own = F.when(F.col("sample_id") % every == 0, -(2 * F.col("sample_id") + place)).otherwise(F.col("sample_id"))
    return score_pairs(hypotheses(spark, sf_dir, model), "strict").withColumn("sample_id", own)


def _apart_sql(name: str, model: tuple[int, int]) -> str:
    every, place = _APART[name]
    return f"""SELECT *, CASE WHEN doc_id % {every} = 0 THEN -(2 * doc_id + {place}) ELSE doc_id END AS sample_id
        FROM ({scored_documents_sql('strict', *model)})"""


_PAIRED = f"""
  SELECT sample_id, coalesce(b.lang, c.lang) AS subset, b.word_edits AS b_edits, c.word_edits AS c_edits,
         b.ref_words AS b_words, c.ref_words AS c_words,
         CASE WHEN c.doc_id IS NULL THEN 'baseline only' WHEN b.doc_id IS NULL THEN 'candidate only' END AS reason
  FROM ({_apart_sql('baseline', BASELINE)}) b FULL JOIN ({_apart_sql('candidate', CANDIDATE)}) c USING (sample_id)"""


def paired_by_id(spark, sf_dir) -> DataFrame:
    """Two tables of scores, each over all documents, some of them under ids that the other lacks."""
    sides = (_scored_apart(spark, sf_dir, name, model) for name, model in (("baseline", BASELINE), ("candidate", CANDIDATE)))
    return compare.pair_with_reason(*sides, shared=["reference", "subset"])


@query(
    "pair_models",
    f"""SELECT sample_id, subset, b_edits AS baseline_word_edits, c_edits AS candidate_word_edits, reason
        FROM ({_PAIRED})""",
)
def pair_models(spark, sf_dir):
    return paired_by_id(spark, sf_dir).select(
        "sample_id", "subset", "baseline_word_edits", "candidate_word_edits", "reason"
    )


@query(
    "pairing_report",
    f"""SELECT subset, count(*) AS samples, count(*) FILTER (reason IS NULL) AS both_scored,
               count(*) FILTER (reason = 'baseline only') AS baseline_only,
               count(*) FILTER (reason = 'candidate only') AS candidate_only,
               {micro_sql("sum(b_edits) FILTER (reason IS NULL)::DOUBLE / sum(b_words) FILTER (reason IS NULL)::DOUBLE")} AS baseline_rate,
               {micro_sql("sum(c_edits) FILTER (reason IS NULL)::DOUBLE / sum(c_words) FILTER (reason IS NULL)::DOUBLE")} AS candidate_rate
        FROM ({_PAIRED}) GROUP BY subset""",
)
def pairing_report(spark, sf_dir):
    report = compare.pairing_report(paired_by_id(spark, sf_dir), "subset")
    return report.withColumns({c: micro(F.col(c)) for c in ("baseline_rate", "candidate_rate")})


@query(
    "objectives",
    f"""WITH both_models AS MATERIALIZED ({_BOTH}),
        totals AS ({_TOTALS} FROM both_models),
        languages AS (SELECT bool_and(c <= b) AS kept FROM (
          SELECT sum(b_edits)::DOUBLE / sum(ref_words)::DOUBLE AS b,
                 sum(c_edits)::DOUBLE / sum(ref_words)::DOUBLE AS c FROM both_models GROUP BY lang))
        SELECT wer_improvement, multilingual_preserved, french_quality, met::INTEGER AS met_count,
               CASE WHEN met = 3 THEN 'success' WHEN met > 0 THEN 'partial' ELSE 'failure' END AS verdict,
               CASE WHEN gain >= 15 THEN 'excellent' WHEN gain >= 5 THEN 'ideal'
                    WHEN gain > 0 THEN 'minimum' ELSE 'none' END AS band
        FROM (SELECT *, wer_improvement::INT + multilingual_preserved::INT + french_quality::INT AS met
              FROM (SELECT cw < bw AS wer_improvement, kept AS multilingual_preserved,
                           cw < bw AS french_quality, (bw - cw) / bw * 100 AS gain
                    FROM totals, languages))""",
)
def objectives(spark, sf_dir):
    judged = compare.objectives(compare.compare(paired_models(spark, sf_dir), "subset"))
    return judged.select(
        *[F.col("objectives_met")[name].alias(name) for name in compare.OBJECTIVES],
        "met_count",
        "verdict",
        improvement_band(F.col("improvement_percent")).alias("band"),
    )


@query(
    "quality_bands",
    f"""SELECT band, gain_band, count(*) AS samples
        FROM (SELECT CASE WHEN c_wer < 0.10::DOUBLE THEN 'excellent' WHEN c_wer < 0.20::DOUBLE THEN 'good'
                          WHEN c_wer < 0.30::DOUBLE THEN 'acceptable' ELSE 'to improve' END AS band,
                     CASE WHEN gain IS NULL THEN NULL WHEN gain >= 15 THEN 'excellent'
                          WHEN gain >= 5 THEN 'ideal' WHEN gain > 0 THEN 'minimum' ELSE 'none' END AS gain_band
              FROM (SELECT *, CASE WHEN b_wer = 0 THEN NULL ELSE (b_wer - c_wer) / b_wer * 100 END AS gain
                    FROM ({_BOTH})))
        GROUP BY ALL""",
)
def quality_bands(spark, sf_dir):
    paired = paired_models(spark, sf_dir)
    percent = improvement_percent(F.col("baseline_wer"), F.col("candidate_wer"))
    return paired.groupBy(
        quality_band(F.col("candidate_wer")).alias("band"),
        improvement_band(percent).alias("gain_band"),
    ).agg(F.count(F.lit(1)).alias("samples"))


@query(
    "first_examples",
    f"""SELECT doc_id AS sample_id, text AS reference, b_hyp AS baseline_hypothesis,
               c_hyp AS candidate_hypothesis FROM ({_BOTH}) ORDER BY doc_id LIMIT 3""",
)
def first_examples(spark, sf_dir):
    return compare.first_examples(paired_models(spark, sf_dir))


@query(
    "worst_examples",
    f"""SELECT doc_id AS sample_id, {micro_sql('c_wer - b_wer')} AS loss
        FROM ({_BOTH}) ORDER BY c_wer - b_wer DESC, doc_id LIMIT 10""",
)
def worst_examples(spark, sf_dir):
    worst = compare.worst_examples(paired_models(spark, sf_dir))
    return worst.select("sample_id", micro(F.col("loss")).alias("loss"))
