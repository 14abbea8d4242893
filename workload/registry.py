"""Registry of queries and the pieces of SQL and Spark they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.functions.text import words
from scribeframe.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# A word that occurs in none of the tables. Deleting words and replacing words
# by it gives a text whose edit distance is known without alignment: every
# unknown word needs an edit of its own, and the lengths need one per word
# missing, so the distance is (unknown words) + (length lost). The same holds
# for characters.
UNKNOWN = "ж"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for CPU-heavy steps, dealt out by their id however the file is cut."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def misheard(normalized: Column, drop_every: int, mask_every: int) -> Column:
    """A hypothesis: every n-th word missing, every m-th of the others not understood."""
    def hear(word: Column, index: Column) -> Column:
        number = index + 1
        return (
            F.when(number % drop_every == 0, F.lit(None).cast("string"))
            .when(number % mask_every == 0, UNKNOWN)
            .otherwise(word)
        )

    return F.array_join(F.transform(words(normalized), hear), " ")


def micro(value: Column) -> Column:
    """Six decimals by the same floating-point steps in both engines."""
    return F.floor(value * 1_000_000 + 0.5) / 1_000_000


def micro_sql(value: str) -> str:
    return f"(floor(({value}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"


# RE2's \s is ASCII only; these are all characters Unicode calls white space,
# and the four separators U+001C to U+001F.
WS_SQL = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def squeeze_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{WS_SQL}]+', ' ', 'g'))"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')"


def strict_sql(text: str) -> str:
    return squeeze_sql(rf"regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_{WS_SQL}]', '', 'g')")


def eval_sql(text: str) -> str:
    bare = rf"regexp_replace(lower({text}), '\p{{P}}', '', 'g')"
    return strip_sql(f"regexp_replace({bare}, '[{WS_SQL}]{{2,}}', ' ', 'g')")


def basic_sql(text: str) -> str:
    spoken = rf"regexp_replace(lower({text}), '[<\[][^>\]]*[>\]]', '', 'g')"
    spoken = rf"regexp_replace({spoken}, '\([^)]+\)', '', 'g')"
    return squeeze_sql(rf"lower(regexp_replace({spoken}, '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g'))")


NORMALIZED_SQL = {"strict": strict_sql, "eval": eval_sql, "basic": basic_sql}


def words_sql(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


def misheard_sql(word_list: str, drop_every: int, mask_every: int) -> str:
    return (
        f"array_to_string(list_filter(list_transform({word_list}, lambda x, i: "
        f"CASE WHEN i % {drop_every} = 0 THEN NULL WHEN i % {mask_every} = 0 THEN '{UNKNOWN}' "
        f"ELSE x END), lambda x: x IS NOT NULL), ' ')"
    )


def scored_documents_sql(profile: str, drop_every: int, mask_every: int) -> str:
    """CTE body: every document with the known edit counts of its hypothesis."""
    return f"""
      SELECT *,
             len({words_sql('hyp')})::BIGINT AS hyp_words,
             length(hyp)::BIGINT AS hyp_chars,
             (len(list_filter({words_sql('hyp')}, lambda x: x = '{UNKNOWN}'))
              + ref_words - len({words_sql('hyp')}))::BIGINT AS word_edits,
             (length(hyp) - length(replace(hyp, '{UNKNOWN}', ''))
              + ref_chars - length(hyp))::BIGINT AS char_edits
      FROM (SELECT doc_id, lang, source, text, norm, len(w)::BIGINT AS ref_words,
                   length(norm)::BIGINT AS ref_chars, {misheard_sql('w', drop_every, mask_every)} AS hyp
            FROM (SELECT *, {words_sql('norm')} AS w
                  FROM (SELECT *, {NORMALIZED_SQL[profile]('text')} AS norm FROM documents)))"""


def rate_sql(edits: str, units: str, hyp_units: str) -> str:
    return (
        f"CASE WHEN {units} = 0 THEN CASE WHEN {hyp_units} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
        f"ELSE {edits}::DOUBLE / {units}::DOUBLE END"
    )
