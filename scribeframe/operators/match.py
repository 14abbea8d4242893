"""Join transcripts, audio and hypotheses by name.

All joins are equi-joins on names that are unique within their folder, so no
key is hot; the join strategy is left to the planner and its size statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages of the validation report, with the path after them.
MISSING = {"audio_path": "Missing audio: ", "ref_path": "Missing reference: "}

# Order in which audio is looked up beside a transcript, and
# beside a course transcript. The first hit wins.
TRANSCRIPT_AUDIO = ("wav", "mp3", "flac", "m4a")
COURSE_AUDIO = ("wav", "mp3", "flac")


def match_audio_references(audio: DataFrame, references: DataFrame) -> DataFrame:
    """Every audio row with its reference or, in ``reason``, the lack of one.

    References without audio are ignored.
    """
    found = references.select("subset", "stem", "reference", F.lit(True).alias("_found"))
    joined = audio.join(found, ["subset", "stem"], "left")
    reason = F.when(F.col("_found").isNull(), "no reference")
    return joined.withColumn("reason", reason).drop("_found")


def extension_rank(extension: Column, order: Sequence[str] = TRANSCRIPT_AUDIO) -> Column:
    """Place of an extension in the look-up order; null when it is not in it."""
    place = F.array_position(F.array(*[F.lit(e) for e in order]), extension)
    return F.nullif(place, F.lit(0))


def preferred_audio(
    audio: DataFrame, keys: Sequence[str], rank: Column, path: str = "path"
) -> DataFrame:
    """One audio path per key: the one of lowest rank; rows without a rank are left out.

    ``min_by`` combines on the map side, so copies never meet in one task.
    """
    ranked = audio.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = F.min_by(path, F.struct("_rank", path))
    return ranked.groupBy(*keys).agg(best.alias("audio_path"))


def attach_preferred_audio(
    texts: DataFrame,
    audio: DataFrame,
    keys: Sequence[str] = ("stem",),
    order: Sequence[str] = TRANSCRIPT_AUDIO,
    folder_rank: str | None = None,
) -> DataFrame:
    """Every text with its best audio path and, where there is none, ``reason``.

    With ``folder_rank`` the folder order comes first and the extension second.
    """
    rank = extension_rank(F.col("extension"), order)
    if folder_rank is not None:
        rank = F.col(folder_rank) * 10 + rank
    best = preferred_audio(audio, keys, rank)
    joined = texts.join(best, list(keys), "left")
    return joined.withColumn("reason", F.when(F.col("audio_path").isNull(), "no audio"))


def texts_with_audio(
    texts: DataFrame,
    audio: DataFrame,
    keys: Sequence[str] = ("stem",),
    order: Sequence[str] = TRANSCRIPT_AUDIO,
) -> DataFrame:
    """Texts whose stem has audio in any accepted format."""
    return texts.join(_accepted(audio, order), list(keys), "left_semi")


def texts_without_audio(
    texts: DataFrame,
    audio: DataFrame,
    keys: Sequence[str] = ("stem",),
    order: Sequence[str] = TRANSCRIPT_AUDIO,
) -> DataFrame:
    return texts.join(_accepted(audio, order), list(keys), "left_anti")


def _accepted(audio: DataFrame, order: Sequence[str]) -> DataFrame:
    return audio.filter(F.col("extension").isin(*order))


def plain_path(path: Column, root: str | None = None) -> Column:
    """A path without scheme and authority, doubled slashes single; relative ones below ``root``."""
    bare = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    if root is not None:
        bare = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), bare))
        bare = F.regexp_replace(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    return F.regexp_replace(bare, "/{2,}", "/")


def missing_files(
    metadata: DataFrame, audio_paths: DataFrame, ref_paths: DataFrame, root: str | None = None
) -> DataFrame:
    """One row per path that the metadata names and the listings lack.

    Listings name files by URI and metadata by plain path, so both are compared
    as plain paths. ``root`` is the folder that relative metadata paths start from.
    """
    def lacking(column: str, listing: DataFrame) -> DataFrame:
        listed = listing.select(plain_path(F.col("path")).alias("_path"))
        named = metadata.withColumn("_path", plain_path(F.col(column), root))
        return named.join(listed, "_path", "left_anti").select(
            "id", F.concat(F.lit(MISSING[column]), F.coalesce(column, F.lit(""))).alias("error")
        )

    return lacking("audio_path", audio_paths).unionByName(lacking("ref_path", ref_paths))
