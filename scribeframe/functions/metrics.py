"""Error rates, bands and objective tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribeframe.functions.text import not_blank

# Upper limits of the quality bands and lower limits of the
# improvement bands (percent).
QUALITY_LIMITS = (("excellent", 0.10), ("good", 0.20), ("acceptable", 0.30))
QUALITY_REST = "to improve"
IMPROVEMENT_LIMITS = (("excellent", 15.0), ("ideal", 5.0))


def error_rate(edits: Column, units: Column, hyp_units: Column, ref: Column, hyp: Column) -> Column:
    """Edits per reference unit; may exceed 1.0.

    A blank reference scores 1.0 against a non-blank hypothesis and 0.0
    otherwise. The same rule holds for a reference that normalises to nothing.
    """
    blank_ref = F.when(not_blank(hyp), 1.0).otherwise(0.0)
    empty_ref = F.when(hyp_units > 0, 1.0).otherwise(0.0)
    return (
        F.when(ref.isNull() | hyp.isNull(), F.lit(None).cast("double"))
        .when(~not_blank(ref), blank_ref)
        .when(units == 0, empty_ref)
        .otherwise(edits / units)
    )


def improvement(baseline: Column, candidate: Column) -> Column:
    """Absolute gain: positive when the candidate makes fewer errors."""
    return baseline - candidate


def improvement_percent(baseline: Column, candidate: Column) -> Column:
    """Gain relative to the baseline in percent; null when the baseline is zero."""
    return F.try_divide(baseline - candidate, baseline) * 100


def quality_band(rate: Column) -> Column:
    """Half-open bands: 0.10 is already ``good``, 0.30 already ``to improve``."""
    band = F.when(rate.isNull(), F.lit(None).cast("string"))
    for name, limit in QUALITY_LIMITS:
        band = band.when(rate < limit, name)
    return band.otherwise(QUALITY_REST)


def improvement_band(percent: Column) -> Column:
    """``excellent`` from 15 %, ``ideal`` from 5 %, ``minimum`` above zero, else ``none``."""
    band = F.when(percent.isNull(), F.lit(None).cast("string"))
    for name, limit in IMPROVEMENT_LIMITS:
        band = band.when(percent >= limit, name)
    return band.when(percent > 0, "minimum").otherwise("none")
