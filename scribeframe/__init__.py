"""Speech-transcript tables on Spark: read, match, clean, score, compare, prepare."""

from scribeframe.functions.metrics import error_rate, improvement_band, quality_band
from scribeframe.functions.text import normalize_basic, normalize_eval, normalize_strict
from scribeframe.operators.hooks import transcribe
from scribeframe.operators.scoring import error_rates, score_pairs

__all__ = [
    "error_rate",
    "error_rates",
    "improvement_band",
    "normalize_basic",
    "normalize_eval",
    "normalize_strict",
    "quality_band",
    "score_pairs",
    "transcribe",
]
