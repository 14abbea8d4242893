"""Toxicity by compression distance.

Two zstandard dictionaries are compared window by window: one trained on
ordinary text, and one that holds, before the same content at the same
distances, content trained on toxic text. A window is toxic by as many bytes as the toxic
dictionary saves. What the toxic part learns from is the text of toxic
documents that ordinary text does not explain: words that are, whole or by a
character n-gram, far more frequent among toxic documents, by document rates, and
words with an n-gram that no ordinary training document has. The gains of a document's windows give
a few numbers, and a logistic fit on other labelled documents, weighted to the
true share of toxic ones, calibrates them to a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeframe.llm.arrow_parts import parts

WINDOW_BYTES = 64
BASE_BYTES = 8192
TOXIC_BYTES = 1024
#: Bytes that the trainer picks at a time for the ordinary and the toxic content.
BASE_SEGMENT, TOXIC_SEGMENT = 64, 20
_HEADER_BYTES = 200
LEVEL = 9
GRAM = 4
#: How many times the ordinary document rate, counted as if ``SLACK`` more had it, a toxic one is.
RATIO, SLACK = 5, 3
#: Labelled documents collected for training, per class, and their length at most.
SAMPLE_TOXIC = 3000
SAMPLE_ORDINARY = 6000
SAMPLE_CHARS = 16_384
#: Windows of an ordinary text that the ordinary dictionary is trained on, at least; at most all
#: of them and less than twice as many.
BASE_WINDOWS = 12


def windows(text: str, size: int = WINDOW_BYTES) -> list[bytes]:
    """The whole lower-cased text in windows cut at spaces; one empty window for no text."""
    raw, out, at = text.lower().encode(), [], 0
    while at < len(raw):
        end = min(len(raw), at + size)
        if end < len(raw):
            space = raw.rfind(b" ", at + 1, end)
            end = space if space > 0 else end
        out.append(raw[at:end])
        at = end
    return out or [b""]


def _grams(word: str) -> set[str]:
    word = f"^{word}$"
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def _rates(texts: list[str]) -> Counter:
    """In how many texts each n-gram and each whole word occurs."""
    counts: Counter = Counter()
    for text in texts:
        words = set(text.lower().split())
        counts.update(set().union(*map(_grams, words)) | {(w,) for w in words})
    return counts


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary: its last ``size`` bytes, without the header."""
    import zstandard

    try:
        held = zstandard.train_dictionary(size + _HEADER_BYTES, samples, level=LEVEL, k=segment, d=6)
    except zstandard.ZstdError:  # too little text for the trainer
        return b"".join(samples)[-size:]
    return held.as_bytes()[-size:]


def _compressor(content: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=WINDOW_BYTES,
        dict_size=len(content),
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


def _numbers(gains: np.ndarray) -> list[float]:
    """What a document's window gains say about it."""
    ranked = np.sort(gains)[::-1]
    most, mean = ranked[0], ranked.mean()
    return [
        most,
        ranked[:2].mean(),
        mean,
        *[(gains >= n).mean() for n in (2, 3, 4)],
        *[np.log1p((gains >= n).sum()) for n in (3, 5)],
        *[float(most >= n) for n in (4, 6)],
        np.log(len(gains)),
        most * most,
        mean * mean,
        np.log1p(max(gains.sum(), 0)),
    ]


@dataclass
class ToxicityModel:
    """Two dictionaries and a calibration; ``constant`` where there was nothing to learn."""

    ordinary: bytes = b""
    toxic: bytes = b""
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float | None = None

    def open(self) -> ToxicityScorer:
        return ToxicityScorer(self)


class ToxicityScorer:
    """A model with its compressors, on one worker."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        if model.constant is None:
            self.by_ordinary = _compressor(model.ordinary)
            self.by_toxic = _compressor(model.toxic)

    def gains(self, text: str) -> np.ndarray:
        ordinary, toxic = self.by_ordinary.compress, self.by_toxic.compress
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.float64)

    def numbers(self, text: str) -> list[float]:
        return _numbers(self.gains(text))

    def __call__(self, text: str) -> float:
        model = self.model
        if model.constant is not None:
            return model.constant
        x = (np.array(self.numbers(text)) - model.centre) / model.scale
        z = float(x @ model.weights[:-1] + model.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _dictionaries(toxic: list[str], ordinary: list[str], base_windows: int = BASE_WINDOWS) -> ToxicityModel:
    in_toxic, in_ordinary = _rates(toxic), _rates(ordinary)
    telling = {
        f
        for f, n in in_toxic.items()
        if n * len(ordinary) >= RATIO * (in_ordinary[f] + SLACK) * len(toxic)
        or (isinstance(f, str) and f not in in_ordinary)
    }
    novel = [[w for w in t.lower().split() if (w,) in telling or not _grams(w).isdisjoint(telling)] for t in toxic]
    novel = [" ".join(words).encode() for words in novel if words]
    spread = [w for v in map(windows, ordinary) for w in v[:: max(1, len(v) // base_windows)]]
    base = _trained(spread, BASE_BYTES, BASE_SEGMENT)
    pieces = [n[i : i + WINDOW_BYTES] for n in novel for i in range(0, len(n), WINDOW_BYTES)]
    extra = _trained(pieces, TOXIC_BYTES, TOXIC_SEGMENT)
    return ToxicityModel(ordinary=base, toxic=extra + base)


def fit(
    toxic: list[str], ordinary: list[str], toxic_share: float, base_windows: int = BASE_WINDOWS
) -> ToxicityModel:
    """Train on two lists of whole texts.

    Dictionaries from either half score the other half, and the calibration
    learns from those scores; the dictionaries of the model come from all. The
    ordinary dictionary is trained on every n-th window of each ordinary text,
    the largest n that leaves ``base_windows`` of them, so that long texts don't
    outweigh short ones; words, rates and scores are from all windows.
    """
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel(constant=float(toxic_share))
    rows, marks = [], []
    for k in (0, 1):
        scorer = _dictionaries(toxic[k::2], ordinary[k::2], base_windows).open()
        for mark, texts in ((1.0, toxic[1 - k :: 2]), (0.0, ordinary[1 - k :: 2])):
            rows += [scorer.numbers(t) for t in texts]
            marks += [mark] * len(texts)
    model = _dictionaries(toxic, ordinary, base_windows)
    x, y = np.array(rows), np.array(marks)
    share = float(np.clip(toxic_share, 1e-3, 1 - 1e-3))
    weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary)) * len(y)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    x = np.c_[(x - model.centre) / model.scale, np.ones(len(x))]
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    model.weights = w
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is 0 modulo 5.

    A null id counts as the empty text, whose remainder is 0.
    """
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from labelled rows that aren't held out.

    The driver collects at most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` whole
    texts of at most ``SAMPLE_CHARS`` characters, in order of the hash of their
    id; ``fit`` says which windows of them the ordinary dictionary sees. Rows labelled both ways count as toxic; null labels and null texts are
    left out. With fewer than two texts of a class, the model is a constant:
    the toxic share of the labels, or 0 without labels.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    marked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        part = marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    # At most SAMPLE_TOXIC + SAMPLE_ORDINARY ids: bounded, so broadcast.
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(order, "text")
    share = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    found = rows.select("toxic", "text").limit(2 * (SAMPLE_TOXIC + SAMPLE_ORDINARY)).collect()
    return fit([r.text for r in found if r.toxic == 1], [r.text for r in found if r.toxic == 0], share)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row's whole text.

    ``score`` is the probability that the text is toxic, ``predicted`` 1 from
    0.5. A null text counts as empty, and an empty text has a score too.
    ``doc_id`` is passed through, null or repeated; rows are independent;
    other columns are ignored. The model's some ten kilobytes go with the task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = model.open()
        for batch in parts(batches):
            scores = [scorer(value.as_py() or "") for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                ["doc_id", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows whose text isn't predicted toxic, all their columns unchanged."""

    def run(batches):
        scorer = model.open()
        for batch in parts(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([scorer(t.as_py() or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
