"""Hard negatives by Fagin's threshold algorithm.

Candidates are dealt in blocks. In a block every component has a list of its
values, sorted; an anchor reads it from the top where its own component is
positive and from the bottom where it is negative, all lists to the same depth,
step by step. Each candidate that turns up is looked up and scored exactly. No
candidate still unseen scores more than the threshold, the anchor's product
with the last values read; reading stops once it is strictly below the k-th
score in each window, or below the window itself.

An anchor's positives come first, from blocks of its own label. Each positive
opens a window of scores, and all windows of an anchor are filled in one
reading of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.llm.integer_vectors import (
    BLOCK,
    block_of,
    blocks_of,
    exact_kind,
    first_by_score,
    foremost,
    integer_rows,
    matrix,
)
from scribeframe.session import stage

POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score, in hundredths of the positive's, both included.
LOW, HIGH = 50, 95
#: Shares of the lists, one over, after which the threshold is looked at.
STEPS = (64, 16, 4, 2, 1)


class Lists:
    """The sorted lists of a block's rows."""

    def __init__(self, rows: np.ndarray, kind: type):
        self.rows = rows.astype(kind)
        self.sorted = np.sort(self.rows, axis=0)
        self.depths = sorted({-(-len(rows) // step) for step in STEPS})

    def seen(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """Which rows (columns of the result) the anchors have met in some list at a depth."""
        top, bottom = self.sorted[len(self.rows) - depth], self.sorted[depth - 1]
        met = np.hstack([self.rows >= top, self.rows <= bottom]).astype(np.float32)
        read = np.hstack([anchors > 0, anchors < 0]).astype(np.float32)
        return read @ met.T > 0

    def thresholds(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        top, bottom = self.sorted[len(self.rows) - depth], self.sorted[depth - 1]
        return np.maximum(anchors, 0) @ top + np.minimum(anchors, 0) @ bottom


def _inside(scores: np.ndarray, positive: int | None) -> np.ndarray:
    """Which scores lie in the window of a positive; no positive is a window of all scores."""
    if positive is None:
        return np.ones(len(scores), bool)
    return (100 * scores >= LOW * positive) & (100 * scores <= HIGH * positive)


def ta_search(
    rows: np.ndarray, ids: np.ndarray, anchors: np.ndarray, wanted, windows: list[list[int | None]], k: int
) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each anchor and window the indices and scores of the ``k`` first wanted rows in it.

    ``wanted(i)`` says which rows may answer the i-th anchor.
    """
    kind = exact_kind(100 * np.ones((1, 1), np.int64) * np.abs(rows).max(initial=1), anchors)
    lists, anchors = Lists(rows, kind), anchors.astype(kind)
    allowed = [wanted(i) for i in range(len(anchors))]
    met = [np.zeros(len(rows), bool) for _ in anchors]
    known = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in anchors]
    reading = [i for i in range(len(anchors)) if allowed[i].any() and windows[i]]
    for depth in lists.depths:
        if not reading:
            break
        some = np.array(reading)
        seen = lists.seen(anchors[some], depth)
        if depth == len(rows):
            seen[:] = True  # also rows that no list leads to: the anchor's components are all zero
        limits = lists.thresholds(anchors[some], depth)
        left = []
        for i, now, limit in zip(reading, seen, limits, strict=True):
            new = np.flatnonzero(now & ~met[i] & allowed[i])
            met[i] |= now
            index, scores = known[i]
            index = np.concatenate([index, new])
            scores = np.concatenate([scores, lists.rows[new] @ anchors[i]])
            known[i] = index, scores
            if not _settled(scores, limit, windows[i], k) and not met[i].all():
                left.append(i)
        reading = left
    out = []
    for (index, scores), own in zip(known, windows, strict=True):
        found = []
        for positive in own:
            inside = np.flatnonzero(_inside(scores, positive))
            first = inside[first_by_score(scores[inside], ids[index[inside]], k)]
            found.append((index[first], scores[first].astype(np.int64)))
        out.append(found)
    return out


def _settled(scores: np.ndarray, limit, windows: list[int | None], k: int) -> bool:
    """Whether nothing that scores the limit or less can enter any window's first ``k``."""
    for positive in windows:
        if positive is not None and 100 * limit < LOW * positive:
            continue
        inside = scores[_inside(scores, positive)]
        if len(inside) < k or limit >= np.partition(inside, len(inside) - k)[len(inside) - k]:
            return False
    return True


FOUND = "anchor_id bigint, anchor bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def _search(width: int, k: int, same: bool):
    """Positives of anchors in a block of their label, or negatives in a block of all labels."""

    def run(table: pa.Table) -> pa.Table:
        asked = table["asks"].to_numpy()
        asking, held = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        columns: list[list] = [[] for _ in FOUND.split(", ")]
        if len(asking) and len(held):
            node, ids, label = (held[c].to_numpy() for c in ("node", "vec_id", "label"))
            anchor, anchor_id, anchor_label = (asking[c].to_numpy() for c in ("node", "vec_id", "label"))
            positives = [p or [] for p in asking["positives"].to_pylist()]

            def wanted(i: int) -> np.ndarray:
                return (label == anchor_label[i]) & (node != anchor[i]) if same else label != anchor_label[i]

            windows = [[None]] * len(asking) if same else [[p["positive_score"] for p in own] for own in positives]
            found = ta_search(matrix(held, width), ids, matrix(asking, width), wanted, windows, k)
            for i, answers in enumerate(found):
                for w, (index, scores) in enumerate(answers):
                    about = [None, None] if same else [positives[i][w]["positive_id"], positives[i][w]["positive_score"]]
                    for one, score in zip(ids[index].tolist(), scores.tolist(), strict=True):
                        row = [int(anchor_id[i]), int(anchor[i]), *about, one, score]
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns, strict=True)})

    return run


PAIRS = "array<struct<positive_id:bigint,positive_score:bigint>>"


def _pass(keys: list[str], asking: DataFrame, held: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    columns = [*dict.fromkeys([*keys, "label"]), "vec_id", "node", "x"]
    rows = held.select(*columns, F.lit(None).cast(PAIRS).alias("positives"), F.lit(False).alias("asks"))
    rows = rows.unionByName(asking.select(*columns, "positives", F.lit(True).alias("asks")))
    return rows.groupBy(*keys).applyInArrow(_search(width, k, same), FOUND)


def _first(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(anchors: DataFrame, rows: DataFrame, width: int, k: int, block: int) -> DataFrame:
    """The first ``k`` other rows of each anchor's label; blocks are dealt within each label."""
    # One more than k, as an anchor is not a candidate of its own.
    held = stage(foremost(rows, ["label", "x"], k + 1), "positive-candidates")
    asked = anchors.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    sizes = held.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(asked, "label")
    sizes = stage(sizes, "label-sizes")
    hashed = F.xxhash64("node")
    there = (
        held.join(sizes, "label")
        .withColumn("block", F.pmod(hashed, "blocks").cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    asking = (
        anchors.join(sizes, "label")
        .withColumn("part", F.pmod(hashed, "parts").cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("positives", F.lit(None).cast(PAIRS))
    )
    found = _pass(["label", "block", "part"], asking, there, width, k, same=True)
    return _first(found, ["anchor"], k).select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )


def mine_negatives(
    vectors: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has ``vec_id``, ``label`` (whole numbers) and ``embedding``;
    anchors are the rows whose ``vec_id`` is divisible by ``every``. Scores are
    inner products of the floored 256-folds of the components; higher ones come
    first, ties by smaller ``vec_id``. An anchor's positives are its first
    other rows of the same label; its negatives for a positive are the first
    rows of other labels whose score is ``LOW`` to ``HIGH`` hundredths of the
    positive's. A window without rows gives none, as does a negative positive
    score. Rows with a null id, label, vector or component, or a component that
    is not finite, take no part; a shorter vector counts as padded with zeros.
    Equal rows are one row; rows that share an id but not label or vector are
    rows of their own. Other columns are ignored; an empty table gives no rows.
    """
    numbered = integer_rows(vectors.where("label is not null"), "label")
    rows = numbered.withColumn("label", F.col("label").cast("bigint"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    width = facts["width"] or 0
    anchors = rows.where(F.col("vec_id") % every == 0)
    pairs = F.struct("positive_id", "positive_score")
    found = _positives(anchors, rows, width, positives, block).groupBy("anchor").agg(F.collect_list(pairs).alias("positives"))
    asking = stage(anchors.join(found.withColumnRenamed("anchor", "node"), "node"), "anchors")
    held = stage(foremost(rows, ["label", "x"], negatives), "negative-candidates")
    blocks, parts = blocks_of(held.count(), block), blocks_of(asking.count(), block)
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int")
    there = held.withColumn("block", block_of(blocks)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    here = asking.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    mined = _pass(["block", "part"], here, there, width, negatives, same=False)
    return _first(mined, ["anchor_id", "anchor", "positive_id", "positive_score"], negatives).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
