"""Exact search for the highest inner products, without random access.

Candidates are dealt in blocks. In a block every component has a list of its
values, sorted, which a query reads from the top where its own component is
positive and from the bottom where it is negative. All lists are read to the
same depth, step by step. What is read of a candidate and, for the rest, the
last values read or the far ends of the lists bound its score from above and
from below; both bounds of all candidates are products of the queries with the
rows, clipped to what is read. Reading stops for a query when no candidate
outside a small set can reach its k-th lower bound, unseen ones included. The
scores of that set are then resolved in one sequential pass over the rows.

A query first searches the block it lives in; the k-th score found there is the
floor that candidates of all other blocks must reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scribeframe.llm.integer_vectors import (
    BLOCK,
    LEAST,
    block_of,
    blocks_of,
    exact_kind,
    first_by_score,
    foremost,
    integer_rows,
    matrix,
)
from scribeframe.session import stage

K = 5
#: Shares of the lists after which the bounds are looked at.
STEPS = 4
#: Candidates that may be left when reading stops, for each of the k.
RESOLVED = 16
#: Bounds of queries and candidates that are held at once.
_CELLS = 1 << 22


def nra_search(
    rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the indices and scores of its ``k`` first rows, among those that reach its floor.

    ``own`` is the index of the query's own row, or -1.
    """
    n, kind = len(rows), exact_kind(rows, queries)
    rows, queries = rows.astype(kind), queries.astype(kind)
    lists = np.sort(rows, axis=0)
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    floors = floors.astype(kind)
    out: list = [None] * len(queries)
    reading = np.arange(len(queries))
    depths = sorted({-(-n * step // STEPS) for step in range(1, STEPS + 1)})
    for depth in depths:
        from_top, from_bottom = lists[n - depth], lists[depth - 1]
        above = np.hstack([np.maximum(rows, from_top), np.minimum(rows, from_bottom)]).T
        below = np.hstack(
            [np.where(rows >= from_top, rows, lists[0]), np.where(rows <= from_bottom, rows, lists[-1])]
        ).T
        step = max(1, _CELLS // n)
        left = []
        for at in range(0, len(reading), step):
            part = reading[at : at + step]
            upper = signed[part] @ above
            lower = upper if depth == n else signed[part] @ below
            inside = np.flatnonzero(own[part] >= 0)
            for bound in (upper, lower):
                bound[inside, own[part][inside]] = LEAST
            if n > k:
                floors[part] = np.maximum(floors[part], np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = upper >= floors[part][:, None]
            open_[inside, own[part][inside]] = False
            few = (open_.sum(1) <= RESOLVED * k) | (depth == n)
            for i in np.flatnonzero(few):
                some = np.flatnonzero(open_[i])
                scores = rows[some] @ queries[part[i]]
                first = first_by_score(scores, ids[some], k)
                first = first[scores[first] >= floors[part[i]]]
                out[part[i]] = some[first], scores[first].astype(np.int64)
            left.append(part[~few])
        reading = np.concatenate(left)
        if not len(reading):
            break
    return out


FOUND = "query_id bigint, query bigint, vec_id bigint, score bigint"


def _search(width: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table["asks"].to_numpy()
        queries, held = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        columns = [[], [], [], []]
        if len(queries) and len(held):
            node, ids = held["node"].to_numpy(), held["vec_id"].to_numpy()
            at = {number: index for index, number in enumerate(node.tolist())}
            numbers = queries["node"].to_pylist()
            own = np.array([at.get(number, -1) for number in numbers])
            floors = np.array([LEAST if f is None else f for f in queries["floor"].to_pylist()], np.int64)
            found = nra_search(matrix(held, width), ids, matrix(queries, width), own, floors, k)
            sizes = [len(index) for index, _ in found]
            index = np.concatenate([index for index, _ in found])
            columns = [
                np.repeat(queries["vec_id"].to_numpy(), sizes),
                np.repeat(np.array(numbers, np.int64), sizes),
                ids[index],
                np.concatenate([scores for _, scores in found]),
            ]
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns, strict=True)})

    return run


def _pass(asking: DataFrame, held: DataFrame, width: int, k: int) -> DataFrame:
    """Search of queries in candidates that meet in a block."""
    columns = ["block", "part", "vec_id", "node", "x"]
    rows = held.select(*columns, F.lit(None).cast("bigint").alias("floor"), F.lit(False).alias("asks"))
    rows = rows.unionByName(asking.select(*columns, "floor", F.lit(True).alias("asks")))
    return rows.groupBy("block", "part").applyInArrow(_search(width, k), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_scores(vectors: DataFrame, every: int, k: int = K, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` first rows.

    ``vectors`` has ``vec_id`` (a whole number) and ``embedding``; queries are the rows whose
    ``vec_id`` is divisible by ``every`` and candidates all rows but the
    query's own. Scores are inner products of the floored 256-folds of the
    components; higher ones come first, ties by smaller ``vec_id``; fewer
    candidates give fewer rows. Null ids and vectors, and vectors with null or
    non-finite components, take no part; a shorter vector counts as padded with
    zeros, an empty one scores 0. Equal rows are one row; rows that share an id
    but not the vector are rows of their own, and each is a candidate of the
    others. Other columns are ignored; an empty table gives no rows.
    """
    rows = integer_rows(vectors)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    width = facts["width"] or 0
    # One more than k, as a query's own row is not among its candidates.
    held = stage(foremost(rows, ["x"], k + 1), "candidates")
    blocks = blocks_of(held.count(), block)
    asking = rows.where(F.col("vec_id") % every == 0)
    parts = blocks_of(asking.count(), block)
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int")
    no_floor = F.lit(None).cast("bigint")
    asking = asking.withColumn("home", block_of(blocks)).withColumn("part", part)
    dealt = held.withColumn("block", block_of(blocks)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    at_home = asking.withColumn("block", F.col("home")).withColumn("floor", no_floor)
    near = stage(_pass(at_home, dealt, width, k), "found-at-home")
    if blocks > 1:
        floors = stage(near.groupBy("query").agg(F.min("score").alias("floor"), F.count("*").alias("n")), "floors")
        floors = floors.select(F.col("query").alias("node"), F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
        others = F.array_remove(F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("home"))
        away = asking.join(floors, "node", "left").withColumn("block", F.explode(others))
        near = near.unionByName(_pass(away, dealt, width, k))
    return _first(near, k).select("query_id", "rank", "vec_id", "score")
