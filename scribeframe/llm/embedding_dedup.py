"""Near-duplicate vectors by product quantisation over inverted lists.

Coarse centroids cut the unit sphere into lists. Lists whose vectors are close
to the threshold on average form one region, so a dense group is not cut, however
many lists it fills; any other list is a region of its own. A vector lives in the
region of its nearest list, with its residual to that list coded per subspace, and
visits the ``PROBES`` nearest regions as a query. There a table lookup per subspace gives an asymmetric
distance to every code; a code is a candidate if its distance, less the stored
length of its coding error, can reach the threshold, so coding loses no link.
Candidates are decided by exact cosines in double precision. A pair counts if
either of its vectors visits the other's region; which of both regions counts it is
decided from the probes, so no pair is written out to be deduplicated.

Equal vectors are one class with a count. A shard of a region answers with link
counts per class and a spanning forest, never with pairs; large regions are dealt
in blocks of classes, every block of queries against every block of codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.llm.components import components, spanning_forest
from scribeframe.session import stage

THRESHOLD = 0.9
#: Classes a list is meant to hold, lists at most, regions a vector visits.
LIST_SIZE = 128
MOST_LISTS = 2048
PROBES = 16
#: Distinct vectors the index is trained on, in order of their hash.
SAMPLE = 16_384
SUBSPACE = 8
CODEWORDS = 256
#: Classes of one region that one task compares with as many queries.
BLOCK = 4096
_SLACK = 1e-4
#: Share of candidates from which all cosines of a block are computed at once.
_DENSE = 1 / 8


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre by Euclidean distance, in blocks."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate(
        [np.argmax(points[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(points), 4096)]
    )


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


@dataclass
class Index:
    """Centroids (lists x width) and codewords (subspaces x codewords x subspace width)."""

    centroids: np.ndarray
    codewords: np.ndarray

    @property
    def width(self) -> int:
        return self.codewords.shape[0] * self.codewords.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        count = min(count, len(self.centroids))
        near = x @ self.centroids.T - (self.centroids * self.centroids).sum(1) / 2
        some = np.argpartition(-near, count - 1, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        return np.take_along_axis(some, order, 1)

    def regions(self, threshold: float) -> np.ndarray:
        """The region of each list, named by one of its lists.

        The product of two centroids is the mean cosine between the vectors of
        their lists. Lists are joined, also by way of others, if it is at most
        as far below the threshold as the threshold is below one.
        """
        count = len(self.centroids)
        near = self.centroids @ self.centroids.T >= 2 * threshold - 1
        linked, root = spanning_forest(count, *np.nonzero(near))
        region = np.arange(count)
        region[linked] = root
        return region

    def visits(self, x: np.ndarray, region: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and the nearest regions, its own first."""
        names, first = np.unique(np.sort(region), return_index=True)
        count = min(count, len(names))
        near = x @ self.centroids.T - (self.centroids * self.centroids).sum(1) / 2
        home = np.argmax(near, 1)
        best = np.maximum.reduceat(near[:, np.argsort(region, kind="stable")], first, axis=1)
        best[np.arange(len(x)), np.searchsorted(names, region[home])] = np.inf
        some = np.argpartition(-best, count - 1, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(best, some, 1), axis=1, kind="stable")
        return home, names[np.take_along_axis(some, order, 1)]

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to the lists' centroids, and the lengths of the coding errors."""
        residual = self.padded(x - self.centroids[lists])
        step = self.codewords.shape[2]
        codes = np.empty((len(x), len(self.codewords)), np.uint8)
        for m, words in enumerate(self.codewords):
            part = residual[:, m * step : (m + 1) * step]
            codes[:, m] = _nearest(part, words)
            residual[:, m * step : (m + 1) * step] -= words[codes[:, m]]
        return codes, np.sqrt((residual * residual).sum(1))

    def lookup(self, queries: np.ndarray, centroid: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate dot products of queries with coded vectors, by table lookup.

        ``centroid`` is that of the one list of all codes, or has a row per code.
        """
        step = self.codewords.shape[2]
        wide = self.padded(queries)
        out = np.empty((len(queries), len(codes)))
        out[:] = queries @ np.atleast_2d(centroid).T
        for m, words in enumerate(self.codewords):
            out += (wide[:, m * step : (m + 1) * step] @ words.T)[:, codes[:, m]]
        return out


def build_index(sample: np.ndarray, lists: int, seed: int = 7) -> Index:
    """Train centroids and codewords on unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = _kmeans(sample, lists, rng)
    residual = sample - centroids[_nearest(sample, centroids)]
    parts = -(-sample.shape[1] // SUBSPACE)
    residual = np.pad(residual, ((0, 0), (0, parts * SUBSPACE - sample.shape[1])))
    words = [_kmeans(residual[:, m * SUBSPACE : (m + 1) * SUBSPACE], CODEWORDS, rng) for m in range(parts)]
    return Index(centroids, np.stack(words))


def _unit(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for k, value in enumerate(raw):
        own = np.frombuffer(value, "<f8")
        out[k, : len(own)] = own
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``raw``: the components in double precision, null if they can't be compared."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                own = value.as_py() if key.is_valid and value.is_valid else []
                x = np.array([np.nan if v is None else v for v in own], "<f8")
                raw.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, raw binary")


ROUTED = (
    "region int, visitor boolean, node bigint, n bigint, raw binary, "
    "home int, probes array<int>, code binary, error double"
)


def _route(classes: DataFrame, index: Index, region: np.ndarray, width: int, probes: int) -> DataFrame:
    """A row per class in its own region, and one per region that it visits."""
    names = [c.split()[0] for c in ROUTED.split(", ")]
    types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    types += [pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.float64()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                node, n, raw = (c.to_pylist() for c in batch.slice(at, 2048).columns)
                x = _unit(raw, width)
                home, near = index.visits(x, region, probes)
                codes, errors = index.code(x, home)
                rows = []
                for k, visited in enumerate(near.tolist()):
                    own = (node[k], n[k], raw[k], int(home[k]))
                    rows.append((visited[0], False, *own, visited, codes[k].tobytes(), float(errors[k])))
                    rows += [(q, True, *own, None, None, None) for q in visited]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                )

    return classes.select("node", "n", "raw").mapInArrow(run, ROUTED)


def _search(index: Index, region: np.ndarray, width: int, threshold: float):
    """The function that compares the queries and codes of one block pair."""

    def run(table: pa.Table) -> pa.Table:
        visitor = table["visitor"].to_numpy()
        codes_of, queries = table.filter(pa.array(~visitor)), table.filter(pa.array(visitor))
        empty = pa.table(
            {"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())}
        )
        if not len(codes_of) or not len(queries):
            return empty
        home = _unit(codes_of["raw"].to_pylist(), width)
        seek = _unit(queries["raw"].to_pylist(), width)
        codes = np.frombuffer(b"".join(codes_of["code"].to_pylist()), np.uint8).reshape(len(home), -1)
        error = codes_of["error"].to_numpy()
        home_node, home_n = codes_of["node"].to_numpy(), codes_of["n"].to_numpy()
        seek_node, seek_n = queries["node"].to_numpy(), queries["n"].to_numpy()
        centroids = index.centroids[codes_of["home"].to_numpy()]
        names, seek_region = np.unique(region[queries["home"].to_numpy()], return_inverse=True)
        # Whether the code's own visit counts the pair in the query's region.
        visited = np.zeros((len(home), len(names)), bool)
        for k, probes in enumerate(codes_of["probes"].to_pylist()):
            visited[k] = np.isin(names, probes)
        nodes = np.unique(np.concatenate([home_node, seek_node]))
        links = np.zeros(len(nodes), np.int64)
        home_at, seek_at = np.searchsorted(nodes, home_node), np.searchsorted(nodes, seek_node)
        found, held = [], 0
        rows = max(1, (1 << 20) // len(home))
        for at in range(0, len(seek), rows):
            part = slice(at, at + rows)
            hit = index.lookup(seek[part], centroids, codes) + error >= threshold - _SLACK
            dense = hit.mean() > _DENSE
            if dense:
                hit &= seek[part] @ home.T >= threshold
            q, h = np.nonzero(hit)
            q += at
            if not dense:
                linked = np.einsum("ij,ij->i", seek[q], home[h]) >= threshold
                q, h = q[linked], h[linked]
            other = seek_node[q] != home_node[h]
            q, h = q[other], h[other]
            np.add.at(links, seek_at[q], home_n[h])
            alone = ~visited[h, seek_region[q]]
            np.add.at(links, home_at[h[alone]], seek_n[q[alone]])
            found.append((seek_at[q], home_at[h]))
            held += len(q)
            if held > 1 << 20:
                found = [spanning_forest(len(nodes), *(np.concatenate(x) for x in zip(*found, strict=True)))]
                held = len(found[0][0])
        if not found:
            return empty
        a, b = spanning_forest(len(nodes), *(np.concatenate(x) for x in zip(*found, strict=True)))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array(np.concatenate([nodes[some], nodes[a]]), pa.int64()),
                "other": pa.array([*[None] * len(some), *nodes[b].tolist()], pa.int64()),
                "links": pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64()),
            }
        )

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """``vec_id``, ``n_links`` and ``component_id`` of every row of ``vec_id``, ``embedding``.

    Two rows are linked if their cosine is at least ``threshold``, as far as
    the probes find them; none below it is linked. Vectors that are null,
    empty or zero, that hold null or non-finite components or whose ``vec_id``
    is null link with nothing. A shorter vector counts as padded with zeros.
    Rows that repeat a vector are linked with one another; rows that share a
    ``vec_id`` stay apart as rows. ``component_id`` is the smallest ``vec_id``
    reachable, the row's own included. An empty table gives no rows.
    """
    rows = stage(_classes(vectors), "vectors")
    classes = rows.where("raw is not null").groupBy("raw").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n")
    )
    # Written out at once, so the numbers given to classes stay.
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("bytes")).first()
    if not facts["n"]:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    width = facts["bytes"] // 8
    sample = classes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()
    lists = max(1, min(MOST_LISTS, len(sample) // 8, facts["n"] // LIST_SIZE))
    index = build_index(_unit([bytes(r.raw) for r in sample], width), lists)

    region = index.regions(threshold)

    routed = stage(_route(classes, index, region, width, probes), "routed")
    # One row per region: how many blocks of codes and of queries it has.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") / block)).cast("int")
    sizes = routed.groupBy("region", "visitor").count().withColumn("blocks", blocks)
    sizes = sizes.groupBy("region").agg(
        F.max(F.when(~F.col("visitor"), F.col("blocks"))).alias("code_blocks"),
        F.max(F.when(F.col("visitor"), F.col("blocks"))).alias("query_blocks"),
    )
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("visitor"), F.col("query_blocks")).otherwise(F.col("code_blocks")))
    theirs = F.when(F.col("visitor"), F.col("code_blocks")).otherwise(F.col("query_blocks"))
    # MOST_LISTS rows at most: bounded, so broadcast. Regions without codes need no visit.
    dealt = (
        routed.join(F.broadcast(sizes.where("code_blocks is not null")), "region")
        .withColumn("mine", mine.cast("int"))
        .withColumn("theirs", F.explode(F.sequence(F.lit(0), theirs - 1)))
        .withColumn("code_block", F.when(F.col("visitor"), F.col("theirs")).otherwise(F.col("mine")))
        .withColumn("query_block", F.when(F.col("visitor"), F.col("mine")).otherwise(F.col("theirs")))
        .select(*routed.columns, "code_block", "query_block")
    )
    found = stage(
        dealt.groupBy("region", "code_block", "query_block").applyInArrow(
            _search(index, region, width, threshold), "node bigint, other bigint, links bigint"
        ),
        "found",
    )
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = (
        classes.join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = rooted.select("raw", "n_links", "root").join(least, "root")
    # Staged, so that the join beside it can split a vector that very many rows share.
    by_vector = stage(by_vector.select("raw", "n_links", "component_id"), "by-vector")
    return rows.join(by_vector, "raw", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
