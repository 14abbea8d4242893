"""Connected components over link tables, in Spark, without collecting links.

Each round every node takes the smallest of itself and its neighbours, in an
order that a hash of the round shuffles anew, and the links are contracted to
those images. A round removes a constant share of the nodes on any shape of
graph, chains and stars included, so rounds grow with the logarithm of the
largest component. Minima are combined before the shuffle, so a node with very
many links costs its tasks a row each; every round's tables are written to the
shared work folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.session import release, stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of the links ``a``, ``b``.

    Nodes of one component, and only those, share a root, which is one of
    them. Links may repeat, in either direction, and link a node with itself;
    nodes without another node don't appear. Links with a null end are
    ignored. No links give no rows.
    """
    kind = links.schema["a"].dataType
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stage(links.distinct(), "links")
    images: list[DataFrame] = []
    while links.head(1):
        turn = F.lit(len(images))
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("n")))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("n"))
        nearest = ends.groupBy("a").agg(least.alias("least"))
        image = stage(
            nearest.select(F.col("a").alias("node"), F.least(own, F.col("least"))["n"].alias("image")),
            "images",
        )
        left = image.select(F.col("node").alias("a"), F.col("image").alias("x"))
        right = image.select(F.col("node").alias("b"), F.col("image").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y")
        contracted = stage(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        release(links)
        links = contracted
        images.append(image)
    if not images:
        return links.select(F.col("a").alias("node"), F.col("b").cast(kind).alias("root"))
    roots = images[0].withColumnRenamed("image", "root")
    for image in images[1:]:
        later = image.select(F.col("node").alias("root"), "image")
        roots = roots.join(later, "root", "left").select(
            "node", F.coalesce("image", "root").alias("root")
        )
    return roots


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most ``n - 1`` links between indices below ``n`` that connect what ``a``-``b`` connect."""
    label = np.arange(n)
    while len(a):
        left, right = label[a], label[b]
        apart = left != right
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]
