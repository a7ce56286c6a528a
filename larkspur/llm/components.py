"""Connected components of a graph of links, distributed.

``forest`` replaces the links inside one task by a spanning forest, ``components`` contracts all links by
alternating large-star and small-star steps, each of which is two aggregations and two joins, until every
node points at the smallest node of its component. A node with very many links is aggregated before the
shuffle; nothing is gathered on the driver but a count and a checksum a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.session import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node (but the smallest of its component) to the smallest, given links a - b."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], m)
        np.minimum.at(new, label[y], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (src, dst: long) but those that are the smallest of their component; root is that smallest node. No links give no rows; self-links and null ends are ignored."""
    e = links.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = cut(e, free=True)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
