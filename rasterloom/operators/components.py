"""Connected components: of a table of links, and of the pixels of a mask."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.shared import discard, written

EIGHT = ((0, 1), (1, -1), (1, 0), (1, 1))
FOUR = ((0, 1), (1, 0))


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b); label is the smallest node that links reach.

    Each round, a node takes the smallest of itself and its neighbours (pre-aggregated before the shuffle),
    then that node's choice, and the links are contracted to what they now join; at least half of the nodes
    go with each round. Rounds are written to the shared folder, so that a lost executor costs one round at
    most and lineage stays short; nothing but "are links left" comes to the driver."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.filter("a <> b").distinct(), "links")
    labels = links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while links.head(1):
        low = links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("low"))
        far = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        step = written(low.join(far, "low").select("node", F.least("low", "far").alias("to")), "step")
        joined = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left")
        labels_now = written(joined.select("node", F.coalesce("to", "label").alias("label")), "labels")
        moved = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        links_now = written(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(links, labels, step)
        links, labels = links_now, labels_now
    return labels


def joined(node: np.ndarray, width: int, ways: tuple) -> np.ndarray:
    """For sorted distinct places r * width + c, the index of the first place of each one's region: larger roots
    are hooked to smaller ones and paths halved until no link is left."""
    root = np.arange(len(node))
    ends = []
    for down, right in ways:
        i = np.flatnonzero((node % width + right >= 0) & (node % width + right < width))
        other = node[i] + down * width + right
        j = np.minimum(np.searchsorted(node, other), len(node) - 1)
        ends.append(np.stack([i, j])[:, node[j] == other])
    a, b = np.concatenate(ends, axis=1)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def regions(mask: DataFrame, width: int, connectivity: int = 8, tile: int = 512) -> DataFrame:
    """r, c, label of the mask's pixels (r, c); the label is the smallest r * width + c of the region. Pixels are
    labelled inside their tile first, tile * tile of them in a task at most; only pixels at the edges of tiles are
    then linked across, looked for in half of the directions, since each link has two ends."""
    ways = EIGHT if connectivity == 8 else FOUR

    def inside(t: pa.Table) -> pa.Table:
        place = t.column("r").to_numpy().astype(np.int64) * width + t.column("c").to_numpy()
        node, at = np.unique(place, return_inverse=True)
        return t.select(["r", "c"]).append_column("label", pa.array(node[joined(node, width, ways)][at]))

    tiled = mask.select("r", "c", F.floor(F.col("r") / tile).alias("_i"), F.floor(F.col("c") / tile).alias("_j"))
    kinds = ", ".join(f"{n} {mask.schema[n].dataType.simpleString()}" for n in ("r", "c"))
    part = written(tiled.groupBy("_i", "_j").applyInArrow(inside, f"{kinds}, label long"), "regions")
    edge = part.filter((F.pmod("r", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1)))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways])).alias("w")
    ends = edge.select(F.col("label").alias("a"), "r", "c", steps).select("a", (F.col("r") + F.col("w.a")).alias("r"), (F.col("c") + F.col("w.b")).alias("c"))
    labels = components(ends.join(edge.select("r", "c", F.col("label").alias("b")), ["r", "c"]).select("a", "b"))
    whole = labels.select(F.col("node").alias("label"), F.col("label").alias("_whole"))
    return part.join(whole, "label", "left").select("r", "c", F.coalesce("_whole", "label").alias("label"))


def without_small(labelled: DataFrame, least: int = 5) -> DataFrame:
    """The pixels of regions of at least so many pixels, with the size."""
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return labelled.join(sizes, "label").filter(F.col("size") >= least)
