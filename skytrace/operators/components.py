"""Connected components for grid graphs.

Edges whose ends share a spatial tile are solved tile by tile (a tile holds a bounded number of cells, whatever the
scan holds). What remains is a much smaller graph of tile components, contracted in rounds of
min-neighbour hooking and pointer jumping; every round ends in a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.session import SALTS, cut


def _tile_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest node id reachable inside one tile, for every node of the tile's edges."""
    n = len(pdf)
    ids, pos = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
    a, b = pos[:n], pos[n:]
    label = np.arange(len(ids))
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        hooked = label.copy()
        np.minimum.at(hooked, la, low)
        np.minimum.at(hooked, lb, low)
        hooked = hooked[hooked]
        if np.array_equal(hooked, label):
            break
        label = hooked
    return pd.DataFrame({"node": ids, "label": ids[label]})


def _map_ends(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Replace both edge ends by table[end] (unchanged if absent). A hub's edges are spread over salts."""
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for end, other in (("src", "dst"), ("dst", "src")):
        lookup = salted.select(F.col("node").alias(end), F.col("label").alias("_to"), "_salt")
        edges = (
            edges.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
            .join(lookup, [end, "_salt"], "left")
            .withColumn(end, F.coalesce("_to", end))
            .drop("_to", "_salt")
        )
    return _simple(edges)


def _simple(edges: DataFrame) -> DataFrame:
    return (
        edges.where("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def _contract(edges: DataFrame) -> DataFrame | None:
    """(node, label) for every node of a general edge list; None if there are no edges."""
    levels: list[DataFrame] = []
    edges = cut(edges)
    while not edges.isEmpty():
        both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        parent = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
        for _ in range(2):
            parent = _jump(parent)
        parent = cut(parent)
        levels.append(parent)
        edges = cut(_map_ends(edges, parent))
    if not levels:
        return None
    table = levels[-1]
    for finer in reversed(levels[:-1]):
        # every coarser node is the label of a finer one, so following the labels covers all nodes
        table = _follow(finer, table)
    return table


def _follow(table: DataFrame, through: DataFrame) -> DataFrame:
    spread = table.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    lookup = through.select(F.col("node").alias("label"), F.col("label").alias("_to")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return spread.join(lookup, ["label", "_salt"], "left").select("node", F.coalesce("_to", "label").alias("label"))


def _jump(parent: DataFrame) -> DataFrame:
    return _follow(parent, parent)


def connected_components(edges: DataFrame, one_tile: bool = False) -> DataFrame:
    """Components of ``edges(src, dst, src_tile, dst_tile)`` as (node, label), label = smallest node id.

    ``one_tile`` promises that no edge crosses tiles (every scan fits into one).
    """
    if not one_tile:
        edges = cut(edges)
    local_edges = edges.where("src_tile = dst_tile AND src <> dst").select(F.col("src_tile").alias("tile"), "src", "dst")
    local = cut(local_edges.groupBy("tile").applyInPandas(_tile_labels, "node bigint, label bigint"))
    if one_tile:
        return local
    # a node lies in one tile, so it has at most one local label
    across = edges.where("src_tile <> dst_tile").select("src", "dst")
    for end in ("src", "dst"):
        lookup = local.select(F.col("node").alias(end), F.col("label").alias("_to"))
        across = across.join(lookup, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    table = _contract(_simple(across))
    if table is None:
        return local
    table = cut(table)
    lonely = table.join(local.select("node"), "node", "left_anti")
    return _follow(local, table).unionByName(lonely)
