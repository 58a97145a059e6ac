"""Connected components of a graph given by its links."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

FINISH = 2_000_000  # links, 16 bytes each, that one task may hold


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, sorted, and the least node of each one's component: hooking and pointer jumping on arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[up]
        np.minimum.at(up, high[apart], low[apart])
        while (jumped := up[up]).tobytes() != up.tobytes():
            up = jumped


def _finish(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, roots = union_find(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(roots[i : i + (1 << 16)])], ["x", "y"])


def components(links: DataFrame, finish: int = FINISH, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b: bigint); equal roots: connected.

    Each round hooks every node to the neighbour, itself included, with the least
    hash (a fresh hash in each round) and contracts the graph accordingly. Nodes with
    the greatest hash among their neighbours vanish, so the number of nodes falls
    geometrically, in stars as in paths. The minimum is combined before the shuffle,
    so a hub's links needn't meet in one task. Once no more than `finish` links are
    left, a constant, one task solves the rest. Nothing but counts reaches the driver.
    """
    edges = saved(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    for r in range(max_rounds):
        few = edges.limit(finish + 1).count() <= finish
        if few:
            hook = saved(edges.coalesce(1).mapInArrow(_finish, "x long, y long"))
        else:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            other, own = (F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("id")) for c in ("b", "a"))
            hook = saved(both.groupBy("a").agg(F.min(other).alias("n")).select(F.col("a").alias("x"), F.least(own, "n")["id"].alias("y")))
        if mapping is None:
            mapping = hook.toDF("node", "root")
        else:
            mapping = saved(mapping.join(hook.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        if few:
            return mapping
        edges = edges.join(hook.toDF("a", "a2"), "a").join(hook.toDF("b", "b2"), "b").where("a2 <> b2")
        edges = saved(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    raise RuntimeError(f"no convergence in {max_rounds} rounds")
