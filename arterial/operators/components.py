"""Connected components, of one graph or of many at once."""

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved

FINISH = 2_000_000  # links that one task may hold


def solve(keys: list[str]):
    """A kernel that labels all nodes of its links (*keys, a, b) with the least node of their component."""

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        links = pd.concat(parts, ignore_index=True)
        ends = pd.concat([links[[*keys, end]].set_axis([*keys, "x"], axis=1) for end in ("a", "b")], ignore_index=True)
        nodes = ends.drop_duplicates().sort_values([*keys, "x"], ignore_index=True)
        at = ends.merge(nodes.reset_index(names="_i"), on=[*keys, "x"], how="left")["_i"].to_numpy()
        x, y, up = at[: len(links)], at[len(links) :], np.arange(len(nodes))
        while True:
            low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(up, high[apart], low[apart])
            while not np.array_equal(up[up], up):
                up = up[up]
        yield nodes.assign(y=nodes["x"].to_numpy()[up])

    return kernel


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), node: str = "id", ends: tuple[str, str] = ("source", "target"), finish: int = FINISH) -> DataFrame:
    """(*keys, node, component): component is the smallest node id that edges reach.

    While many links are left, every round hooks each node to the neighbour, itself
    included, with the least fresh hash and contracts the graph, so stars and paths alike
    shrink geometrically. Once no more than `finish` are left, a constant, one task solves
    the rest. keys separate graphs or scenarios that are solved together.
    """
    keys = list(keys)
    a, b = ends
    links = saved(edges.select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())
    found = nodes.select(*keys, F.col(node).alias("node")).distinct().withColumn("root", F.col("node"))
    kinds = dict(links.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "") + "x long, y long"
    for r in range(60):
        few = links.limit(finish + 1).count() <= finish
        if few:
            hooks = saved(links.coalesce(1).mapInPandas(solve(keys), schema))
        else:
            both = links.union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
            other, own = (F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("id")) for c in ("b", "a"))
            hooks = saved(both.groupBy(*keys, "a").agg(F.min(other).alias("n")).select(*keys, F.col("a").alias("x"), F.least(own, "n")["id"].alias("y")))
        found = saved(found.join(hooks.withColumnsRenamed({"x": "root", "y": "next"}), [*keys, "root"], "left").select(*keys, "node", F.coalesce("next", "root").alias("root")))
        if few:
            break
        links = links.join(hooks.withColumnsRenamed({"x": "a", "y": "a2"}), [*keys, "a"]).join(hooks.withColumnsRenamed({"x": "b", "y": "b2"}), [*keys, "b"]).where("a2 <> b2")
        links = saved(links.select(*keys, F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    least = found.groupBy(*keys, "root").agg(F.min("node").alias("component"))
    return found.join(least, [*keys, "root"]).select(*keys, F.col("node").alias(node), "component")


def component_sizes(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*keys, "component").agg(F.count("*").alias("n_nodes"))


def connectivity(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), least_share: float = 0.60) -> DataFrame:
    """One row a graph: nodes, components, share of the largest, isolated and small ones, mean size, pass, sizes."""
    sizes = component_sizes(components(nodes, edges, keys), keys)
    total: Column = F.sum("n_nodes")
    out = sizes.groupBy(*keys) if keys else sizes
    return out.agg(
        total.alias("n_nodes"),
        F.count("*").alias("n_components"),
        F.max("n_nodes").alias("lcc_nodes"),
        (F.max("n_nodes") / total).alias("lcc_share"),
        F.sum(F.when(F.col("n_nodes") == 1, 1).otherwise(0)).alias("n_isolated"),
        F.sum(F.when(F.col("n_nodes") < 5, 1).otherwise(0)).alias("n_small"),
        F.avg("n_nodes").alias("mean_size"),
        (F.max("n_nodes") / total >= least_share).alias("passes"),
        F.sort_array(F.collect_list("n_nodes"), asc=False).alias("sizes"),
    )
