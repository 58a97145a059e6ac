"""Agreement of a graph with a reference network."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .spatial import nearest


def _scores(matched, ours, theirs) -> list:
    precision, recall = F.coalesce(F.try_divide(matched, ours), F.lit(0.0)), F.coalesce(F.try_divide(matched, theirs), F.lit(0.0))
    return [precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))]


def snapped(nodes: DataFrame, reference: DataFrame, snap_m: float) -> DataFrame:
    """(id, id_b, dist_m): the nearest reference node of each node, within snap_m."""
    left = nodes.select("id", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    right = reference.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return nearest(left, right, snap_m).select("id", "id_b", "dist_m")


def matched_edges(edges: DataFrame, reference_edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Our edges (edge_idx, u, v) whose snapped ends are the ends u < v of a reference edge."""
    ends = edges.join(snaps.select(F.col("id").alias("source"), F.col("id_b").alias("a")), "source").join(snaps.select(F.col("id").alias("target"), F.col("id_b").alias("b")), "target")
    pairs = reference_edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    return ends.select("edge_idx", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).join(pairs, ["u", "v"], "left_semi")


def topology_scores(nodes: DataFrame, edges: DataFrame, ref_nodes: DataFrame, ref_edges: DataFrame, snap_m: float = 10.0) -> DataFrame:
    """One row of node and edge precision, recall and F1.

    A reference node counts once however many of our nodes snap to it; our edges count each.
    """
    snaps = saved(snapped(nodes, ref_nodes, snap_m))
    distinct_pairs = ref_edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    counts = snaps.agg(F.count_distinct("id_b").alias("mn"))
    for df, name in ((nodes, "n"), (ref_nodes, "rn"), (matched_edges(edges, ref_edges, snaps), "me"), (edges, "e"), (distinct_pairs, "re")):
        counts = counts.crossJoin(df.agg(F.count("*").alias(name)))
    node, edge = _scores(F.col("mn"), F.col("n"), F.col("rn")), _scores(F.col("me"), F.col("e"), F.col("re"))
    names = ("precision", "recall", "f1")
    return counts.select(F.col("mn").alias("matched_nodes"), F.col("me").alias("matched_edges"), *(c.alias(f"node_{n}") for c, n in zip(node, names, strict=True)), *(F.least(c, F.lit(1.0)).alias(f"edge_{n}") if n != "f1" else c.alias("edge_f1") for c, n in zip(edge, names, strict=True)))


def subsample_interval(nodes: DataFrame, edges: DataFrame, ref_nodes: DataFrame, ref_edges: DataFrame, samples: int = 100, share: float = 0.8, snap_m: float = 10.0) -> DataFrame:
    """(mean, ci_low, ci_high) of the edge F1 over subsamples, drawn without replacement, of the reference edges.

    A sample keeps the share of edges with the least MD5 of sample and edge: any engine can redo it.
    """
    from pyspark.sql import Window

    pairs = saved(ref_edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct())
    hits = matched_edges(edges, ref_edges, snapped(nodes, ref_nodes, snap_m)).groupBy("u", "v").agg(F.count("*").alias("hits"))
    n, ours = pairs.count(), edges.count()
    keep = max(1, int(n * share))
    drawn = pairs.join(hits, ["u", "v"], "left").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.md5(F.concat_ws("-", "sample", "u", "v")), "u", "v"))
    found = drawn.withColumn("rank", rank).where(F.col("rank") <= keep).groupBy("sample").agg(F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
    scored = found.select(_scores(F.col("hits"), F.lit(max(ours, 1)), F.lit(keep))[2].alias("f1"))
    return scored.agg(F.avg("f1").alias("mean"), F.percentile("f1", F.lit(0.025)).alias("ci_low"), F.percentile("f1", F.lit(0.975)).alias("ci_high"))


def greedy_matches(predicted: DataFrame, reference: DataFrame, degrees: float = 0.00027) -> DataFrame:
    """(id, id_b): each predicted node, in order of id, takes the first unused reference node within a planar distance.

    The outcome depends on that order. Rounds run it for all at once: a predicted node takes its
    first free candidate when no earlier one that is still waiting could take it.
    """
    step = degrees * 1.001
    a = predicted.select("id", "lat", "lon", F.floor(F.col("lat") / step).alias("r"), F.floor(F.col("lon") / step).alias("c"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = a.withColumn("d", F.explode(around)).withColumn("r", F.col("r") + F.col("d")).withColumn("d", F.explode(around)).withColumn("c", F.col("c") + F.col("d"))
    b = reference.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.floor(F.col("lat") / step).alias("r"), F.floor(F.col("lon") / step).alias("c"))
    apart = F.sqrt(F.pow(F.col("lat") - F.col("lat_b"), 2) + F.pow(F.col("lon") - F.col("lon_b"), 2))
    open_pairs = saved(a.join(b, ["r", "c"]).where(apart < degrees).select("id", "id_b"))
    done = open_pairs.limit(0)
    while not open_pairs.isEmpty():
        first = open_pairs.groupBy("id").agg(F.min("id_b").alias("id_b"))
        earliest = open_pairs.groupBy("id_b").agg(F.min("id").alias("id"))
        now = saved(first.join(earliest, ["id", "id_b"]).select("id", "id_b"))
        done = saved(done.union(now))
        open_pairs = saved(open_pairs.join(now.select("id"), "id", "left_anti").join(now.select("id_b"), "id_b", "left_anti").select("id", "id_b"))
    return done


def overall_score(contract_ok, node_f1, edge_f1, lcc_share, lcc_ok):
    """The mean of the five scores."""
    return (F.when(contract_ok, 1.0).otherwise(0.0) + node_f1 + edge_f1 + lcc_share + F.when(lcc_ok, 1.0).otherwise(0.0)) / 5
