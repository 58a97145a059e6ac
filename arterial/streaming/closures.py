"""An extension: road closures as a stream. The batch engine has no counterpart.

Events (ts, edge_idx, closed) keep the latest state of each edge; for every batch the
efficiency of the network without the closed edges is computed afresh.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.network import global_efficiency


def closure_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Closures by tumbling window and edge, late events up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "edge_idx").agg(F.sum(F.col("closed").cast("long")).alias("n_closed"))


def latest_state(events: DataFrame) -> DataFrame:
    """(edge_idx, closed) after the last event of each edge; equal times: closed wins."""
    return events.groupBy("edge_idx").agg(F.max_by("closed", F.struct("ts", "closed")).alias("closed"))


def watch(events: DataFrame, nodes: DataFrame, edges: DataFrame, report: Callable[[int, float], None], checkpoint: str):
    """Start a query that reports (batch, efficiency) after each batch of closures."""
    state = {"closed": None}

    def on_batch(batch: DataFrame, number: int) -> None:
        new = {r.edge_idx: r.closed for r in latest_state(batch).collect()}
        state["closed"] = {k for k in (state["closed"] or set()) | set(new) if new.get(k, True)}
        left = edges.where(~F.col("edge_idx").isin(list(state["closed"]))) if state["closed"] else edges
        report(number, global_efficiency(nodes, left).first()[0])

    return events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()
