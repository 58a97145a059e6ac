"""Shortest paths, centrality, efficiency and what-if scenarios.

A road graph is simple and undirected. Graphs up to MAX_EDGES edges travel to the
executors as one adjacency of checked size; work is dealt out by scenario and block of
sources, so neither many scenarios nor many sources meet in one task. Beyond that
size distances come from relational relaxation, round by round.
"""

import heapq
import math
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_atan2
from ..schema import COLLAPSE_THRESHOLD
from ..storage import saved

MAX_EDGES = 2_000_000
SOURCES_PER_ROW = 64
TIE = 1e-12
PLACE_BLOCK = 512  # ids of a place in one row


def simple_edges(edges: DataFrame, keep: str = "last") -> DataFrame:
    """The simple graph: one edge (source < target) a pair, of parallel ones the last, the first or the shortest; loops stay."""
    order = {"last": -F.col("edge_idx").cast("double"), "first": F.col("edge_idx").cast("double"), "shortest": F.col("weight_m")}[keep]
    names = [c for c in edges.columns if c not in ("source", "target")]
    pairs = edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), F.struct(order.alias("_o"), "edge_idx", *[c for c in edges.columns if c != "edge_idx"]).alias("e"))
    best = pairs.groupBy("u", "v").agg(F.min_by("e", F.struct("e._o", "e.edge_idx")).alias("e"))
    return best.select(F.col("u").alias("source"), F.col("v").alias("target"), *(F.col(f"e.{c}").alias(c) for c in names))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node: a loop counts 2, parallel edges 1, isolated nodes 0."""
    pairs = edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """The nodes of the highest degree over n - 1."""
    n = nodes.count()
    return degrees(nodes, edges).select("id", (F.col("degree") / max(n - 1, 1)).alias("centrality")).orderBy(F.desc("centrality"), "id").limit(top)


def without(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the removed nodes (id) and their edges."""
    gone = removed.select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def lost_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The edges that touch a removed node."""
    gone = [r.id for r in removed.select("id").limit(1001).collect()]
    if len(gone) <= 1000:
        return edges.where(F.col("source").isin(gone) | F.col("target").isin(gone))
    touch = edges.select("source", "target").join(removed.select("id"), (F.col("source") == F.col("id")) | (F.col("target") == F.col("id")), "left_semi").distinct()
    return edges.join(touch, ["source", "target"], "left_semi")


@dataclass
class Adjacency:
    """A graph in rows of neighbours; node i is ids[i], in the order of ids."""

    ids: np.ndarray
    start: np.ndarray
    to: list[int]
    weight: list[float]

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> "Adjacency":
        simple = simple_edges(edges).select("source", "target", "weight_m")
        if edges.limit(MAX_EDGES + 1).count() > MAX_EDGES or nodes.limit(MAX_EDGES + 1).count() > MAX_EDGES:
            raise ValueError("the graph is too large for one adjacency; use relaxed_distances")
        ids = np.sort(nodes.select("id").distinct().toPandas()["id"].to_numpy())
        e = simple.toPandas()
        u, v, w = np.searchsorted(ids, e["source"].to_numpy()), np.searchsorted(ids, e["target"].to_numpy()), e["weight_m"].fillna(1.0).to_numpy(float)
        loop = u == v
        a, b, w = np.concatenate([u, v[~loop]]), np.concatenate([v, u[~loop]]), np.concatenate([w, w[~loop]])
        order = np.lexsort((b, a))
        return Adjacency(ids, np.searchsorted(a[order], np.arange(len(ids) + 1)), b[order].tolist(), w[order].tolist())

    def distances(self, source: int, gone: frozenset[int] = frozenset()) -> dict[int, float]:
        """Shortest distances from source to what it reaches, itself included."""
        done: dict[int, float] = {}
        queue = [(0.0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done[x] = d
            for i in range(self.start[x], self.start[x + 1]):
                y = self.to[i]
                if y not in done and y not in gone:
                    heapq.heappush(queue, (d + self.weight[i], y))
        return done

    def flows(self, source: int, gone: frozenset[int] = frozenset()) -> dict[tuple[int, int], float]:
        """What all shortest paths from source put on each edge, by back-propagation in order of distance."""
        done: dict[int, float] = {}
        paths, before = {source: 1.0}, {source: []}
        best = {source: 0.0}
        queue, order = [(0.0, source)], []
        while queue:
            d, x = heapq.heappop(queue)
            if x in done:
                continue
            done[x] = d
            order.append(x)
            for i in range(self.start[x], self.start[x + 1]):
                y = self.to[i]
                if y in gone or y == x:
                    continue
                new = d + self.weight[i]
                old = best.get(y, math.inf)
                if new < old - TIE:
                    best[y], paths[y], before[y] = new, paths[x], [x]
                    heapq.heappush(queue, (new, y))
                elif abs(new - old) <= TIE and y not in done:
                    paths[y] += paths[x]
                    before[y].append(x)
        share = dict.fromkeys(order, 0.0)
        out: dict[tuple[int, int], float] = {}
        for y in reversed(order):
            for x in before[y]:
                flow = paths[x] / paths[y] * (1 + share[y])
                share[x] += flow
                out[min(x, y), max(x, y)] = out.get((min(x, y), max(x, y)), 0.0) + flow
        return out

    def betweenness(self, gone: frozenset[int] = frozenset()) -> dict[tuple[int, int], float]:
        left = [x for x in range(len(self.ids)) if x not in gone]
        out: dict[tuple[int, int], float] = {}
        for s in left:
            for edge, flow in self.flows(s, gone).items():
                out[edge] = out.get(edge, 0.0) + flow
        n = len(left)
        return {e: f / (n * (n - 1)) for e, f in out.items()} if n > 1 else {}

    def efficiency(self, gone: frozenset[int] = frozenset()) -> float:
        left = [x for x in range(len(self.ids)) if x not in gone]
        n = len(left)
        return sum(1 / d for s in left for t, d in self.distances(s, gone).items() if t != s) / (n * (n - 1)) if n > 1 else 0.0


def _sources(adjacency: Adjacency, sources: Sequence[int] | None) -> list[int]:
    return list(range(len(adjacency.ids))) if sources is None else np.searchsorted(adjacency.ids, np.array(sorted(sources))).tolist()


def _dealt(spark, positions: list[int]) -> DataFrame:
    """Blocks of node positions, a row a block, spread over the cluster."""
    blocks = [(i, positions[i : i + SOURCES_PER_ROW // 4]) for i in range(0, len(positions), SOURCES_PER_ROW // 4)]
    return spark.createDataFrame(blocks, "block long, at array<long>").repartition(max(1, min(len(blocks), 4 * spark.sparkContext.defaultParallelism)))


def distances(nodes: DataFrame, edges: DataFrame, sources: Sequence[int] | None = None) -> DataFrame:
    """(src, dst, d) for every source and each node it reaches."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(adjacency := Adjacency.of(nodes, edges))

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for batch in batches:
            for s in (x for at in batch["at"] for x in at):
                found = graph.distances(int(s))
                yield pd.DataFrame({"src": graph.ids[s], "dst": graph.ids[list(found)], "d": list(found.values())})

    return _dealt(spark, _sources(adjacency, sources)).mapInPandas(solve, "src long, dst long, d double")


def relaxed_distances(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), rounds: int = 10_000) -> DataFrame:
    """(*keys, src, dst, d) by relaxing the frontier until nothing improves; for graphs of any size. sources: (*keys, id)."""
    keys = list(keys)
    steps = edges.select(*keys, F.col("source").alias("dst"), F.col("target").alias("to"), "weight_m")
    steps = saved(steps.union(steps.select(*keys, "to", "dst", "weight_m")))
    best = sources.select(*keys, F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d"))
    frontier = best = saved(best)
    for _ in range(rounds):
        reached = frontier.join(steps, [*keys, "dst"]).groupBy(*keys, "src", F.col("to").alias("dst")).agg(F.min(F.col("d") + F.col("weight_m")).alias("new"))
        frontier = saved(reached.join(best, [*keys, "src", "dst"], "left").where("d is null or new < d").select(*keys, "src", "dst", F.col("new").alias("d")))
        if frontier.isEmpty():
            return best
        best = saved(best.union(frontier).groupBy(*keys, "src", "dst").agg(F.min("d").alias("d")))
    raise RuntimeError(f"no convergence in {rounds} rounds")


def route(nodes: DataFrame, edges: DataFrame, source: int, target: int) -> DataFrame:
    """The nodes of a shortest path in order, with the distance from its start; no rows without one."""
    from_source, from_target = (distances(nodes, edges, [x]).select(F.col("dst").alias("id"), F.col("d").alias(n)) for x, n in ((source, "d"), (target, "rest")))
    both = from_source.join(from_target, "id")
    whole = both.where(F.col("id") == target).select(F.col("d").alias("length"))
    # of equally short paths the one through the smallest ids at each distance
    on_path = both.crossJoin(whole).where(F.abs(F.col("d") + F.col("rest") - F.col("length")) <= 1e-9 * (1 + F.col("length")))
    return on_path.groupBy("d").agg(F.min("id").alias("id")).select("id", "d").orderBy("d")


def edge_betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, ebc), u < v: the share of ordered pairs whose shortest paths use an edge, split over ties; every edge has a row."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(adjacency := Adjacency.of(nodes, edges))
    n = len(adjacency.ids)

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, total = shared.value, {}
        for batch in batches:
            for s in (x for at in batch["at"] for x in at):
                for edge, flow in graph.flows(int(s)).items():
                    total[edge] = total.get(edge, 0.0) + flow
        if total:
            at = np.array(list(total))
            yield pd.DataFrame({"u": graph.ids[at[:, 0]], "v": graph.ids[at[:, 1]], "flow": list(total.values())})

    flows = _dealt(spark, _sources(adjacency, None)).mapInPandas(solve, "u long, v long, flow double").groupBy("u", "v").agg(F.sum("flow").alias("flow"))
    pairs = edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u <> v").distinct()
    return pairs.join(flows, ["u", "v"], "left").select("u", "v", (F.coalesce("flow", F.lit(0.0)) / max(n * (n - 1), 1)).alias("ebc"))


def node_criticality(nodes: DataFrame, ebc: DataFrame) -> DataFrame:
    """(id, crit): the betweenness of a node's edges over the greatest such sum; all 0 if that is 0."""
    ends = ebc.select(F.col("u").alias("id"), "ebc").union(ebc.select(F.col("v").alias("id"), "ebc")).groupBy("id").agg(F.sum("ebc").alias("s"))
    sums = nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    top = sums.agg(F.max("s").alias("top"))
    return sums.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(0.0).alias("crit"))


def choke_points(crit: DataFrame, top: int = 10) -> DataFrame:
    """The most critical nodes; scores are compared to nine digits, ties go to the smaller id."""
    return crit.orderBy(F.desc(F.round("crit", 9)), "id").limit(top)


def sampled_pairs(nodes: DataFrame, k: int, seed: int = 42) -> list[tuple[int, int]]:
    """K distinct unordered pairs, all of them if there are no more."""
    ids = sorted(r.id for r in nodes.select("id").collect())
    if k >= math.comb(len(ids), 2):
        return [(u, v) for i, u in enumerate(ids) for v in ids[i + 1 :]]
    rng, out = random.Random(seed), set()
    while len(out) < k:
        u, v = rng.sample(ids, 2)
        out.add((min(u, v), max(u, v)))
    return sorted(out)


def pair_distances(nodes: DataFrame, edges: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(u, v, d) of the given pairs; d is null where there is no path."""
    wanted = nodes.sparkSession.createDataFrame(pairs, "u long, v long")
    found = distances(nodes, edges, sorted({u for u, _ in pairs})).select(F.col("src").alias("u"), F.col("dst").alias("v"), "d")
    return wanted.join(found, ["u", "v"], "left")


def approximate_efficiency(pairs: DataFrame) -> DataFrame:
    """Mean and standard error of 1 / d over the reachable sampled pairs."""
    inverse = F.try_divide(F.lit(1.0), F.col("d"))
    return pairs.where("d is not null").agg(F.avg(inverse).alias("efficiency"), (F.stddev_samp(inverse) / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n_pairs"))


def impacts(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """One row for each scenario of removed (scenario_id, id; a null id removes nothing).

    efficiency: over the nodes left. survival_all_pairs: pairs still connected over all pairs of the whole
    graph; survival_active_pairs: over the pairs of nodes left. stretch: mean of d' / d - 1 over connected pairs.
    Work is dealt out by scenario and block of sources.
    """
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(adjacency := Adjacency.of(nodes, edges))
    n = len(adjacency.ids)
    blocks = -(-n // SOURCES_PER_ROW)
    scenarios = removed.groupBy("scenario_id").agg(F.collect_set("id").alias("gone")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))))

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, base = shared.value, {}
        place = {int(x): i for i, x in enumerate(graph.ids)}
        for batch in batches:
            rows = []
            for scenario, ids, block in batch.itertuples(index=False):
                gone = frozenset(place[x] for x in ids if x in place)
                inverse = connected = stretch = 0.0
                for s in range(block * SOURCES_PER_ROW, min(n, (block + 1) * SOURCES_PER_ROW)):
                    if s in gone:
                        continue
                    whole = base.get(s)
                    if whole is None:
                        if len(base) >= 4 * SOURCES_PER_ROW:
                            base.clear()
                        whole = base[s] = graph.distances(s)
                    for t, d in (graph.distances(s, gone) if gone else whole).items():
                        if t != s:
                            inverse += 1 / d
                            if t > s:
                                connected += 1
                                stretch += d / whole[t] - 1
                rows.append((scenario, len(gone), inverse, connected, stretch))
            yield pd.DataFrame(rows, columns=["scenario_id", "n_removed", "inverse", "connected", "stretch"])

    parts = scenarios.repartition(4 * spark.sparkContext.defaultParallelism, "scenario_id", "block").mapInPandas(solve, "scenario_id long, n_removed long, inverse double, connected double, stretch double")
    left = F.lit(n) - F.max("n_removed")
    pairs = left * (left - 1)
    return parts.groupBy("scenario_id").agg(
        F.max("n_removed").alias("n_removed"),
        F.coalesce(F.try_divide(F.sum("inverse"), pairs), F.lit(0.0)).alias("efficiency"),
        (F.sum("connected") / max(math.comb(n, 2), 1)).alias("survival_all_pairs"),
        F.coalesce(F.try_divide(F.sum("connected"), pairs / 2), F.lit(0.0)).alias("survival_active_pairs"),
        F.coalesce(F.try_divide(F.sum("stretch"), F.sum("connected")), F.lit(0.0)).alias("stretch"),
    )


def global_efficiency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (efficiency): the mean of 1 / d over ordered pairs; unreachable pairs add 0."""
    return impacts(nodes, edges, nodes.sparkSession.createDataFrame([(0, None)], "scenario_id long, id long")).select("efficiency")


def delay_penalty(baseline, efficiency):
    """Baseline / efficiency - 1; null where either isn't positive (no travel at all)."""
    return F.when((efficiency > 0) & (baseline > 0), baseline / F.nullif(efficiency, F.lit(0.0)) - 1)


def resilience_index(baseline, efficiency):
    """Efficiency / baseline; 0 where the baseline isn't positive."""
    return F.when(baseline > 0, efficiency / F.nullif(baseline, F.lit(0.0))).otherwise(0.0)


def leave_one_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, efficiency, penalty, index) for closing each node in turn, all in one job."""
    all_in = nodes.sparkSession.createDataFrame([(-1, None)], "scenario_id long, id long")
    found = impacts(nodes, edges, nodes.select(F.col("id").alias("scenario_id"), "id").union(all_in))
    baseline = found.where("scenario_id = -1").select(F.col("efficiency").alias("baseline"))
    out = found.where("scenario_id <> -1").crossJoin(F.broadcast(baseline))
    return out.select(F.col("scenario_id").alias("id"), "efficiency", delay_penalty(F.col("baseline"), F.col("efficiency")).alias("penalty"), resilience_index(F.col("baseline"), F.col("efficiency")).alias("index"))


def ablation(nodes: DataFrame, edges: DataFrame, crit: DataFrame, threshold: float = COLLAPSE_THRESHOLD, first: int = 8) -> DataFrame:
    """The trajectory (step, removed_node, efficiency, penalty, index) of removing nodes by falling criticality.

    It ends at the first penalty over the threshold. Steps are evaluated in batches that
    double in size, each batch in one job, so an early collapse costs little.
    """
    spark = nodes.sparkSession
    order = [r.id for r in crit.orderBy(F.desc(F.round("crit", 9)), "id").collect()]
    baseline = global_efficiency(nodes, edges).first()[0]
    rows, at, size = [], 0, first
    while at < len(order):
        steps = range(at + 1, min(at + size, len(order)) + 1)
        removed = spark.createDataFrame([(k, x) for k in steps for x in order[:k]], "scenario_id long, id long")
        for r in sorted(impacts(nodes, edges, removed).collect(), key=lambda r: r.scenario_id):
            penalty = baseline / r.efficiency - 1 if r.efficiency > 0 and baseline > 0 else None
            rows.append((r.scenario_id, order[r.scenario_id - 1], r.efficiency, penalty, r.efficiency / baseline if baseline > 0 else 0.0))
            if penalty is None or penalty > threshold:
                return spark.createDataFrame(rows, TRAJECTORY)
        at, size = at + size, size * 2
    return spark.createDataFrame(rows, TRAJECTORY)


TRAJECTORY = "step long, removed_node long, efficiency double, penalty double, index double"


def threshold_sweep(trajectory: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold the first step whose penalty exceeds it (a missing penalty exceeds all), or null."""
    limits = trajectory.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    over = limits.join(trajectory, F.col("penalty").isNull() | (F.col("penalty") > F.col("threshold")), "left")
    return over.groupBy("threshold").agg(F.min("step").alias("removals"))


def hashed_scenarios(nodes: DataFrame, scenarios: int, k: int, first: int = 0) -> DataFrame:
    """(scenario_id, id): in each scenario the k nodes with the least MD5 of scenario and id; any engine can redo it."""
    from pyspark.sql import Window

    rows = nodes.select("id").withColumn("scenario_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + scenarios - 1).cast("long"))))
    rank = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.md5(F.concat_ws("-", "scenario_id", "id")), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("scenario_id", "id")


def seeded_scenarios(nodes: DataFrame, scenarios: int, k: int, seed: int = 42) -> DataFrame:
    """(scenario_id, id) drawn by Python's generator over the nodes in order."""
    ids, rng = sorted(r.id for r in nodes.select("id").collect()), random.Random(seed)
    return nodes.sparkSession.createDataFrame([(s, x) for s in range(scenarios) for x in rng.sample(ids, min(k, len(ids)))], "scenario_id long, id long")


def monte_carlo(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: means and 95 % half-widths (1.96 standard errors) of survival and stretch over scenarios."""
    half = lambda c: F.coalesce(1.96 * F.stddev_samp(c) / F.sqrt(F.count("*")), F.lit(0.0))
    found = impacts(nodes, edges, removed)
    return found.agg(F.count("*").alias("n_scenarios"), *(f(c).alias(f"{n}_{c}") for c in ("survival_all_pairs", "survival_active_pairs", "stretch") for n, f in (("mean", F.avg), ("ci", half))))


def k_sweep(nodes: DataFrame, edges: DataFrame, ks: Sequence[int], scenarios: int = 25) -> DataFrame:
    """(k, survival, stretch): Monte Carlo for each k, all in one job."""
    removed = None
    for i, k in enumerate(ks):
        part = hashed_scenarios(nodes, scenarios, k, i * scenarios)
        removed = part if removed is None else removed.union(part)
    found = impacts(nodes, edges, removed).withColumn("at", F.floor(F.col("scenario_id") / scenarios).cast("int"))
    named = F.element_at(F.array(*(F.lit(int(k)) for k in ks)), F.col("at") + 1)
    return found.groupBy(named.alias("k")).agg(F.avg("survival_all_pairs").alias("survival"), F.avg("stretch").alias("stretch"))


def sampled_survival(nodes: DataFrame, edges: DataFrame, removed: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(scenario_id, survival, stretch) over given pairs; pairs with a removed end are left out, pairs unconnected from the start count as failed."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(Adjacency.of(nodes, edges))

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        place = {int(x): i for i, x in enumerate(graph.ids)}
        by_source: dict[int, list[int]] = {}
        for u, v in pairs:
            by_source.setdefault(place[u], []).append(place[v])
        for batch in batches:
            rows = []
            for scenario, ids in batch.itertuples(index=False):
                gone, active, alive, stretch = frozenset(place[x] for x in ids if x in place), 0, 0, 0.0
                for s, targets in by_source.items():
                    if s in gone:
                        continue
                    now, whole = graph.distances(s, gone), graph.distances(s)
                    for t in targets:
                        if t not in gone:
                            active += 1
                            if t in now:
                                alive += 1
                                stretch += now[t] / whole[t] - 1
                rows.append((scenario, alive / active if active else 0.0, stretch / alive if alive else 0.0))
            yield pd.DataFrame(rows, columns=["scenario_id", "survival", "stretch"])

    grouped = removed.groupBy("scenario_id").agg(F.collect_set("id").alias("gone"))
    return grouped.repartition(4 * spark.sparkContext.defaultParallelism, "scenario_id").mapInPandas(solve, "scenario_id long, survival double, stretch double")


def cascades(nodes: DataFrame, edges: DataFrame, scenarios: int = 20, initial: int = 1, radius_m: float = 200.0, probability: float = 0.8, threshold: float = COLLAPSE_THRESHOLD, most_steps: int = 10, seed: int = 42) -> DataFrame:
    """A row a scenario. Seeds fail, neighbours within the radius fail with them by chance, then the most critical node goes, step by step, until the penalty passes the threshold.

    All chances are drawn first, in node order, so they don't depend on how work is dealt out.
    """
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(adjacency := Adjacency.of(nodes, edges))
    baseline, rng, ids = global_efficiency(nodes, edges).first()[0], random.Random(seed), adjacency.ids.tolist()
    near = {r.centre: sorted(r.near) for r in within_radius(nodes, radius_m).groupBy("centre").agg(F.collect_list("id").alias("near")).collect()}
    rows = []
    for s in range(scenarios):
        seeds = rng.sample(ids, min(initial, len(ids)))
        failed = set(seeds)
        for x in seeds:
            failed.update([y for y in near.get(x, ()) if rng.random() < probability])
        rows.append((s, sorted(failed)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        place = {int(x): i for i, x in enumerate(graph.ids)}
        for batch in batches:
            out = []
            for scenario, failed in batch.itertuples(index=False):
                gone, steps = {place[x] for x in failed}, 0
                while steps < most_steps and len(graph.ids) - len(gone) >= 2:
                    now = graph.efficiency(frozenset(gone))
                    if now <= 0 or baseline <= 0 or baseline / now - 1 > threshold:
                        break
                    score = dict.fromkeys((i for i in range(len(graph.ids)) if i not in gone), 0.0)
                    for (u, v), f in graph.betweenness(frozenset(gone)).items():
                        score[u] += f
                        score[v] += f
                    gone.add(min(score, key=lambda i: (-round(score[i], 9), i)))
                    steps += 1
                out.append((scenario, len(failed), steps, len(failed) + steps, steps / len(failed) if len(failed) else None))
            yield pd.DataFrame(out, columns=["scenario_id", "initial_failures", "cascade_length", "total_removed", "acceleration"])

    dealt = spark.createDataFrame(rows, "scenario_id long, failed array<long>").repartition(max(1, len(rows)), "scenario_id")
    return dealt.mapInPandas(run, "scenario_id long, initial_failures long, cascade_length long, total_removed long, acceleration double")


def cascade_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.avg("cascade_length").alias("mean_length"), F.percentile("cascade_length", F.lit(0.5)).alias("median_length"), F.avg("total_removed").alias("mean_total_removed"), F.avg("acceleration").alias("mean_acceleration"))


def near_places(nodes: DataFrame, radius_m: float, centres: DataFrame | None = None) -> DataFrame:
    """(centres, ids, dist_m): ids of centres and of nodes whose places lie within a radius, by a join on grid cells of that size.

    A place is compared once, whatever number of nodes are there; long lists of ids come in blocks.
    """
    from .spatial import near_pairs

    def places(at: DataFrame, ids: str, end: str) -> DataFrame:
        block = lambda i: F.slice(ids, i * PLACE_BLOCK + 1, PLACE_BLOCK)
        found = at.groupBy(F.col("lat").alias(f"lat_{end}"), F.col("lon").alias(f"lon_{end}")).agg(F.collect_list("id").alias(ids)).where(F.size(ids) > 0)
        return found.withColumn(ids, F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / PLACE_BLOCK).cast("int")), block)))

    # pairs are many more than nodes, so what Spark would merge into few tasks by its size is dealt out to all
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * nodes.sparkSession.sparkContext.defaultParallelism)
    pairs = near_pairs(places(nodes if centres is None else centres, "centres", "a"), places(nodes, "ids", "b"), radius_m, tasks)
    return pairs.withColumn("dist_m", haversine_atan2(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("dist_m") <= radius_m).select("centres", "ids", "dist_m")


def pairs_of(near: DataFrame) -> DataFrame:
    """(centre, id, dist_m) of near_places: a row for each centre and other node."""
    return near.select(F.explode("centres").alias("centre"), "ids", "dist_m").select("centre", F.explode("ids").alias("id"), "dist_m").where("centre <> id")


def within_radius(nodes: DataFrame, radius_m: float, centres: DataFrame | None = None) -> DataFrame:
    """(centre, id, dist_m): the other nodes within a radius."""
    return pairs_of(near_places(nodes, radius_m, centres))


def fragility(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, bootstrap: int = 200, seed: int = 42) -> DataFrame:
    """One row: how the largest component's share falls when single edges (scenario_id, edge_idx) are cut.

    auc: mean of 1 - drop, with a bootstrapped 95 % interval; critical: drops over 0.20.
    """
    spark = nodes.sparkSession
    ids = np.sort(nodes.select("id").toPandas()["id"].to_numpy())
    if edges.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        raise ValueError("the graph is too large for one edge list; use components with scenario keys")
    e = edges.select("edge_idx", "source", "target").toPandas()
    shared = spark.sparkContext.broadcast((len(ids), e["edge_idx"].to_numpy(), np.searchsorted(ids, e["source"]), np.searchsorted(ids, e["target"])))

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, index, u, v = shared.value
        whole = largest_share(n, u, v)
        for batch in batches:
            cut = [largest_share(n, u[index != x], v[index != x]) for x in batch["edge_idx"]]
            yield pd.DataFrame({"scenario_id": batch["scenario_id"], "drop": [whole - s for s in cut]})

    drops = scenarios.repartition(4 * spark.sparkContext.defaultParallelism, "scenario_id").mapInPandas(solve, "scenario_id long, drop double").toPandas().sort_values("scenario_id")["drop"].to_numpy()
    rng = np.random.default_rng(seed)
    means = 1 - rng.choice(drops, (bootstrap, len(drops))).mean(axis=1) if len(drops) else np.array([1.0])
    row = (len(drops), float(1 - drops.mean()) if len(drops) else 1.0, float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5)), int((drops > 0.20).sum()), float(drops.max(initial=0.0)))
    return spark.createDataFrame([row], "n_removals long, auc double, ci_low double, ci_high double, n_critical long, worst_drop double")


def largest_share(n: int, u: np.ndarray, v: np.ndarray) -> float:
    """The share of nodes in the largest component, by union-find."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return max(np.bincount([find(x) for x in range(n)])) / n if n else 0.0


def disaster(nodes: DataFrame, edges: DataFrame, source: int, target: int, threshold: float = 0.5) -> DataFrame:
    """Cutting the edge of the highest betweenness: the route's length before and after, delay and collapse."""
    top = edge_betweenness(nodes, edges).orderBy(F.desc(F.round("ebc", 9)), "u", "v").first()
    cut = edges.where(~((F.least("source", "target") == top.u) & (F.greatest("source", "target") == top.v)))
    length: Callable[[DataFrame], float | None] = lambda e: (distances(nodes, e, [source]).where(F.col("dst") == target).first() or [None] * 3)[2]
    before, after = length(edges), length(cut)
    delay = after / before - 1 if before and after is not None else None
    return nodes.sparkSession.createDataFrame([(top.u, top.v, before, after, delay, before is not None and (delay is None or delay > threshold))], "u long, v long, before_m double, after_m double, delay double, collapsed boolean")


def report(nodes: DataFrame, edges: DataFrame, crit: DataFrame, trajectory: DataFrame, chaos: DataFrame, cascade: DataFrame) -> DataFrame:
    """One row with the evaluation's figures, rounded to six digits, and a sentence."""
    end = trajectory.orderBy(F.desc("step")).limit(1).select(F.col("step").alias("collapse_step"), F.round("penalty", 6).alias("collapse_penalty"))
    top = choke_points(crit, 1).select(F.col("id").alias("top_node"), F.round("crit", 6).alias("top_crit"))
    sizes = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    round6 = lambda df: df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    joined = sizes.crossJoin(top).crossJoin(end).crossJoin(round6(chaos)).crossJoin(round6(cascade))
    return joined.withColumn("summary", F.format_string("Node %d is the most critical; %d removals lead to a delay penalty of %.3f.", "top_node", "collapse_step", F.coalesce("collapse_penalty", F.lit(float("inf")))))
