"""Gaps, healing, pruning, chain contraction, weight audit and road classes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import close_line, haversine, inward_bearing, join_lines, line_points, local_metres, point, polyline_length, spline_points, straightness
from ..storage import saved
from .components import components
from .network import degrees, simple_edges
from .spatial import near_pairs


def breaks(nodes: DataFrame, edges: DataFrame, snap_m: float = 25.0) -> DataFrame:
    """(id_a, id_b, dist_m), id_a < id_b: dead ends whose equirectangular distance is snap_m at most; dist_m is the haversine."""
    ends = nodes.join(degrees(nodes, edges).where("degree = 1"), "id").select("id", "lat", "lon")
    centre = ends.agg(F.avg("lat").alias("centre"))
    a = ends.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    b = ends.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    pairs = near_pairs(a, b, snap_m * 1.01).where("id_a < id_b").crossJoin(F.broadcast(centre))
    p, q = (local_metres(F.col(f"lat_{s}"), F.col(f"lon_{s}"), F.col("centre")) for s in "ab")
    flat = F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    return pairs.where(flat <= snap_m).select("id_a", "id_b", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("dist_m")).orderBy("dist_m", "id_a", "id_b")


def spanning_pairs(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_dist: float | None = None) -> DataFrame:
    """The pairs that Kruskal's algorithm would bridge, in order of (dist_m, id_a, id_b).

    Found by Boruvka rounds: every component takes its least pair to another one. As that order
    is strict the minimum spanning forest is unique, so both algorithms choose the same pairs,
    and the rounds are joins over whole tables instead of a sequential loop.
    """
    left = saved(pairs.where(F.lit(True) if max_dist is None else F.col("dist_m") <= max_dist).select("id_a", "id_b", "dist_m"))
    label = saved(components(nodes, edges).select("id", "component"))
    chosen = left.limit(0)
    while True:
        a, b = (label.select(F.col("id").alias(f"id_{s}"), F.col("component").alias(f"c_{s}")) for s in "ab")
        open_pairs = saved(left.join(a, "id_a").join(b, "id_b").where("c_a <> c_b").select("id_a", "id_b", "dist_m", "c_a", "c_b"))
        if open_pairs.isEmpty():
            return chosen
        sides = open_pairs.select(F.col("c_a").alias("c"), F.struct("dist_m", "id_a", "id_b", "c_a", "c_b").alias("p")).union(open_pairs.select(F.col("c_b").alias("c"), F.struct("dist_m", "id_a", "id_b", "c_a", "c_b").alias("p")))
        best = saved(sides.groupBy("c").agg(F.min("p").alias("p")).select("p.*").distinct())
        chosen = saved(chosen.union(best.select("id_a", "id_b", "dist_m")))
        merged = components(label.select(F.col("component").alias("id")), best.select(F.col("c_a").alias("source"), F.col("c_b").alias("target")))
        label = saved(label.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component").select("id", F.col("to").alias("component")))


def _with_places(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("id").alias(f"id_{s}"), point(F.col("lat"), F.col("lon")).alias(f"p_{s}")), f"id_{s}")
    return pairs


def _appended(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """edges and bridges (source, target, weight_m, geometry), numbered on in order of their ends."""
    last = edges.agg(F.coalesce(F.max("edge_idx"), F.lit(-1)).alias("last"))
    numbered = bridges.withColumn("edge_idx", F.row_number().over(Window.orderBy("source", "target")).cast("long")).crossJoin(F.broadcast(last))
    return edges.unionByName(numbered.withColumn("edge_idx", F.col("edge_idx") + F.col("last")).drop("last").select(*[c for c in edges.columns if c in numbered.columns]), allowMissingColumns=True)


def heal_straight(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_dist: float | None = None) -> DataFrame:
    """Edges plus straight bridges over the chosen pairs; a bridge weighs its length, a metre at least."""
    found = _with_places(spanning_pairs(nodes, edges, pairs, max_dist), nodes)
    bridges = found.select(F.col("id_a").alias("source"), F.col("id_b").alias("target"), F.greatest("dist_m", F.lit(1.0)).alias("weight_m"), line_points(F.col("p_a"), F.col("p_b"), 3).alias("geometry"))
    return _appended(edges, bridges)


def bearings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, bearing) from each node into its first edge."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "edge_idx", "geometry")
    first = ends.groupBy("id").agg(F.min_by("geometry", "edge_idx").alias("geometry"))
    return nodes.join(first, "id", "left").select("id", inward_bearing(F.col("lat"), F.col("lon"), F.col("geometry")).alias("bearing"))


def heal_curved(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, max_dist: float | None = None) -> DataFrame:
    """Edges plus bridges that leave each dead end in the direction of its road; they weigh their length."""
    found = _with_places(spanning_pairs(nodes, edges, pairs, max_dist), nodes)
    turn = bearings(nodes, edges)
    for s in "ab":
        found = found.join(turn.select(F.col("id").alias(f"id_{s}"), F.col("bearing").alias(f"b_{s}")), f"id_{s}", "left")
    found = found.withColumn("geometry", spline_points(F.col("p_a"), F.col("p_b"), F.col("b_a"), F.col("b_b")))
    bridges = found.select(F.col("id_a").alias("source"), F.col("id_b").alias("target"), F.greatest(polyline_length(F.col("geometry")), F.lit(1.0)).alias("weight_m"), "geometry")
    return _appended(edges, bridges)


def classify_breaks(pairs: DataFrame, nodes: DataFrame, occlusion: DataFrame, to_pixel, radius_px: int = 3) -> DataFrame:
    """Pairs plus kind: A if any pixel of occlusion (row, col, v) in the box around the rounded midpoint is set, else B.

    to_pixel gives the fractional (row, col) of a place.
    """
    placed = _with_places(pairs, nodes)
    middle = to_pixel((F.col("p_a.lat") + F.col("p_b.lat")) / 2, (F.col("p_a.lon") + F.col("p_b.lon")) / 2)
    placed = placed.withColumn("r", F.rint(middle["row"]).cast("int")).withColumn("c", F.rint(middle["col"]).cast("int"))
    around = F.sequence(F.lit(-radius_px), F.lit(radius_px))
    boxes = placed.select("id_a", "id_b", "r", "c", F.explode(around).alias("dr")).select("*", F.explode(around).alias("dc")).select("id_a", "id_b", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"))
    hit = boxes.join(occlusion.where("v = 1").select("row", "col"), ["row", "col"], "left_semi").select("id_a", "id_b").distinct().withColumn("hit", F.lit(True))
    return pairs.join(hit, ["id_a", "id_b"], "left").withColumn("kind", F.when(F.col("hit"), "A").otherwise("B")).drop("hit")


def heal_guided(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, snap_m: float, target: float = 0.80) -> DataFrame:
    """Occluded breaks (kind A) are bridged up to snap_m; if the largest component stays under the target, others up to half of it."""
    healed = saved(heal_curved(nodes, edges, pairs.where("kind = 'A'"), snap_m))
    sizes = components(nodes, healed).groupBy("component").agg(F.count("*").alias("n"))
    share = sizes.agg((F.max("n") / F.sum("n")).alias("s")).first().s
    return healed if share is None or share >= target else heal_curved(nodes, healed, pairs.where("kind = 'B'"), snap_m / 2)


def prune_stubs(nodes: DataFrame, edges: DataFrame, min_m: float = 8.0, resolution_m: float = 0.0, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Dead ends on edges shorter than max(min_m, 1.5 * resolution) go, all of a round at once, up to five rounds.

    Never below three nodes; of parallel edges the last one's length counts and all go. Two
    dead ends that share an edge stay if fewer than three other nodes would be left.
    """
    limit = max(min_m, 1.5 * resolution_m)
    for _ in range(rounds):
        n = nodes.count()
        if n <= 3:
            break
        degree = degrees(nodes, edges)
        pair = simple_edges(edges).where("source <> target").select("source", "target", "weight_m")
        both = pair.select(F.col("source").alias("id"), F.col("target").alias("other"), "weight_m").union(pair.select("target", "source", "weight_m"))
        stubs = both.join(degree.where("degree = 1").select("id"), "id", "left_semi").where(F.col("weight_m") < limit)
        stubs = stubs.join(degree.select(F.col("id").alias("other"), F.col("degree").alias("other_degree")), "other")
        if n - 2 < 3:
            stubs = stubs.where("other_degree <> 1")
        stubs = saved(stubs.select("id", "other"))
        if stubs.isEmpty():
            break
        cut = stubs.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
        nodes = saved(nodes.join(stubs.select("id"), "id", "left_anti").select(*nodes.columns))
        edges = saved(edges.join(cut, (F.least("source", "target") == F.col("u")) & (F.greatest("source", "target") == F.col("v")), "left_anti"))
    return nodes, edges


def contract_chains(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of degree-2 nodes become one edge between their anchors, weights added, lines joined in order.

    Each half-edge finds the start and its rank in its chain by pointer doubling, in a logarithmic
    number of rounds. Of parallel edges the shorter stays. Rings without an anchor stay as they are;
    a chain that returns to its anchor becomes a loop; results may be parallel. A chain runs from the
    anchor with the smaller id, a loop from its smaller first edge.
    """
    simple = saved(simple_edges(edges, "shortest").where("source <> target").select("source", "target", "edge_idx", "weight_m", "geometry"))
    loops = edges.where("source = target")
    two = saved(degrees(nodes, edges).where("degree = 2").join(loops.select(F.col("source").alias("id")).distinct(), "id", "left_anti").select("id"))
    half = simple.select("edge_idx", F.col("source").alias("a"), F.col("target").alias("b")).union(simple.select("edge_idx", "target", "source"))
    half = saved(half.withColumn("h", F.col("edge_idx") * 2 + (F.col("a") > F.col("b")).cast("int")))
    # before a half-edge that leaves a degree-2 node comes the one that enters it by the other edge
    enters = half.join(two.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("b").alias("a"), F.col("h").alias("before"), F.col("edge_idx").alias("other"))
    state = half.select("h", "a", "edge_idx").join(enters, "a", "left").where("other is null or other <> edge_idx").select("h", "before", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("rank"))
    state = saved(state.withColumn("start", F.coalesce("before", "h")).select("h", "start", "rank", F.col("before").isNull().alias("done")))
    for _ in range(64):
        step = state.select(F.col("h").alias("start"), F.col("start").alias("start2"), F.col("rank").alias("rank2"), F.col("done").alias("done2"))
        after = state.join(step, "start", "left").select(
            "h", F.when(F.col("done"), F.col("start")).otherwise(F.col("start2")).alias("start"), F.when(F.col("done"), F.col("rank")).otherwise(F.col("rank") + F.col("rank2")).alias("rank"), (F.col("done") | F.col("done2")).alias("done")
        )
        changed = state.where("not done").count()
        state = saved(after)
        left = state.where("not done").count()
        if left == 0 or left == changed:
            # what doubling no longer finishes lies on rings
            break
    info = half.join(simple.select("edge_idx", "weight_m", "geometry"), "edge_idx")
    # geometry runs from source to target as stored; simple_edges orders the ends by id
    stored = edges.select("edge_idx", F.col("source").alias("first_end"))
    info = info.join(stored, "edge_idx").withColumn("line", F.when(F.col("a") == F.col("first_end"), F.col("geometry")).otherwise(F.reverse("geometry"))).drop("first_end")
    parts = state.where("done").join(info.select("h", "a", "b", "edge_idx", "weight_m", "line"), "h")
    chains = parts.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("rank", "a", "b", "edge_idx", "weight_m", "line"))).alias("c"))
    first, last = F.col("c")[0], F.element_at("c", -1)
    chains = chains.withColumn("source", first["a"]).withColumn("target", last["b"])
    complete = chains.join(two.withColumnRenamed("id", "target"), "target", "left_anti")
    one_way = complete.where((F.col("source") < F.col("target")) | ((F.col("source") == F.col("target")) & (first["edge_idx"] <= last["edge_idx"])))
    line = F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), F.col("c")[0]["line"], lambda acc, x: join_lines(acc, x["line"]))
    weight = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x["weight_m"])
    made = one_way.select("source", "target", F.array_min(F.transform("c", lambda x: x["edge_idx"])).alias("edge_idx"), weight.alias("weight_m"), line.alias("geometry"))
    rings = info.join(state.where("not done").select("h"), "h", "left_semi").groupBy("edge_idx").agg(F.min("a").alias("source"), F.max("a").alias("target"))
    ring_edges = simple.join(rings.select("edge_idx"), "edge_idx", "left_semi")
    kept = made.unionByName(ring_edges.select("source", "target", "edge_idx", "weight_m", "geometry")).unionByName(loops.select("source", "target", "edge_idx", "weight_m", "geometry"))
    kept = saved(kept)
    gone = two.join(kept.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(*nodes.columns), kept


def healed_or_warned(nodes: DataFrame, edges: DataFrame, second_snap_m: float, resolution_m: float, target: float = 0.80) -> tuple[DataFrame, str, float]:
    """Edges as they are if the largest component reaches the target, else healed once more at the relaxed snap; with a status and the share."""

    def share(e: DataFrame) -> float:
        sizes = components(nodes, e).groupBy("component").agg(F.count("*").alias("n"))
        return sizes.agg((F.max("n") / F.sum("n")).alias("s")).first().s or 0.0

    before = share(edges)
    if before >= target:
        return edges, "PASS", before
    snap = max(second_snap_m, 16 * resolution_m)
    healed = saved(heal_straight(nodes, edges, breaks(nodes, edges, snap), snap))
    after = share(healed)
    return healed, "PASS_AFTER_SECOND_PASS" if after >= target else "WARN", after


def audit_weights(edges: DataFrame, tolerance_m: float = 1.0) -> DataFrame:
    """Edges plus stored_m, length_m, delta_m and corrected; weight_m becomes the length where it differs by more, or isn't positive."""
    out = edges.withColumn("stored_m", F.col("weight_m")).withColumn("length_m", polyline_length(F.col("geometry")))
    out = out.withColumn("delta_m", F.abs(F.col("length_m") - F.col("stored_m")))
    return out.withColumn("corrected", (F.col("delta_m") > tolerance_m) | (F.col("stored_m") <= 0)).withColumn("weight_m", F.when(F.col("corrected"), F.col("length_m")).otherwise(F.col("stored_m")))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row of counts and quartiles of the audited weights."""
    quartile = lambda p: F.percentile("weight_m", F.lit(p))
    return audited.agg(
        F.count("*").alias("n_edges"), F.sum(F.col("corrected").cast("long")).alias("n_corrected"), F.max("delta_m").alias("max_delta_m"), F.avg("weight_m").alias("mean_m"),
        quartile(0.25).alias("q1_m"), quartile(0.5).alias("median_m"), quartile(0.75).alias("q3_m"), F.sum((F.col("weight_m") < 1).cast("long")).alias("n_short"), F.sum((F.col("weight_m") > 2000).cast("long")).alias("n_long"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, lengths and points per edge."""
    lengths = edges.agg(F.count("*").alias("n_edges"), F.avg("weight_m").alias("mean_m"), F.min("weight_m").alias("min_m"), F.max("weight_m").alias("max_m"), (F.sum("weight_m") / 1000).alias("total_km"), F.avg(F.size("geometry")).alias("mean_points"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(lengths)


def intersections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes where three roads or more meet."""
    return degrees(nodes, edges).where("degree >= 3")


def street_statistics(nodes: DataFrame, edges: DataFrame, area_km2: float = 7.04) -> DataFrame:
    """One row: intersections (a node where several roads meet), their number a square kilometre, total length, and circuity, length over straight distance."""
    met = degrees(nodes, edges).agg(F.sum((F.col("degree") > 1).cast("long")).alias("n_intersections"))
    end = lambda i, c: F.element_at("geometry", i)[c]
    straight = haversine(end(1, "lat"), end(1, "lon"), end(-1, "lat"), end(-1, "lon"))
    total = edges.agg(F.sum("weight_m").alias("length_m"), F.try_divide(F.sum("weight_m"), F.sum(straight)).alias("circuity"))
    return met.crossJoin(total).select("n_intersections", (F.col("n_intersections") / area_km2).alias("per_km2"), "length_m", "circuity")


def edge_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges plus max_degree, mean_degree, straightness and n_points."""
    d = saved(degrees(nodes, edges))
    out = edges.join(d.select(F.col("id").alias("source"), F.col("degree").alias("ds")), "source").join(d.select(F.col("id").alias("target"), F.col("degree").alias("dt")), "target")
    return out.select(*edges.columns, F.greatest("ds", "dt").alias("max_degree"), ((F.col("ds") + F.col("dt")) / 2).alias("mean_degree"), straightness(F.col("geometry")).alias("straightness"), F.size("geometry").alias("n_points"))


def road_types(features: DataFrame) -> DataFrame:
    """Features plus score and road_type; length counts 45 %, degree 35 %, straightness 20 %."""
    at = lambda c, p: F.percentile(c, F.lit(p))
    limits = features.agg(at("weight_m", 0.1).alias("p10"), at("weight_m", 0.9).alias("p90"), at("max_degree", 0.75).alias("p75"))
    span = F.col("p90") - F.col("p10")
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    length: Column = F.when(span > 1e-6, unit((F.col("weight_m") - F.col("p10")) / F.nullif(span, F.lit(0.0)))).otherwise(0.5)
    degree: Column = F.when(F.col("p75") > 0, F.least(F.lit(1.0), F.col("max_degree") / F.nullif(F.col("p75"), F.lit(0.0)))).otherwise(0.5)
    scored = features.crossJoin(F.broadcast(limits)).withColumn("score", F.bround(0.45 * length + 0.35 * degree + 0.20 * F.col("straightness"), 4))
    kind = F.when(F.col("score") >= 0.65, "highway").when(F.col("score") >= 0.35, "arterial").otherwise("local")
    return scored.withColumn("road_type", kind).drop("p10", "p90", "p75")


def road_type_summary(typed: DataFrame) -> DataFrame:
    total = typed.agg(F.count("*").alias("n"))
    return typed.groupBy("road_type").agg(F.count("*").alias("n_edges"), F.avg("score").alias("mean_score")).crossJoin(F.broadcast(total)).select("road_type", "n_edges", (F.col("n_edges") / F.col("n")).alias("share"), "mean_score")


def skeleton_graph(skeleton: DataFrame, to_place, min_weight_m: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a thinned mask (row, col of its set pixels); to_place gives the place of a pixel.

    Pixels with other than two neighbours are node pixels; touching ones are one node, placed
    at their centroid. Edges are the pixel lines between them, found as chains of the pixel graph.
    """
    px = saved(skeleton.select("row", "col").distinct().withColumn("id", F.col("row").cast("long") * 1_000_000 + F.col("col")))
    links = neighbours(px)
    edges = links.withColumn("edge_idx", F.row_number().over(Window.orderBy("source", "target")).cast("long"))
    count = links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    corner = saved(px.join(count, "id", "left").where("coalesce(n, 0) <> 2").select("id", "row", "col"))
    inside = edges.join(corner.select(F.col("id").alias("source")), "source", "left_semi").join(corner.select(F.col("id").alias("target")), "target", "left_semi")
    cluster = saved(components(corner, inside))
    at = corner.join(cluster, "id").groupBy("component").agg(F.avg("row").alias("r"), F.avg("col").alias("c"))
    nodes = at.select(F.col("component").alias("id"), to_place(F.col("r"), F.col("c")).alias("p")).select("id", F.round("p.lat", 8).alias("lat"), F.round("p.lon", 8).alias("lon"))
    place = px.select(F.col("id").alias("x"), to_place(F.col("row").cast("double"), F.col("col").cast("double")).alias("p"))
    lined = edges.join(place.toDF("source", "ps"), "source").join(place.toDF("target", "pt"), "target").select("source", "target", "edge_idx", F.array("ps", "pt").alias("geometry")).withColumn("weight_m", polyline_length(F.col("geometry")))
    _, chains = contract_chains(px.select("id"), lined)
    label = cluster.select("id", "component")
    out = chains.join(label.toDF("source", "cs"), "source", "left").join(label.toDF("target", "ct"), "target", "left")
    out = out.join(inside.select("edge_idx"), "edge_idx", "left_anti").select(F.coalesce("cs", "source").alias("source"), F.coalesce("ct", "target").alias("target"), "edge_idx", "geometry")
    ends = nodes.select("id", point(F.col("lat"), F.col("lon")).alias("p"))
    out = out.join(ends.toDF("source", "ps"), "source").join(ends.toDF("target", "pt"), "target").withColumn("geometry", close_line(F.col("geometry"), F.col("ps"), F.col("pt")))
    out = out.withColumn("weight_m", F.round(polyline_length(F.col("geometry")), 3)).where(F.col("weight_m") > min_weight_m)
    return nodes, out.select("source", "target", "edge_idx", "weight_m", "geometry")


def neighbours(px: DataFrame) -> DataFrame:
    """(source, target): touching pixels (id, row, col); a diagonal counts only where no straight step does the same."""
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)]
    moved = px.select("id", "row", "col", F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in steps))).alias("s"))
    moved = moved.select(F.col("id").alias("source"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("row").alias("r0"), F.col("col").alias("c0"))
    found = moved.join(px.withColumnRenamed("id", "target"), ["row", "col"])
    diagonal = found.where("row <> r0 and col <> c0")
    around = diagonal.select("source", "target", F.explode(F.array(F.struct(F.col("r0").alias("row"), F.col("col")), F.struct(F.col("row"), F.col("c0").alias("col")))).alias("p")).select("source", "target", "p.*")
    short = around.join(px.select("row", "col"), ["row", "col"], "left_semi").select("source", "target").distinct()
    return found.select("source", "target").join(short, ["source", "target"], "left_anti")
