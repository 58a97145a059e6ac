"""The engine's queries over the driver's tables, each beside the SQL that gives the same rows.

Names begin with the operator ids that a query covers. Floats are rounded to six digits.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import contract, matching, network, raster, topology
from ..operators import components as cc
from ..schema import TEST_BOX
from ..sources import graphs, rasters, settings
from . import views
from .views import haversine_sql, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def rounded_sql(body: str, floats: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in floats.split())}) FROM ({body})"


# --- scalars ---------------------------------------------------------------------------------------------------------

HOME = "12.9277, 77.6251"


@query(sql("pts", f"SELECT id, round({haversine_sql('lat', 'lon', '12.9277', '77.6251')}, 6) d, round({haversine_sql('lat', 'lon', '12.9277', '77.6251')}, 6) d2 FROM pts"))
def x01_x02_haversine(spark, sf_dir):
    home = (F.lit(12.9277), F.lit(77.6251))
    p = views.customer_points(spark, sf_dir)
    return p.select("id", r6(geo.haversine(F.col("lat"), F.col("lon"), *home)).alias("d"), r6(geo.haversine_atan2(F.col("lat"), F.col("lon"), *home)).alias("d2"))


@query(sql("lines", f"SELECT edge_idx, n_points, round(length_m, 6) length_m, round(CASE WHEN n_points < 2 OR length_m < 1e-6 THEN 1 ELSE least(1, {haversine_sql('lat0', 'lon0', 'lat1', 'lon1')} / length_m) END, 6) straight FROM lines"))
def x03_x12_polylines(spark, sf_dir):
    g = F.col("geometry")
    return views.order_lines(spark, sf_dir).select("edge_idx", F.size(g).cast("long").alias("n_points"), r6(geo.polyline_length(g)).alias("length_m"), r6(geo.straightness(g)).alias("straight"))


@query(
    sql(
        "pts",
        """SELECT id, round((top - lat) / ((top - low) / 480), 6) AS r, round((lon - west) / ((east - west) / 640), 6) AS c,
        round(top - 7 * ((top - low) / 480), 6) lat7, greatest(0, least(479, round_even((top - lat) / (top - low) * 479, 0)))::INT br,
        greatest(0, least(639, round_even((lon - west) / (east - west) * 639, 0)))::INT bc FROM pts, (SELECT 12.9377::DOUBLE top, 12.9177::DOUBLE low, 77.6101::DOUBLE west, 77.6401::DOUBLE east)""",
    )
)
def x04_x05_x06_pixels(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    at, burn = geo.latlon_to_pixel(lat, lon, TEST_BOX, 480, 640), geo.burn_pixel(lat, lon, TEST_BOX, 480, 640)
    back = geo.pixel_to_latlon(F.lit(7), F.lit(0), TEST_BOX, 480, 640)
    return views.customer_points(spark, sf_dir).select("id", r6(at["row"]).alias("r"), r6(at["col"]).alias("c"), r6(back["lat"]).alias("lat7"), burn["row"].alias("br"), burn["col"].alias("bc"))


@query(sql("pts", "SELECT id, round(lon * 111320 * cos(radians((SELECT avg(lat) FROM pts))), 3) x, round(lat * 111320, 3) y FROM pts"))
def x07_local_metres(spark, sf_dir):
    p = views.customer_points(spark, sf_dir)
    m = geo.local_metres(F.col("lat"), F.col("lon"), F.col("c"))
    return p.crossJoin(F.broadcast(p.agg(F.avg("lat").alias("c")))).select("id", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y"))


@query(
    sql(
        "items",
        """, f AS (SELECT edge_idx, max(i) n FROM items GROUP BY 1),
        a AS (SELECT f.edge_idx, p.lat la, p.lon lo, q.lat qa, q.lon qo FROM f JOIN items p ON p.edge_idx = f.edge_idx AND p.i = f.n JOIN items q ON q.edge_idx = f.edge_idx AND q.i = greatest(f.n - 4, 1) WHERE f.n >= 2)
        SELECT edge_idx, CASE WHEN abs(qa - la) >= 1e-12 OR abs(qo - lo) >= 1e-12 THEN round((degrees(atan2(qo - lo, qa - la)) + 360) % 360, 4) END bearing FROM a""",
    )
)
def x08_bearing(spark, sf_dir):
    lines = views.order_lines(spark, sf_dir).where(F.size("geometry") >= 2)
    end = F.element_at("geometry", -1)
    # a node at the far end of its polyline; where both ends coincide the last one counts as nearer too
    return lines.select("edge_idx", F.round(geo.inward_bearing(end["lat"], end["lon"], F.col("geometry")) % 360, 4).alias("bearing"))


@query(sql("pts", "SELECT id, round(n / sqrt(n * n + e * e), 6) + 0.0::DOUBLE vlat, round(e / sqrt(n * n + e * e), 6) + 0.0::DOUBLE vlon FROM (SELECT id, cos(radians(id % 360)) n, sin(radians(id % 360)) / cos(radians(lat)) e FROM pts)"))
def x09_bearing_vector(spark, sf_dir):
    v = geo.bearing_vector((F.col("id") % 360).cast("double"), F.col("lat"))
    return views.customer_points(spark, sf_dir).select("id", (r6(v["lat"]) + 0.0).alias("vlat"), (r6(v["lon"]) + 0.0).alias("vlon"))


@query(
    sql(
        "e25 n25",
        """, p AS (SELECT edge_idx, a.lat alat, a.lon alon, b.lat blat, b.lon blon FROM e25 JOIN n25 a ON a.id = source JOIN n25 b ON b.id = target),
        t AS (SELECT *, k / 7.0::DOUBLE t, 0.4::DOUBLE * sqrt(pow(blat - alat, 2) + pow(blon - alon, 2)) g, cos(radians((alat + blat) / 2)) s FROM p, range(0, 8) r(k)),
        u AS (SELECT *, cos(radians(210)) an, sin(radians(210)) / s ae, cos(radians(380)) bn, sin(radians(380)) / s be FROM t)
        SELECT edge_idx, k::INT k, round((2*t*t*t - 3*t*t + 1) * alat + (t*t*t - 2*t*t + t) * g * an / sqrt(an*an + ae*ae) + (3*t*t - 2*t*t*t) * blat + (t*t*t - t*t) * g * bn / sqrt(bn*bn + be*be), 6) lat,
        round((2*t*t*t - 3*t*t + 1) * alon + (t*t*t - 2*t*t + t) * g * ae / sqrt(an*an + ae*ae) + (3*t*t - 2*t*t*t) * blon + (t*t*t - t*t) * g * be / sqrt(bn*bn + be*be), 6) lon,
        round(alat + (blat - alat) * t, 6) line_lat FROM u""",
    )
)
def x10_x11_splines(spark, sf_dir):
    _, edges = views.nation_grid(spark, sf_dir)
    a, b = F.col("geometry")[0], F.col("geometry")[1]
    curve = geo.spline_points(a, b, F.lit(30.0), F.lit(200.0))
    both = edges.select("edge_idx", F.posexplode(F.arrays_zip(curve.alias("c"), geo.line_points(a, b, 8).alias("l"))).alias("k", "p"))
    return both.select("edge_idx", "k", r6("p.c.lat").alias("lat"), r6("p.c.lon").alias("lon"), r6("p.l.lat").alias("line_lat"))


@query(
    sql(
        "pts",
        """SELECT id, x, y, round(degrees(atan(sinh(pi() * (1 - 2 * y / 131072.0::DOUBLE)))), 6) clat, round(x / 131072.0::DOUBLE * 360 - 180, 6) clon FROM
        (SELECT id, floor((lon + 180) / 360 * 131072)::BIGINT x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 131072)::BIGINT y FROM pts)""",
    )
)
def x13_x14_tiles(spark, sf_dir):
    t = views.customer_points(spark, sf_dir).select("id", geo.tile_of(F.col("lat"), F.col("lon"), 17).alias("t")).select("id", "t.x", "t.y")
    c = geo.tile_corner(F.col("x"), F.col("y"), 17)
    return t.select("id", "x", "y", r6(c["lat"]).alias("clat"), r6(c["lon"]).alias("clon"))


@query(sql("pts", "SELECT round((max(lat) - min(lat)) * 111 * (max(lon) - min(lon)) * 111 * cos(radians((min(lat) + max(lat)) / 2)), 6) km2 FROM pts"))
def x15_box_area(spark, sf_dir):
    box = views.customer_points(spark, sf_dir).agg(F.min("lon").alias("a"), F.min("lat").alias("b"), F.max("lon").alias("c"), F.max("lat").alias("d"))
    return box.select(r6(geo.box_area_km2(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).alias("km2"))


@query("SELECT o_orderkey::BIGINT AS edge_idx, greatest(32, 32 * round_even((o_orderkey % 999) / 32.0::DOUBLE, 0))::INT AS snapped, CASE WHEN s >= 0.8 THEN 'STRONG' WHEN s >= 0.6 THEN 'ACCEPTABLE' WHEN s >= 0.4 THEN 'WEAK' ELSE 'POOR' END AS grade, round(1 / (1 + exp(-(s * 8 - 4))), 6) AS p, round(s * 5.8::DOUBLE, 6) AS metres FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE s FROM orders)")
def x18_x19_x20_x22_scores(spark, sf_dir):
    s = (F.col("o_orderkey") % 101 / 100.0).alias("s")
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("edge_idx"), s)
    return o.select("edge_idx", geo.snap_size(F.col("edge_idx") % 999).alias("snapped"), geo.band(F.col("s"), *geo.F1_GRADES).alias("grade"), r6(geo.road_probability(F.col("s") * 8 - 4)).alias("p"), r6(geo.pixels_to_metres(F.col("s"), F.lit(5.8))).alias("metres"))


# --- graphs ----------------------------------------------------------------------------------------------------------

DEGREE = "SELECT id, count(u) degree FROM n100 LEFT JOIN b100 ON u = id GROUP BY id"
REACH = ", reach(id, other) AS (SELECT id, id FROM n100 UNION SELECT reach.id, v FROM reach JOIN b100 ON u = other), comp AS (SELECT id, min(other) component FROM reach GROUP BY id)"


@query(sql("n100 b100", DEGREE))
def g01_degrees(spark, sf_dir):
    return network.degrees(*views.supplier_grid(spark, sf_dir))


@query(sql("n100 b100", REACH + " SELECT * FROM comp"))
def g02_g04_components(spark, sf_dir):
    return cc.components(*views.supplier_grid(spark, sf_dir))


@query(
    sql(
        "n100 b100",
        REACH + """, s AS (SELECT component, count(*) n FROM comp GROUP BY 1) SELECT sum(n)::BIGINT n_nodes, count(*) n_components, max(n) lcc_nodes, round(max(n) / sum(n), 6) lcc_share,
        count(*) FILTER (n = 1) n_isolated, count(*) FILTER (n < 5) n_small, round(avg(n), 6) mean_size, max(n) / sum(n) >= 0.6 passes, array_to_string(list(n ORDER BY n DESC), ',') sizes FROM s""",
    )
)
def g03_connectivity(spark, sf_dir):
    found = rounded(cc.connectivity(*views.supplier_grid(spark, sf_dir)))
    return found.withColumn("sizes", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ","))


#: Shortest distances of the nation grid; no path there is longer than 1300.
DIST = ", walk(src, dst, d) AS (SELECT id, id, 0::DOUBLE FROM n25 UNION SELECT src, v, d + w FROM walk JOIN b25 ON u = dst WHERE d + w <= 1300), dist AS (SELECT src, dst, min(d) d FROM walk GROUP BY 1, 2)"
PATHS = DIST + """, hop AS (SELECT a.src, a.dst, b.v, a.d FROM dist a JOIN b25 b ON b.u = a.dst JOIN dist c ON c.src = a.src AND c.dst = b.v AND c.d = a.d + b.w),
    trail(src, path, dst) AS (SELECT id, [id], id FROM n25 UNION ALL SELECT trail.src, list_append(path, v), v FROM trail JOIN hop ON hop.src = trail.src AND hop.dst = trail.dst),
    sig AS (SELECT src, dst, count(*)::DOUBLE sg FROM trail GROUP BY 1, 2),
    flow AS (SELECT least(b.u, b.v) u, greatest(b.u, b.v) v, sum(x.sg * y.sg / t.sg) f FROM dist a JOIN b25 b ON b.u = a.dst JOIN dist c ON c.src = b.v JOIN dist z ON z.src = a.src AND z.dst = c.dst AND z.d = a.d + b.w + c.d
        JOIN sig x ON x.src = a.src AND x.dst = b.u JOIN sig y ON y.src = b.v AND y.dst = c.dst JOIN sig t ON t.src = a.src AND t.dst = c.dst GROUP BY 1, 2),
    ebc AS (SELECT least(source, target) u, greatest(source, target) v, coalesce(f, 0) / (25 * 24) ebc FROM e25 LEFT JOIN flow ON flow.u = least(source, target) AND flow.v = greatest(source, target)),
    sums AS (SELECT id, coalesce(sum(ebc), 0) s FROM n25 LEFT JOIN ebc ON id IN (u, v) GROUP BY id), crit AS (SELECT id, s / (SELECT max(s) FROM sums) crit FROM sums)"""


@query(sql("n25 b25", DIST + " SELECT * FROM dist"))
def g05_g11_distances(spark, sf_dir):
    return network.distances(*views.nation_grid(spark, sf_dir))


@query(sql("n25 b25", DIST + " SELECT * FROM dist"))
def g05_relaxed_distances(spark, sf_dir):
    nodes, edges = views.nation_grid(spark, sf_dir)
    return network.relaxed_distances(edges, nodes)


@query(sql("n25 b25 e25", PATHS + " SELECT u, v, round(ebc, 6) ebc FROM ebc"))
def g06_g07_edge_betweenness(spark, sf_dir):
    return rounded(network.edge_betweenness(*views.nation_grid(spark, sf_dir)))


def _criticality(spark, sf_dir):
    nodes, edges = views.nation_grid(spark, sf_dir)
    return nodes, edges, network.node_criticality(nodes, network.edge_betweenness(nodes, edges))


@query(sql("n25 b25 e25", PATHS + " SELECT id, round(crit, 6) crit FROM crit"))
def g08_g10_criticality(spark, sf_dir):
    return rounded(_criticality(spark, sf_dir)[2])


@query(sql("n25 b25 e25", PATHS + " SELECT id, round(crit, 6) crit FROM crit ORDER BY round(crit, 9) DESC, id LIMIT 5"))
def g09_choke_points(spark, sf_dir):
    return rounded(network.choke_points(_criticality(spark, sf_dir)[2], 5))


@query(sql("n25 b25", DIST + " SELECT round(sum(1 / d) / 600, 9) efficiency FROM dist WHERE src <> dst"))
def g12_efficiency(spark, sf_dir):
    return network.global_efficiency(*views.nation_grid(spark, sf_dir)).select(F.round("efficiency", 9).alias("efficiency"))


@query(sql("n25 b25", DIST + " SELECT round(avg(1 / d), 9) efficiency, round(stddev_samp(1 / d) / sqrt(count(*)), 9) sem, count(*) n_pairs FROM dist WHERE src < dst"))
def g13_g14_sampled_efficiency(spark, sf_dir):
    nodes, edges = views.nation_grid(spark, sf_dir)
    pairs = network.pair_distances(nodes, edges, network.sampled_pairs(nodes, 300))
    return network.approximate_efficiency(pairs).select(F.round("efficiency", 9).alias("efficiency"), F.round("sem", 9).alias("sem"), "n_pairs")


GAPS = f""", deg AS ({DEGREE}), ends AS (SELECT n100.* FROM n100 JOIN deg USING (id) WHERE degree = 1), mid AS (SELECT cos(radians(avg(lat))) * 111320 k FROM ends)
    SELECT a.id id_a, b.id id_b, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) dist_m FROM ends a JOIN ends b ON a.id < b.id, mid WHERE sqrt(pow((a.lon - b.lon) * k, 2) + pow((a.lat - b.lat) * 111320, 2)) <= 70"""


@query(sql("n100 b100", GAPS))
def g15_breaks(spark, sf_dir):
    return rounded(topology.breaks(*views.supplier_grid(spark, sf_dir), 70.0))


def _gaps(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    return nodes, edges, topology.breaks(nodes, edges, 70.0)


def _plain(edges: DataFrame) -> DataFrame:
    return rounded(edges.select("source", "target", "weight_m", F.size("geometry").cast("long").alias("n_points")))


@query()
def g16_straight_healing(spark, sf_dir):
    return _plain(topology.heal_straight(*_gaps(spark, sf_dir)))


@query()
def g17_curved_healing(spark, sf_dir):
    return _plain(topology.heal_curved(*_gaps(spark, sf_dir)))


def _occlusion(spark: SparkSession) -> DataFrame:
    """A wide shadow over the middle of the box."""
    return spark.range(200 * 200).select(F.expr("int(id div 200)").alias("row"), (F.col("id") % 200).cast("int").alias("col")).withColumn("v", F.when((F.col("row") % 40 < 12), 1).otherwise(0))


@query()
def g18_g19_guided_healing(spark, sf_dir):
    nodes, edges, pairs = _gaps(spark, sf_dir)
    kinds = topology.classify_breaks(pairs, nodes, _occlusion(spark), lambda lat, lon: geo.latlon_to_pixel(lat, lon, TEST_BOX, 200, 200))
    return _plain(topology.heal_guided(nodes, edges, kinds, 70.0))


@query()
def g20_g21_pruned(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    return _plain(topology.prune_stubs(nodes, edges, 50.0)[1])


@query(
    sql(
        "n100 b100 e100",
        f""", deg AS ({DEGREE}), stub AS (SELECT d.id, b.v other FROM deg d JOIN b100 b ON b.u = d.id WHERE d.degree = 1 AND b.w < 50)
        SELECT source, target, weight_m, 2::BIGINT n_points FROM e100 WHERE NOT EXISTS (SELECT 1 FROM stub WHERE (id = source AND other = target) OR (id = target AND other = source))""",
    )
)
def g21_pruned_once(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    return _plain(topology.prune_stubs(nodes, edges, 50.0, rounds=1)[1])


@query()
def g22_contracted(spark, sf_dir):
    return _plain(topology.contract_chains(*views.supplier_grid(spark, sf_dir))[1])


@query()
def g23_healing_gate(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    _, status, share = topology.healed_or_warned(nodes, edges, 60.9, 5.8)
    return spark.createDataFrame([(status, round(share, 6))], "status string, lcc_share double")


AUDIT = ", a AS (SELECT edge_idx, weight_m stored_m, length_m, abs(length_m - weight_m) delta_m, abs(length_m - weight_m) > 1 corrected FROM lines), w AS (SELECT *, CASE WHEN corrected THEN length_m ELSE stored_m END weight_m FROM a)"


@query(sql("lines", AUDIT + " " + rounded_sql("SELECT edge_idx, stored_m, length_m, delta_m, corrected, weight_m FROM w", "stored_m length_m delta_m weight_m")))
def g24_weight_audit(spark, sf_dir):
    return rounded(topology.audit_weights(views.order_lines(spark, sf_dir)).drop("geometry"))


@query(sql("lines", AUDIT + " SELECT count(*) n_edges, count(*) FILTER (corrected) n_corrected, round(max(delta_m), 6) max_delta_m, round(avg(weight_m), 6) mean_m, round(quantile_cont(weight_m, 0.25), 6) q1_m, round(quantile_cont(weight_m, 0.5), 6) median_m, round(quantile_cont(weight_m, 0.75), 6) q3_m, count(*) FILTER (weight_m < 1) n_short, count(*) FILTER (weight_m > 2000) n_long FROM w"))
def g24_audit_summary(spark, sf_dir):
    return rounded(topology.audit_summary(topology.audit_weights(views.order_lines(spark, sf_dir))))


@query(sql("n100 e100", "SELECT (SELECT count(*) FROM n100) n_nodes, count(*) n_edges, round(avg(weight_m), 6) mean_m, min(weight_m) min_m, max(weight_m) max_m, round(sum(weight_m) / 1000, 6) total_km, 2.0::DOUBLE mean_points FROM e100"))
def g25_s09_graph_stats(spark, sf_dir):
    return rounded(topology.graph_stats(*views.supplier_grid(spark, sf_dir)))


FEATURES = f", deg AS ({DEGREE}), feat AS (SELECT edge_idx, weight_m, greatest(a.degree, b.degree) max_degree, (a.degree + b.degree) / 2 mean_degree, 1.0::DOUBLE straightness FROM e100 JOIN deg a ON a.id = source JOIN deg b ON b.id = target)"
TYPES = FEATURES + """, lim AS (SELECT quantile_cont(weight_m, 0.1) p10, quantile_cont(weight_m, 0.9) p90, quantile_cont(max_degree, 0.75) p75 FROM feat),
    typed AS (SELECT edge_idx, round(0.45::DOUBLE * least(1, greatest(0, (weight_m - p10) / (p90 - p10))) + 0.35::DOUBLE * least(1, max_degree / p75) + 0.20::DOUBLE * straightness, 4) score FROM feat, lim),
    named AS (SELECT *, CASE WHEN score >= 0.65 THEN 'highway' WHEN score >= 0.35 THEN 'arterial' ELSE 'local' END road_type FROM typed)"""


@query(sql("n100 b100 e100", FEATURES + " SELECT edge_idx, weight_m, max_degree, round(mean_degree, 6) mean_degree, straightness, 2::INT n_points FROM feat"))
def g26_edge_features(spark, sf_dir):
    return rounded(topology.edge_features(*views.supplier_grid(spark, sf_dir)).drop("source", "target", "geometry"))


@query(sql("n100 b100 e100", TYPES + " SELECT road_type, count(*) n_edges, round(count(*) / (SELECT count(*) FROM named), 6) share, round(avg(score), 3) mean_score FROM named GROUP BY road_type"))
def g27_road_types(spark, sf_dir):
    typed = topology.road_types(topology.edge_features(*views.supplier_grid(spark, sf_dir)))
    return topology.road_type_summary(typed).select("road_type", "n_edges", r6("share").alias("share"), F.round("mean_score", 3).alias("mean_score"))


#: Distances of the nation grid in scenarios cut(scenario_id, id); detours there stay under 2000.
CUT = """, live AS (SELECT s.scenario_id, n25.id FROM (SELECT DISTINCT scenario_id FROM cut) s, n25 WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.scenario_id = s.scenario_id AND c.id = n25.id)),
    walks(scenario_id, src, dst, d) AS (SELECT scenario_id, id, id, 0::DOUBLE FROM live UNION SELECT w.scenario_id, src, v, d + b.w FROM walks w JOIN b25 b ON b.u = dst JOIN live l ON l.scenario_id = w.scenario_id AND l.id = v WHERE d + b.w <= 2000),
    dists AS (SELECT scenario_id, src, dst, min(d) d FROM walks GROUP BY 1, 2, 3),
    sizes AS (SELECT scenario_id, count(*) n FROM live GROUP BY 1),
    eff AS (SELECT scenario_id, any_value(n) n, coalesce(sum(1 / d), 0) / (any_value(n) * (any_value(n) - 1)) efficiency FROM sizes LEFT JOIN (SELECT * FROM dists WHERE src <> dst) USING (scenario_id) GROUP BY 1)"""


@query(sql("n25 b25", DIST + ", cut AS (SELECT id scenario_id, id FROM n25), base AS (SELECT sum(1 / d) / 600 e0 FROM dist WHERE src <> dst)" + CUT + " SELECT scenario_id id, round(efficiency, 9) efficiency, round(e0 / efficiency - 1, 6) penalty, round(efficiency / e0, 6) AS index FROM eff, base"))
def g30_leave_one_out(spark, sf_dir):
    found = network.leave_one_out(*views.nation_grid(spark, sf_dir))
    return found.select("id", F.round("efficiency", 9).alias("efficiency"), r6("penalty").alias("penalty"), r6("index").alias("index"))


TRAJECTORY = PATHS + ", rank AS (SELECT id, row_number() OVER (ORDER BY round(crit, 9) DESC, id) k FROM crit), cut AS (SELECT a.k scenario_id, b.id FROM rank a JOIN rank b ON b.k <= a.k WHERE a.k <= 23), base AS (SELECT sum(1 / d) / 600 e0 FROM dist WHERE src <> dst)" + CUT + ", steps AS (SELECT scenario_id step, rank.id removed_node, efficiency, CASE WHEN efficiency > 0 THEN e0 / efficiency - 1 END penalty, efficiency / e0 AS index FROM eff JOIN rank ON rank.k = scenario_id, base)"


@query(sql("n25 b25 e25", TRAJECTORY + " SELECT step, removed_node, round(efficiency, 9) efficiency, round(penalty, 6) penalty, round(index, 6) AS index FROM steps WHERE step <= (SELECT min(step) FROM steps WHERE penalty > 0.5 OR penalty IS NULL)"))
def g28_g30_ablation(spark, sf_dir):
    found = network.ablation(*_criticality(spark, sf_dir))
    return found.select("step", "removed_node", F.round("efficiency", 9).alias("efficiency"), r6("penalty").alias("penalty"), r6("index").alias("index"))


@query(sql("n25 b25 e25", TRAJECTORY + " SELECT t.threshold::DOUBLE threshold, min(step) removals FROM (VALUES (0.1), (0.2), (0.3), (0.5)) t(threshold) LEFT JOIN steps ON penalty > t.threshold OR penalty IS NULL GROUP BY 1"))
def g38_threshold_sweep(spark, sf_dir):
    return network.threshold_sweep(network.ablation(*_criticality(spark, sf_dir)), [0.1, 0.2, 0.3, 0.5])


def drawn(scenarios: int, k: int, first: int = 0) -> str:
    return f"SELECT scenario_id, id FROM (SELECT s scenario_id, id, row_number() OVER (PARTITION BY s ORDER BY md5(s || '-' || id), id) r FROM n25, range({first}, {first + scenarios}) t(s)) WHERE r <= {k}"


IMPACT = CUT + """, hit AS (SELECT s.scenario_id, s.n, count(x.d) c, coalesce(sum(x.d / b.d - 1), 0) st FROM sizes s LEFT JOIN (SELECT * FROM dists WHERE src < dst) x USING (scenario_id) LEFT JOIN dist b ON b.src = x.src AND b.dst = x.dst GROUP BY 1, 2),
    imp AS (SELECT scenario_id, c / 300.0::DOUBLE survival_all_pairs, c / (n * (n - 1) / 2.0::DOUBLE) survival_active_pairs, st / c stretch FROM hit)"""


@query(sql("n25 b25", DIST + f", cut AS ({drawn(20, 3)})" + IMPACT + " SELECT count(*) n_scenarios, " + ", ".join(f"round(avg({c}), 6) mean_{c}, round(1.96 * stddev_samp({c}) / sqrt(count(*)), 6) ci_{c}" for c in ("survival_all_pairs", "survival_active_pairs", "stretch")) + " FROM imp"))
def g31_g33_g34_monte_carlo(spark, sf_dir):
    nodes, edges = views.nation_grid(spark, sf_dir)
    return rounded(network.monte_carlo(nodes, edges, network.hashed_scenarios(nodes, 20, 3)))


@query(sql("n25 b25", DIST + f", cut AS ({drawn(6, 1)} UNION ALL {drawn(6, 2, 6)} UNION ALL {drawn(6, 5, 12)})" + IMPACT + " SELECT (CASE scenario_id // 6 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END)::INT k, round(avg(survival_all_pairs), 6) survival, round(avg(stretch), 6) stretch FROM imp GROUP BY 1"))
def g37_k_sweep(spark, sf_dir):
    return rounded(network.k_sweep(*views.nation_grid(spark, sf_dir), [1, 2, 5], 6))


@query(
    sql(
        "n25 b25",
        DIST + f""", cut AS ({drawn(10, 4)})""" + CUT + """, pairs AS (SELECT a.id u, b.id v FROM n25 a, n25 b WHERE a.id < b.id AND (a.id + b.id) % 3 = 0),
        act AS (SELECT s.scenario_id, u, v FROM sizes s, pairs WHERE EXISTS (SELECT 1 FROM live l WHERE l.scenario_id = s.scenario_id AND l.id = u) AND EXISTS (SELECT 1 FROM live l WHERE l.scenario_id = s.scenario_id AND l.id = v))
        SELECT act.scenario_id, round(count(x.d) / count(*), 6) survival, round(coalesce(avg(x.d / b.d - 1), 0), 6) stretch FROM act LEFT JOIN dists x ON x.scenario_id = act.scenario_id AND x.src = u AND x.dst = v LEFT JOIN dist b ON b.src = u AND b.dst = v GROUP BY 1""",
    )
)
def g32_g50_sampled_survival(spark, sf_dir):
    nodes, edges = views.nation_grid(spark, sf_dir)
    pairs = [(u, v) for u in range(25) for v in range(u + 1, 25) if (u + v) % 3 == 0]
    return rounded(network.sampled_survival(nodes, edges, network.hashed_scenarios(nodes, 10, 4), pairs))


@query()
def g35_cascades(spark, sf_dir):
    return rounded(network.cascades(*views.nation_grid(spark, sf_dir), scenarios=8, radius_m=900.0, most_steps=5))


@query()
def g39_report(spark, sf_dir):
    nodes, edges, crit = _criticality(spark, sf_dir)
    chaos = network.monte_carlo(nodes, edges, network.hashed_scenarios(nodes, 10, 3))
    cascade = network.cascade_summary(network.cascades(nodes, edges, scenarios=4, most_steps=3))
    return network.report(nodes, edges, crit, network.ablation(nodes, edges, crit), chaos, cascade)


@query(sql("pts", f"SELECT centre, id, round(dist_m, 6) dist_m FROM (SELECT a.id centre, b.id id, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} dist_m FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.0006) WHERE dist_m <= 60"))
def g36_within_radius(spark, sf_dir):
    return network.pairs_of(rounded(network.near_places(views.customer_points(spark, sf_dir), 60.0)))


SNAP = f"""snap AS (SELECT id, min_by(id_b, (d, id_b)) id_b FROM (SELECT a.id, b.id id_b, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} d FROM n100 a JOIN pts b ON abs(a.lat - b.lat) < 0.0003) WHERE d <= 25 GROUP BY id)"""


@query(
    sql(
        "n100 e100 pts",
        f""", {SNAP}, ref AS (SELECT DISTINCT least(s.id_b, t.id_b) u, greatest(s.id_b, t.id_b) v FROM e100 JOIN snap s ON s.id = source JOIN snap t ON t.id = target WHERE edge_idx % 2 = 0),
        me AS (SELECT count(*) c FROM e100 JOIN snap s ON s.id = source JOIN snap t ON t.id = target JOIN ref ON u = least(s.id_b, t.id_b) AND v = greatest(s.id_b, t.id_b)),
        c AS (SELECT (SELECT count(DISTINCT id_b) FROM snap) mn, (SELECT count(*) FROM n100) n, (SELECT count(*) FROM pts) rn, me.c me, (SELECT count(*) FROM e100) e, (SELECT count(*) FROM ref) re FROM me)
        SELECT mn matched_nodes, me matched_edges, round(mn / n, 6) node_precision, round(mn / rn, 6) node_recall, coalesce(round(2 * mn / (n + rn), 6), 0) node_f1,
        least(1, round(coalesce(me / e, 0), 6)) edge_precision, least(1, round(coalesce(me / nullif(re, 0), 0), 6)) edge_recall, round(2 * me / (e + re), 6) edge_f1 FROM c""",
    )
)
def g40_topology_scores(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    ref = views.customer_points(spark, sf_dir)
    return rounded(matching.topology_scores(nodes, edges, ref, _reference_edges(nodes, edges, ref), 25.0))


def _reference_edges(nodes, edges, ref):
    snaps = matching.snapped(nodes, ref, 25.0).drop("dist_m")
    return edges.where("edge_idx % 2 = 0").join(snaps.toDF("source", "a"), "source").join(snaps.toDF("target", "b"), "target").select(F.col("a").alias("source"), F.col("b").alias("target"))


@query()
def g41_greedy_matches(spark, sf_dir):
    return matching.greedy_matches(views.supplier_grid(spark, sf_dir)[0], views.customer_points(spark, sf_dir))


@query()
def g42_fragility(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    cuts = edges.select("edge_idx").orderBy(F.md5(F.col("edge_idx").cast("string"))).limit(50)
    return rounded(network.fragility(nodes, edges, cuts.select(F.col("edge_idx").alias("scenario_id"), "edge_idx")))


@query()
def g43_subsample_interval(spark, sf_dir):
    nodes, edges = views.supplier_grid(spark, sf_dir)
    ref = views.customer_points(spark, sf_dir)
    return rounded(matching.subsample_interval(nodes, edges, ref, _reference_edges(nodes, edges, ref), 40, snap_m=25.0))


@query("SELECT o_orderkey::BIGINT AS edge_idx, round((ok + f + e + l + (l >= 0.6)::INT) / 5, 6) AS overall FROM (SELECT o_orderkey, (o_orderkey % 2)::DOUBLE ok, (o_orderkey % 11) / 10.0::DOUBLE f, (o_orderkey % 7) / 7.0::DOUBLE e, (o_orderkey % 13) / 13.0::DOUBLE l FROM orders)")
def g44_overall_score(spark, sf_dir):
    k = F.col("o_orderkey")
    lcc = k % 13 / 13.0
    return views.table(spark, sf_dir, "orders").select(k.cast("long").alias("edge_idx"), r6(matching.overall_score(k % 2 == 1, k % 11 / 10.0, k % 7 / 7.0, lcc, lcc >= 0.6)).alias("overall"))


@query()
def g45_skeleton_graph(spark, sf_dir):
    skeleton = raster.skeletonise(rasters.arterial_mask(spark)).where("v = 1")
    _, edges = topology.skeleton_graph(skeleton, lambda r, c: geo.pixel_to_latlon(r, c, TEST_BOX, 200, 200))
    return _plain(edges)


@query(sql("e25", "SELECT edge_idx FROM e25 WHERE source IN (7, 12) OR target IN (7, 12)"))
def g46_lost_edges(spark, sf_dir):
    _, edges = views.nation_grid(spark, sf_dir)
    return network.lost_edges(edges, spark.createDataFrame([(7,), (12,)], "id long")).select("edge_idx")


@query(sql("e25", "SELECT edge_idx FROM e25 WHERE source NOT IN (7, 12) AND target NOT IN (7, 12)"))
def g29_severed(spark, sf_dir):
    nodes, edges = views.nation_grid(spark, sf_dir)
    return network.without(nodes, edges, spark.createDataFrame([(7,), (12,)], "id long"))[1].select("edge_idx")


@query(sql("n100 b100", f", deg AS ({DEGREE}) SELECT id, round(degree / (SELECT count(*) - 1 FROM n100), 6) centrality FROM deg ORDER BY degree DESC, id LIMIT 10"))
def g47_degree_centrality(spark, sf_dir):
    return rounded(network.degree_centrality(*views.supplier_grid(spark, sf_dir), 10))


@query(sql("n25 b25", DIST + " SELECT min(a.dst) id, a.d FROM dist a JOIN dist b ON b.src = 24 AND b.dst = a.dst, (SELECT d FROM dist WHERE src = 0 AND dst = 24) w WHERE a.src = 0 AND a.d + b.d = w.d GROUP BY a.d"))
def g48_g49_route(spark, sf_dir):
    return network.route(*views.nation_grid(spark, sf_dir), 0, 24)


@query()
def g51_disaster(spark, sf_dir):
    return rounded(network.disaster(*views.nation_grid(spark, sf_dir), 0, 24))


@query(sql("n100 b100", f", deg AS ({DEGREE}) SELECT * FROM deg WHERE degree >= 3"))
def g52_intersections(spark, sf_dir):
    return topology.intersections(*views.supplier_grid(spark, sf_dir))


@query("WITH d AS (SELECT o_orderkey k, o_totalprice::DOUBLE w FROM orders) SELECT count(*) n, round(quantile_cont(w, 0.5), 6) median, round(quantile_cont(w, 0.025), 6) low, round(quantile_cont(w, 0.975), 6) high FROM d")
def g33_percentiles(spark, sf_dir):
    w = F.col("o_totalprice").cast("double")
    p = lambda x: r6(F.percentile(w, F.lit(x)))
    return views.table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), p(0.5).alias("median"), p(0.025).alias("low"), p(0.975).alias("high"))


# --- sources ---------------------------------------------------------------------------------------------------------


@query(f"WITH n AS (SELECT i id, 12.9177 + 0.02 * ((i // 5) / 4.0::DOUBLE) lat, 77.6101 + 0.03 * ((i % 5) / 4.0::DOUBLE) lon FROM range(25) t(i)), e AS (SELECT id source, id + 1 target FROM n WHERE id % 5 < 4 UNION ALL SELECT id, id + 5 FROM n WHERE id < 20) SELECT source, target, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) weight_m FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target")
def s08_grid_graph(spark, sf_dir):
    return graphs.grid_graph(spark)[1].select("source", "target", "weight_m")


@query(sql("n100 e100", "SELECT (row_number() OVER (ORDER BY edge_idx) - 1) edge_idx, a.k source, b.k target, weight_m FROM e100 JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 k FROM n100) a ON a.id = source JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 k FROM n100) b ON b.id = target"))
def s04_normalised(spark, sf_dir):
    return graphs.normalised(*views.supplier_grid(spark, sf_dir))[1].drop("geometry")


@query(sql("n100 b100 e100", REACH + " SELECT edge_idx, source, target, weight_m FROM e100 JOIN comp ON id = source WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"))
def s03_largest_component(spark, sf_dir):
    return graphs.largest_component(*views.supplier_grid(spark, sf_dir))[1].drop("geometry")


@query(
    """WITH px AS (SELECT i // 200 AS r, i % 200 AS c FROM range(40000) t(i)),
    f AS (SELECT r, c, (r BETWEEN 48 AND 51 OR r BETWEEN 98 AND 101 OR r BETWEEN 148 AND 151) AND NOT (r BETWEEN 48 AND 51 AND c BETWEEN 66 AND 80) a,
    (c BETWEEN 48 AND 51 OR c BETWEEN 98 AND 101 OR c BETWEEN 148 AND 151) AND NOT (c BETWEEN 148 AND 151 AND r BETWEEN 66 AND 77) b FROM px)
    SELECT 0::INT tile_id, r::INT AS "row", c::INT col, (a OR b)::INT v FROM f"""
)
def s14_arterial_mask(spark, sf_dir):
    return rasters.arterial_mask(spark)


@query("SELECT i::INT tile_id, (1000 + i)::INT seed, 'train' split, CASE i % 7 WHEN 0 THEN 'none' WHEN 2 THEN 'canopy' WHEN 6 THEN 'canopy' WHEN 4 THEN 'shadow' ELSE 'cloud' END occlusion_type FROM range(200) t(i)")
def s24_tile_plan(spark, sf_dir):
    return rasters.tile_plan(spark, 200, 1000, "train")


@query("SELECT i::INT tile_id, (i % 10)::INT region, i % 10 >= 8 held_out FROM range(50) t(i)")
def s27_round_robin(spark, sf_dir):
    return rasters.round_robin(rasters.tile_plan(spark, 50, 0, "x").select("tile_id"), 10, 2)


# --- contracts -------------------------------------------------------------------------------------------------------


def _broken(spark, sf_dir):
    """The supplier grid with planted faults: places far away, weights of zero, unknown ends, a duplicate."""
    nodes, edges = views.supplier_grid(spark, sf_dir)
    bad = nodes.withColumn("lat", F.when(F.col("id") % 17 == 3, 95.0).otherwise(F.col("lat")))
    edges = edges.withColumn("weight_m", F.when(F.col("edge_idx") % 5 == 0, 0.0).otherwise(F.col("weight_m"))).withColumn("target", F.when(F.col("edge_idx") % 11 == 1, F.lit(-1).cast("long")).otherwise(F.col("target")))
    return bad.union(bad.where("id % 23 = 5")), edges


BROKEN = ", bn AS (SELECT id, CASE WHEN id % 17 = 3 THEN 95.0 ELSE lat END lat, lon FROM n100), be AS (SELECT edge_idx, source, CASE WHEN edge_idx % 11 = 1 THEN -1 ELSE target END target, CASE WHEN edge_idx % 5 = 0 THEN 0 ELSE weight_m END weight_m FROM e100)"
UNKNOWN = "SELECT 'edge.endpoint' AS rule, edge_idx idx FROM be WHERE target NOT IN (SELECT id FROM bn)"


@query(sql("n100 e100", BROKEN + f" SELECT rule, idx, count(*) n FROM (SELECT 'node.range' AS rule, id idx FROM (SELECT * FROM bn UNION ALL SELECT * FROM bn WHERE id % 23 = 5) WHERE lat > 90 UNION ALL SELECT 'node.duplicate', id FROM bn WHERE id % 23 = 5 UNION ALL {UNKNOWN}) GROUP BY 1, 2"))
def v01_loose_contract(spark, sf_dir):
    return contract.loose_violations(*_broken(spark, sf_dir)).groupBy("rule", "idx").agg(F.count("*").alias("n"))


@query(sql("n100 e100", BROKEN + f" SELECT rule, idx, count(*) n FROM (SELECT 'node.box' AS rule, id idx FROM (SELECT * FROM bn UNION ALL SELECT * FROM bn WHERE id % 23 = 5) WHERE lat NOT BETWEEN 12.8677 AND 12.9877 OR lon NOT BETWEEN 77.5601 AND 77.6901 UNION ALL SELECT 'edge.weight', edge_idx FROM be WHERE weight_m <= 0 UNION ALL {UNKNOWN}) GROUP BY 1, 2"))
def v02_strict_contract(spark, sf_dir):
    return contract.strict_violations(*_broken(spark, sf_dir)).groupBy("rule", "idx").agg(F.count("*").alias("n"))


@query(sql("n100 e100", BROKEN + f" SELECT rule, idx FROM (SELECT 'edge.weight' AS rule, edge_idx idx FROM be WHERE weight_m <= 0 UNION ALL {UNKNOWN})"))
def v03_basic_contract(spark, sf_dir):
    return contract.basic_violations(*_broken(spark, sf_dir)).select("rule", "idx")


@query(sql("truth", """SELECT 'mask.dense' AS rule, tile_id::BIGINT idx FROM truth GROUP BY tile_id HAVING sum(v) > 0.8 * count(*) UNION ALL SELECT 'mask.empty', tile_id FROM truth GROUP BY tile_id HAVING sum(v) = 0 UNION ALL SELECT 'mask.size', tile_id FROM truth GROUP BY tile_id HAVING max("row") < 9 OR max(col) < 9"""))
def v04_v05_s12_mask_contract(spark, sf_dir):
    return contract.mask_violations(views.masks(spark, sf_dir)[0], for_extraction=True).select("rule", "idx")


@query("SELECT true AS ok")
def v06_transform(spark, sf_dir):
    return contract.transform_errors(spark, TEST_BOX, 480, 640).select(((F.col("degrees") < 1e-6) & (F.col("pixels") < 1e-6)).alias("ok"))


@query(
    """WITH r AS (SELECT o_orderkey::BIGINT id, lower(o_orderpriority || ' ' || CASE o_orderkey % 4 WHEN 0 THEN 'Close the BRIDGE' WHEN 1 THEN 'flood here' WHEN 2 THEN 'hello' ELSE 'road and flood' END) t, 0.8 + (o_orderkey % 3) / 10.0 AS s FROM orders),
    a AS (SELECT id, s, CASE WHEN contains(t, 'bridge') OR contains(t, 'road') THEN 'sever_edge' WHEN contains(t, 'flood') OR contains(t, 'intersection') THEN 'sever_node' END AS action FROM r)
    SELECT id, action, action IS NOT NULL AND s >= 0.9 AS valid, CASE WHEN action IS NULL OR s < 0.9 THEN 'Low confidence score' ELSE 'Valid' END AS reason FROM a"""
)
def v10_d25_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat_ws(" ", "o_orderpriority", F.when(k % 4 == 0, "Close the BRIDGE").when(k % 4 == 1, "flood here").when(k % 4 == 2, "hello").otherwise("road and flood"))
    parsed = contract.parsed_requests(views.table(spark, sf_dir, "orders").select(k.cast("long").alias("id"), text.alias("text")))
    scored = parsed.withColumn("confidence_score", F.when(F.col("action").isNotNull(), F.round(0.8 + F.col("id") % 3 / 10.0, 1)))
    return contract.judged_requests(scored).select("id", "action", "valid", "reason")


# --- rasters ---------------------------------------------------------------------------------------------------------

CONFUSION = "sum(p * g)::BIGINT tp, sum(p * (1 - g))::BIGINT fp, sum((1 - p) * g)::BIGINT fn, sum((1 - p) * (1 - g))::BIGINT tn"
METRICS = "tp / nullif(tp + fp + fn, 0) iou, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / nullif(tp + fn, 0) recall, 2 * tp / nullif(2 * tp + fp + fn, 0) f1, (tp + tn) / (tp + fp + fn + tn) accuracy"


@query(sql("pg", f", c AS (SELECT tile_id, {CONFUSION} FROM pg GROUP BY 1) " + rounded_sql(f"SELECT *, {METRICS} FROM c", "iou precision recall f1 accuracy")))
def r28_r29_r30_confusion(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.confusion(raster.paired(pred, truth)))


@query(sql("pg", f", c AS (SELECT tile_id, {CONFUSION} FROM pg GROUP BY 1), m AS (SELECT *, {METRICS} FROM c) SELECT count(*) n_tiles, " + ", ".join(f"round(avg({n}), 6) mean_{n}, round(stddev_pop({n}), 6) std_{n}" for n in ("iou", "precision", "recall", "f1")) + " FROM m WHERE tp + fn >= 50"))
def r35_r55_tile_means(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.mean_metrics(raster.confusion(raster.paired(pred, truth))))


@query(sql("pg", "SELECT tile_id, sum(p)::BIGINT n_sar, sum(g)::BIGINT n_optical, sum(p * (1 - g))::BIGINT n_occluded, sum(p * g)::BIGINT n_both FROM pg GROUP BY 1"))
def r05_occlusion(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return raster.occlusion_counts(pred, truth)


@query(sql("pg", "SELECT tile_id, CASE WHEN p = 1 AND g = 1 THEN 'TP' WHEN p = 1 THEN 'FP' WHEN g = 1 THEN 'FN' ELSE 'TN' END cls, count(*) n FROM pg GROUP BY 1, 2"))
def r38_discrepancy(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return raster.discrepancy(raster.paired(pred, truth)).groupBy("tile_id", "cls").agg(F.count("*").alias("n"))


@query(sql("pg", "SELECT tile_id, round(avg(p), 6) predicted, round(avg(g), 6) truth, round(abs(avg(p) - avg(g)), 6) gap FROM pg GROUP BY 1"))
def r37_r60_density(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.density(pred, truth))


@query(sql("probs", "SELECT ceil(p * 10)::INT bin, count(*) n, round(avg(p), 6) confidence, round(avg(y), 6) accuracy FROM probs WHERE p > 0 GROUP BY 1"))
def r36_reliability(spark, sf_dir):
    return rounded(raster.calibration(views.probabilities(spark, sf_dir)))


@query(sql("probs", ", b AS (SELECT count(*) n, avg(p) c, avg(y) a FROM probs WHERE p > 0 GROUP BY ceil(p * 10)) SELECT round(sum(n * abs(c - a)) / sum(n), 6) ece FROM b"))
def r36_calibration_error(spark, sf_dir):
    return rounded(raster.expected_calibration_error(raster.calibration(views.probabilities(spark, sf_dir))))


@query(sql("probs", ", q AS (SELECT greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) q, y FROM probs), r AS (SELECT *, y * q + (1 - y) * (1 - q) r, y * 0.25::DOUBLE + (1 - y) * 0.75::DOUBLE w FROM q) SELECT round(1 - (2 * sum(q * y) + 1) / (sum(q) + sum(y) + 1), 6) dice, round(avg(-ln(r)), 6) bce, round(avg(-w * pow(1 - r, 2) * ln(r)), 6) focal FROM r"))
def r44_losses(spark, sf_dir):
    return rounded(raster.losses(views.probabilities(spark, sf_dir)))


def _pixels(spark, sf_dir):
    truth, _ = views.masks(spark, sf_dir)
    return truth.select("tile_id", "row", "col", F.col("v").alias("y")).join(views.optical(spark, sf_dir, 1).select("tile_id", "row", "col", (F.col("value") - 0.3).alias("p")), ["tile_id", "row", "col"])


def _line(axis: str, frame: str = "") -> str:
    other = "col" if axis == "row" else "row"
    return f'OVER (PARTITION BY tile_id, "{axis}" ORDER BY "{other}" {frame})'


def sobel_sql(source: str, value: str, name: str) -> str:
    """Tables of the two passes of the Sobel filter."""
    w, lag = _line("row"), lambda c, n, o: f"coalesce(lag({c}, {n}) {o}, 0)"
    one = f', {name}1 AS MATERIALIZED (SELECT tile_id, "row", col, {lag(value, -1, w)} - {lag(value, 1, w)} AS d, {lag(value, 1, w)} + 2 * {value} + {lag(value, -1, w)} AS s FROM {source})'
    w = _line("col")
    return one + f', {name} AS MATERIALIZED (SELECT tile_id, "row", col, sqrt(pow({lag("d", 1, w)} + 2 * d + {lag("d", -1, w)}, 2) + pow({lag("s", -1, w)} - {lag("s", 1, w)}, 2) + 1e-8::DOUBLE) AS edge FROM {name}1)'


def pooled_sql(source: str, value: str, pick: str, name: str) -> str:
    near = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return f', {name}a AS MATERIALIZED (SELECT tile_id, "row", col, {pick}({value}) {_line("row", near)} v FROM {source}), {name} AS MATERIALIZED (SELECT tile_id, "row", col, {pick}(v) {_line("col", near)} v FROM {name}a)'


def skeleton_sql(value: str, rounds: int = 10) -> str:
    """The soft skeleton of a column of px, as sk_<value>."""
    out, before, gone = f', {value}0 AS MATERIALIZED (SELECT tile_id, "row", col, {value}::DOUBLE v FROM px)', f"{value}0", []
    for r in range(1, rounds + 1):
        thin, open_ = f"{value}{r}", f"{value}o{r}"
        out += pooled_sql(before, "v", "min", thin) + pooled_sql(thin, "v", "max", open_)
        gone.append(f'SELECT tile_id, "row", col, greatest(b.v - o.v, 0) g FROM {before} b JOIN {open_} o USING (tile_id, "row", col)')
        before = thin
    return out + f', sk_{value} AS MATERIALIZED (SELECT tile_id, "row", col, least(sum(g), 1) v FROM ({" UNION ALL ".join(gone)}) GROUP BY 1, 2, 3)'


COMBINED = (
    ', px AS MATERIALIZED (SELECT tile_id, "row", col, v y, value - 0.3::DOUBLE p FROM truth JOIN opt USING (tile_id, "row", col) WHERE band = 0)'
    + sobel_sql("px", "p", "sp") + sobel_sql("px", "y", "sy")
    + f', za AS MATERIALIZED (SELECT tile_id, "row", col, max(y) {_line("row", "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING")} z FROM px), zone AS MATERIALIZED (SELECT tile_id, "row", col, (max(z) {_line("col", "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING")} > 0)::INT z FROM za)'
    + ', bl AS (SELECT sum(z * pow(sp.edge - sy.edge, 2)) / (sum(z) + 1e-8::DOUBLE) boundary FROM sp JOIN sy USING (tile_id, "row", col) JOIN zone USING (tile_id, "row", col))'
    + skeleton_sql("p") + skeleton_sql("y")
    + ', cl AS (SELECT 1 - avg(d) connectivity FROM (SELECT (2 * sum(a.v * b.v) + 1) / (sum(a.v) + sum(b.v) + 1) d FROM sk_p a JOIN sk_y b USING (tile_id, "row", col) GROUP BY tile_id))'
    + ", q AS (SELECT greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) q, y FROM px), r AS (SELECT *, y * q + (1 - y) * (1 - q) r, y * 0.25::DOUBLE + (1 - y) * 0.75::DOUBLE w FROM q)"
    + ", pl AS (SELECT 1 - (2 * sum(q * y) + 1) / (sum(q) + sum(y) + 1) dice, avg(-ln(r)) bce, avg(-w * pow(1 - r, 2) * ln(r)) focal FROM r)"
    + " SELECT round(dice, 6) dice, round(bce, 6) bce, round(focal, 6) focal, round(boundary, 6) boundary, round(connectivity, 6) connectivity, round(0.4::DOUBLE * dice + 0.3::DOUBLE * focal + 0.2::DOUBLE * boundary + 0.1::DOUBLE * connectivity, 6) total FROM pl, bl, cl"
)


@query(sql("truth opt", COMBINED))
def r44_combined_loss(spark, sf_dir):
    return rounded(raster.combined_loss(_pixels(spark, sf_dir)))


LABELLED = ", p AS (SELECT tile_id, \"row\" AS r, col c FROM pred WHERE v = 1), f(tile_id, r, c, r0, c0) AS (SELECT tile_id, r, c, r, c FROM p UNION SELECT f.tile_id, p.r, p.c, r0, c0 FROM f JOIN p ON p.tile_id = f.tile_id AND abs(p.r - f.r) + abs(p.c - f.c) = 1), l AS (SELECT tile_id, r, c, min(r0 * 10000000::BIGINT + c0) k FROM f GROUP BY 1, 2, 3), s AS (SELECT tile_id, k, count(*) n FROM l GROUP BY 1, 2)"


@query(
    sql(
        "pg", LABELLED + """, parts AS (SELECT tile_id, count(*) FILTER (n >= 10) n_components, count(*) FILTER (n < 10) n_filtered, round(coalesce(max(n) FILTER (n >= 10), 0) / sum(n), 6) largest_share FROM s GROUP BY 1),
    m AS (SELECT tile_id, count(*) FILTER (p = 1 AND g = 1) tp, count(*) FILTER (p = 1 AND g = 0) fp, count(*) FILTER (p = 0 AND g = 1) fn, count(*) FILTER (p = 0 AND g = 0) tn, round(avg(p), 6) density, round(avg(g), 6) truth_density FROM pg GROUP BY 1)
    SELECT tile_id, n_components, n_filtered, largest_share, density, tp, fp, fn, tn, round(tp / (tp + fp + fn), 6) iou, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy, truth_density
    FROM parts JOIN m USING (tile_id)""",
    )
)
def r47_evaluation(spark, sf_dir):
    truth, predicted = views.masks(spark, sf_dir)
    return rounded(raster.evaluated(predicted, truth))


@query(sql("truth", """, faulty AS (SELECT *, CASE WHEN "row" BETWEEN 40 AND 44 AND col BETWEEN 0 AND 40 THEN 1 WHEN "row" BETWEEN 10 AND 30 AND col BETWEEN 20 AND 30 THEN 0 ELSE v END p FROM truth)
    SELECT tile_id, count(*) FILTER (p = 1 AND v = 1) tp, count(*) FILTER (p = 1 AND v = 0) fp, count(*) FILTER (p = 0 AND v = 1) fn, round(count(*) FILTER (p = 1 AND v = 1) / count(*) FILTER (p = 1 OR v = 1), 6) iou FROM faulty GROUP BY 1"""))
def r58_known_faults(spark, sf_dir):
    truth, _ = views.masks(spark, sf_dir)
    faulty = raster.with_known_faults(truth, (10, 30, 20, 30), (40, 44, 0, 40))
    return rounded(raster.confusion(raster.paired(faulty, truth)).select("tile_id", "tp", "fp", "fn", "iou"))


@query()
def r51_synthetic_tiles(spark, sf_dir):
    return rounded(rasters.synthetic_tiles(views.masks(spark, sf_dir)[0]))


@query(
    """WITH m AS (SELECT s_suppkey::BIGINT id, 1.0::DOUBLE + s_suppkey % 30 resolution_m, CASE s_suppkey % 5 WHEN 0 THEN 'LISS-IV' WHEN 1 THEN 'Sentinel-2' WHEN 2 THEN ' sentinel 1 ' WHEN 3 THEN 's1' ELSE 'drone' END AS source FROM supplier),
    p AS (SELECT *, CASE source WHEN 'LISS-IV' THEN 5.8::DOUBLE WHEN 'drone' THEN resolution_m ELSE 10.0::DOUBLE END pixel_m, CASE source WHEN 'Sentinel-2' THEN 2 WHEN ' sentinel 1 ' THEN 2 ELSE 4 END gap FROM m),
    s AS (SELECT *, round(gap * pixel_m * 1.5::DOUBLE, 1) snap_m FROM p)
    SELECT id, resolution_m, source, pixel_m, snap_m, round(snap_m * 1.75::DOUBLE, 1) second_snap_m, round(greatest(pixel_m * 1.5::DOUBLE, 5), 1) stub_m, round(greatest(pixel_m * 3, 10), 1) least_road_m,
           round(greatest(pixel_m * 2, 7), 1) road_width_m, round(pixel_m * 8, 1) wide_stub_m, greatest(1, round(pixel_m / 5.8::DOUBLE))::INT closing_px FROM s"""
)
def s29_thresholds(spark, sf_dir):
    k = F.col("s_suppkey")
    source = F.element_at(F.array(*(F.lit(x) for x in ("LISS-IV", "Sentinel-2", " sentinel 1 ", "s1", "drone"))), (k % 5 + 1).cast("int"))
    return settings.thresholds(views.table(spark, sf_dir, "supplier").select(k.cast("long").alias("id"), (1.0 + k % 30).alias("resolution_m"), source.alias("source")))


@query(sql("n100 b100 e100", f", deg AS ({DEGREE}) SELECT (SELECT count(*) FROM deg WHERE degree > 1) n_intersections, round((SELECT count(*) FROM deg WHERE degree > 1) / 7.04::DOUBLE, 6) per_km2, round(sum(weight_m), 6) length_m, round(sum(weight_m) / sum({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) circuity FROM e100 JOIN n100 a ON a.id = source JOIN n100 b ON b.id = target"))
def x21_street_statistics(spark, sf_dir):
    return rounded(topology.street_statistics(*views.supplier_grid(spark, sf_dir)))


AROUND = "(SELECT unnest(range(-{n}, {n} + 1)) dr) a, (SELECT unnest(range(-{n}, {n} + 1)) dc) b"
ON = 'SELECT tile_id, "row" AS r, col c FROM truth WHERE v = 1'


def dilated_sql(mask: str, n: int, keep: str = "true") -> str:
    at = AROUND.replace("{n}", str(n))
    return f'SELECT t.tile_id, t."row", t.col, (x.r IS NOT NULL)::INT v FROM {mask} t LEFT JOIN (SELECT DISTINCT tile_id, "row" + dr r, col + dc c FROM {mask}, {at} WHERE v = 1 AND {keep}) x ON x.tile_id = t.tile_id AND x.r = t."row" AND x.c = t.col'


def eroded_sql(mask: str, n: int, keep: str = "true") -> str:
    at = AROUND.replace("{n}", str(n))
    return f'SELECT t.tile_id, t."row", t.col, (t.v = 1 AND x.r IS NULL)::INT v FROM {mask} t LEFT JOIN (SELECT DISTINCT tile_id, "row" + dr r, col + dc c FROM {mask}, {at} WHERE v = 0 AND {keep}) x ON x.tile_id = t.tile_id AND x.r = t."row" AND x.c = t.col'


@query(sql("truth", f", d AS ({dilated_sql('truth', 1)}), e AS ({eroded_sql('truth', 1, 'abs(dr) + abs(dc) <= 1')}) SELECT d.tile_id, d.\"row\", d.col, d.v dilated, e.v eroded FROM d JOIN e USING (tile_id, \"row\", col)"))
def r11_morphology(spark, sf_dir):
    truth, _ = views.masks(spark, sf_dir)
    d, e = raster.dilate(truth, raster.square(1)), raster.erode(truth, raster.CROSS)
    return d.withColumnRenamed("v", "dilated").join(e.withColumnRenamed("v", "eroded"), ["tile_id", "row", "col"])


@query(sql("truth", f", d AS ({dilated_sql('truth', 3, 'dr * dr + dc * dc <= 9')}) {eroded_sql('d', 3, 'dr * dr + dc * dc <= 9')}"))
def r11_r49_closing(spark, sf_dir):
    return raster.close_mask(views.masks(spark, sf_dir)[0], raster.disk(3))


@query()
def r10_labels(spark, sf_dir):
    return raster.label(views.masks(spark, sf_dir)[0], 4)


@query(sql("truth", f", p AS ({ON}), f(tile_id, r, c, r0, c0) AS (SELECT tile_id, r, c, r, c FROM p UNION SELECT f.tile_id, p.r, p.c, r0, c0 FROM f JOIN p ON p.tile_id = f.tile_id AND abs(p.r - f.r) + abs(p.c - f.c) = 1), l AS (SELECT tile_id, r, c, min(r0 * 10000000::BIGINT + c0) k FROM f GROUP BY 1, 2, 3), s AS (SELECT tile_id, k, count(*) n FROM l GROUP BY 1, 2) SELECT tile_id, count(*) FILTER (n >= 10) n_components, count(*) FILTER (n < 10) n_filtered, round(coalesce(max(n) FILTER (n >= 10), 0) / sum(n), 6) largest_share FROM s GROUP BY 1"))
def r09_component_stats(spark, sf_dir):
    return rounded(raster.component_stats(views.masks(spark, sf_dir)[0]))


@query()
def r01_preprocess(spark, sf_dir):
    return raster.preprocess(views.masks(spark, sf_dir)[0], 10.0)


@query()
def r08_postprocess(spark, sf_dir):
    return raster.postprocess(views.masks(spark, sf_dir)[0])


@query()
def r02_r03_skeletons(spark, sf_dir):
    return raster.skeletonise(views.masks(spark, sf_dir)[1])


@query()
def r04_v07_skeleton_metrics(spark, sf_dir):
    return rounded(raster.skeleton_metrics(raster.skeletonise(views.masks(spark, sf_dir)[1]), 5.8))


@query()
def r31_skeleton_iou(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.skeleton_iou(pred, truth, 1.0))


@query(
    sql(
        "truth pred",
        f""", a AS ({dilated_sql('truth', 2)}), b AS ({dilated_sql('pred', 2)}) SELECT tile_id, round(avg(a.v) FILTER (p.v = 1), 6) AS precision, round(avg(b.v) FILTER (t.v = 1), 6) recall
        FROM truth t JOIN pred p USING (tile_id, "row", col) JOIN a USING (tile_id, "row", col) JOIN b USING (tile_id, "row", col) GROUP BY 1""",
    )
)
def r32_tolerant_scores(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.tolerant_scores(pred, truth))


def mirrored_sql(name: str, n: int, value: str) -> str:
    """name with mirrored borders; tiles are 50 (the last may be lower) by 64."""
    return f'SELECT tile_id, y AS "row", x AS col, {value} FROM {name} JOIN (SELECT tile_id, max("row") h FROM {name} GROUP BY 1) USING (tile_id), LATERAL (SELECT unnest([{name}."row", CASE WHEN {name}."row" < {n} THEN -1 - {name}."row" END, CASE WHEN {name}."row" > h - {n} THEN 2 * h + 1 - {name}."row" END]) y), LATERAL (SELECT unnest([{name}.col, CASE WHEN {name}.col < {n} THEN -1 - {name}.col END, CASE WHEN {name}.col > 63 - {n} THEN 127 - {name}.col END]) x) WHERE y IS NOT NULL AND x IS NOT NULL'


@query(
    sql(
        "opt",
        f""", one AS (SELECT tile_id, "row", col, value FROM opt WHERE band = 0), m AS ({mirrored_sql('one', 3, 'value')}),
        w AS (SELECT tile_id, "row", col, sum(value) OVER (PARTITION BY tile_id, "row" ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) s, sum(value * value) OVER (PARTITION BY tile_id, "row" ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) ss FROM m),
        z AS (SELECT tile_id, "row", col, sum(s) OVER (PARTITION BY tile_id, col ORDER BY "row" RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 49 mean, sum(ss) OVER (PARTITION BY tile_id, col ORDER BY "row" RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 49 sq FROM w)
        SELECT tile_id, 0::INT band, "row", col, round(mean + greatest(sq - mean * mean, 0) / (greatest(sq - mean * mean, 0) + 0.273::DOUBLE) * (value - mean), 6) AS value FROM z JOIN one USING (tile_id, "row", col)""",
    )
)
def r12_lee_filter(spark, sf_dir):
    return rounded(raster.lee(views.optical(spark, sf_dir, 1)))


@query(
    sql(
        "opt",
        f""", one AS (SELECT tile_id, "row", col, value FROM opt WHERE band = 0), m AS ({mirrored_sql('one', 2, 'value')})
        SELECT t.tile_id, 0::INT band, t."row", t.col, round(quantile_cont(m.value, 0.5), 6) AS value FROM one t, (SELECT unnest(range(-2, 3)) dr) a, (SELECT unnest(range(-2, 3)) dc) b, m WHERE m.tile_id = t.tile_id AND m."row" = t."row" + dr AND m.col = t.col + dc GROUP BY 1, 2, 3, 4""",
    )
)
def r13_median_filter(spark, sf_dir):
    return rounded(raster.median_filter(views.optical(spark, sf_dir, 1)))


@query(sql("sar", ", m AS (SELECT tile_id, quantile_cont(value, 0.5) m FROM sar WHERE band = 0 GROUP BY 1) SELECT tile_id, band, \"row\", col, round(CASE WHEN m < 0 THEN value ELSE 10 * log10(greatest(value, 1e-10)) END, 6) AS value FROM sar JOIN m USING (tile_id)"))
def r14_decibel(spark, sf_dir):
    return rounded(raster.to_decibel(views.sar(spark, sf_dir)))


@query(sql("sar", ", q AS (SELECT tile_id, band, quantile_cont(value, 0.01) lo, quantile_cont(value, 0.99) hi FROM sar GROUP BY 1, 2) SELECT tile_id, band, \"row\", col, round(least(1, greatest(0, (value - lo) / greatest(hi - lo, 1e-8))), 6) AS value FROM sar JOIN q USING (tile_id, band)"))
def r15_r54_percentile_scaled(spark, sf_dir):
    return rounded(raster.percentile_scaled(views.sar(spark, sf_dir)))


@query(sql("opt", ", q AS (SELECT tile_id, band, quantile_cont(value, 0.02) lo, quantile_cont(value, 0.98) hi FROM opt GROUP BY 1, 2), c AS (SELECT opt.* REPLACE (least(hi, greatest(lo, value)) AS value) FROM opt JOIN q USING (tile_id, band)), s AS (SELECT tile_id, band, avg(value) m, stddev_pop(value) d FROM c GROUP BY 1, 2) SELECT tile_id, band, \"row\", col, round((value - m) / greatest(d, 1e-8), 5) AS value FROM c JOIN s USING (tile_id, band)"))
def r17_r53_z_scored(spark, sf_dir):
    z = raster.z_scored(views.optical(spark, sf_dir))
    return z.withColumn("value", F.round("value", 5))


@query(sql("opt", "SELECT tile_id, \"row\", col, (avg(value) > 0.85 AND stddev_pop(value) < 0.05)::INT v FROM opt GROUP BY 1, 2, 3"))
def r18_cloud_mask(spark, sf_dir):
    return raster.cloud_mask(views.optical(spark, sf_dir))


CLOUDS = ", cl AS (SELECT tile_id, avg((m > 0.8)::INT) cloud FROM (SELECT tile_id, \"row\", col, avg(value) m FROM opt WHERE band < 3 GROUP BY 1, 2, 3) GROUP BY 1)"


@query(sql("opt", CLOUDS + " SELECT tile_id, round(cloud, 5) cloud FROM cl"))
def r42_cloud_share(spark, sf_dir):
    return raster.cloud_share(views.optical(spark, sf_dir), bright=0.8).select("tile_id", F.round("cloud", 5).alias("cloud"))


@query(sql("opt sar", CLOUDS + " SELECT tile_id, band, \"row\", col, round(CASE WHEN cloud > 0.5 THEN 0 ELSE value END, 6) AS value FROM opt JOIN cl USING (tile_id) UNION ALL SELECT tile_id, band + 4, \"row\", col, round(CASE WHEN cloud > 0.5 THEN value * 2 ELSE value END, 6) FROM sar JOIN cl USING (tile_id)"))
def r20_fusion(spark, sf_dir):
    optical = views.optical(spark, sf_dir)
    return rounded(raster.fused(optical, views.sar(spark, sf_dir), raster.cloud_share(optical, bright=0.8)))


BAND = 'SELECT tile_id, "row", col, max(value) FILTER (band = 1) g, max(value) FILTER (band = 2) r, max(value) FILTER (band = 3) n FROM opt GROUP BY 1, 2, 3'


@query(sql("opt", f'SELECT tile_id, "row", col, round(((n - r) / (n + r + 1e-6) + 1) / 2, 6) ndvi, round(((g - n) / (g + n + 1e-6) + 1) / 2, 6) ndwi FROM ({BAND})'))
def r21_indices(spark, sf_dir):
    return rounded(raster.indices(views.optical(spark, sf_dir)))


def _turned(optical: DataFrame) -> DataFrame:
    return optical.withColumn("col", (F.col("col") + 1) % 64)


TURNED = '(SELECT tile_id, band, "row", ((col + 1) % 64)::INT col, value FROM opt)'


@query(sql("opt", f'SELECT a.tile_id, a.band, a."row", a.col, round(abs(a.value - b.value), 6) AS value FROM opt a JOIN {TURNED} b USING (tile_id, band, "row", col)'))
def r23_temporal_difference(spark, sf_dir):
    optical = views.optical(spark, sf_dir)
    return rounded(raster.temporal_difference(optical, _turned(optical)))


@query(sql("opt sar", f'SELECT tile_id, band, count(*) n, round(sum(value), 3) total FROM (SELECT tile_id, band, value FROM opt UNION ALL SELECT tile_id, 4, ((n - r) / (n + r + 1e-6) + 1) / 2 FROM ({BAND}) UNION ALL SELECT tile_id, 5, ((g - n) / (g + n + 1e-6) + 1) / 2 FROM ({BAND}) UNION ALL SELECT tile_id, band + 6, value FROM sar UNION ALL SELECT a.tile_id, a.band + 8, abs(a.value - b.value) FROM opt a JOIN {TURNED} b USING (tile_id, band, "row", col)) GROUP BY 1, 2'))
def r22_channels(spark, sf_dir):
    optical = views.optical(spark, sf_dir)
    stack = raster.channels(optical, raster.indices(optical), views.sar(spark, sf_dir), raster.temporal_difference(optical, _turned(optical)))
    return stack.groupBy("tile_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(sql("opt sar", ", c AS (SELECT tile_id, band, avg(value) m, stddev_samp(value) d FROM opt WHERE band < 2 GROUP BY 1, 2), s AS (SELECT tile_id, band, avg(value) m, stddev_samp(value) d FROM sar WHERE band < 2 GROUP BY 1, 2) SELECT o.tile_id, o.band, o.\"row\", o.col, round(CASE WHEN o.band < 2 THEN least(1, greatest(0, (value - c.m) / greatest(c.d, 1e-6) * s.d + s.m)) ELSE value END, 6) AS value FROM opt o LEFT JOIN c USING (tile_id, band) LEFT JOIN s USING (tile_id, band)"))
def r43_style_transfer(spark, sf_dir):
    return rounded(raster.style_transfer(views.optical(spark, sf_dir), views.sar(spark, sf_dir), 2))


@query(sql("opt", 'SELECT tile_id, "row", col, round(avg(value), 6) AS value, round(stddev_samp(value), 6) uncertainty FROM opt GROUP BY 1, 2, 3'))
def r40_ensemble(spark, sf_dir):
    return rounded(raster.ensemble(views.optical(spark, sf_dir)))


@query(sql("opt", ', e AS (SELECT tile_id, avg(value) v, stddev_samp(value) u FROM opt GROUP BY tile_id, "row", col) SELECT tile_id, round(avg((u > 0.06)::INT), 6) uncertain FROM e WHERE v > 0.5 GROUP BY 1'))
def r41_uncertain_share(spark, sf_dir):
    return rounded(raster.uncertain_share(raster.ensemble(views.optical(spark, sf_dir)), 0.06))


def _squares(spark, sf_dir):
    return views.optical(spark, sf_dir, 1).where("col < 50").drop("band")


@query(sql("opt", ', s AS (SELECT tile_id, "row" AS r, col c, value FROM opt WHERE band = 0 AND col < 50 AND tile_id IN (SELECT tile_id FROM opt GROUP BY 1 HAVING max("row") = 49)) SELECT tile_id, r AS "row", c AS col, round(value, 6) AS value, 0.0::DOUBLE uncertainty FROM s'))
def r39_r46_r57_augmented_mean(spark, sf_dir):
    squares = _squares(spark, sf_dir)
    full = squares.groupBy("tile_id").agg(F.max("row").alias("m")).where("m = 49").select("tile_id")
    return rounded(raster.augmented_mean(squares.join(full, "tile_id", "left_semi"), lambda r: r))


@query()
def r33_edge_scores(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.edge_scores(pred, truth))


@query()
def r34_width_split(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    return rounded(raster.width_split_iou(pred, truth))


@query()
def r16_r19_resized(spark, sf_dir):
    return rounded(raster.resized(views.optical(spark, sf_dir, 2), 25, 40))


@query()
def r16_padded(spark, sf_dir):
    return rounded(raster.padded_to(views.optical(spark, sf_dir, 1)))


@query()
def r26_burned(spark, sf_dir):
    _, edges = views.nation_grid(spark, sf_dir)
    return raster.burned(edges.withColumn("tile_id", F.lit(0)), lambda lat, lon: geo.burn_pixel(lat, lon, TEST_BOX, 128, 128))


@query()
def r27_buffered(spark, sf_dir):
    _, edges = views.nation_grid(spark, sf_dir)
    return rounded(raster.buffered(views.customer_points(spark, sf_dir), edges, 2e-4))


@query()
def r24_r25_occlusions(spark, sf_dir):
    truth, _ = views.masks(spark, sf_dir)
    return rounded(rasters.occluded(views.optical(spark, sf_dir, 2), rasters.blobs(truth, 3, (3, 9)), level=0.95))


@query()
def r06_r07_synthetic_sar(spark, sf_dir):
    return raster.synthetic_sar(views.masks(spark, sf_dir)[0])


@query()
def s21_s22_s23_synthetic_bands(spark, sf_dir):
    mask = rasters.arterial_mask(spark)
    return rounded(rasters.synthetic_raster(mask, 4).union(rasters.synthetic_speckle(mask).withColumn("band", F.col("band") + 4)))


@query()
def r48_network_noise(spark, sf_dir):
    return rasters.with_network_noise(rasters.arterial_mask(spark))


@query()
def r50_robustness_sweep(spark, sf_dir):
    truth, pred = views.masks(spark, sf_dir)
    levels = None
    for k in (0, 2, 4):
        cut = rasters.blobs(truth, k, (3, 9)) if k else None
        p = pred if cut is None else pred.join(cut.withColumn("off", F.lit(1)), ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", F.when(F.col("off").isNull(), F.col("v")).otherwise(0).alias("v"))
        one = raster.paired(p, truth).withColumn("level", F.lit(k))
        levels = one if levels is None else levels.union(one)
    return rounded(raster.sweep(levels))


@query()
def r52_seeded_masks(spark, sf_dir):
    return rasters.seeded_masks(rasters.grid_mask(spark, 60, 20, 3, 10), spark.range(10).select(F.col("id").cast("int").alias("seed")))


@query('WITH px AS (SELECT i // 200 AS r, i % 200 AS c FROM range(40000) t(i)) SELECT 0::INT tile_id, r::INT AS "row", c::INT col, ((r % 40 < 5 OR c % 40 < 5) AND NOT (r BETWEEN 80 AND 119 AND c BETWEEN 80 AND 119))::INT v FROM px')
def r59_grid_mask(spark, sf_dir):
    return rasters.grid_mask(spark)
