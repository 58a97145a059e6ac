"""Road graphs, polylines and rasters derived from the star-schema tables, in Spark and in DuckDB's SQL alike."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_idx and geometry for pairs (source, target, weight_m)."""
    for end in ("source", "target"):
        pairs = pairs.join(nodes.select(F.col("id").alias(end), point(F.col("lat"), F.col("lon")).alias(f"p_{end}")), end)
    return pairs.select((F.col("source") * 100_000 + F.col("target")).alias("edge_idx"), "source", "target", F.col("weight_m").cast("double").alias("weight_m"), F.array("p_source", "p_target").alias("geometry"))


def nation_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The 25 nations as a five by five grid with whole weights, so that ties are exact."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (12.9177 + F.expr("n_nationkey div 5") * 0.005).alias("lat"), (77.6101 + F.col("n_nationkey") % 5 * 0.0075).alias("lon"))
    right = nodes.where("id % 5 < 4").select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    down = nodes.where("id < 20").select(F.col("id").alias("source"), (F.col("id") + 5).alias("target"))
    pairs = right.union(down).withColumn("weight_m", 100 + (F.col("source") * 37 + F.col("target") * 11) % 50)
    return nodes, _edges(pairs, nodes)


def supplier_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as a grid ten wide, about 30 m a step, without the edges that an account balance drops: gaps and dead ends."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.abs(F.round(F.col("s_acctbal") * 100)).cast("long").alias("cents"))
    nodes = s.select("id", (12.9177 + F.expr("id div 10") * 0.0003).alias("lat"), (77.6101 + F.col("id") % 10 * 0.0003).alias("lon"))
    keep = (F.col("cents") * 7 + F.col("target")) % 3 > 0
    right = s.where("id % 10 < 9").withColumn("target", F.col("id") + 1).where(keep)
    down = s.withColumn("target", F.col("id") + 10).where(keep)
    pairs = right.union(down).select(F.col("id").alias("source"), "target").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes, _edges(pairs.withColumn("weight_m", 20 + (F.col("source") * 13 + F.col("target") * 7) % 60), nodes)


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.abs(F.round(F.col("c_acctbal") * 100)).cast("long").alias("cents"))
    return c.select("id", (12.9177 + F.col("id") % 400 * 0.00005).alias("lat"), (77.6101 + F.col("cents") % 600 * 0.00005).alias("lon"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_idx, weight_m, geometry): an order's line items as a polyline, in their order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", point(12.9177 + F.col("l_partkey") % 1000 * 0.00002, 77.6101 + F.col("l_suppkey") % 1000 * 0.00003).alias("p"))
    grouped = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p"))).alias("x"))
    return grouped.select(F.col("l_orderkey").cast("long").alias("edge_idx"), (F.col("l_orderkey") % 500 + 1.0).alias("weight_m"), F.transform("x", lambda i: i["p"]).alias("geometry"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.expr("int(vec_id div 50)").alias("tile_id"), (F.col("vec_id") % 50).cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return e.select("tile_id", "row", "col", F.col("e").cast("double").alias("e"))


def masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth and prediction, tiles of 50 rows by the vectors' length."""
    v = _values(spark, sf_dir)
    return v.select("tile_id", "row", "col", (F.col("e") > 0.10).cast("int").alias("v")), v.select("tile_id", "row", "col", (F.col("e") > 0.06).cast("int").alias("v"))


def optical(spark: SparkSession, sf_dir: str, bands: int = 4) -> DataFrame:
    """Bands (tile_id, band, row, col, value): the vectors turned by 16 places a band, around 0.8."""
    v = _values(spark, sf_dir)
    turned = v.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    return turned.select("tile_id", "band", "row", ((F.col("col") + 16 * F.col("band")) % 64).alias("col"), (0.8 + F.col("e") / 2).alias("value"))


def sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir)
    two = v.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return two.select("tile_id", "band", "row", "col", (F.abs(F.col("e")) + 0.01 + 0.1 * F.col("band")).alias("value"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).cast("double").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


#: The same views as common table expressions.
SQL = {
    "n25": "SELECT n_nationkey::BIGINT id, 12.9177 + (n_nationkey // 5) * 0.005::DOUBLE lat, 77.6101 + (n_nationkey % 5) * 0.0075::DOUBLE lon FROM nation",
    "e25": "SELECT source * 100000 + target edge_idx, source, target, (100 + (source * 37 + target * 11) % 50)::DOUBLE weight_m FROM (SELECT id source, id + 1 target FROM n25 WHERE id % 5 < 4 UNION ALL SELECT id, id + 5 FROM n25 WHERE id < 20)",
    "b25": "SELECT source u, target v, weight_m w FROM e25 UNION ALL SELECT target, source, weight_m FROM e25",
    "s100": "SELECT s_suppkey::BIGINT id, abs(round(s_acctbal::DOUBLE * 100))::BIGINT cents FROM supplier",
    "n100": "SELECT id, 12.9177 + (id // 10) * 0.0003::DOUBLE lat, 77.6101 + (id % 10) * 0.0003::DOUBLE lon FROM s100",
    "e100": "SELECT source * 100000 + target edge_idx, source, target, (20 + (source * 13 + target * 7) % 60)::DOUBLE weight_m FROM (SELECT id source, id + 1 target, cents FROM s100 WHERE id % 10 < 9 UNION ALL SELECT id, id + 10, cents FROM s100) WHERE (cents * 7 + target) % 3 > 0 AND target IN (SELECT id FROM s100)",
    "b100": "SELECT source u, target v, weight_m w FROM e100 UNION ALL SELECT target, source, weight_m FROM e100",
    "pts": "SELECT id, 12.9177 + (id % 400) * 0.00005::DOUBLE lat, 77.6101 + (cents % 600) * 0.00005::DOUBLE lon FROM (SELECT c_custkey::BIGINT id, abs(round(c_acctbal::DOUBLE * 100))::BIGINT cents FROM customer)",
    "items": "SELECT l_orderkey::BIGINT edge_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) i, 12.9177 + (l_partkey % 1000) * 0.00002::DOUBLE lat, 77.6101 + (l_suppkey % 1000) * 0.00003::DOUBLE lon FROM lineitem",
    "hops": "SELECT *, lag(lat) OVER (PARTITION BY edge_idx ORDER BY i) plat, lag(lon) OVER (PARTITION BY edge_idx ORDER BY i) plon FROM items",
    "lines": "SELECT edge_idx, edge_idx % 500 + 1.0::DOUBLE weight_m, count(*) n_points, coalesce(sum({hav}), 0.0) length_m, min_by(lat, i) lat0, min_by(lon, i) lon0, max_by(lat, i) lat1, max_by(lon, i) lon1 FROM hops GROUP BY edge_idx",
    "vals": "SELECT (vec_id // 50)::INT tile_id, (vec_id % 50)::INT AS \"row\", (k - 1)::INT col, embedding[k]::DOUBLE e FROM embeddings, range(1, 65) r(k)",
    "truth": 'SELECT tile_id, "row", col, (e > 0.10)::INT v FROM vals',
    "pred": 'SELECT tile_id, "row", col, (e > 0.06)::INT v FROM vals',
    "pg": 'SELECT tile_id, "row", col, p.v p, t.v g FROM pred p JOIN truth t USING (tile_id, "row", col)',
    "opt": 'SELECT tile_id, b::INT band, "row", ((col + 16 * b) % 64)::INT col, 0.8::DOUBLE + e / 2 AS value FROM vals, range(0, 4) r(b)',
    "sar": 'SELECT tile_id, b::INT band, "row", col, abs(e) + 0.01::DOUBLE + 0.1::DOUBLE * b AS value FROM vals, range(0, 2) r(b)',
    "probs": "SELECT (l_discount * 10)::DOUBLE p, (l_returnflag = 'R')::INT y FROM lineitem",
}
NEEDS = {"e25": ["n25"], "b25": ["e25"], "n100": ["s100"], "e100": ["s100"], "b100": ["e100"], "hops": ["items"], "lines": ["hops"], "truth": ["vals"], "pred": ["vals"], "pg": ["truth", "pred"], "opt": ["vals"], "sar": ["vals"]}


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    chord = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371000 * asin(sqrt(least(greatest({chord}, 0), 1)))"


def sql(views: str, body: str) -> str:
    """WITH the named views and whatever they need; body goes on after them, either `, name AS (...)` or SELECT."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in names:
            names.append(name)

    for view in views.split():
        need(view)
    text = ", ".join(f"{n} AS MATERIALIZED ({SQL[n].replace('{hav}', haversine_sql('plat', 'plon', 'lat', 'lon'))})" for n in names)
    return f"WITH RECURSIVE {text} {body}"
