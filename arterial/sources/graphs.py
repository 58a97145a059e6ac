"""Road graphs from and to JSON, OSM responses and generated grids."""

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, point
from ..operators.components import components
from ..schema import CRS, EDGES, GRAPH_JSON, NODES, OVERPASS_JSON, TEST_BOX, Box


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graph files under a path; graph_id is the file. Broken JSON fails the query."""
    files = spark.read.schema(GRAPH_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("graph_id", F.input_file_name())
    nodes = files.select("graph_id", F.posexplode("nodes").alias("node_ord", "n")).select("graph_id", "n.id", "n.lat", "n.lon", F.col("node_ord").cast("long").alias("node_ord"))
    edges = files.select("graph_id", F.posexplode("edges").alias("i", "e"))
    line = F.transform("e.geometry", lambda p: point(p[0], p[1]))
    return nodes, edges.select("graph_id", F.col("i").cast("long").alias("edge_idx"), "e.source", "e.target", "e.weight_m", line.alias("geometry"), "e.road_type")


def frames_of(spark: SparkSession, document: dict, graph_id: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph held as a dictionary."""
    nodes = [(graph_id, n["id"], float(n["lat"]), float(n["lon"]), i) for i, n in enumerate(document["nodes"])]
    edges = [(graph_id, i, e["source"], e["target"], float(e["weight_m"]), [(float(a), float(b)) for a, b in e["geometry"]]) for i, e in enumerate(document["edges"])]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, crs: str = CRS) -> None:
    """One JSON document as a text file; road_type goes along where edges have it."""
    order = "node_ord" if "node_ord" in nodes.columns else "id"
    extra = ["road_type"] if "road_type" in edges.columns else []
    ns = nodes.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct("id", "lat", "lon").alias("n")))).alias("n")).select(F.transform("n", lambda x: x["n"]).alias("nodes"))
    line = F.transform("geometry", lambda p: F.array(p["lat"], p["lon"])).alias("geometry")
    es = edges.agg(F.sort_array(F.collect_list(F.struct(F.col("edge_idx").alias("o"), F.to_json(F.struct("source", "target", "weight_m", line, *extra)).alias("e")))).alias("e")).select(F.transform("e", lambda x: x["e"]).alias("edges"))
    text = F.concat(F.lit(f'{{"crs": "{crs}", "nodes": '), F.to_json("nodes"), F.lit(', "edges": ['), F.array_join("edges", ", "), F.lit("]}"))
    ns.crossJoin(es).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_overpass(spark: SparkSession, path: str, default_length: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """OSM elements; ways become edges between consecutive nodes that are known, weighing the great circle or else the default."""
    elements = spark.read.schema(OVERPASS_JSON).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    nodes = elements.where("e.type = 'node'").select("e.id", "e.lat", "e.lon").dropDuplicates(["id"])
    hops = elements.where("e.type = 'way'").select(F.col("e.id").alias("way"), F.posexplode(F.arrays_zip(F.col("e.nodes").alias("a"), F.slice("e.nodes", 2, F.greatest(F.size("e.nodes") - 1, F.lit(0))).alias("b")))).where("col.b is not null").select("way", "pos", "col.a", "col.b")
    for s in "ab":
        hops = hops.join(nodes.select(F.col("id").alias(s), point(F.col("lat"), F.col("lon")).alias(f"p{s}")), s)
    weight = F.coalesce(haversine(F.col("pa.lat"), F.col("pa.lon"), F.col("pb.lat"), F.col("pb.lon")), F.lit(default_length))
    index = F.row_number().over(Window.orderBy("way", "pos")).cast("long") - 1
    return nodes, hops.select(index.alias("edge_idx"), F.col("a").alias("source"), F.col("b").alias("target"), weight.alias("weight_m"), F.array("pa", "pb").alias("geometry"))


def normalised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids from 0 in order, the first edge of each pair, a positive weight: the given one, else the great circle, else 1; rounded to millimetres."""
    ids = nodes.select("id", "lat", "lon", (F.row_number().over(Window.orderBy("id")).cast("long") - 1).alias("new"))
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("edge_idx")
    first = edges.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")
    for end in ("source", "target"):
        first = first.join(ids.select(F.col("id").alias(end), F.col("new").alias(f"{end}_new"), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon")), end)
    direct = haversine(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon"))
    weight = F.when(F.col("weight_m") > 0, F.col("weight_m")).when(direct > 0, direct).otherwise(1.0)
    index = F.row_number().over(Window.orderBy("edge_idx")).cast("long") - 1
    out = first.select(index.alias("edge_idx"), F.col("source_new").alias("source"), F.col("target_new").alias("target"), F.round(weight, 3).alias("weight_m"), "geometry")
    return ids.select(F.col("new").alias("id"), "lat", "lon"), out


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of the graph in its largest component (the one with the smallest id of equals)."""
    labels = components(nodes, edges)
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = labels.join(F.broadcast(top), "component", "left_semi").select("id")
    return nodes.join(kept, "id", "left_semi"), edges.join(kept.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)


def grid_graph(spark: SparkSession, rows: int = 5, cols: int = 5, box: Box = TEST_BOX) -> tuple[DataFrame, DataFrame]:
    """A street grid over the box; edges first along rows, then along columns."""
    at = spark.range(rows * cols).select("id", F.expr(f"id div {cols}").alias("r"), (F.col("id") % cols).alias("c"))
    lat = box.min_lat + (box.max_lat - box.min_lat) * (F.col("r") / (rows - 1))
    lon = box.min_lon + (box.max_lon - box.min_lon) * (F.col("c") / (cols - 1))
    nodes = at.select(F.lit("grid").alias("graph_id"), "id", lat.alias("lat"), lon.alias("lon"), F.col("id").alias("node_ord"))
    right = at.where(F.col("c") < cols - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(0).alias("kind"))
    down = at.where(F.col("r") < rows - 1).select(F.col("id").alias("source"), (F.col("id") + cols).alias("target"), F.lit(1).alias("kind"))
    edges = right.union(down)
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(end), point(F.col("lat"), F.col("lon")).alias(f"p_{end}")), end)
    weight = F.greatest(F.round(haversine(F.col("p_source.lat"), F.col("p_source.lon"), F.col("p_target.lat"), F.col("p_target.lon")), 3), F.lit(1.0))
    index = F.row_number().over(Window.orderBy("kind", "source")).cast("long") - 1
    return nodes, edges.select(F.lit("grid").alias("graph_id"), index.alias("edge_idx"), "source", "target", weight.alias("weight_m"), F.array("p_source", "p_target").alias("geometry"))


def save_reference(nodes: DataFrame, edges: DataFrame, path: str, meta: dict) -> None:
    """A reference network as a local JSON file with a `_meta` header, by way of the driver; for files that people look at."""
    document = {
        "_meta": meta, "crs": CRS, "nodes": [{"id": r.id, "lat": r.lat, "lon": r.lon} for r in nodes.orderBy("id").toLocalIterator()],
        "edges": [{"source": r.source, "target": r.target, "weight_m": r.weight_m, "geometry": [[p.lat, p.lon] for p in r.geometry]} for r in edges.orderBy("edge_idx").toLocalIterator()],
    }
    Path(path).write_text(json.dumps(document))


def reference_network(spark: SparkSession, cache: str | None = None, overpass: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cached graph if there is one, else an OSM response's largest component, else the grid."""
    if cache and Path(cache).exists():
        return read_graphs(spark, cache)
    if overpass and Path(overpass).exists():
        return normalised(*largest_component(*read_overpass(spark, overpass)))
    return grid_graph(spark)


def feature_rows(nodes: DataFrame, crit: DataFrame, edges: DataFrame, lost: DataFrame) -> DataFrame:
    """GeoJSON features (value): nodes with a radius by criticality, edges with a flag for the lost ones."""
    place = lambda p: F.array(p["lon"], p["lat"])
    spots = nodes.join(crit, "id").select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("id", "crit", (8 + 12 * F.col("crit")).alias("radius")).alias("properties"))).alias("value"))
    flagged = edges.join(lost.select("edge_idx").withColumn("lost", F.lit(True)), "edge_idx", "left")
    lines = flagged.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("geometry", place).alias("coordinates")).alias("geometry"), F.struct("edge_idx", F.coalesce("lost", F.lit(False)).alias("lost")).alias("properties"))).alias("value"))
    return spots.union(lines)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML, an element a line, in as many part files as there are partitions; no line depends on another."""
    data = lambda key, c: F.concat(F.lit(f'<data key="{key}">'), F.col(c).cast("string"), F.lit("</data>"))
    line = F.array_join(F.transform("geometry", lambda p: F.concat_ws(" ", p["lat"].cast("string"), p["lon"].cast("string"))), ",")
    n = nodes.select(F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('">'), data("lat", "lat"), data("lon", "lon"), F.lit("</node>")).alias("value"))
    e = edges.withColumn("_line", line).select(F.concat(F.lit('<edge source="'), F.col("source").cast("string"), F.lit('" target="'), F.col("target").cast("string"), F.lit('">'), data("weight_m", "weight_m"), data("geometry", "_line"), F.lit("</edge>")).alias("value"))
    n.union(e).write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML whose elements stand on a line each."""
    text = spark.read.text(path)
    found = lambda pattern: F.regexp_extract("value", pattern, 1)
    data = lambda key: found(f'<data key="{key}">([^<]*)</data>')
    nodes = text.where(F.col("value").contains("<node ")).select(found('<node id="([^"]*)"').cast("long").alias("id"), data("lat").cast("double").alias("lat"), data("lon").cast("double").alias("lon"))
    line = F.transform(F.split(data("geometry"), ","), lambda p: point(F.split_part(p, F.lit(" "), F.lit(1)).cast("double"), F.split_part(p, F.lit(" "), F.lit(2)).cast("double")))
    edges = text.where(F.col("value").contains("<edge ")).select(found('source="([^"]*)"').cast("long").alias("source"), found('target="([^"]*)"').cast("long").alias("target"), data("weight_m").cast("double").alias("weight_m"), line.alias("geometry"))
    return nodes, edges
