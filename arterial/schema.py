"""Schemas and locked constants of the data model."""

from dataclasses import dataclass

from pyspark.sql import types as T

# The contract between the stages.
CRS = "EPSG:4326"
COLLAPSE_THRESHOLD = 0.50
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
ROAD_CLASSES = ("highway", "arterial", "local")


@dataclass(frozen=True)
class Box:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float


TEST_BOX = Box(77.6101, 12.9177, 77.6401, 12.9377)

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
NODES = T.StructType([T.StructField("graph_id", T.StringType()), T.StructField("id", T.LongType(), False), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("node_ord", T.LongType())])
EDGES = T.StructType(
    [T.StructField("graph_id", T.StringType()), T.StructField("edge_idx", T.LongType()), T.StructField("source", T.LongType()), T.StructField("target", T.LongType()), T.StructField("weight_m", T.DoubleType()), T.StructField("geometry", T.ArrayType(POINT))]
)
#: The JSON form: points are [lat, lon].
GRAPH_JSON = "crs STRING, nodes ARRAY<STRUCT<id: BIGINT, lat: DOUBLE, lon: DOUBLE>>, edges ARRAY<STRUCT<source: BIGINT, target: BIGINT, weight_m: DOUBLE, geometry: ARRAY<ARRAY<DOUBLE>>, road_type: STRING>>"
META_JSON = "crs STRING, bbox STRUCT<min_lon: DOUBLE, min_lat: DOUBLE, max_lon: DOUBLE, max_lat: DOUBLE>, resolution_m DOUBLE, source STRING"
MASK = "tile_id INT, row INT, col INT, v TINYINT"
RASTER = "tile_id INT, band INT, row INT, col INT, value FLOAT"
TILE_META = "tile_id INT, seed INT, occlusion_type STRING, occlusion_fraction DOUBLE, bbox ARRAY<DOUBLE>, optical_shape ARRAY<INT>, sar_shape ARRAY<INT>"
OVERPASS_JSON = "version DOUBLE, generator STRING, elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, nodes: ARRAY<BIGINT>, tags: MAP<STRING, STRING>>>"
