"""Contract rules as rows (rule, idx, message); no rows: the contract holds."""

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CRS, TEST_BOX, Box


class ContractError(ValueError):
    pass


def _rule(df: DataFrame, name: str, idx: str, broken: Column, message) -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    return df.where(broken).select(F.lit(name).alias("rule"), F.col(idx).cast("long").alias("idx"), text.alias("message"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _missing(column: str) -> Column:
    return F.col(column).isNull()


def _no_such_node(edges: DataFrame, nodes: DataFrame, name: str = "edge.endpoint") -> DataFrame:
    known = nodes.select("id").distinct()
    out = [_rule(edges.join(known.withColumnRenamed("id", end), end, "left_anti"), name, "edge_idx", F.lit(True), F.concat(F.lit(f"{end} isn't a node: "), F.col(end).cast("string"))) for end in ("source", "target")]
    return out[0].unionByName(out[1])


def loose_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Types and ranges, duplicate ids, unknown ends; weights may have any sign, lines may be empty."""
    on_earth = lambda lat, lon: (lat.between(-90, 90)) & (lon.between(-180, 180))
    points = edges.select("edge_idx", F.explode("geometry").alias("p"))
    twice = nodes.groupBy("id").agg(F.count("*").alias("n"))
    return _all(
        [
            _rule(nodes, "node.type", "id", _missing("id") | _missing("lat") | _missing("lon"), "id, lat and lon must be numbers"),
            _rule(nodes, "node.range", "id", ~on_earth(F.col("lat"), F.col("lon")), "lat or lon out of range"),
            _rule(twice, "node.duplicate", "id", F.col("n") > 1, "Duplicate node id"),
            _rule(edges, "edge.type", "edge_idx", _missing("source") | _missing("target") | _missing("weight_m"), "source, target and weight_m must be numbers"),
            _rule(points, "edge.geometry", "edge_idx", F.coalesce(~on_earth(F.col("p.lat"), F.col("p.lon")), F.lit(True)), "point out of range"),
            _no_such_node(edges, nodes),
        ]
    )


def strict_violations(nodes: DataFrame, edges: DataFrame, box: Box = TEST_BOX, margin: float = 0.05) -> DataFrame:
    """No empty tables, places near the box, positive weights, lines with points; duplicate ids aren't looked for."""
    inside = F.col("lat").between(box.min_lat - margin, box.max_lat + margin) & F.col("lon").between(box.min_lon - margin, box.max_lon + margin)
    points = edges.select("edge_idx", F.explode("geometry").alias("p"))
    empty = lambda df, name: _rule(df.agg(F.count("*").alias("n")).withColumn("idx", F.lit(None)), f"{name}.empty", "idx", F.col("n") == 0, f"no {name}s")
    return _all(
        [
            empty(nodes, "node"),
            empty(edges, "edge"),
            _rule(nodes, "node.type", "id", _missing("id") | _missing("lat") | _missing("lon"), "id, lat and lon must be numbers"),
            _rule(nodes, "node.box", "id", ~inside, "outside of the box"),
            _rule(edges, "edge.weight", "edge_idx", F.coalesce(F.col("weight_m") <= 0, F.lit(True)), "weight_m must be positive"),
            _rule(edges, "edge.geometry", "edge_idx", F.coalesce(F.size("geometry") < 1, F.lit(True)), "geometry is empty"),
            _rule(points, "edge.point", "edge_idx", F.col("p.lat").isNull() | F.col("p.lon").isNull(), "point isn't numeric"),
            _no_such_node(edges, nodes),
        ]
    )


def basic_violations(nodes: DataFrame, edges: DataFrame, crs: str = CRS) -> DataFrame:
    """Something there, the right CRS, known ends, positive weights, lines of two points."""
    one = nodes.sparkSession.range(1).withColumn("idx", F.lit(None).cast("long"))
    empty = lambda df, name: _rule(df.agg(F.count("*").alias("n")).withColumn("idx", F.lit(None)), f"{name}.empty", "idx", F.col("n") == 0, f"no {name}s")
    return _all([empty(nodes, "node"), empty(edges, "edge"), _rule(one, "crs", "idx", F.lit(crs != CRS), f"CRS must be {CRS}"), _no_such_node(edges, nodes), _rule(edges, "edge.weight", "edge_idx", F.coalesce(F.col("weight_m") <= 0, F.lit(True)), "weight_m must be positive"), _rule(edges, "edge.geometry", "edge_idx", F.coalesce(F.size("geometry") < 2, F.lit(True)), "geometry needs two points")])


def ensure(violations: DataFrame) -> None:
    """Fail on the first violation."""
    if row := violations.orderBy("rule", "idx").first():
        raise ContractError(f"{row.rule} [{row.idx}]: {row.message}")


TOP_KEYS = ("crs", "nodes", "edges")


def document_violations(document: dict, strict: bool = False) -> list[str]:
    """The rules on a graph file's top level and types that a schema on read would hide."""
    out = [f"Missing top-level key: '{k}'" for k in TOP_KEYS if k not in document]
    if strict:
        out += [f"Unexpected top-level key: '{k}'" for k in document if k not in TOP_KEYS]
    if document.get("crs", CRS) != CRS:
        out.append(f"CRS must be {CRS}")
    whole = lambda x: isinstance(x, int)
    for kind, fields in (("nodes", ("id",)), ("edges", ("source", "target"))):
        for i, row in enumerate(document.get(kind, ())):
            out += [f"{kind}[{i}].{f} must be of type int" for f in fields if not whole(row.get(f))]
    return out


def check_file(spark: SparkSession, path: str) -> dict:
    """V02 on a local file: status (PASS, FAIL, FILE_NOT_FOUND or JSON_ERROR), violations and counts."""
    from ..sources.graphs import frames_of

    if not Path(path).exists():
        return {"status": "FILE_NOT_FOUND", "violations": [], "n_nodes": 0, "n_edges": 0}
    try:
        document = json.loads(Path(path).read_text())
    except ValueError as broken:
        return {"status": "JSON_ERROR", "violations": [str(broken)], "n_nodes": 0, "n_edges": 0}
    found = document_violations(document, strict=True)
    if not found:
        nodes, edges = frames_of(spark, document)
        found = [f"{r.rule} [{r.idx}]: {r.message}" for r in strict_violations(nodes, edges).orderBy("rule", "idx").collect()]
    return {"status": "FAIL" if found else "PASS", "violations": found, "n_nodes": len(document.get("nodes", ())), "n_edges": len(document.get("edges", ()))}


def meta_violations(meta: DataFrame, crs: str = CRS) -> DataFrame:
    """V04, V05, S11 on meta rows: CRS to the letter, box order and range, resolution in (0, 1000], a source that isn't blank."""
    m = meta.withColumn("idx", F.lit(None).cast("long"))
    b = lambda c: F.col(f"bbox.{c}")
    return _all(
        [
            _rule(m, "meta.crs", "idx", F.coalesce(F.col("crs") != crs, F.lit(True)), f"CRS must be {crs}"),
            _rule(m, "meta.box", "idx", F.coalesce((b("min_lon") >= b("max_lon")) | (b("min_lat") >= b("max_lat")), F.lit(True)), "box is inverted"),
            _rule(m, "meta.range", "idx", ~(b("min_lon").between(-180, 180) & b("max_lon").between(-180, 180) & b("min_lat").between(-90, 90) & b("max_lat").between(-90, 90)), "box out of range"),
            _rule(m, "meta.resolution", "idx", F.coalesce((F.col("resolution_m") <= 0) | (F.col("resolution_m") > 1000), F.lit(True)), "resolution must be in (0, 1000]"),
            _rule(m, "meta.source", "idx", F.coalesce(F.trim("source") == "", F.lit(True)), "source is blank"),
        ]
    )


def mask_violations(mask: DataFrame, for_extraction: bool = False) -> DataFrame:
    """V04 on mask pixels (tile_id, row, col, v): only 0 and 1, no pixel twice. For extraction (S12) also 10 by 10 at least, not empty, 80 % road at most."""
    one = mask.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("v").alias("on"), (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count_distinct("row", "col").alias("d"))
    out = [_rule(mask.where(~F.col("v").isin(0, 1)).groupBy("tile_id").agg(F.count("*").alias("n")), "mask.value", "tile_id", F.lit(True), "values must be 0 or 1"), _rule(one, "mask.duplicate", "tile_id", F.col("d") < F.col("n"), "a pixel stands twice")]
    if for_extraction:
        out += [_rule(one, "mask.size", "tile_id", (F.col("h") < 10) | (F.col("w") < 10), "smaller than 10 by 10"), _rule(one, "mask.empty", "tile_id", F.col("on") == 0, "no road"), _rule(one, "mask.dense", "tile_id", F.col("on") > 0.8 * F.col("n"), "more than 80 % road")]
    return _all(out)


def transform_errors(spark: SparkSession, box: Box, height: int, width: int) -> DataFrame:
    """The largest error, in degrees and in pixels, of mapping the four corners there and back."""
    from ..functions.geo import latlon_to_pixel, pixel_to_latlon

    corners = spark.createDataFrame([(0.0, 0.0, box.max_lat, box.min_lon), (0.0, float(width), box.max_lat, box.max_lon), (float(height), 0.0, box.min_lat, box.min_lon), (float(height), float(width), box.min_lat, box.max_lon)], "row double, col double, lat double, lon double")
    there = corners.withColumn("p", pixel_to_latlon(F.col("row"), F.col("col"), box, height, width))
    back = there.withColumn("q", latlon_to_pixel(F.col("p.lat"), F.col("p.lon"), box, height, width))
    return back.agg(F.max(F.greatest(F.abs(F.col("p.lat") - F.col("lat")), F.abs(F.col("p.lon") - F.col("lon")))).alias("degrees"), F.max(F.greatest(F.abs(F.col("q.row") - F.col("row")), F.abs(F.col("q.col") - F.col("col")))).alias("pixels"))


def skeleton_violations(metrics: DataFrame) -> DataFrame:
    """V07 on rows of raster.skeleton_metrics: density 0.02 to 0.60, full 2x2 blocks at most 10 or 1 % of the pixels."""
    m = metrics.withColumn("idx", F.lit(None).cast("long"))
    return _all([_rule(m, "skeleton.density", "idx", ~F.col("density").between(0.02, 0.60), "density out of range"), _rule(m, "skeleton.blocks", "idx", F.col("n_blocks") > F.greatest(F.lit(10.0), 0.01 * F.col("n_pixels")), "lines are too thick")])


def check_tolerances(values: dict, rules: list[tuple[str, str, object]]) -> list[str]:
    """The rules (name, one of >= <= == in, bound) that the values break."""
    test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "in": lambda a, b: b[0] <= a <= b[1]}
    return [f"{n} = {values.get(n)} isn't {op} {bound}" for n, op, bound in rules if values.get(n) is None or not test[op](values[n], bound)]


# What a request may ask for, and the words that say so.
ACTIONS = {"sever_edge": ("bridge", "road"), "sever_node": ("flood", "intersection")}


def parsed_requests(requests: DataFrame, text: str = "text", confidence: float = 0.98) -> DataFrame:
    """Requests plus action (null: not understood) and confidence_score, by key words; the first action of the list wins."""
    low = F.lower(F.col(text))
    action = F.lit(None).cast("string")
    for name, words in reversed(ACTIONS.items()):
        action = F.when(reduce(Column.__or__, (low.contains(w) for w in words)), name).otherwise(action)
    return requests.withColumn("action", action).withColumn("confidence_score", F.when(action.isNotNull(), confidence))


def judged_requests(payloads: DataFrame, least: float = 0.90) -> DataFrame:
    """Payloads plus valid and reason."""
    low = F.coalesce(F.col("confidence_score") < least, F.lit(True))
    wrong = F.coalesce(~F.col("action").isin(*ACTIONS), F.lit(True))
    return payloads.withColumn("valid", ~low & ~wrong).withColumn("reason", F.when(low, "Low confidence score").when(wrong, "Unknown action").otherwise("Valid"))
