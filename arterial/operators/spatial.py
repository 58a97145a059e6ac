"""Range and nearest-neighbour joins over places, on grid cells of the search radius."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..schema import METRES_PER_DEGREE


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, tasks: int | None = None) -> DataFrame:
    """Pairs of rows whose places may lie within the radius, a superset; left has lat_a, lon_a, right lat_b, lon_b.

    Cells measure the radius (and a thousandth) in latitude; in longitude a cell is as wide
    as the radius is at its latitude band, so only the nine cells around a place are looked at.
    tasks: into how many tasks the cells are dealt, however small the tables are.
    """
    step = radius_m * 1.001 / METRES_PER_DEGREE * (METRES_PER_DEGREE / 111_194.9266)
    row = lambda lat: F.floor(lat / step)
    # a band's columns are as wide as its end nearer to the pole asks for
    width = lambda r: step / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(r), F.abs(r + 1)) * step, F.lit(89.9)))), F.lit(1e-3))
    cells = right.withColumn("_row", row(F.col("lat_b"))).withColumn("_col", F.floor(F.col("lon_b") / width(F.col("_row"))))
    near = left.withColumn("_row", F.explode(F.array(*(row(F.col("lat_a")) + d for d in (-1, 0, 1))))).withColumn("_at", F.floor(F.col("lon_a") / width(F.col("_row"))))
    near = near.withColumn("_col", F.explode(F.array(*(F.col("_at") + d for d in (-1, 0, 1))))).drop("_at")
    if tasks:
        near, cells = near.repartition(tasks, "_row", "_col"), cells.repartition(tasks, "_row", "_col")
    return near.join(cells, ["_row", "_col"]).drop("_row", "_col")


def nearest(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """(left's columns, id_b, dist_m): for each left row the nearest right row (id_b, lat_b, lon_b) within the radius; ties go to the smaller id."""
    pairs = near_pairs(left, right, radius_m).withColumn("dist_m", haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).where(F.col("dist_m") <= radius_m)
    best = pairs.groupBy(*left.columns).agg(F.min(F.struct("dist_m", "id_b")).alias("n"))
    return best.select(*left.columns, F.col("n.id_b").alias("id_b"), F.col("n.dist_m").alias("dist_m"))
