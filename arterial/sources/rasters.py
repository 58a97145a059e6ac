"""Masks, rasters and tiles: files, generators and splits."""

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import META_JSON, TEST_BOX, Box
from .files import exists, first_there


class _Part(InputPartition):
    def __init__(self, tile: int, path: str, first: int, last: int):
        self.tile, self.path, self.first, self.last = tile, path, first, last


class NpySource(DataSource):
    """`spark.read.format("npy")`: the pixels of .npy files, a block of rows a partition.

    Option `path`: a file or a folder that all executors see (files are mapped, not loaded).
    For stores that only Spark reads use read_masks.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "tile_id int, row int, col int, value double"

    def reader(self, schema):
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 1024))

    def partitions(self) -> Sequence[InputPartition]:
        from pathlib import Path

        import numpy as np

        top = Path(self.path)
        files = sorted(top.glob("*.npy")) if top.is_dir() else [top]
        return [_Part(i, str(f), a, a + self.rows) for i, f in enumerate(files) for a in range(0, np.load(f, mmap_mode="r").shape[0], self.rows)]

    def read(self, partition: _Part) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part = np.load(partition.path, mmap_mode="r")[partition.first : partition.last]
        r, c = np.mgrid[: part.shape[0], : part.shape[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, partition.tile, np.int32)), pa.array((r.ravel() + partition.first).astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(part.ravel().astype(float))], ["tile_id", "row", "col", "value"])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).load()


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, v) of the .npy masks under a path in any store that Spark reads; one file a task at a time."""

    def load(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                image = np.load(io.BytesIO(content))
                if image.ndim != 2 or not np.isin(np.unique(image), (0, 1)).all():
                    raise ValueError(f"{name}: a mask is a 2-D array of 0 and 1")
                r, c = np.mgrid[: image.shape[0], : image.shape[1]]
                yield pd.DataFrame({"path": name, "row": r.ravel(), "col": c.ravel(), "v": image.ravel().astype(np.int8)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, row int, col int, v tinyint")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Meta rows; check them with contract.meta_violations."""
    return spark.read.schema(META_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_mask(mask: DataFrame, path: str) -> None:
    """Masks and rasters as parquet, by tile."""
    mask.repartition("tile_id").write.mode("overwrite").partitionBy("tile_id").parquet(path)


def write_meta(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def arterial_mask(spark: SparkSession, height: int = 200, width: int = 200) -> DataFrame:
    """Three horizontal and three vertical roads, four pixels wide, with a gap in one of each."""
    px = spark.range(height * width).select(F.lit(0).alias("tile_id"), F.expr(f"int(id div {width})").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    # fixed values: where the roads and their gaps are
    near = lambda x, n: F.array_contains(F.array(*(F.lit(n * k // 4 + d) for k in (1, 2, 3) for d in (-2, -1, 0, 1))), x)
    row, col = F.col("row"), F.col("col")
    across = near(row, height) & ~(row.between(height // 4 - 2, height // 4 + 1) & col.between(66, 80))
    along = near(col, width) & ~(col.between(3 * width // 4 - 2, 3 * width // 4 + 1) & row.between(66, 77))
    return px.withColumn("v", (across | along).cast("int"))


def grid_mask(spark: SparkSession, size: int = 200, step: int = 40, road: int = 5, hole: int = 40) -> DataFrame:
    """Roads every `step` pixels with a square hole in the middle."""
    px = spark.range(size * size).select(F.lit(0).alias("tile_id"), F.expr(f"int(id div {size})").alias("row"), (F.col("id") % size).cast("int").alias("col"))
    low = (size - hole) // 2
    inside = F.col("row").between(low, low + hole - 1) & F.col("col").between(low, low + hole - 1)
    return px.withColumn("v", ((((F.col("row") % step) < road) | ((F.col("col") % step) < road)) & ~inside).cast("int"))


def _uniform(*parts):
    """In [0, 1), from a hash: the same on every executor and retry."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def synthetic_raster(mask: DataFrame, bands: int, seed: int = 0, road: float = 0.6, ground: float = 0.25, noise: float = 0.1) -> DataFrame:
    """Optical bands of a mask: a level for road and for ground, with hashed noise."""
    each = mask.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    level = F.when(F.col("v") == 1, road).otherwise(ground) + (_uniform(F.lit(seed), "tile_id", "band", "row", "col") - 0.5) * 2 * noise
    return each.select("tile_id", "band", "row", "col", F.least(F.lit(1.0), F.greatest(F.lit(0.0), level)).alias("value"))


def synthetic_speckle(mask: DataFrame, seed: int = 0, road: float = 0.02, ground: float = 0.1) -> DataFrame:
    """Two SAR bands with Rayleigh speckle: level * sqrt(-2 ln u)."""
    each = mask.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(1))))
    u = 1 - _uniform(F.lit(seed), F.lit("sar"), "tile_id", "band", "row", "col")
    level = F.when(F.col("v") == 1, road).otherwise(ground) * F.when(F.col("band") == 1, 0.3).otherwise(1.0)
    return each.select("tile_id", "band", "row", "col", (level * F.sqrt(-2 * F.log(u))).alias("value"))


def blobs(mask: DataFrame, count: int, radius: tuple[int, int], seed: int = 0, name: str = "cloud") -> DataFrame:
    """(tile_id, row, col) under `count` hashed circles a tile."""
    size = mask.groupBy("tile_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    at = lambda what: _uniform(F.lit(seed), F.lit(name), F.lit(what), "tile_id", "i")
    spots = size.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(count)))).select("tile_id", F.floor(at("r") * F.col("h")).alias("r"), F.floor(at("c") * F.col("w")).alias("c"), F.floor(radius[0] + at("d") * (radius[1] - radius[0])).alias("d"), "h", "w")
    near = spots.withColumn("row", F.explode(F.sequence(F.greatest(F.lit(0), F.col("r") - F.col("d")), F.least(F.col("h") - 1, F.col("r") + F.col("d")))))
    near = near.withColumn("col", F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - F.col("d")), F.least(F.col("w") - 1, F.col("c") + F.col("d")))))
    inside = F.pow(F.col("row") - F.col("r"), 2) + F.pow(F.col("col") - F.col("c"), 2) <= F.pow(F.col("d"), 2)
    return near.where(inside).select("tile_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()


def occluded(raster: DataFrame, where: DataFrame, level: float | None = None, factor: float | None = None) -> DataFrame:
    """Raster with the places set to a level (cloud, canopy) or scaled (shadow, SAR under canopy)."""
    hit = F.col("_hit").isNotNull()
    new = F.lit(level) if level is not None else F.col("value") * factor
    return raster.join(where.withColumn("_hit", F.lit(1)), ["tile_id", "row", "col"], "left").select("tile_id", "band", "row", "col", F.when(hit, new).otherwise(F.col("value")).alias("value"))


#: The cycle of occlusion kinds over tiles.
OCCLUSIONS = ("none", "cloud", "canopy", "cloud", "shadow", "cloud", "canopy")


def tile_plan(spark: SparkSession, n: int, first_seed: int, split: str) -> DataFrame:
    """(tile_id, seed, split, occlusion_type) of generated tiles."""
    kinds = F.array(*(F.lit(k) for k in OCCLUSIONS))
    return spark.range(n).select(F.col("id").cast("int").alias("tile_id"), (F.col("id") + first_seed).cast("int").alias("seed"), F.lit(split).alias("split"), F.element_at(kinds, (F.col("id") % len(OCCLUSIONS) + 1).cast("int")).alias("occlusion_type"))


def split_tiles(tiles: DataFrame, seed: int = 42, train_percent: int = 80) -> DataFrame:
    """Tiles plus split, by a hash of seed and tile: adding tiles moves none."""
    return tiles.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), "tile_id"), F.lit(100)) < train_percent, "train").otherwise("val"))


def round_robin(tiles: DataFrame, regions: int, held_out: int) -> DataFrame:
    """Tiles plus region, in turn, and held_out for the last regions."""
    return tiles.withColumn("region", F.col("tile_id") % regions).withColumn("held_out", F.col("tile_id") % regions >= regions - held_out)


def seeded_masks(base: DataFrame, seeds: DataFrame) -> DataFrame:
    """One mask a seed (tile_id = seed): the base mask, dilated by a pixel for two seeds of every five."""
    from ..operators.raster import dilate, square

    each = base.drop("tile_id").crossJoin(F.broadcast(seeds.select(F.col("seed").alias("tile_id"))))
    grown = dilate(each.where("tile_id % 5 >= 3"), square(1))
    return each.where("tile_id % 5 < 3").select("tile_id", "row", "col", "v").unionByName(grown)


def with_network_noise(mask: DataFrame, gaps: int = 50, holes: int = 100, salt: float = 0.01, seed: int = 0) -> DataFrame:
    """A mask with hashed 3x3 gaps, single holes and salt."""
    from ..operators.raster import moved, square

    size = mask.groupBy("tile_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))

    def spots(n: int, name: str) -> DataFrame:
        at = lambda what: _uniform(F.lit(seed), F.lit(name), F.lit(what), "tile_id", "i")
        return size.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("tile_id", F.floor(at("r") * F.col("h")).cast("int").alias("row"), F.floor(at("c") * F.col("w")).cast("int").alias("col"))

    off = moved(spots(gaps, "gap"), square(1)).union(spots(holes, "hole")).distinct().withColumn("off", F.lit(1))
    white = _uniform(F.lit(seed), F.lit("salt"), "tile_id", "row", "col") < salt
    return mask.join(off, ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", F.when(F.col("off").isNotNull(), 0).when(white, 1).otherwise(F.col("v")).alias("v"))


def slippy_tiles(box: Box = TEST_BOX, zoom: int = 17) -> list[tuple[int, int]]:
    """The tiles that cover a box."""
    import math

    n = 1 << zoom
    x = lambda lon: int((lon + 180.0) / 360.0 * n)
    y = lambda lat: int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
    return [(i, j) for i in range(x(box.min_lon), x(box.max_lon) + 1) for j in range(y(box.max_lat), y(box.min_lat) + 1)]


def _one_mask(spark: SparkSession, path: str) -> DataFrame:
    """A mask as tile 0, from a .npy file or as write_mask has written it."""
    if path.endswith(".npy"):
        return read_masks(spark, path).select(F.lit(0).alias("tile_id"), "row", "col", F.col("v").cast("int").alias("v"))
    return spark.read.parquet(path)


def inputs(spark: SparkSession, mask_path: str, meta_path: str, synthetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """Mask and meta from their files; if either isn't there and synthetic is allowed, the generated arterial mask with a meta row of its own."""
    if exists(spark, mask_path) and exists(spark, meta_path):
        return _one_mask(spark, mask_path), read_meta(spark, meta_path)
    if not synthetic:
        raise FileNotFoundError(f"{mask_path} or {meta_path}")
    b, height = TEST_BOX, 200
    box = F.struct(*(F.lit(getattr(b, c)).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))
    metres = round((b.max_lat - b.min_lat) * 111_320 / height, 2)
    return arterial_mask(spark, height, height), spark.range(1).select(F.lit("EPSG:4326").alias("crs"), box.alias("bbox"), F.lit(metres).alias("resolution_m"), F.lit("synthetic").alias("source"))


def truth_mask(spark: SparkSession, given: str | None, cached: str | None, generate=None) -> DataFrame | None:
    """The truth, by trust: the given file, the cached one, what generate() makes, or None, with which metrics are left out."""
    path = first_there(spark, [given, cached])
    if path is None:
        return generate() if generate else None
    return _one_mask(spark, path)


#: Fixed values of R51: circles a tile and their radii, by kind of cloud.
CLOUD_KINDS = {"thin": (3, (4, 8)), "scattered": (8, (3, 6)), "thick": (2, (10, 18)), "haze": (1, (20, 28))}


def synthetic_tiles(mask: DataFrame, bands: int = 4, seed: int = 0) -> DataFrame:
    """(tile_id, band, row, col, value): optical and SAR bands of masks, under the kind of cloud that is a tile's turn.

    Roads and ground have their levels with hashed noise, SAR its speckle; clouds hide optical bands and leave SAR alone.
    """
    optical = synthetic_raster(mask, bands, seed)
    kinds = list(CLOUD_KINDS.items())
    for turn, (name, (count, radius)) in enumerate(kinds):
        under = blobs(mask.where(F.col("tile_id") % len(kinds) == turn), count, radius, seed, name)
        optical = occluded(optical, under, level=0.95 if name != "haze" else None, factor=1.3 if name == "haze" else None)
    return optical.unionByName(synthetic_speckle(mask, seed).withColumn("band", F.col("band") + bands))
