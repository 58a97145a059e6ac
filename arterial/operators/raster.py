"""Pixel analytics over long tables.

A mask is (tile_id, row, col, v) with every pixel; a raster adds band and has value. All
operators work on many tiles at once; keys are (tile_id) or (tile_id, band). Windows are
separable frames over one row or column of one tile; neighbours come from exploded
offsets and an equi-join. Only thinning, an inherently sequential sweep over one image,
runs as an Arrow kernel on one tile at a time.
"""

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .components import components

PIXEL = 10_000_000  # ids: row * PIXEL + col


def shape(mask: DataFrame) -> DataFrame:
    return mask.groupBy("tile_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def _ratio(a, b) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# --- confusion metrics -----------------------------------------------------------------------------------------------


def paired(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(tile_id, row, col, p, g) of two masks of the same tiles."""
    return predicted.select("tile_id", "row", "col", F.col("v").cast("int").alias("p")).join(truth.select("tile_id", "row", "col", F.col("v").cast("int").alias("g")), ["tile_id", "row", "col"])


def confusion(pairs: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Counts and IoU, precision, recall, F1 (= Dice), accuracy by keys; null without truth, 0 without prediction."""
    p, g = F.col("p") == 1, F.col("g") == 1
    count = lambda c: F.sum(c.cast("long"))
    one = pairs.groupBy(*keys).agg(count(p & g).alias("tp"), count(p & ~g).alias("fp"), count(~p & g).alias("fn"), count(~p & ~g).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    known = lambda c: F.when(tp + fn > 0, F.coalesce(c, F.lit(0.0)))
    return one.select(
        *keys, "tp", "fp", "fn", "tn", known(_ratio(tp, tp + fp + fn)).alias("iou"), known(_ratio(tp, tp + fp)).alias("precision"), known(_ratio(tp, tp + fn)).alias("recall"), known(_ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), _ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn")).alias("accuracy")
    )


def mean_metrics(per_tile: DataFrame, names: Sequence[str] = ("iou", "precision", "recall", "f1"), least_road: int = 50) -> DataFrame:
    """Mean and population deviation over the tiles with enough road pixels."""
    kept = per_tile.where(F.col("tp") + F.col("fn") >= least_road)
    return kept.agg(F.count("*").alias("n_tiles"), *(f(n).alias(f"{k}_{n}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))))


def discrepancy(pairs: DataFrame) -> DataFrame:
    """Pixels classed TP, FP, FN or TN."""
    p, g = F.col("p") == 1, F.col("g") == 1
    return pairs.withColumn("cls", F.when(p & g, "TP").when(p, "FP").when(g, "FN").otherwise("TN"))


def density(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of road pixels of both masks and their gap, by tile."""
    return paired(predicted, truth).groupBy("tile_id").agg(F.avg("p").alias("predicted"), F.avg("g").alias("truth"), F.abs(F.avg("p") - F.avg("g")).alias("gap"))


def calibration(probabilities: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(bin, n, confidence, accuracy) for bins (lo, hi]; p = 0 falls in none."""
    return probabilities.where(F.col(p) > 0).groupBy(F.ceil(F.col(p) * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def expected_calibration_error(binned: DataFrame, n: int | None = None) -> DataFrame:
    total = F.sum("n") if n is None else F.lit(n)
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / total).alias("ece"))


def losses(probabilities: DataFrame, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Dice, cross-entropy and focal loss as aggregates over (p, y)."""
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-7)), F.lit(1e-7))
    y = F.col("y").cast("double")
    right = y * q + (1 - y) * (1 - q)
    weight = y * alpha + (1 - y) * (1 - alpha)
    return probabilities.agg((1 - (2 * F.sum(q * y) + 1) / (F.sum(q) + F.sum(y) + 1)).alias("dice"), F.avg(-F.log(right)).alias("bce"), F.avg(-weight * F.pow(1 - right, F.lit(gamma)) * F.log(right)).alias("focal"))


def _across(raster: DataFrame, axis: str) -> Window:
    """Pixels of a line of a tile, in order."""
    other = "col" if axis == "row" else "row"
    return Window.partitionBy("tile_id", axis).orderBy(other)


def soft_edges(raster: DataFrame, value: str) -> DataFrame:
    """raster plus edge: the size of its Sobel gradient; outside of the tile is 0. Two passes of three pixels, as the filter is a product."""
    at = lambda c, n, w: F.lag(c, n, 0.0).over(w)
    w = _across(raster, "row")
    out = raster.withColumns({"_d": at(value, -1, w) - at(value, 1, w), "_s": at(value, 1, w) + 2 * F.col(value) + at(value, -1, w)})
    w = _across(raster, "col")
    out = out.withColumns({"_x": at("_d", 1, w) + 2 * F.col("_d") + at("_d", -1, w), "_y": at("_s", -1, w) - at("_s", 1, w)})
    return out.withColumn("edge", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + 1e-8)).drop("_d", "_s", "_x", "_y")


def boundary_loss(pixels: DataFrame, zone_px: int = 3) -> DataFrame:
    """Mean squared difference of the Sobel edges of p and y within zone_px of a road, over all tiles. pixels: whole tiles (tile_id, row, col, p, y)."""
    both = soft_edges(soft_edges(pixels, "p").withColumnRenamed("edge", "_p"), "y")
    for axis in ("row", "col"):
        both = both.withColumn("_zone", F.max("y" if axis == "row" else "_zone").over(_across(both, axis).rowsBetween(-zone_px, zone_px)))
    inside = F.when(F.col("_zone") > 0, 1.0).otherwise(0.0)
    return both.agg((F.sum(inside * F.pow(F.col("_p") - F.col("edge"), 2)) / (F.sum(inside) + 1e-8)).alias("boundary"))


def _pooled(image: np.ndarray, pick) -> np.ndarray:
    """The least or greatest of the three by three pixels around each, as far as there are any."""
    for axis in (0, 1):
        moved = np.moveaxis(image, axis, 0)
        out = moved.copy()
        out[1:] = pick(out[1:], moved[:-1])
        out[:-1] = pick(out[:-1], moved[1:])
        image = np.moveaxis(out, 0, axis)
    return image


def soft_skeleton(image: np.ndarray, rounds: int = 10) -> np.ndarray:
    """What opening takes away, added up while the image is eroded round by round; 1 at most."""
    out = np.zeros_like(image)
    for _ in range(rounds):
        thinner = _pooled(image, np.minimum)
        out += np.maximum(image - _pooled(thinner, np.maximum), 0)
        image = thinner
    return np.minimum(out, 1.0)


def connectivity_loss(pixels: DataFrame, rounds: int = 10) -> DataFrame:
    """One less the Dice coefficient of the soft skeletons of p and y, mean over tiles. pixels: whole tiles (tile_id, row, col, p, y); a tile is one task."""

    def kernel(tile: pd.DataFrame) -> pd.DataFrame:
        images = []
        for c in ("p", "y"):
            image = np.zeros((tile["row"].max() + 1, tile["col"].max() + 1))
            image[tile["row"], tile["col"]] = tile[c]
            images.append(soft_skeleton(image, rounds))
        p, y = images
        return pd.DataFrame({"dice": [(2 * (p * y).sum() + 1) / (p.sum() + y.sum() + 1)]})

    return pixels.select("tile_id", "row", "col", F.col("p").cast("double"), F.col("y").cast("double")).groupBy("tile_id").applyInPandas(kernel, "dice double").agg((1 - F.avg("dice")).alias("connectivity"))


# The weights of the losses in their sum.
LOSS_WEIGHTS = {"dice": 0.4, "focal": 0.3, "boundary": 0.2, "connectivity": 0.1}


def combined_loss(pixels: DataFrame) -> DataFrame:
    """One row of all losses and their weighted sum, total."""
    parts = losses(pixels).crossJoin(boundary_loss(pixels)).crossJoin(connectivity_loss(pixels))
    return parts.withColumn("total", sum((F.col(c) * w for c, w in LOSS_WEIGHTS.items()), F.lit(0.0)))


def evaluated(predicted: DataFrame, truth: DataFrame | None, least_area: int = 10) -> DataFrame:
    """The report of predicted masks, a row a tile: confusion metrics, road densities and component counts; metrics are null without truth.

    Masks come checked (contract.mask_violations); truth of another size is brought to that of the prediction by its nearest pixels.
    """
    own = component_stats(predicted, least=least_area).join(predicted.groupBy("tile_id").agg(F.avg("v").alias("density")), "tile_id")
    if truth is None:
        return own
    size = lambda m, p: m.groupBy("tile_id").agg((F.max("row") + 1).alias(f"{p}h"), (F.max("col") + 1).alias(f"{p}w"))
    sizes = size(predicted, "p").join(size(truth, "t"), "tile_id")
    places = predicted.select("tile_id", "row", "col").join(sizes, "tile_id")
    nearest = places.select("tile_id", "row", "col", F.expr("int(row * th div ph)").alias("r"), F.expr("int(col * tw div pw)").alias("c"))
    fitted = nearest.join(truth.select("tile_id", F.col("row").alias("r"), F.col("col").alias("c"), "v"), ["tile_id", "r", "c"]).select("tile_id", "row", "col", "v")
    pairs = saved(paired(predicted, fitted))
    return own.join(confusion(pairs), "tile_id", "left").join(pairs.groupBy("tile_id").agg(F.avg("g").alias("truth_density")), "tile_id", "left")


# First and last row, first and last column.
MISSED_STRIP, ADDED_ALLEY = (200, 299, 200, 209), (100, 107, 100, 199)


def with_known_faults(truth: DataFrame, missed: tuple[int, int, int, int] = MISSED_STRIP, added: tuple[int, int, int, int] = ADDED_ALLEY) -> DataFrame:
    """Truth as a prediction that misses a strip and adds an alley, for a check of the metrics."""
    inside = lambda b: F.col("row").between(b[0], b[1]) & F.col("col").between(b[2], b[3])
    return truth.withColumn("v", F.when(inside(added), 1).when(inside(missed), 0).otherwise(F.col("v")))


# --- neighbourhoods --------------------------------------------------------------------------------------------------


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)]


CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


def moved(on: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """The places (tile_id, row, col) that offsets reach from the given ones."""
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets))
    return on.select("tile_id", "row", "col", F.explode(steps).alias("s")).select("tile_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).distinct()


def _set(mask: DataFrame, on: DataFrame) -> DataFrame:
    """mask with v = 1 exactly at the places of on."""
    return mask.select("tile_id", "row", "col").join(on.withColumn("v", F.lit(1)), ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", F.coalesce("v", F.lit(0)).alias("v"))


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], times: int = 1) -> DataFrame:
    """Binary dilation; nothing comes in from outside of the tile."""
    for _ in range(times):
        mask = _set(mask, moved(mask.where("v = 1"), offsets))
    return mask


def erode(mask: DataFrame, offsets: list[tuple[int, int]], times: int = 1) -> DataFrame:
    """Binary erosion; outside of the tile counts as set."""
    for _ in range(times):
        off = moved(mask.where("v = 0"), [(-r, -c) for r, c in offsets])
        mask = mask.join(off.withColumn("off", F.lit(1)), ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", F.when((F.col("v") == 1) & F.col("off").isNull(), 1).otherwise(0).alias("v"))
    return mask


def close_mask(mask: DataFrame, offsets: list[tuple[int, int]], times: int = 1) -> DataFrame:
    """Dilation, then erosion."""
    return erode(dilate(mask, offsets, times), offsets, times)


def label(mask: DataFrame, connectivity: int = 8, value: int = 1) -> DataFrame:
    """(tile_id, row, col, component) of the pixels with the value; component: its smallest pixel id."""
    on = saved(mask.where(F.col("v") == value).select("tile_id", "row", "col", (F.col("row").cast("long") * PIXEL + F.col("col")).alias("id")))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    arms = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))
    to = on.select("tile_id", F.col("id").alias("source"), "row", "col", F.explode(arms).alias("s")).select("tile_id", "source", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    links = to.join(on.withColumnRenamed("id", "target"), ["tile_id", "row", "col"]).select("tile_id", "source", "target")
    return on.join(components(on, links, ["tile_id"]), ["tile_id", "id"]).select("tile_id", "row", "col", "component")


def component_stats(mask: DataFrame, connectivity: int = 4, least: int = 10) -> DataFrame:
    """By tile, components of at least that many pixels, the largest's share of all road pixels, and how many are smaller."""
    sizes = label(mask, connectivity).groupBy("tile_id", "component").agg(F.count("*").alias("n"))
    big = F.col("n") >= least
    return sizes.groupBy("tile_id").agg(F.sum(big.cast("long")).alias("n_components"), F.sum((~big).cast("long")).alias("n_filtered"), (F.coalesce(F.max(F.when(big, F.col("n"))), F.lit(0)) / F.sum("n")).alias("largest_share"))


def without_small(mask: DataFrame, least: Column | int, connectivity: int = 8) -> DataFrame:
    """Mask without components of fewer pixels."""
    labels = label(mask, connectivity)
    kept = labels.groupBy("tile_id", "component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _set(mask, labels.join(kept, ["tile_id", "component"], "left_semi").select("tile_id", "row", "col"))


def without_holes(mask: DataFrame, least: int) -> DataFrame:
    """Mask with background components (4-connected) of fewer pixels filled."""
    holes = label(mask, 4, value=0)
    small = holes.groupBy("tile_id", "component").agg(F.count("*").alias("n")).where(F.col("n") < least)
    return _set(mask, mask.where("v = 1").select("tile_id", "row", "col").union(holes.join(small, ["tile_id", "component"], "left_semi").select("tile_id", "row", "col")))


def preprocess(mask: DataFrame, resolution_m: float) -> DataFrame:
    """Small blobs go, narrow gaps are closed."""
    least = max(4, (20 / resolution_m) ** 2)
    return close_mask(saved(without_small(mask, int(least) + 1)), disk(max(1, int(1.5 / max(resolution_m / 10, 0.1)))))


def postprocess(mask: DataFrame, mean_uncertainty: float = 0.0) -> DataFrame:
    """Closing, holes under 200 pixels filled, components of 20 pixels (100 if uncertain) kept."""
    closed = saved(close_mask(mask, disk(3)))
    return without_small(saved(without_holes(closed, 200)), 100 if mean_uncertainty > 0.3 else 20)


# --- thinning and skeleton metrics -----------------------------------------------------------------------------------


def thin(image: np.ndarray) -> np.ndarray:
    """Zhang and Suen's parallel thinning (1984) of a binary image."""
    img = np.pad(image.astype(bool), 1)
    while True:
        before = img.sum()
        for phase in (0, 1):
            n, ne, e, se, s, sw, w, nw = (np.roll(img, shift, (0, 1)) for shift in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)))
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(x.astype(np.int8) for x in ring)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            first, second = (~(n & e & s), ~(e & s & w)) if phase == 0 else (~(n & e & w), ~(n & s & w))
            img = img & ~(img & (count >= 2) & (count <= 6) & (turns == 1) & first & second)
        if img.sum() == before:
            return img[1:-1, 1:-1]


def skeletonise(mask: DataFrame) -> DataFrame:
    """Thinned masks, tile by tile."""

    def kernel(tile: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((tile["row"].max() + 1, tile["col"].max() + 1), bool)
        image[tile["row"], tile["col"]] = tile["v"] == 1
        return tile.assign(v=thin(image)[tile["row"], tile["col"]].astype(np.int32))[["tile_id", "row", "col", "v"]]

    return mask.select("tile_id", "row", "col", F.col("v").cast("int").alias("v")).groupBy("tile_id").applyInPandas(kernel, "tile_id int, row int, col int, v int")


def full_blocks(mask: DataFrame) -> DataFrame:
    """Counts of 2x2 blocks of set pixels, by tile."""
    corner = moved_counts(mask, [(0, 0), (0, -1), (-1, 0), (-1, -1)])
    return corner.where("n = 4").groupBy("tile_id").agg(F.count("*").alias("n_blocks"))


def moved_counts(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets))
    at = mask.where("v = 1").select("tile_id", "row", "col", F.explode(steps).alias("s"))
    return at.groupBy("tile_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).agg(F.count("*").alias("n"))


def skeleton_metrics(skeleton: DataFrame, resolution_m: float) -> DataFrame:
    """Density, length, components (8-connected), share of the largest, full 2x2 blocks; by tile."""
    whole = skeleton.groupBy("tile_id").agg(F.sum("v").cast("long").alias("n_pixels"), F.avg("v").alias("density"))
    sizes = label(skeleton).groupBy("tile_id", "component").agg(F.count("*").alias("n")).groupBy("tile_id").agg(F.count("*").alias("n_components"), (F.max("n") / F.sum("n")).alias("largest_share"))
    out = whole.join(sizes, "tile_id", "left").join(full_blocks(skeleton), "tile_id", "left")
    return out.withColumn("length_m", F.col("n_pixels") * resolution_m).fillna(0, ["n_components", "largest_share", "n_blocks"])


def skeleton_iou(predicted: DataFrame, truth: DataFrame, empty: float | None = None) -> DataFrame:
    """IoU of the thinned masks; `empty` where neither has a pixel."""
    found = confusion(paired(skeletonise(predicted), skeletonise(truth)))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return found.select("tile_id", F.when(union == 0, F.lit(empty).cast("double")).otherwise(_ratio(F.col("tp"), union)).alias("skeleton_iou"))


def tolerant_scores(predicted: DataFrame, truth: DataFrame, radius: int = 2) -> DataFrame:
    """Precision and recall of skeleton pixels within a square of that radius."""

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        near = moved(b.where("v = 1"), square(radius)).withColumn("hit", F.lit(1))
        return a.where("v = 1").join(near, ["tile_id", "row", "col"], "left").groupBy("tile_id").agg((F.count("hit") / F.count("*")).alias(name))

    return share(predicted, truth, "precision").join(share(truth, predicted, "recall"), "tile_id", "full")


# --- focal windows ---------------------------------------------------------------------------------------------------


def mirrored(raster: DataFrame, radius: int, keys: Sequence[str]) -> DataFrame:
    """raster (keys, row, col, value) with mirrored borders, the edge pixel repeated."""
    keys = list(keys)
    for axis in ("row", "col"):
        end = raster.groupBy(*keys).agg(F.max(axis).alias("_end"))
        r = raster.join(F.broadcast(end), keys) if keys else raster.crossJoin(F.broadcast(end))
        places = F.array(F.col(axis), F.when(F.col(axis) < radius, -1 - F.col(axis)), F.when(F.col(axis) > F.col("_end") - radius, 2 * F.col("_end") + 1 - F.col(axis)))
        raster = r.withColumn("_at", F.explode(F.array_compact(places))).drop(axis, "_end").withColumnRenamed("_at", axis)
    return raster.select(*keys, "row", "col", "value")


def focal_sums(raster: DataFrame, radius: int, values: dict[str, Column], keys: Sequence[str] = ("tile_id", "band")) -> DataFrame:
    """Sums of the values over the square window of every pixel, with mirrored borders: one frame along rows, one along columns."""
    keys = list(keys)
    padded = mirrored(raster, radius, keys).select(*keys, "row", "col", *(c.alias(n) for n, c in values.items()))
    along = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
    out = padded.select(*keys, "row", "col", *(F.sum(n).over(along).alias(n) for n in values))
    out = out.select(*keys, "row", "col", *(F.sum(n).over(down).alias(n) for n in values))
    return out.join(raster.select(*keys, "row", "col", F.col("value").alias("value")), [*keys, "row", "col"])


def lee(raster: DataFrame, radius: int = 3, noise: float = 0.273, keys: Sequence[str] = ("tile_id", "band")) -> DataFrame:
    """Lee's speckle filter: mean + k (x - mean), k = var / (var + noise) over the window."""
    n = float((2 * radius + 1) ** 2)
    x = F.col("value").cast("double")
    out = focal_sums(raster, radius, {"s": x, "ss": x * x}, keys)
    mean = F.col("s") / n
    variance = F.greatest(F.col("ss") / n - mean * mean, F.lit(0.0))
    return out.select(*keys, "row", "col", (mean + variance / (variance + noise) * (F.col("value") - mean)).alias("value"))


def median_filter(raster: DataFrame, radius: int = 2, keys: Sequence[str] = ("tile_id", "band")) -> DataFrame:
    """The median of the square window, mirrored borders."""
    keys = list(keys)
    side = F.sequence(F.lit(-radius), F.lit(radius))
    around = mirrored(raster, radius, keys).withColumn("_d", F.explode(side)).withColumn("row", F.col("row") + F.col("_d")).withColumn("_d", F.explode(side)).withColumn("col", F.col("col") + F.col("_d"))
    found = around.groupBy(*keys, "row", "col").agg(F.percentile("value", F.lit(0.5)).alias("value"))
    return found.join(raster.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


def sobel(mask: DataFrame) -> DataFrame:
    """Gradient magnitude of a mask, mirrored borders: (tile_id, row, col, value)."""
    padded = mirrored(mask.select("tile_id", "row", "col", F.col("v").cast("double").alias("value")), 1, ["tile_id"])
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(float(-r * (2 - abs(c)))).alias("y"), F.lit(float(-c * (2 - abs(r)))).alias("x")) for r, c in square(1)))
    at = padded.where("value <> 0").select("tile_id", "row", "col", "value", F.explode(steps).alias("s"))
    sums = at.groupBy("tile_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).agg(F.sum(F.col("value") * F.col("s.x")).alias("gx"), F.sum(F.col("value") * F.col("s.y")).alias("gy"))
    return mask.select("tile_id", "row", "col").join(sums, ["tile_id", "row", "col"], "left").select("tile_id", "row", "col", F.coalesce(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), F.lit(0.0)).alias("value"))


def edge_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion metrics of the masks' edges, where the gradient exceeds 0.3 of its maximum."""

    def edges(mask: DataFrame) -> DataFrame:
        g = sobel(mask)
        top = g.groupBy("tile_id").agg(F.max("value").alias("top"))
        return g.join(F.broadcast(top), "tile_id").select("tile_id", "row", "col", ((F.col("value") > 0.3 * F.col("top")) & (F.col("top") > 0)).cast("int").alias("v"))

    return confusion(paired(edges(predicted), edges(truth)))


def nearest_set(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance, row and column of the set pixel nearest to each; ties go to the smaller row, then column. on: one set pixel at least.

    Each column's nearest rows first, then columns at growing distance until no pixel can gain.
    """
    h, w = on.shape
    r, c = np.mgrid[:h, :w]
    far = h + w
    up = np.maximum.accumulate(np.where(on, r, -far), 0)
    down = np.minimum.accumulate(np.where(on, r, h + far)[::-1], 0)[::-1]
    row = np.where(r - up <= down - r, up, down)
    own = np.where(on.any(0), (r - row) ** 2 * (h * w) + row * w + c, np.int64(1) << 62)  # distance, row and column in one number
    best = own.copy()
    for d in range(1, w):
        if d * d * h * w > best.max():
            break
        best[:, d:] = np.minimum(best[:, d:], own[:, :-d] + d * d * h * w)
        best[:, :-d] = np.minimum(best[:, :-d], own[:, d:] + d * d * h * w)
    return best // (h * w), best % (h * w) // w, best % w


def width_split_iou(predicted: DataFrame, truth: DataFrame, narrow: int = 3, wide: int = 5) -> DataFrame:
    """IoU over truth pixels by road width: twice the distance to the background at the nearest skeleton pixel, up to `narrow` or over `wide`; tile by tile."""

    def kernel(truth: pd.DataFrame, predicted: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"tile_id": [], "kind": [], "iou": []})
        if truth.empty or predicted.empty:
            return none
        road, off = (np.zeros((truth["row"].max() + 1, truth["col"].max() + 1), bool) for _ in range(2))
        road[truth["row"], truth["col"]] = truth["v"] == 1
        off[truth["row"], truth["col"]] = truth["v"] == 0
        spine = thin(road)
        if not spine.any() or not off.any():
            return none
        _, r, c = nearest_set(spine)
        width = (2 * np.sqrt(nearest_set(off)[0]) - 1)[r, c]
        r, c = np.nonzero(road)
        on = pd.DataFrame({"r": r, "c": c, "kind": np.where(width[r, c] <= narrow, "narrow", np.where(width[r, c] > wide, "wide", "middle"))})
        found = on.merge(predicted, on=["r", "c"]).groupby("kind")["p"].mean()
        return pd.DataFrame({"tile_id": truth["tile_id"].iloc[0], "kind": found.index, "iou": found.to_numpy(float)})

    value = F.col("v").cast("int")
    right = predicted.select(F.col("tile_id").alias("of"), F.col("row").alias("r"), F.col("col").alias("c"), value.alias("p"))  # other names: a cogroup mixes up columns that both sides have from one frame
    return truth.select("tile_id", "row", "col", value.alias("v")).groupBy("tile_id").cogroup(right.groupBy("of")).applyInPandas(kernel, f"tile_id {dict(truth.dtypes)['tile_id']}, kind string, iou double")


# --- radiometry and fusion -------------------------------------------------------------------------------------------


def to_decibel(sar: DataFrame) -> DataFrame:
    """10 log10 of (tile_id, band, row, col, value), unless band 0 has a negative median (then it is in dB already)."""
    middle = sar.where("band = 0").groupBy("tile_id").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    return sar.join(middle, "tile_id").select("tile_id", "band", "row", "col", F.when(F.col("m") < 0, F.col("value")).otherwise(10 * F.log10(F.greatest(F.col("value"), F.lit(1e-10)))).alias("value"))


def percentile_scaled(raster: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Each band to [0, 1] between two percentiles."""
    at = raster.groupBy("tile_id", "band").agg(F.percentile("value", F.lit(low)).alias("lo"), F.percentile("value", F.lit(high)).alias("hi"))
    scaled = (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8))
    return raster.join(at, ["tile_id", "band"]).select("tile_id", "band", "row", "col", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)).alias("value"))


def z_scored(raster: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std by band, clipped to the 2nd and 98th percentile first; stats (band, mean, std) override the band's own."""
    at = raster.groupBy("tile_id", "band").agg(F.percentile("value", F.lit(0.02)).alias("lo"), F.percentile("value", F.lit(0.98)).alias("hi"))
    clipped = raster.join(at, ["tile_id", "band"]).withColumn("value", F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("value")))).drop("lo", "hi")
    own = clipped.groupBy("tile_id", "band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    joined = clipped.join(own, ["tile_id", "band"]) if stats is None else clipped.join(F.broadcast(stats), "band")
    return joined.select("tile_id", "band", "row", "col", ((F.col("value") - F.col("mean")) / F.greatest("std", F.lit(1e-8))).alias("value"))


def cloud_mask(optical: DataFrame, bright: float = 0.85, flat: float = 0.05) -> DataFrame:
    """v = 1 where the bands' mean is over `bright` and their population deviation under `flat`."""
    return optical.groupBy("tile_id", "row", "col").agg(((F.avg("value") > bright) & (F.stddev_pop("value") < flat)).cast("int").alias("v"))


def cloud_share(optical: DataFrame, bands: int = 3, bright: float = 0.7) -> DataFrame:
    """(tile_id, cloud): the share of pixels whose first bands' mean is over `bright`."""
    pixel = optical.where(F.col("band") < bands).groupBy("tile_id", "row", "col").agg(F.avg("value").alias("m"))
    return pixel.groupBy("tile_id").agg(F.avg((F.col("m") > bright).cast("double")).alias("cloud"))


def fused(optical: DataFrame, sar: DataFrame, clouds: DataFrame, limit: float = 0.5) -> DataFrame:
    """Optical bands, then SAR bands; where a tile's cloud is strictly over the limit, optical is 0 and SAR doubled."""
    n = optical.groupBy("tile_id").agg((F.max("band") + 1).alias("n"))
    cloudy = F.coalesce(F.col("cloud") > limit, F.lit(False))
    o = optical.join(F.broadcast(clouds), "tile_id", "left").select("tile_id", "band", "row", "col", F.when(cloudy, 0.0).otherwise(F.col("value")).alias("value"))
    s = sar.join(F.broadcast(clouds), "tile_id", "left").join(F.broadcast(n), "tile_id").select("tile_id", (F.col("band") + F.col("n")).alias("band"), "row", "col", F.when(cloudy, F.col("value") * 2).otherwise(F.col("value")).alias("value"))
    return o.unionByName(s)


def indices(optical: DataFrame, green: int = 1, red: int = 2, nir: int = 3, eps: float = 1e-6) -> DataFrame:
    """(tile_id, row, col, ndvi, ndwi), rescaled to [0, 1]."""
    band = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    px = optical.groupBy("tile_id", "row", "col").agg(band(green).alias("g"), band(red).alias("r"), band(nir).alias("n"))
    index = lambda a, b: ((F.col(a) - F.col(b)) / (F.col(a) + F.col(b) + eps) + 1) / 2
    return px.select("tile_id", "row", "col", index("n", "r").alias("ndvi"), index("g", "n").alias("ndwi"))


def channels(optical: DataFrame, ndx: DataFrame, sar: DataFrame, temporal: DataFrame) -> DataFrame:
    """The twelve-channel stack: optical 0-3, indices 4-5, SAR 6-7, temporal difference 8-11."""
    both = ndx.select("tile_id", "row", "col", F.explode(F.array(F.struct(F.lit(4).alias("band"), F.col("ndvi").alias("value")), F.struct(F.lit(5).alias("band"), F.col("ndwi").alias("value")))).alias("x")).select("tile_id", "x.band", "row", "col", "x.value")
    shift = lambda df, by: df.select("tile_id", (F.col("band") + by).alias("band"), "row", "col", "value")
    return optical.select("tile_id", "band", "row", "col", "value").unionByName(both).unionByName(shift(sar, 6)).unionByName(shift(temporal, 8))


def temporal_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """Absolute differences of two dates."""
    keys = ["tile_id", "band", "row", "col"]
    return now.join(before.withColumnRenamed("value", "old"), keys).select(*keys, F.abs(F.col("value") - F.col("old")).alias("value"))


def style_transfer(content: DataFrame, style: DataFrame, bands: int = 3) -> DataFrame:
    """The first bands of content with mean and sample deviation of style, clipped to [0, 1]; tiles pair by id."""
    stats = lambda df, p: df.where(F.col("band") < bands).groupBy("tile_id", "band").agg(F.avg("value").alias(f"{p}m"), F.stddev_samp("value").alias(f"{p}s"))
    joined = content.join(stats(content, "c"), ["tile_id", "band"], "left").join(stats(style, "s"), ["tile_id", "band"], "left")
    new = (F.col("value") - F.col("cm")) / F.greatest("cs", F.lit(1e-6)) * F.col("ss") + F.col("sm")
    return joined.select("tile_id", "band", "row", "col", F.when(F.col("band") < bands, F.least(F.lit(1.0), F.greatest(F.lit(0.0), new))).otherwise(F.col("value")).alias("value"))


def occlusion(sar: DataFrame, optical: DataFrame) -> DataFrame:
    """v = 1 where SAR sees a road that optics doesn't."""
    return paired(sar, optical).select("tile_id", "row", "col", ((F.col("p") == 1) & (F.col("g") == 0)).cast("int").alias("v"))


def occlusion_counts(sar: DataFrame, optical: DataFrame) -> DataFrame:
    p, g = F.col("p") == 1, F.col("g") == 1
    return paired(sar, optical).groupBy("tile_id").agg(*(F.sum(c.cast("long")).alias(n) for n, c in (("n_sar", p), ("n_optical", g), ("n_occluded", p & ~g), ("n_both", p & g))))


def synthetic_sar(mask: DataFrame, noise: float = 0.005, seed: int = 42) -> DataFrame:
    """The mask dilated twice by a cross, with pixels flipped by a hash of their place."""
    grown = dilate(mask, CROSS, 2)
    flip = F.pmod(F.xxhash64(F.lit(seed), "tile_id", "row", "col"), F.lit(1_000_000)) < int(noise * 1_000_000)
    return grown.select("tile_id", "row", "col", F.when(flip, 1 - F.col("v")).otherwise(F.col("v")).alias("v"))


# --- ensembles -------------------------------------------------------------------------------------------------------

#: The eight symmetries, as the place (row, col) that lands on (r, c) of a size h by w image.
SYMMETRIES: list[Callable] = [
    lambda r, c, h, w: (r, c), lambda r, c, h, w: (r, w - 1 - c), lambda r, c, h, w: (h - 1 - r, c), lambda r, c, h, w: (h - 1 - r, w - 1 - c),
    lambda r, c, h, w: (c, r), lambda r, c, h, w: (c, w - 1 - r), lambda r, c, h, w: (h - 1 - c, r), lambda r, c, h, w: (h - 1 - c, w - 1 - r),
]


def symmetry(raster: DataFrame, which: int) -> DataFrame:
    """One of the eight symmetries of square tiles."""
    sized = raster.join(F.broadcast(raster.groupBy("tile_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))), "tile_id")
    row, col = SYMMETRIES[which](F.col("row"), F.col("col"), F.col("_h"), F.col("_w"))
    return sized.withColumns({"row": row.cast("int"), "col": col.cast("int")}).drop("_h", "_w")


def inverse_symmetry(raster: DataFrame, which: int) -> DataFrame:
    return symmetry(raster, {5: 6, 6: 5}.get(which, which))


def augmented_mean(raster: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean and sample deviation of the predictions (tile_id, row, col, value) over the eight symmetries, turned back."""
    passes = [inverse_symmetry(predict(symmetry(raster, k)), k).withColumn("pass_id", F.lit(k)) for k in range(8)]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return ensemble(out)


def ensemble(passes: DataFrame) -> DataFrame:
    """(tile_id, row, col, value, uncertainty): mean and sample deviation over passes."""
    return passes.groupBy("tile_id", "row", "col").agg(F.avg("value").alias("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("uncertainty"))


def uncertain_share(found: DataFrame, limit: float = 0.3) -> DataFrame:
    """The share of road pixels (value over 0.5) whose uncertainty exceeds the limit, by tile."""
    return found.where("value > 0.5").groupBy("tile_id").agg(F.avg((F.col("uncertainty") > limit).cast("double")).alias("uncertain"))


def predicted(raster: DataFrame, model: Callable[[np.ndarray], np.ndarray], bands: int) -> DataFrame:
    """A hook for any model that maps (bands, h, w) to an (h, w) image of probabilities, tile by tile."""

    def kernel(tile: pd.DataFrame) -> pd.DataFrame:
        h, w = tile["row"].max() + 1, tile["col"].max() + 1
        image = np.zeros((bands, h, w), np.float32)
        image[tile["band"], tile["row"], tile["col"]] = tile["value"]
        r, c = np.mgrid[:h, :w]
        return pd.DataFrame({"tile_id": tile["tile_id"].iloc[0], "row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "value": model(image).ravel().astype(float)})

    return raster.groupBy("tile_id").applyInPandas(kernel, "tile_id int, row int, col int, value double")


# --- geometry of rasters ---------------------------------------------------------------------------------------------


def resized(raster: DataFrame, height: int, width: int, keys: Sequence[str] = ("tile_id", "band")) -> DataFrame:
    """Bilinear resampling to a common size, sample points at pixel centres, borders held."""
    keys = list(keys)
    size = raster.groupBy(*keys).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    # pixels go to the samples that use them; a left join, as sizes may be broadcast, but pixels and samples, whose number Spark underrates, never
    out = raster.select(*keys, "row", "col", "value").join(size, keys, "left")
    for axis, extent, n in (("row", "_h", height), ("col", "_w", width)):
        at, end = F.col(axis), F.col(extent)
        low = F.when(at == 0, 0).otherwise(F.greatest(F.floor((at - 0.5) * n / end - 0.5), F.lit(0)))
        high = F.when(at == end - 1, n - 1).otherwise(F.least(F.ceil((at + 1.5) * n / end - 0.5), F.lit(n - 1)))
        place = F.least(F.greatest((F.col("_to") + 0.5) * end / n - 0.5, F.lit(0.0)), end - 1.0)
        part = place - F.floor(place)
        out = out.withColumn("_to", F.explode(F.sequence(low.cast("int"), high.cast("int")))).withColumn(f"_f{axis}", F.when(F.floor(place) == at, 1 - part).when(F.floor(place) + 1 == at, part))
        out = out.where(F.col(f"_f{axis}") > 0).drop(axis).withColumnRenamed("_to", axis)
    return out.groupBy(*keys, "row", "col").agg(F.sum(F.col("_frow") * F.col("_fcol") * F.col("value")).alias("value"))


def padded_to(raster: DataFrame, step: int = 32, keys: Sequence[str] = ("tile_id", "band")) -> DataFrame:
    """Mirrored (without the edge) at the lower right, to the next multiple of step."""
    keys = list(keys)
    for axis in ("row", "col"):
        end = raster.groupBy(*keys).agg(F.max(axis).alias("_e"))
        up = F.ceil((F.col("_e") + 1) / step) * step - 1
        mirror = 2 * F.col("_e") - F.col(axis)
        r = raster.join(F.broadcast(end), keys)
        places = F.array_compact(F.array(F.col(axis), F.when((mirror > F.col("_e")) & (mirror <= up), mirror)))
        raster = r.withColumn("_at", F.explode(places)).withColumn(axis, F.col("_at").cast("int")).drop("_at", "_e")
    return raster.select(*keys, "row", "col", "value")


def burned(lines: DataFrame, to_pixel: Callable[[Column, Column], Column], width: int = 2) -> DataFrame:
    """Pixels (tile_id, row, col) of polylines (tile_id, geometry): each segment in unit steps, then a square brush of that width."""
    segment = lines.where(F.size("geometry") >= 2).select("tile_id", F.explode(F.arrays_zip(F.slice("geometry", 1, F.size("geometry") - 1).alias("a"), F.slice("geometry", 2, F.size("geometry") - 1).alias("b"))).alias("s"))
    ends = segment.select("tile_id", to_pixel(F.col("s.a.lat"), F.col("s.a.lon")).alias("p"), to_pixel(F.col("s.b.lat"), F.col("s.b.lon")).alias("q"))
    n = F.greatest(F.abs(F.col("q.row") - F.col("p.row")), F.abs(F.col("q.col") - F.col("p.col")))
    steps = ends.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a: F.rint(F.col(f"p.{a}") + (F.col(f"q.{a}") - F.col(f"p.{a}")) * F.coalesce(F.try_divide(F.col("i"), F.col("n")), F.lit(0.0))).cast("int")
    core = steps.select("tile_id", at("row").alias("row"), at("col").alias("col")).distinct()
    low = -((width - 1) // 2)
    brush = [(r, c) for r in range(low, low + width) for c in range(low, low + width)]
    return moved(core, brush)


def buffered(places: DataFrame, lines: DataFrame, degrees: float = 3e-5) -> DataFrame:
    """Places (id, lat, lon) within a planar distance of a polyline, by cells of that size."""
    segment = lines.where(F.size("geometry") >= 2).select(F.explode(F.arrays_zip(F.slice("geometry", 1, F.size("geometry") - 1).alias("a"), F.slice("geometry", 2, F.size("geometry") - 1).alias("b"))).alias("s")).select("s.a", "s.b")
    cell = lambda x: F.floor(x / degrees).cast("long")
    span = lambda f: F.sequence(cell(F.least(F.col(f"a.{f}"), F.col(f"b.{f}"))) - 1, cell(F.greatest(F.col(f"a.{f}"), F.col(f"b.{f}"))) + 1)
    cells = segment.withColumn("r", F.explode(span("lat"))).withColumn("c", F.explode(span("lon")))
    near = places.withColumn("r", cell(F.col("lat"))).withColumn("c", cell(F.col("lon"))).join(cells, ["r", "c"])
    dy, dx = F.col("b.lat") - F.col("a.lat"), F.col("b.lon") - F.col("a.lon")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((F.col("lat") - F.col("a.lat")) * dy + (F.col("lon") - F.col("a.lon")) * dx, dy * dy + dx * dx), F.lit(0.0))))
    away = F.sqrt(F.pow(F.col("lat") - F.col("a.lat") - t * dy, 2) + F.pow(F.col("lon") - F.col("a.lon") - t * dx, 2))
    return near.where(away <= degrees).select(*places.columns).distinct()


def sweep(levels: DataFrame) -> DataFrame:
    """Mean IoU by level of pairs (level, tile_id, p, g)."""
    return confusion(levels, ("level", "tile_id")).groupBy("level").agg(F.avg("iou").alias("iou"), F.count("*").alias("n_tiles"))
