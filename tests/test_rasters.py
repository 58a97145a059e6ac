import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.operators import contract, raster
from arterial.sources import rasters


def mask(spark, image, tile=0):
    r, c = np.mgrid[: image.shape[0], : image.shape[1]]
    return spark.createDataFrame([(tile, int(a), int(b), int(v)) for a, b, v in zip(r.ravel(), c.ravel(), image.ravel(), strict=True)], "tile_id int, row int, col int, v int")


def bands(spark, array):
    return spark.createDataFrame([(0, b, r, c, float(array[b, r, c])) for b in range(array.shape[0]) for r in range(array.shape[1]) for c in range(array.shape[2])], "tile_id int, band int, row int, col int, value double")


def image(df, name="v"):
    rows = df.collect()
    out = np.zeros((max(r.row for r in rows) + 1, max(r.col for r in rows) + 1))
    for r in rows:
        out[r.row, r.col] = r[name]
    return out


def test_confusion(spark):
    gt, pred = np.array([[1, 1, 1, 1, 0, 0, 0, 0]]), np.array([[1, 1, 1, 1, 1, 1, 0, 0]])
    r = raster.confusion(raster.paired(mask(spark, pred), mask(spark, gt))).first()
    assert (round(r.iou, 4), round(r.precision, 4), r.recall, round(r.f1, 4)) == (0.6667, 0.6667, 1.0, 0.8)
    empty = raster.confusion(raster.paired(mask(spark, pred), mask(spark, gt * 0))).first()
    assert empty.iou is None and empty.f1 is None


def test_component_stats(spark):
    img = np.zeros((40, 40), int)
    img[[10, 30]] = 1
    img[5, 5] = img[35, 35] = 1
    r = raster.component_stats(mask(spark, img), 4, 5).first()
    assert (r.n_components, r.n_filtered) == (2, 2)


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(1)
    img = (rng.random((14, 17)) < 0.3).astype(int)
    padded = np.pad(img, 1)
    grown = np.max([padded[1 + r : 15 + r, 1 + c : 18 + c] for r, c in raster.square(1)], axis=0)
    assert (image(raster.dilate(mask(spark, img), raster.square(1))) == grown).all()
    full = np.pad(img, 1, constant_values=1)
    shrunk = np.min([full[1 + r : 15 + r, 1 + c : 18 + c] for r, c in raster.CROSS], axis=0)
    assert (image(raster.erode(mask(spark, img), raster.CROSS)) == shrunk).all()


def test_holes_and_small_parts(spark):
    img = np.zeros((12, 12), int)
    img[2:9, 2:9] = 1
    img[5, 5] = 0
    img[11, 11] = 1
    m = mask(spark, img)
    assert image(raster.without_holes(m, 5))[5, 5] == 1 and image(raster.without_small(m, 3))[11, 11] == 0


def test_lee(spark):
    flat = bands(spark, np.full((1, 12, 12), -10.0))
    assert np.allclose(image(raster.lee(flat), "value"), -10)
    step = np.full((1, 9, 20), -15.0)
    step[0, :, 10:] = 5
    assert image(raster.lee(bands(spark, step)), "value")[4, 10] == pytest.approx(4.976, abs=2e-3)


def test_median_and_scaling(spark):
    rng = np.random.default_rng(2)
    a = rng.random((1, 7, 8))
    padded = np.pad(a[0], 2, mode="symmetric")
    want = np.array([[np.median(padded[r : r + 5, c : c + 5]) for c in range(8)] for r in range(7)])
    assert np.allclose(image(raster.median_filter(bands(spark, a)), "value"), want)
    lo, hi = np.percentile(a, [1, 99])
    assert np.allclose(image(raster.percentile_scaled(bands(spark, a)), "value"), np.clip((a[0] - lo) / (hi - lo), 0, 1))


def test_decibel(spark):
    sar = np.array([[[0.01, 0.01]], [[0.1, 0.1]]])
    out = {(r.band, r.col): r.value for r in raster.to_decibel(bands(spark, sar)).collect()}
    assert out == pytest.approx({(0, 0): -20, (0, 1): -20, (1, 0): -10, (1, 1): -10})
    assert {r.value for r in raster.to_decibel(bands(spark, -sar)).collect()} == {-0.01, -0.1}


@pytest.mark.parametrize(("cloud", "dropped"), [(0.67, True), (0.50, False), (0.501, True)])
def test_fusion(spark, cloud, dropped):
    o, s = bands(spark, np.full((4, 2, 2), 0.5)), bands(spark, np.full((2, 2, 2), 3.0))
    out = {r.band: r.value for r in raster.fused(o, s, spark.createDataFrame([(0, cloud)], "tile_id int, cloud double")).collect()}
    assert out == {b: (0.0 if dropped else 0.5) if b < 4 else (6.0 if dropped else 3.0) for b in range(6)}


def test_clouds(spark):
    assert raster.cloud_mask(bands(spark, np.full((3, 4, 4), 0.95))).agg(F.avg("v")).first()[0] == 1
    mixed = np.stack([np.full((4, 4), x) for x in (0.9, 0.1, 0.5, 0.3)])
    assert raster.cloud_mask(bands(spark, mixed)).agg(F.avg("v")).first()[0] == 0


def test_thinning_keeps_lines_connected():
    img = np.zeros((20, 40), bool)
    img[8:12, 4:36] = True
    thin = raster.thin(img)
    assert 25 <= thin.sum() <= 34 and thin.sum(axis=0).max() == 1 and not (thin & ~img).any()


def test_symmetries_invert(spark):
    a = bands(spark, np.arange(16.0).reshape(1, 4, 4))
    for k in range(8):
        assert sorted(map(tuple, raster.inverse_symmetry(raster.symmetry(a, k), k).collect())) == sorted(map(tuple, a.collect()))
    out = raster.augmented_mean(a.drop("band"), lambda r: r)
    assert out.agg(F.max("uncertainty")).first()[0] == 0


def test_calibration_bins(spark):
    p = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.15, 0), (1.0, 1)], "p double, y int")
    assert {r.bin: r.n for r in raster.calibration(p).collect()} == {1: 1, 2: 1, 10: 1}


def test_resize_and_pad(spark):
    a = np.arange(6.0).reshape(1, 2, 3)
    assert np.allclose(image(raster.resized(bands(spark, a), 2, 3), "value"), a[0])
    padded = image(raster.padded_to(bands(spark, np.arange(30.0).reshape(1, 5, 6)), 8), "value")
    assert np.allclose(padded, np.pad(np.arange(30.0).reshape(5, 6), ((0, 3), (0, 2)), mode="reflect"))


def broadcast(df):
    """What the plan of a frame that was computed broadcasts, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out += lines[i:end]
    return "\n".join(out)


def test_samples_of_a_resize_stay_off_the_driver(spark):
    tiles = spark.range(20_000).selectExpr("int(id div 100) tile_id", "0 band", "int(id div 10 % 10) row", "int(id % 10) col", "double(id % 100) value")
    out = raster.resized(tiles, 25, 4)
    assert sum(r.value for r in out.collect()) == pytest.approx(200 * 100 * 49.5)
    assert "Generate" not in broadcast(out)


def test_roads_split_by_width(spark):
    truth, pred = np.zeros((60, 40), int), np.zeros((60, 40), int)
    truth[5, :] = truth[10:14, :] = truth[20:51, :] = 1
    pred[5, :10] = pred[10:14, :20] = pred[20:51, :30] = 1
    out = raster.width_split_iou(mask(spark, pred), mask(spark, truth))
    found = {r.kind: r.iou for r in out.collect()}
    assert found["narrow"] < found["wide"] == pytest.approx(0.75, abs=0.02)
    total = raster.width_split_iou(mask(spark, pred), mask(spark, truth), 0, 0).first()
    assert (total.kind, total.iou) == ("wide", pytest.approx(float(pred.sum() / truth.sum())))
    assert not broadcast(out)


def test_nearest_set_pixel():
    rng = np.random.default_rng(6)
    for _ in range(30):
        on = rng.random(rng.integers(2, 12, 2)) < rng.choice([0.02, 0.1, 0.5])
        on[tuple(rng.integers(0, on.shape))] = True
        d, r, c = raster.nearest_set(on)
        for i, j in np.ndindex(on.shape):
            assert (d[i, j], r[i, j], c[i, j]) == min(((i - a) ** 2 + (j - b) ** 2, a, b) for a, b in np.argwhere(on).tolist())


def test_npy_source(spark, tmp_path):
    img = (np.random.default_rng(3).random((30, 20)) < 0.5).astype(np.uint8)
    np.save(tmp_path / "m.npy", img)
    assert (image(rasters.read_npy(spark, str(tmp_path / "m.npy")), "value") == img).all()
    assert (image(rasters.read_masks(spark, str(tmp_path))) == img).all()


def test_generated_masks(spark):
    m = rasters.arterial_mask(spark)
    assert 0.05 <= m.agg(F.avg("v")).first()[0] <= 0.6
    seeds = spark.createDataFrame([(i,) for i in range(5)], "seed int")
    n = {r.tile_id: r.n for r in rasters.seeded_masks(rasters.grid_mask(spark, 30, 10, 2, 4), seeds).groupBy("tile_id").agg(F.sum("v").alias("n")).collect()}
    assert n[0] == n[1] == n[2] < n[3] == n[4]


def test_losses_of_pixels(spark):
    """The soft skeleton of a thin line is the line; equal images lose nothing but smoothing."""
    line = np.zeros((12, 12))
    line[6, 2:10] = 1
    assert (raster.soft_skeleton(line) == line).all()
    wide = np.zeros((12, 20))
    wide[4:9, 2:18] = 1
    skeleton = raster.soft_skeleton(wide)
    assert 0 < skeleton.sum() < wide.sum() and not (skeleton > wide).any()
    rows = [(0, r, c, float(wide[r, c]), int(wide[r, c])) for r in range(12) for c in range(20)]
    pixels = spark.createDataFrame(rows, "tile_id int, row int, col int, p double, y int")
    r = raster.combined_loss(pixels).first()
    assert max(r.dice, r.bce, r.focal, r.boundary, r.connectivity, r.total) < 1e-6
    x = np.pad(wide, 1)
    gx = sum(w * (x[i : i + 12, 2:] - x[i : i + 12, :-2]) for i, w in enumerate((1, 2, 1)))
    gy = sum(w * (x[2:, i : i + 20] - x[:-2, i : i + 20]) for i, w in enumerate((1, 2, 1)))
    assert np.allclose(image(raster.soft_edges(pixels, "p"), "edge"), np.sqrt(gx**2 + gy**2 + 1e-8))


def test_inputs_and_truth_by_trust(spark, tmp_path):
    mask, meta = rasters.inputs(spark, str(tmp_path / "m.npy"), str(tmp_path / "meta.json"))
    assert mask.count() == 40_000 and meta.first().source == "synthetic" and contract.meta_violations(meta).count() == 0
    with pytest.raises(FileNotFoundError):
        rasters.inputs(spark, str(tmp_path / "m.npy"), str(tmp_path / "meta.json"), synthetic=False)
    rasters.write_meta(meta, str(tmp_path / "meta.json"))
    np.save(tmp_path / "m.npy", np.eye(30, dtype=np.uint8))
    mask, meta = rasters.inputs(spark, str(tmp_path / "m.npy"), str(tmp_path / "meta.json"))
    assert mask.agg(F.sum("v")).first()[0] == 30 and meta.count() == 1
    given, cached = str(tmp_path / "given.npy"), str(tmp_path / "m.npy")
    total = lambda m: m.agg(F.sum("v")).first()[0]
    assert rasters.truth_mask(spark, given, given) is None
    assert total(rasters.truth_mask(spark, given, given, lambda: rasters.arterial_mask(spark))) > 100 and total(rasters.truth_mask(spark, given, cached)) == 30
    np.save(tmp_path / "given.npy", np.ones((3, 3), np.uint8))
    assert total(rasters.truth_mask(spark, given, cached)) == 9


def test_evaluation_fits_the_truth(spark):
    truth = rasters.grid_mask(spark, 40, 10, 3, 4)
    small = truth.where("row % 2 = 0 and col % 2 = 0").select("tile_id", (F.col("row") / 2).cast("int").alias("row"), (F.col("col") / 2).cast("int").alias("col"), "v")
    same = raster.evaluated(truth, truth).first()
    assert same.iou == 1 and same.density == same.truth_density
    assert raster.evaluated(small, truth).first().iou == 1
    assert "iou" not in raster.evaluated(truth, None).columns
    tiles = rasters.synthetic_tiles(truth, 3)
    assert tiles.groupBy("band").count().count() == 5 and tiles.where("band < 3 and (value < 0 or value > 1.3)").count() == 0
