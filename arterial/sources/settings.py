"""Configuration, thresholds, reports, hashes and timers."""

import hashlib
import json
import logging
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("arterial")

# Settings and their defaults.
DEFAULTS = {
    "city_name": "Koramangala, Bengaluru",
    "bbox": [77.6101, 12.9177, 77.6401, 12.9377],
    "collapse_threshold": 0.50,
    "monte_carlo_scenarios": 100,
    "monte_carlo_k": 5,
    "cascading_scenarios": 20,
    "cascading_radius_m": 200,
    "cascading_correlation_prob": 0.8,
    "random_seed": 42,
    "graph_source": "part_b",
    "output_dir": "outputs",
    "road_mask_path": "outputs/road_mask.npy",
    "meta_path": "outputs/meta.json",
    "graph_path": "outputs/graph.json",
    "heatmap_path": "outputs/disaster_heatmap.html",
}
LOCKED = ("collapse_threshold", "bbox")
GRAPH_SOURCES = ("part_b", "osmnx")
# By sensor name, metres a pixel and how many pixels a gap under trees usually spans.
SENSORS = {
    "liss-iv": (5.8, 4), "lissiv": (5.8, 4), "liss_iv": (5.8, 4),
    "sentinel-2": (10.0, 2), "sentinel2": (10.0, 4), "s2": (10.0, 4),
    "sentinel-1": (10.0, 2), "sentinel1": (10.0, 4), "s1": (10.0, 4), "sar": (10.0, 4),
}
UNKNOWN_GAP_PX = 4
# Distances as a multiple of a pixel, and their least value in metres.
BY_PIXEL = {"stub_m": (1.5, 5.0), "least_road_m": (3.0, 10.0), "road_width_m": (2.0, 7.0), "wide_stub_m": (8.0, 0.0)}
SNAP_BY_GAP, SECOND_SNAP_BY_SNAP, CLOSING_PIXEL_M = 1.5, 1.75, 5.8


def load_config(path: str | None = None) -> dict:
    """Defaults plus the known keys of a YAML file; unknown keys are dropped, changes of locked ones kept, both with a warning."""
    config = dict(DEFAULTS)
    if path and Path(path).exists():
        import yaml

        for key, value in (yaml.safe_load(Path(path).read_text()) or {}).items():
            if key not in DEFAULTS:
                log.warning("unknown setting %s is ignored", key)
                continue
            if key in LOCKED and value != DEFAULTS[key]:
                log.warning("locked setting %s is changed to %s", key, value)
            config[key] = value
    return config


def thresholds(meta: DataFrame) -> DataFrame:
    """Meta rows (resolution_m, source) plus the distances that follow from them: a known sensor's own resolution goes before the stated one."""
    name = F.regexp_replace(F.lower(F.trim("source")), " ", "-")
    out = meta.withColumn("pixel_m", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in SENSORS.items() for x in (k, v[0]))), name), "resolution_m"))
    gap_px = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in SENSORS.items() for x in (k, v[1]))), name), F.lit(UNKNOWN_GAP_PX))
    out = out.withColumn("snap_m", F.round(gap_px * F.col("pixel_m") * SNAP_BY_GAP, 1))
    out = out.withColumn("second_snap_m", F.round(F.col("snap_m") * SECOND_SNAP_BY_SNAP, 1))
    by_pixel = {k: F.round(F.greatest(F.col("pixel_m") * factor, F.lit(least)), 1) for k, (factor, least) in BY_PIXEL.items()}
    return out.withColumns(by_pixel | {"closing_px": F.greatest(F.lit(1), F.round(F.col("pixel_m") / CLOSING_PIXEL_M)).cast("int")})


def start_up_errors(spark, config: dict, box, paths: Iterable[str] = ()) -> list[str]:
    """What speaks against starting: a locked setting that was changed, a box out of order, an unknown graph source, a schema without its columns, an input that isn't there."""
    from ..schema import EDGES, NODES
    from .files import exists

    locked = [f"{k} is {config.get(k)!r}, not {DEFAULTS[k]!r}" for k in LOCKED if config.get(k) != DEFAULTS[k]]
    box_order = [] if box.min_lon < box.max_lon and box.min_lat < box.max_lat else ["the box is inverted"]
    source = [] if config.get("graph_source") in GRAPH_SOURCES else [f"unknown graph source {config.get('graph_source')!r}"]
    lacking = [f"{name} lack {c}" for name, schema, wanted in (("nodes", NODES, ("id", "lat", "lon")), ("edges", EDGES, ("source", "target", "weight_m", "geometry"))) for c in wanted if c not in str(schema)]
    return locked + box_order + source + lacking + [f"{p} isn't there" for p in paths if not exists(spark, p)]


def write_evaluation(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Per-tile rows, appended."""
    rows.write.mode("append").option("header", True).csv(path)


def append_text(path: str, lines: list[str]) -> None:
    with Path(path).open("a") as out:
        out.writelines(f"{line}\n" for line in lines)


def short_hash(df: DataFrame, columns: list[str]) -> str:
    """16 hex digits that don't depend on row order: the SHA-256 of the sum of row hashes and the count."""
    r = df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{r.s}|{r.n}".encode()).hexdigest()[:16]


@dataclass
class StageTimer:
    """Seconds by stage."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def save(self, path: str, **extra) -> None:
        Path(path).write_text(json.dumps({"stages": self.seconds, "total": sum(self.seconds.values()), **extra}, indent=2))


def setup_logging(level: int = logging.INFO) -> None:
    """S41."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
