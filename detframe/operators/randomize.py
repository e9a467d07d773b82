"""Randomised generation, the tabular part: reproducible draws from a hash of seed, key and name.

Draws depend on nothing but their key, so a lost partition is drawn again with equal values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import focal_length
from .configs import assets_of


def unit(seed: int, name: str, *key: Column) -> Column:
    """Uniform in [0, 1): 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), *key), 11) / float(1 << 53)


def uniform(low, high, u: Column) -> Column:
    return low + (high - low) * u


def integer(low: int, high: int, u: Column) -> Column:
    """Uniform over low..high, both included."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def normal(mean: float, std: float, u: Column, v: Column) -> Column:
    """Box-Muller from two uniforms."""
    return mean + std * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def choice(values: list, u: Column) -> Column:
    """One of the values; repeated values weigh more."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def vector(lows: list[float], highs: list[float], seed: int, name: str, *key: Column) -> Column:
    return F.array(*[uniform(F.lit(lo), F.lit(hi), unit(seed, f"{name}{i}", *key)) for i, (lo, hi) in enumerate(zip(lows, highs, strict=True))])


#: Ranges of the draws by default: fixed values of the base configuration.
RANGES = {
    "noise": (2.0, 10.0), "blur": (1.0, 4.0), "jpeg": (95, 100), "x": (-9.2, 7.2), "y": (-11.8, 15.8), "height": (0.4, 4.0), "focal": (10.4775, 18.14756), "yaw": (0.0, 360.0),
    "intensity": (100_000.0, 600_000.0), "visible": (True, False, False, False, False, False, False), "roughness": (0.0, 1.0), "scale": (1.0, 1.5),
    "object_scale": (0.01, 0.01), "emission": (0.0, 1000.0), "metallic": (0, 1),
}
#: Surfaces with a material of their own.
SURFACES = ("floor", "wall")


def generation_modes(configs: DataFrame, root: str = "") -> DataFrame:
    """What a configuration selects; further columns of configs(config variant) stay.

    aim: `tilt` if a smallest tilt is set, else `look_at`. focal_min, focal_max: the focal lengths if the smallest is
    set, else those of the largest and the smallest field of view, else null (the lens stays). distractor_pool: paths
    of the pool that run.distractors names below the asset root; empty for any other name.
    """
    number = lambda path: F.try_variant_get("config", f"$.camera.{path}", "double")
    least, fov, aperture = number("focal_length_min"), number("fov_min"), F.nullif(number("horizontal_aperture"), F.lit(0.0))
    lens = lambda own, view: F.when(least.isNotNull(), number(own)).when(fov.isNotNull(), focal_length(number(view), aperture))
    named = F.try_variant_get("config", "$.run.distractors", "string")
    pool = F.when(named == "warehouse", assets_of("config", "$.distractors_warehouse.assets", root)).when(named == "additional", assets_of("config", "$.distractors_additional.assets", root))
    return configs.select(
        "*", F.when(number("camera_tilt_min").isNotNull(), "tilt").otherwise("look_at").alias("aim"),
        lens("focal_length_min", "fov_max").alias("focal_min"), lens("focal_length_max", "fov_min").alias("focal_max"),
        F.coalesce(pool, F.array().cast("array<string>")).alias("distractor_pool"),
    )


def run_draws(runs: DataFrame, seed: int = 0, r=RANGES) -> DataFrame:
    """Once a run (key: run): noise, motion blur, JPEG quality."""
    k = F.col("run")
    return runs.select("run", uniform(*map(F.lit, r["noise"]), unit(seed, "noise", k)).alias("noise"), uniform(*map(F.lit, r["blur"]), unit(seed, "blur", k)).alias("blur"), integer(*r["jpeg"], unit(seed, "jpeg", k)).alias("jpeg_quality"))


def frame_draws(frames: DataFrame, seed: int = 0, r=RANGES, tilt: tuple[float, float] | None = None) -> DataFrame:
    """Once a frame (key: run, frame): camera, lens, light and floor. With tilt the yaw is free, else the camera looks at a point."""
    k = [F.col("run"), F.col("frame")]
    u = lambda n: unit(seed, n, *k)
    span = lambda n: uniform(*map(F.lit, r[n]), u(n))
    aim = [F.lit(None).cast("double").alias("pitch"), F.lit(None).cast("double").alias("yaw")] if tilt is None else [uniform(*map(F.lit, tilt), u("pitch")).alias("pitch"), span("yaw").alias("yaw")]
    return frames.select(
        "run", "frame", span("x").alias("camera_x"), span("y").alias("camera_y"), span("height").alias("camera_z"), *aim, span("focal").alias("focal_length"),
        vector([0.0] * 3, [1.0] * 3, seed, "light", *k).alias("light_color"), normal(*r["intensity"], u("i1"), u("i2")).alias("intensity"), choice(list(r["visible"]), u("visible")).alias("visible"),
        span("roughness").alias("roughness"), choice([0, 1], u("metallic")).alias("metallic"),
    )


def _posed(objects: DataFrame, seed: int, name: str, scale: Column) -> DataFrame:
    k = _object_key()
    placed = objects.where(F.col("asset") != "None")
    return placed.select("run", "frame", "object", "asset", vector([-6.0, -6.0, 0.0], [6.0, 12.0, 0.0], seed, f"{name}pos", *k).alias("position"), vector([0.0] * 3, [0.0, 0.0, 360.0], seed, f"{name}rot", *k).alias("rotation"), scale.alias("scale"))


def _object_key() -> list[Column]:
    return [F.col("run"), F.col("frame"), F.col("object")]


def object_draws(objects: DataFrame, seed: int = 0, r=RANGES) -> DataFrame:
    """Once a frame and object (key: run, frame, object): position, rotation, scale of each axis, colour; `None` objects go."""
    low, high = r["object_scale"]
    k = _object_key()
    posed = _posed(objects, seed, "", vector([low] * 3, [high] * 3, seed, "scale", *k))
    return posed.withColumn("color", vector([0.0] * 3, [1.0] * 3, seed, "col", *k))


def distractor_draws(objects: DataFrame, seed: int = 0, r=RANGES) -> DataFrame:
    """As object_draws for distractors: one scale for all axes, no colour."""
    one = uniform(*map(F.lit, r["scale"]), unit(seed, "distractor-scale", *_object_key()))
    return _posed(objects, seed, "distractor-", F.array(one, one, one))


def material_draws(frames: DataFrame, textures: list[str], seed: int = 0, r=RANGES, surfaces=SURFACES) -> DataFrame:
    """Once a frame and surface (key: run, frame, surface): textures (null if there are none), roughness, metal, emission."""
    rows = frames.select("run", "frame", F.explode(F.array(*map(F.lit, surfaces))).alias("surface"))
    u = lambda n: unit(seed, n, F.col("run"), F.col("frame"), F.col("surface"))
    texture = lambda n: choice(textures, u(n)) if textures else F.lit(None).cast("string")
    return rows.select(
        "run", "frame", "surface", texture("diffuse").alias("texture"), texture("emissive").alias("emissive_texture"), uniform(*map(F.lit, r["roughness"]), u("roughness")).alias("roughness"),
        choice(list(r["metallic"]), u("metallic")).alias("metallic"), uniform(*map(F.lit, r["emission"]), u("emission")).alias("emissive_intensity"),
    )


def expanded(assets: DataFrame, copies: int) -> DataFrame:
    """Each asset `copies` times, numbered."""
    return assets.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))) if copies > 0 else assets.withColumn("copy", F.lit(1)).limit(0)


def kept_classes(labels: DataFrame, classes: list[str]) -> DataFrame:
    """Labels of the listed classes only; an empty list keeps all."""
    return labels.where(F.col("label").isin(*classes)) if classes else labels


def hash_split(rows: DataFrame, key: str, percent: int = 10, shards: int = 10, seed: int = 0) -> DataFrame:
    """fold (validation for `percent` of 100) and shard, by a hash of the key."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100 * shards))
    return rows.withColumn("fold", F.when(h % 100 < percent, "validation").otherwise("training")).withColumn("shard", F.floor(h / 100).cast("int"))
