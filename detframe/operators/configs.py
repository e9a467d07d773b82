"""Layered configurations: deep merge, inheritance, flattening, and configurations from trial tables."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, rounded, truncated

#: Fixed values of the generated configurations.
TEXTURE_PREFIX = "/Isaac/Materials/Textures/Patterns/"
TRIAL_PREFIX = "metadata.synth_metadata_synth_"
TRIAL_TEXTURES, METADATA_TEXTURES = 12, 25


def merged_path(base: Column, override: Column, path: str) -> Column:
    """One path of the merged configuration, as a variant: the override wins if it has the path, even with null."""
    return F.coalesce(F.try_variant_get(override, path, "variant"), F.try_variant_get(base, path, "variant"))


def layered_path(layers: list[Column], path: str) -> Column:
    """One path of several configurations, the later over the earlier, as a variant; a layer that lacks it leaves it."""
    return F.coalesce(*[F.try_variant_get(c, path, "variant") for c in reversed(layers)])


def merge_objects(base, override):
    """Objects merge key by key; anything else in the override, null and lists included, replaces."""
    if isinstance(base, dict) and isinstance(override, dict):
        return base | {k: merge_objects(base[k], v) if k in base else v for k, v in override.items()}
    return override


def _merge_json(base: pd.Series, override: pd.Series) -> pd.Series:
    def one(b, o):
        if b is None or o is None:
            return b if o is None else o
        return json.dumps(merge_objects(json.loads(b), json.loads(o)))

    return pd.Series([one(b, o) for b, o in zip(base, override, strict=True)])


def deep_merge(base: Column, override: Column) -> Column:
    """Merged JSON text of any schema (Arrow batches); use merged_path where the paths are known."""
    return F.pandas_udf(_merge_json, "string")(base, override)


def resolve_extends(configs: DataFrame) -> DataFrame:
    """configs(path, extends, config JSON): each with its parent's config below it; one level, left outer.

    `extends` is relative to the child's folder.
    """
    folder = F.regexp_replace("path", r"[^/]*$", "")
    raw = F.concat(folder, "extends")
    # a/b/../c -> a/c, as often as it occurs (up to eight levels), and ./ goes.
    plain = F.regexp_replace(raw, r"(^|/)\./", "$1")
    for _ in range(8):
        plain = F.regexp_replace(plain, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    parents = configs.select(F.col("path").alias("parent_path"), F.col("config").alias("parent"))
    j = configs.withColumn("parent_path", plain).join(parents, "parent_path", "left")
    return j.select("path", "parent_path", F.when(F.col("parent").isNull(), F.col("config")).otherwise(deep_merge(F.col("parent"), F.col("config"))).alias("config"))


def with_overrides(config: Column, overrides: Column) -> Column:
    """Command-line values over everything."""
    return F.when(overrides.isNull(), config).otherwise(deep_merge(config, overrides))


def _get(layers: list[Column], path: str, kind: str) -> Column:
    return F.try_variant_get(layers[0], path, kind) if len(layers) == 1 else F.try_variant_get(layered_path(layers, path), "$", kind)


_NUMBERS = (
    ("camera_height_min", "$.camera.camera_height_min", "double", None), ("camera_height_max", "$.camera.camera_height_max", "double", None),
    ("fov_min", "$.camera.fov_min", "double", None), ("fov_max", "$.camera.fov_max", "double", None),
    ("noise_std_min", "$.camera.noise_std_min", "double", None), ("noise_std_max", "$.camera.noise_std_max", "double", None),
    ("motion_blur_min", "$.camera.motion_blur_strength_min", "double", None), ("motion_blur_max", "$.camera.motion_blur_strength_max", "double", None),
    ("jpeg_quality_min", "$.camera.jpeg_quality_min", "double", 0.0), ("jpeg_quality_max", "$.camera.jpeg_quality_max", "double", 0.0),
    ("render_width", "$.render.width", "double", 0.0), ("render_height", "$.render.height", "double", 0.0),
    ("palletjack_count_per_model", "$.palletjacks.count_per_model", "double", 0.0),
    ("lighting_intensity_mean", "$.lighting.intensity_mean", "double", None), ("lighting_intensity_std", "$.lighting.intensity_std", "double", None),
    ("materials_roughness_min", "$.materials.roughness_min", "double", None), ("materials_roughness_max", "$.materials.roughness_max", "double", None),
)


def synth_metadata(samples: DataFrame, layers: tuple = ("run_config",)) -> DataFrame:
    """The 51 flat columns of a sample's run configuration.

    samples: sample_id, the layers (variants; each lies over those before it, path by path), run_number, experiment,
    n_annotations. Real samples and empty configurations get the sentinels (NaN, empty text). Null numbers give NaN.
    """
    nan, rc = F.lit(float("nan")), [F.col(c) for c in layers]
    on = reduce(or_, [c.isNotNull() & (F.coalesce(F.to_json(c), F.lit("{}")) != "{}") for c in rc])
    number = lambda c, default: F.when(on, F.coalesce(c, nan if default is None else F.lit(default))).otherwise(nan)
    text = lambda c: F.when(on, F.coalesce(c, F.lit(""))).otherwise("")
    textures = _get(rc, "$.materials.textures", "array<string>")
    colors = F.coalesce(_get(rc, "$.palletjacks.color_max", "array<double>"), F.array().cast("array<double>"))
    size = lambda path: F.coalesce(F.size(_get(rc, path, "array<string>")), F.lit(0))
    cols = [
        number(F.col("run_number").cast("double"), 0.0).alias("synth_run_number"), text(F.col("experiment")).alias("synth_experiment"),
        text(_get(rc, "$.run.distractors", "string")).alias("synth_distractors"), text(_get(rc, "$.environment.env_url", "string")).alias("synth_env_url"),
    ]
    cols += [number(_get(rc, path, kind), default).alias(f"synth_{name}") for name, path, kind, default in _NUMBERS]
    cols += [number(F.get(_get(rc, "$.palletjacks.rotation_max", "array<double>"), F.lit(2)), None).alias("synth_palletjack_rotation_max_z")]
    cols += [number(F.exists(colors, lambda v: v > 0).cast("double"), 0.0).alias("synth_palletjack_color_randomized")]
    cols += [text(basename(F.get(textures, F.lit(i)))).alias(f"synth_texture_{i + 1}") for i in range(METADATA_TEXTURES)]
    cols += [number(F.greatest(size(f"$.distractors_{p}.assets"), F.lit(0)).cast("double"), 0.0).alias(f"synth_num_{p}_distractors") for p in ("warehouse", "additional")]
    cols += [number(F.col("n_annotations").cast("double"), 0.0).alias("synth_num_objects")]
    return samples.select("sample_id", *cols)


def assets_of(config: str, path: str, root: str = "") -> Column:
    """The paths that a configuration lists there, in order, below the asset root; empty where it lists none."""
    listed = F.coalesce(F.try_variant_get(config, path, "array<string>"), F.array().cast("array<string>"))
    return F.transform(listed, lambda a: F.concat(F.lit(root), a))


def distinct_textures(slots: list[Column], prefix: str = TEXTURE_PREFIX) -> Column:
    """Non-blank slots, first occurrences in order, with the prefix."""
    names = F.filter(F.transform(F.array(*[F.trim(F.coalesce(s, F.lit(""))) for s in slots]), lambda x: x), lambda x: x != "")
    return F.transform(F.array_distinct(names), lambda x: F.concat(F.lit(prefix), x))


def trial_configs(trials: DataFrame, extends: str, data_dir: str = "/placeholder") -> DataFrame:
    """distribution_id and the generation config (a struct) of each trial row; columns by name, all text."""
    col = lambda k: F.col(f"`{TRIAL_PREFIX}{k}`")
    flt, whole = (lambda k: rounded(col(k)).alias(k)), (lambda k: truncated(col(k)))
    config = F.struct(
        F.lit(extends).alias("extends"),
        F.struct(F.trim("n_samples").cast("int").alias("num_frames"), F.trim(col("distractors")).alias("distractors"), F.lit(data_dir).alias("data_dir")).alias("run"),
        F.struct(
            flt("camera_height_min"), flt("camera_height_max"), *[whole(k).alias(k) for k in ("fov_min", "fov_max", "noise_std_min", "noise_std_max")],
            rounded(col("motion_blur_min")).alias("motion_blur_strength_min"), rounded(col("motion_blur_max")).alias("motion_blur_strength_max"),
        ).alias("camera"),
        F.struct(rounded(col("lighting_intensity_mean")).alias("intensity_mean"), rounded(col("lighting_intensity_std")).alias("intensity_std")).alias("lighting"),
        F.struct(
            rounded(col("materials_roughness_min")).alias("roughness_min"), rounded(col("materials_roughness_max")).alias("roughness_max"),
            distinct_textures([col(f"texture_{i}") for i in range(1, TRIAL_TEXTURES + 1)]).alias("textures"),
        ).alias("materials"),
        F.struct(whole("palletjack_count_per_model").alias("count_per_model")).alias("palletjacks"),
    )
    return trials.select("distribution_id", config.alias("config"))
