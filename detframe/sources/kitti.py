"""KITTI label lines and generated run folders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dir_number
from ..storage import listed
from .listing import lines, texts_below
from .staged import write_files

#: Fixed value: the one class of generated labels and its category.
CLASS_MAP = {"palletjack": 11}


def parse_labels(lines: DataFrame, classes: dict[str, int] = CLASS_MAP) -> DataFrame:
    """lines(..., value) -> the other columns, category_id and x, y, w, h; short and foreign lines go."""
    t = lines.withColumn("tok", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).where(F.size("tok") >= 8)
    known = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    t = t.withColumn("category_id", F.try_element_at(known, F.lower(F.col("tok")[0]))).where("category_id IS NOT NULL")
    x1, y1, x2, y2 = (F.get("tok", F.lit(i)).cast("double") for i in range(4, 8))
    return t.select(*[c for c in lines.columns if c != "value"], "category_id", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def label_line(name, x1, y1, x2, y2):
    """One object as a label line; fields that nothing reads are zeros."""
    zero = F.lit("0.00")
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    return F.concat_ws(" ", name, zero, F.lit("0"), zero, number(x1), number(y1), number(x2), number(y2), *[zero] * 7)


#: Folders of a generated run, and its size of images where no configuration names one.
RUN_PREFIX, LABELS, IMAGES = "palletjack_run_", "Camera/object_detection", "Camera/rgb"
WIDTH, HEIGHT = 960, 544


def write_labels(boxes: DataFrame, folder: str) -> None:
    """boxes(run_number, experiment, frame, line): the text file that read_labels reads, one a frame.

    Lines of a frame stand in the order of ann_pos, if there is such a column, else of the text. All files appear when
    the job has ended well, none if it fails (see staged).
    """
    order = F.col("ann_pos") if "ann_pos" in boxes.columns else F.lit(0)
    files = boxes.groupBy("run_number", "experiment", "frame").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "line"))).alias("lines"))
    name = F.concat(F.lit(RUN_PREFIX), F.col("run_number").cast("string"), F.lit("/"), "experiment", F.lit(f"/{LABELS}/"), F.col("frame").cast("string"), F.lit(".txt"))
    write_files(files.select(name.alias("path"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("content")), folder)


def run_dirs(paths: DataFrame) -> DataFrame:
    """paths(path) -> run_dir, run_number, experiment of folders palletjack_run_<n>/<experiment>, in text order of use."""
    run = F.regexp_extract("path", r"(palletjack_run_[^/]*)/([^/]+)/", 1)
    exp = F.regexp_extract("path", r"(palletjack_run_[^/]*)/([^/]+)/", 2)
    d = paths.select(run.alias("run_dir"), exp.alias("experiment")).where("run_dir <> ''").distinct()
    return d.withColumn("run_number", dir_number(F.col("run_dir")))


def _yaml_to_json(texts: pd.Series) -> pd.Series:
    import yaml

    return texts.map(lambda t: json.dumps(yaml.safe_load(t) or {}, default=str))


def run_folders(spark: SparkSession, base: str) -> DataFrame:
    """run_dir, run_number of every run folder, with or without configurations."""
    dirs = spark.createDataFrame([(d.rsplit("/", 1)[1],) for d, _ in listed(spark, f"{base}/{RUN_PREFIX}*", folders=True)], "run_dir string")
    return dirs.withColumn("run_number", dir_number(F.col("run_dir")))


def read_run_configs(spark: SparkSession, base: str) -> DataFrame:
    """run_dir, experiment, run_number, config (JSON text): an experiment without run_config.yaml has no row."""
    raw = texts_below(spark, f"{base}/{RUN_PREFIX}*", "*/run_config.yaml")
    run, experiment = F.regexp_extract("folder", r"([^/]+)/?$", 1), F.regexp_extract("path", r"^([^/]+)/", 1)
    return raw.select(run.alias("run_dir"), experiment.alias("experiment"), dir_number(run).alias("run_number"), F.pandas_udf(_yaml_to_json, "string")("value").alias("config"))


def frames(runs: DataFrame) -> DataFrame:
    """One row for each frame 0..num_frames-1 of the configuration; images aren't looked for."""
    n = F.coalesce(F.try_variant_get(F.try_parse_json("config"), "$.run.num_frames", "int"), F.lit(0))
    return runs.withColumn("n", n).where("n > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def read_labels(spark: SparkSession, base: str) -> DataFrame:
    """run_dir, experiment, frame, ann_pos (the line's number in its file) and what parse_labels gives.

    Executors list the run folders and read their files in packs, so the driver never holds a list of label files.
    """
    raw = lines(texts_below(spark, f"{base}/{RUN_PREFIX}*", f"*/{LABELS}/*.txt"))
    run, experiment = F.regexp_extract("folder", r"([^/]+)/?$", 1), F.regexp_extract("path", r"^([^/]+)/", 1)
    frame = F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).try_cast("int")
    return parse_labels(raw.select(run.alias("run_dir"), experiment.alias("experiment"), frame.alias("frame"), F.col("line").cast("long").alias("ann_pos"), "value").where("frame IS NOT NULL"))


def read_synth(spark: SparkSession, base: str | None, runs: list[int] | None = None, wanted: bool = True, base_config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and their annotations of generated runs; both empty if switched off or without a folder.

    Each experiment's configuration lies over base_config. runs names the wanted ones (None: all, an empty list: none);
    a run is there if its folder is. A frame without a label file stays, with no annotations; images aren't looked for.
    Frames: sample_id, image_id, path, width, height, subset, state, run_config (JSON text), run_number, run_dir,
    experiment, frame. Annotations: sample_id, ann_pos and what parse_labels gives.
    """
    from ..operators.configs import deep_merge
    from ..operators.samples import require_runs, sample_id

    there = bool(wanted and base and listed(spark, base, folders=True))
    configs = read_run_configs(spark, base if there else "/nowhere-at-all")
    if there and runs is not None:
        configs = configs.join(F.broadcast(require_runs(run_folders(spark, base), runs).select("run_dir")), "run_dir")
    f = frames(configs.withColumn("config", deep_merge(F.lit(json.dumps(base_config or {})), F.col("config"))))
    rc = F.try_parse_json("config")
    at = lambda path, default: F.coalesce(F.try_variant_get(rc, path, "int"), F.lit(default))
    f = f.select(
        sample_id(F.col("frame"), F.col("run_number"), F.col("experiment")).alias("sample_id"), F.col("frame").alias("image_id"),
        F.concat_ws("/", F.lit(base or ""), "run_dir", "experiment", F.lit(IMAGES), F.concat(F.col("frame").cast("string"), F.lit(".png"))).alias("path"),
        at("$.render.width", WIDTH).alias("width"), at("$.render.height", HEIGHT).alias("height"), F.lit("synth").alias("subset"), F.lit("additional").alias("state"),
        F.col("config").alias("run_config"), "run_number", "run_dir", "experiment", "frame",
    )
    labels = read_labels(spark, base if there else "/nowhere-at-all")
    return f, labels.join(f.select("run_dir", "experiment", "frame", "sample_id"), ["run_dir", "experiment", "frame"])
