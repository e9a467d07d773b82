"""Trial tables (CSV) in, configurations (YAML) out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staged import write_files


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by name; an empty field is an empty text and `None` a word."""
    d = spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    return d.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in d.columns])


def _to_yaml(texts: pd.Series) -> pd.Series:
    import yaml

    return texts.map(lambda t: yaml.dump(json.loads(t), sort_keys=False, default_flow_style=False))


def write_configs(configs: DataFrame, folder: str) -> None:
    """configs(distribution_id, config struct): <id>.yaml each, keys in the struct's order, overwriting; all appear or none."""
    text = F.pandas_udf(_to_yaml, "string")(F.to_json("config"))
    write_files(configs.select(F.concat(F.col("distribution_id"), F.lit(".yaml")).alias("path"), text.alias("content")), folder)


def with_provenance(configs: DataFrame, config_file: str, commit: str | None, timestamp: str) -> DataFrame:
    meta = F.struct(F.lit(timestamp).alias("timestamp"), F.lit(config_file).alias("config_file"), F.lit(commit or "unavailable").alias("git_commit"))
    return configs.withColumn("config", F.struct(meta.alias("meta"), "config.*"))
