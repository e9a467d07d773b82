"""Sample records: joins, filters, splits, caps, ids and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import subset_of

#: Fixed values: (id in annotation files, name, index).
CATEGORIES = ((3, "small_load_carrier", 0), (5, "forklift", 1), (7, "pallet", 2), (10, "stillage", 3), (11, "pallet_truck", 4))
TRAIN_SUBSETS = ("subset-2", "subset-3", "subset-5")
VALIDATION_SUBSETS = ("subset-1", "subset-4")


def categories(spark: SparkSession, rows=CATEGORIES) -> DataFrame:
    return spark.createDataFrame(list(rows), "category_id int, name string, idx int")


def class_name(idx: Column, rows=CATEGORIES) -> Column:
    """Name of a class index; `Unknown` outside the list. A literal list, so no join."""
    names = F.array(*[F.lit(n) for _, n, _ in sorted(rows, key=lambda r: r[2])])
    return F.coalesce(F.when(idx >= 0, F.get(names, idx.cast("int"))), F.lit("Unknown"))


def with_valid_class(annotations: DataFrame, spark_categories: DataFrame) -> DataFrame:
    """Annotations of known categories with their class; the category table has a fixed few rows."""
    return annotations.join(F.broadcast(spark_categories.select("category_id", F.col("idx").alias("cls"))), "category_id")


def routed(samples: DataFrame, train=TRAIN_SUBSETS, validation=VALIDATION_SUBSETS) -> DataFrame:
    """subset and state from the path; a sample of neither split goes. Train wins where both name a subset."""
    state = F.when(F.col("subset").isin(*train), "training").when(F.col("subset").isin(*validation), "validation")
    return samples.withColumn("subset", subset_of(F.col("path"))).withColumn("state", state).where("state IS NOT NULL")


def sample_id(image_id: Column, run: Column | None = None, experiment: Column | None = None) -> Column:
    if run is None:
        return image_id.cast("string")
    return F.concat(F.lit("run"), run.cast("string"), F.lit("_"), experiment, F.lit("_frame"), image_id.cast("string"))


def data_type(run_config: Column) -> Column:
    """A record with a run configuration, even an empty one, is synthetic."""
    return F.when(run_config.isNotNull(), "synth").otherwise("real")


def images_with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with its annotations in file order, none included."""
    nested = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_pos", "category_id", "bbox"))).alias("anns"))
    return images.join(nested, "image_id", "left").withColumn("anns", F.coalesce("anns", F.array().cast(nested.schema["anns"].dataType)))


def capped(samples: DataFrame, limit: int | None, order: list, by: str = "state") -> DataFrame:
    """The first `limit` rows of each state in a given order (a rank filter: Spark prunes before the shuffle); None is no limit."""
    if limit is None:
        return samples
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return samples.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def ordered_synth(frames: DataFrame, num_samples: int | None = None, max_samples: int | None = None) -> DataFrame:
    """Synthetic frames: capped in directory order (text), then numbered by run number, stably.

    Frames are ranked in their directory and experiment; only the table of these is counted up in order.
    """
    dirs = [F.col("run_dir"), F.col("experiment"), F.col("frame")]
    kept = capped(capped(frames, num_samples, dirs), max_samples, dirs)
    place = ["state", "run_number", "run_dir", "experiment"]
    counts = kept.groupBy(*place).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("state").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*(F.col(c).alias(f"__{c}") for c in place), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = kept.withColumn("__rank", F.row_number().over(Window.partitionBy(*place).orderBy("frame")) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
    return ranked.join(start, same).withColumn("position", F.col("__start") + F.col("__rank")).select(*kept.columns, "position")


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def union_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def mapped_sources(sources: dict[str, DataFrame], class_map: dict[str, str], validation_fold: int = 0) -> DataFrame:
    """Rows of all sources with `source`, their class mapped by name (others go, a fixed few names) and `state` by fold.

    Sources hold label and fold; columns that some of them lack are null there.
    """
    rows = union_splits(*[d.withColumn("source", F.lit(name)) for name, d in sources.items()])
    named = F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv]) if class_map else F.create_map().cast("map<string,string>")
    state = F.when(F.col("fold") == validation_fold, "validation").otherwise("training")
    return rows.withColumn("label", F.element_at(named, F.col("label"))).where("label IS NOT NULL").withColumn("state", state)


def latest_by_id(samples: DataFrame, order: str) -> DataFrame:
    """Of rows with one sample id the last; other rows go."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc(order)))
    return samples.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


#: Runs that an error message names at most.
SHOWN = 10_000


def require_runs(available: DataFrame, desired: list[int]) -> DataFrame:
    """The wanted runs; a missing one is an error that names desired, available and missing runs."""
    runs = available.select("run_number").where(F.col("run_number").isNotNull()).distinct()
    found = {r[0] for r in runs.where(F.col("run_number").isin(*desired)).collect()}  # no more than are wanted
    missing = sorted(set(desired) - found)
    if missing:
        have = [r[0] for r in runs.orderBy("run_number").limit(SHOWN + 1).collect()]
        more = " and more" if len(have) > SHOWN else ""
        raise ValueError(f"runs not found: desired {sorted(desired)}, available {have[:SHOWN]}{more}, missing {missing}")
    return available.where(F.col("run_number").isin(*desired))


def missing_runs(desired: DataFrame, available: DataFrame) -> DataFrame:
    return desired.select("run_number").distinct().join(available.select("run_number").distinct(), "run_number", "left_anti")
