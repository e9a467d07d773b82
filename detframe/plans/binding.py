"""Detection tables derived from the driver's tables by fixed arithmetic, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid
from ..operators.gt import ground_truth
from ..operators.preds import top_predictions
from ..operators.samples import categories

WIDTH, HEIGHT = 960, 544


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))
    sub = F.concat(F.lit("subset-"), (F.col("sample_id") % 6).cast("string"))
    return o.select("sample_id", F.concat(F.lit("//dataset/"), sub, F.lit("/"), F.col("sample_id").cast("string"), F.lit(".jpg")).alias("path"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def annotations(spark, d) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    li = li.withColumn("ann_pos", pos)
    return li.select(
        F.col("l_orderkey").alias("sample_id"), "ann_pos", (F.col("l_partkey") % 12).cast("int").alias("category_id"),
        (F.col("l_partkey") % 37 * 16).cast("double").alias("x"), (F.col("l_suppkey") % 23 * 20).cast("double").alias("y"), (F.col("l_quantity") + 16.0).alias("w"), (F.col("l_quantity") + 24.0).alias("h"),
        (F.col("l_suppkey") % 5).cast("int").alias("label"), (F.col("l_discount") * 100).alias("dx"), (F.col("l_tax") * 100).alias("dy"),
        ((F.col("l_partkey") * 7919 + F.col("ann_pos") * 104729) % 1000 / 1000.0).alias("score"),
    )


def predictions(spark, d) -> DataFrame:
    a = annotations(spark, d)
    sx, sy = F.lit(640.0) / WIDTH, F.lit(640.0) / HEIGHT
    x1, y1 = (F.col("x") + F.col("dx")) * sx, (F.col("y") + F.col("dy")) * sy
    return a.select("sample_id", F.col("ann_pos").alias("query_idx"), "label", x1.alias("x1"), y1.alias("y1"), (x1 + F.col("w") * sx).alias("x2"), (y1 + F.col("h") * sy).alias("y2"), "score")


def gt(spark, d) -> DataFrame:
    return ground_truth(samples(spark, d), annotations(spark, d), categories(spark))


def top(spark, d) -> DataFrame:
    return top_predictions(predictions(spark, d))


def queries(spark, d) -> DataFrame:
    """Seven queries a vector: five logits and a box through the sigmoid."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding")
    q = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("query_idx"))
    at = lambda k: F.get("embedding", F.col("query_idx") * 9 + k).cast("double")
    return q.select("sample_id", "query_idx", F.array(*[at(k) for k in range(5)]).alias("logits"), *[sigmoid(at(5 + i)).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])


def vector_gt(spark, d) -> DataFrame:
    """One or two boxes a vector, by its label."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("k"))
    g = e.select("*", F.explode(F.sequence(F.lit(0), F.col("k") % 2)).alias("gt_idx"))
    k, j = F.col("k"), F.col("gt_idx")
    return g.select("sample_id", "gt_idx", ((k + j) % 5).cast("int").alias("cls"), ((k + 1 + 3 * j) / 14.0).alias("cx"), ((k * 3 % 10 + 1) / 12.0).alias("cy"), (k * 0.02 + 0.1).alias("w"), (k * 0.01 + j * 0.05 + 0.15).alias("h"))


#: The configuration below the overrides in the events table.
BASE_CONFIG = '{"run": {"num_frames": 3, "distractors": "None"}, "render": {"width": 960, "height": 544}, "camera": {"fov_min": 60, "fov_max": 90, "noise_std_min": 2.0}, "k": -1}'


def overrides(spark, d) -> DataFrame:
    """event_id, run_number, experiment and an override JSON that holds the event's own k."""
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"run": {"num_frames": '), (F.col("event_id") % 4).cast("string"), F.lit('}, "camera": {"fov_min": '), (F.col("event_id") % 50 + 40).cast("string"), F.lit('}, "k": '), k, F.lit("}"))
    return e.select("event_id", (F.col("user_id") % 5).cast("int").alias("run_number"), F.col("event_type").alias("experiment"), text.alias("override"))


def trials(spark, d) -> DataFrame:
    """Trial rows from parts: numbers as text, texture slots with blanks and repeats."""
    p = read(spark, d, "part")
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    from ..operators.configs import TRIAL_PREFIX

    size, price = F.col("p_size"), F.col("p_retailprice")
    cols = {
        "camera_height_min": (price % 7 / 3).cast("string"), "camera_height_max": (price % 7).cast("string"), "fov_min": (size + 40).cast("string"), "fov_max": F.concat((size + 60).cast("string"), F.lit(".9")),
        "noise_std_min": (size % 4).cast("string"), "noise_std_max": (size % 7).cast("string"), "motion_blur_min": (price % 1).cast("string"), "motion_blur_max": (price % 2).cast("string"),
        "lighting_intensity_mean": (size * 1000).cast("string"), "lighting_intensity_std": (size * 3000).cast("string"), "materials_roughness_min": F.lit("0.12345"), "materials_roughness_max": F.lit(" 1.0 "),
        "palletjack_count_per_model": F.lit("2"), "distractors": F.when(size % 3 == 0, "None").when(size % 3 == 1, " warehouse ").otherwise("additional"),
    }
    slots = {f"texture_{i + 1}": F.when(F.lit(i % 4 == 3), F.lit("")).otherwise(F.coalesce(word(i % 3), F.lit(""))) for i in range(12)}
    return p.select(F.concat(F.lit("dist_"), F.col("p_partkey").cast("string")).alias("distribution_id"), (size % 9 + 1).cast("string").alias("n_samples"), *[c.alias(TRIAL_PREFIX + n) for n, c in (cols | slots).items()])


def label_lines(spark, d) -> DataFrame:
    """KITTI lines, some too short and some of another class."""
    a = annotations(spark, d)
    from ..sources.kitti import label_line

    name = F.when(F.col("category_id") % 3 == 0, "PalletJack").when(F.col("category_id") % 3 == 1, "palletjack").otherwise("person")
    full = label_line(name, F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    short = F.concat_ws(" ", name, F.lit("0 0 0 1 2 3"))
    return a.select("sample_id", "ann_pos", F.when(F.col("ann_pos") % 5 == 0, short).otherwise(full).alias("value"))
