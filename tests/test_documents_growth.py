"""Documents of many ranges: tasks are packed, records parsed once, and sections of many records written whole."""

import json
import re

from pyspark.sql import functions as F

from detframe.sources import coco, json_ranges


def test_ranges_share_tasks_and_records_are_parsed_once(spark, tmp_path):
    folder = str(tmp_path / "documents")
    images = spark.range(500).select(F.col("id").alias("image_id"), F.concat(F.lit('a "{b}" é/'), F.col("id").cast("string")).alias("path"), F.lit(9).alias("width"), F.lit(8).alias("height"))
    anns = spark.range(25_000).select((F.col("id") % 400).alias("image_id"), F.floor(F.col("id") / 400).alias("ann_pos"), (F.col("id") % 12).cast("int").alias("category_id"), F.array(*[F.lit(1.5)] * 4).alias("bbox"))
    coco.write_coco(images, anns, folder, 2)
    documents = [json.loads((tmp_path / "documents" / f"0000{k}.json").read_text()) for k in range(2)]
    assert sum(len(d["annotations"]) for d in documents) == 25_000 and sorted(i["id"] for d in documents for i in d["images"]) == list(range(500))
    split = 1 << 14
    ranges = json_ranges.plan(spark, f"{folder}/*.json", split)
    tasks = json_ranges.array_records(spark, ranges, "annotations").rdd.getNumPartitions()
    assert len(ranges) > 60 and tasks <= 4 * spark.sparkContext.defaultParallelism  # before: a task for each
    i, a = coco.read_coco_ranges(spark, f"{folder}/*.json", split)
    few = a.where("category_id = 5 AND image_id > 3")
    assert len(re.findall("from_json", few._jdf.queryExecution().optimizedPlan().toString())) == 1  # before: in the filter, too
    assert few.count() == anns.where("category_id = 5 AND image_id > 3").count()
    assert a.groupBy("image_id").agg(F.sum("category_id").alias("s")).exceptAll(anns.groupBy("image_id").agg(F.sum("category_id").alias("s"))).isEmpty()
    assert i.drop("image_pos").exceptAll(images).isEmpty() and i.count() == 500
