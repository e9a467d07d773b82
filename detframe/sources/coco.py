"""Annotation documents: one JSON object with images, annotations and categories."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .json_ranges import SPLIT_BYTES, array_records, plan
from .staged import StagedWriter, inside

#: Only what is read; other keys are skipped by the parser.
SCHEMA = "images array<struct<id:bigint,path:string,width:int,height:int>>, annotations array<struct<image_id:bigint,category_id:int,bbox:array<double>>>"


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """images(image_id, image_pos, path, width, height) and annotations(image_id, ann_pos, category_id, bbox).

    ann_pos keeps the file's order. One task parses a whole document; read_coco_ranges splits it.
    """
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    images = doc.select(F.posexplode("images").alias("image_pos", "i")).select(F.col("i.id").alias("image_id"), "image_pos", "i.path", "i.width", "i.height")
    anns = doc.select(F.posexplode("annotations").alias("ann_pos", "a")).select("a.image_id", "ann_pos", "a.category_id", "a.bbox")
    return images, anns


def read_coco_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """What read_coco gives, each document read in ranges of split_bytes, which share tasks while small; several documents by a pattern."""
    ranges = plan(spark, path, split_bytes)
    image, ann = (t.removeprefix(f"{n} array<")[:-1] for n, t in zip(("images", "annotations"), SCHEMA.split(", "), strict=True))
    # A generator, as Spark moves what filters a field later on below a projection: records would be parsed for it once more.
    parsed = lambda name, kind, pos: array_records(spark, ranges, name).select(F.col("pos").alias(pos), F.inline(F.array(F.from_json("record", kind))))
    i, a = parsed("images", image, "image_pos"), parsed("annotations", ann, "ann_pos")
    return i.select(F.col("id").alias("image_id"), "image_pos", "path", "width", "height"), a.select("image_id", "ann_pos", "category_id", "bbox")


class DocumentWriter(StagedWriter):
    """Rows (file, section, record), sorted by file and section: one document a file, written as rows come."""

    def stage(self, iterator, fs, folder):
        path = section = out = None
        files, done = 0, []

        def close() -> None:
            if out:
                rest = "".join(f', "{s}": []' for s in SECTIONS if s not in done)
                out.write(f"]{rest}}}".encode())
                out.close()

        for batch in iterator:
            files_, sections, records = batch.columns
            n = batch.num_rows
            if not n:
                continue
            other = reduce(pc.or_, [pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (files_, sections)])
            starts = [0, *(i + 1 for i in np.flatnonzero(other.to_numpy(zero_copy_only=False)).tolist())]
            for start, end in zip(starts, [*starts[1:], n], strict=True):
                file, of = files_[start].as_py(), sections[start].as_py()
                if file != path:
                    close()
                    path, section, files = file, None, files + 1
                    out, done = fs.open_output_stream(f"{folder}/{inside(file)}"), []
                if of != section:
                    out.write(f'{"], " if done else "{"}"{of}": ['.encode())
                    section = of
                    done.append(of)
                else:
                    out.write(b",\n")
                run = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), records.slice(start, end - start).cast(pa.string()))
                out.write(pc.binary_join(run, ",\n")[0].as_buffer())
        close()
        return files


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotation_documents"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


SECTIONS = ("annotations", "images")


def write_coco(images: DataFrame, annotations: DataFrame, folder: str, documents: int = 1) -> None:
    """images(image_id, path, width, height) and annotations(image_id, ann_pos, category_id, bbox) as <n>.json.

    An image and its annotations, in order of image_id and ann_pos, go to one document, by a hash of the id. Each document is streamed by
    one task; all appear when the job has ended well.
    """
    spark = images.sparkSession
    spark.dataSource.register(Documents)
    document = F.pmod(F.xxhash64("image_id"), F.lit(documents)).alias("document")
    record = lambda at, place, *fields: (document, F.lit(place).alias("place"), "image_id", at.cast("long").alias("at"), F.to_json(F.struct(*fields)).alias("record"))
    a = annotations.select(*record(F.col("ann_pos"), 0, "image_id", "category_id", "bbox"))
    i = images.select(*record(F.lit(0), 1, F.col("image_id").alias("id"), "path", "width", "height"))
    tasks = min(documents, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Numbers are dealt out evenly and sorted; names follow.
    rows = i.unionByName(a).repartitionById(tasks, (F.col("document") % tasks).cast("int")).sortWithinPartitions("document", "place", "image_id", "at")
    rows = rows.select(F.format_string("%05d.json", "document").alias("file"), F.get(F.array(*map(F.lit, SECTIONS)), "place").alias("section"), "record")
    rows.select("file", "section", "record").write.format("annotation_documents").mode("append").option("path", folder).save()


def land(images: DataFrame, annotations: DataFrame, folder: str) -> None:
    images.write.mode("overwrite").parquet(f"{folder}/images")
    annotations.write.mode("overwrite").parquet(f"{folder}/annotations")


def box_columns(annotations: DataFrame) -> DataFrame:
    return annotations.select("*", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")])
