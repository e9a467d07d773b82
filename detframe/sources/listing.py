"""Many small files: executors list folders, pack files by size, and read each pack in one task.

The driver knows the top folders only. A task lists one of them, walks the levels below it by their patterns, and puts
the files it finds into packs of about PACK_BYTES or PACK_FILES, whichever comes first; the table of paths is written
to the shared folder, and its packs are dealt to tasks.
"""

from __future__ import annotations

import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import listed, store, written

PACK_BYTES, PACK_FILES, BATCH_BYTES = 16 << 20, 5_000, 1 << 20


def _walk(fs, folder: str, levels: list[str]):
    """Files below a folder that fit the patterns, one a level, in text order."""
    import pyarrow.fs as pafs

    level, rest = levels[0], levels[1:]
    if rest and not any(c in level for c in "*?["):
        yield from _walk(fs, f"{folder}/{level}", rest)
        return
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    for f in sorted(found, key=lambda f: f.base_name):
        if not fnmatch.fnmatchcase(f.base_name, level):
            continue
        if rest and f.type == pafs.FileType.Directory:
            yield from _walk(fs, f.path, rest)
        elif not rest and f.is_file:
            yield f.path, f.size


def small_files(spark: SparkSession, folders: list[str], below: str) -> DataFrame:
    """folder, path (from the folder on), size, pack of the files below the folders (URIs) that a pattern of levels names."""
    schema = "folder string, path string, size long, pack int"
    if not folders:
        return spark.createDataFrame([], schema)

    def find(batches):
        for batch in batches:
            for folder in batch.column(1).to_pylist():
                fs, root = store(folder)
                paths, sizes, packs, pack, held, n = [], [], [], 0, 0, 0
                for path, size in _walk(fs, root, below.split("/")):
                    if n and (held + size > PACK_BYTES or n >= PACK_FILES):
                        pack, held, n = pack + 1, 0, 0
                    held, n = held + size, n + 1
                    paths.append(path[len(root) + 1 :])
                    sizes.append(size)
                    packs.append(pack)
                    if len(paths) == 10_000:
                        yield _rows(folder, paths, sizes, packs)
                        paths, sizes, packs = [], [], []
                yield _rows(folder, paths, sizes, packs)

    rows = spark.createDataFrame(list(enumerate(folders)), "task int, folder string")
    return written(rows.repartitionById(len(folders), F.col("task")).mapInArrow(find, schema), "listing")


def _rows(folder, paths, sizes, packs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([folder] * len(paths), pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(packs, pa.int32())], ["folder", "path", "size", "pack"])


def read_texts(files: DataFrame) -> DataFrame:
    """folder, path, value (the whole text) of small_files' rows; a pack is read by one task."""

    def read(batches):
        for batch in batches:
            out, held = [], 0
            for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = store(folder)
                with fs.open_input_stream(f"{root}/{path}") as f:
                    text = f.read().decode("utf-8", "replace")
                out.append((folder, path, text))
                held += len(text)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["folder", "path", "value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["folder", "path", "value"])

    # A number of its own: paths are small, and few tasks would take them all otherwise.
    packs = files.select("folder", "pack").distinct().count()
    return files.select("folder", "path", "pack").repartition(max(1, packs), "folder", "pack").select("folder", "path").mapInArrow(read, "folder string, path string, value string")


def texts_below(spark: SparkSession, pattern: str, below: str) -> DataFrame:
    """folder, path, value of all files below the folders that a pattern matches, in any store.

    Stores that executors reach through Spark alone are listed by the driver, as Spark's own readers do.
    """
    folders = [f for f, _ in listed(spark, pattern, folders=True)]
    if not folders:
        return spark.createDataFrame([], "folder string, path string, value string")
    try:
        store(folders[0])
    except (pa.ArrowInvalid, OSError):
        if not listed(spark, f"{pattern}/{below}"):
            return spark.createDataFrame([], "folder string, path string, value string")
        whole = spark.read.text(f"{pattern}/{below}", wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        depth = below.count("/") + 1
        return whole.select(F.regexp_extract("file", rf"^(.*)((?:/[^/]+){{{depth}}})$", 1).alias("folder"), F.regexp_extract("file", rf"((?:[^/]+/){{{depth - 1}}}[^/]+)$", 1).alias("path"), "value")
    return read_texts(small_files(spark, folders, below))


def lines(texts: DataFrame) -> DataFrame:
    """The other columns, line (its number in the file, 0-based) and value; an empty last line is none."""
    d = texts.withColumn("value", F.regexp_replace("value", r"\r\n?", "\n"))
    return d.select(*[c for c in texts.columns if c != "value"], F.posexplode(F.split("value", "\n")).alias("line", "value")).where("value <> ''")
