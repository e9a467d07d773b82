"""Frames from a stream in any order, against the batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from detframe.streaming import assembly

START = datetime.datetime(2024, 1, 1)


def made_events(seed):
    r = random.Random(seed)
    at = lambda: START + datetime.timedelta(seconds=r.randrange(600))
    rows = []
    for run, n in (("palletjack_run_1", 70), ("palletjack_run_2", 3)):
        for e in ("a", "b"):
            rows += [(run, e, f, at(), '{"run": {"num_frames": %d}}' % n, None, None, None, None, None, None) for f in range(n)]
            for f in range(0, n + 2, 2):  # the last ones are of no frame
                rows += [(run, e, f, at(), None, k, 11, f + 0.5, 1.0, 2.0, 3.0) for k in range(r.randrange(4))]
    rows += [(*x[:3], at(), *x[4:7], -1.0, *x[8:]) for x in r.sample(rows, 20) if x[4] is None]  # newer or older versions of labels
    return rows


def key(rows):
    return sorted((r.run_dir, r.experiment, r.frame, r.config, [tuple(a) for a in r.annotations]) for r in rows)


@pytest.mark.parametrize("seed,files", [(1, 1), (2, 3), (3, 6)])
def test_any_order_of_arrival_equals_the_batch(spark, tmp_path, seed, files):
    rows = made_events(seed)
    random.Random(seed).shuffle(rows)
    folder = str(tmp_path / "in")
    for i in range(files):
        spark.createDataFrame(rows[i::files], assembly.EVENT).coalesce(1).write.mode("append").parquet(folder)
    far = [("end", "", 0, START + datetime.timedelta(days=900), None, 0, 0, 0.0, 0.0, 0.0, 0.0)]
    spark.createDataFrame(far, assembly.EVENT).coalesce(1).write.mode("append").parquet(folder)
    late = [("palletjack_run_1", "a", 0, START, None, 99, 11, 9.0, 9.0, 9.0, 9.0)]
    expected = key(assembly.assembled_batch(spark.createDataFrame(rows, assembly.EVENT)).collect())
    assert len(expected) == 2 * (70 + 3) and any(x[4] for x in expected)

    def run():
        stream = spark.readStream.schema(assembly.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        q = assembly.assembled(stream, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    run()
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == expected
    # A label behind the watermark changes nothing, and only the far event has a state.
    spark.createDataFrame(late, assembly.EVENT).coalesce(1).write.mode("append").parquet(folder)
    q = run()
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == expected
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_events_of_configurations_and_labels(spark):
    configs = spark.createDataFrame([("palletjack_run_1", "e", '{"run": {"num_frames": 2}}', START)], "run_dir string, experiment string, config string, event_time timestamp")
    labels = spark.createDataFrame([("palletjack_run_1", "e", 1, 0, 11, 1.0, 2.0, 3.0, 4.0, START)], "run_dir string, experiment string, frame int, ann_pos long, category_id int, x double, y double, w double, h double, event_time timestamp")
    e = assembly.events(configs, labels)
    assert e.schema.simpleString() == spark.createDataFrame([], assembly.EVENT).schema.simpleString() and e.count() == 3
    got = key(assembly.assembled_batch(e).collect())
    assert [(f, a) for _, _, f, _, a in got] == [(0, []), (1, [(0, 11, 1.0, 2.0, 3.0, 4.0)])]
    assert assembly.assembled_batch(e.where(F.lit(False))).count() == 0
