"""Many frames share a state, whose configurations and labels keep their latest versions."""

import datetime
import random

from detframe.streaming import assembly

from .test_assembly import START, key


def test_many_frames_to_a_state(spark, tmp_path):
    r = random.Random(7)
    at = lambda: START + datetime.timedelta(seconds=r.randrange(3))
    rows = [("palletjack_run_1", "a", f, at(), '{"run": {"num_frames": 1500}, "v": "%s"}' % r.choice("cab"), *[None] * 6) for f in range(1500) for _ in range(2)]
    rows += [("palletjack_run_1", "a", f, at(), None, r.randrange(2), 11, float(r.randrange(3)), 1.0, 2.0, 3.0) for f in range(0, 1600, 2) for _ in range(3)]
    r.shuffle(rows)
    folder = str(tmp_path / "in")
    for part in (rows[::2], rows[1::2], [("end", "", 0, START + datetime.timedelta(days=900), None, 0, 0, 0.0, 0.0, 0.0, 0.0)]):
        spark.createDataFrame(part, assembly.EVENT).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(assembly.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    q = assembly.assembled(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    expected = key(assembly.assembled_batch(spark.createDataFrame(rows, assembly.EVENT)).collect())
    assert key(spark.read.parquet(str(tmp_path / "out")).collect()) == expected and len(expected) == 1500
    # Two blocks of frames and the end; a state for every 64 frames made Spark's cost of a group the whole job's.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 3
