import math

import pytest
from pyspark.sql import functions as F

from detframe import jobs
from detframe.operators import configs, gt, preds, randomize, samples

OBJECTS = "run int, frame int, object int, asset string"


def test_modes_of_a_configuration(spark):
    rows = {
        "tilt": '{"camera": {"camera_tilt_min": -80, "focal_length_min": 18, "focal_length_max": 50, "fov_min": 60, "fov_max": 90}, "run": {"distractors": "warehouse"}, "distractors_warehouse": {"assets": ["/b", "/a", "/b"]}}',
        "fov": '{"camera": {"camera_tilt_min": null, "fov_min": 60, "fov_max": 90, "horizontal_aperture": 10}, "run": {"distractors": "additional"}}',
        "none": '{"run": {"distractors": "None"}, "distractors_warehouse": {"assets": ["/a"]}}',
        "empty": "{}",
        "zero": '{"camera": {"fov_min": 60, "fov_max": 90, "horizontal_aperture": 0}}',
    }
    d = spark.createDataFrame(list(rows.items()), "name string, text string").select("name", F.parse_json("text").alias("config"))
    got = {r.name: (r.aim, r.focal_min, r.focal_max, r.distractor_pool) for r in randomize.generation_modes(d, "/root").drop("config").collect()}
    assert got["tilt"] == ("tilt", 18.0, 50.0, ["/root/b", "/root/a", "/root/b"])
    assert got["fov"][0] == "look_at" and got["fov"][1:3] == pytest.approx((10 / (2 * math.tan(math.pi / 4)), 10 / (2 * math.tan(math.pi / 6)))) and got["fov"][3] == []
    assert got["none"] == got["empty"] == ("look_at", None, None, [])
    assert got["zero"][1] == pytest.approx(20.955 / 2)


def test_object_and_distractor_draws(spark):
    o = spark.range(600).select((F.col("id") % 2).cast("int").alias("run"), F.col("id").cast("int").alias("frame"), F.lit(1).alias("object"), F.when(F.col("id") < 500, "a").otherwise("None").alias("asset"))
    placed, other = randomize.object_draws(o).collect(), randomize.distractor_draws(o).collect()
    assert len(placed) == len(other) == 500
    assert all(r.scale == [0.01] * 3 and len(r.color) == 3 and 0 <= r.rotation[2] < 360 and r.rotation[:2] == [0.0, 0.0] for r in placed)
    assert all(len(set(r.scale)) == 1 and 1 <= r.scale[0] < 1.5 and -6 <= r.position[1] < 12 for r in other)
    assert len({r.scale[0] for r in other}) == 500 and {r.frame: r.position for r in placed} != {r.frame: r.position for r in other}
    assert sorted(map(str, other)) == sorted(map(str, randomize.distractor_draws(o.repartition(7)).collect()))
    assert randomize.object_draws(spark.createDataFrame([], OBJECTS)).count() == 0


def test_materials(spark):
    f = spark.range(900).select((F.col("id") % 3).alias("run"), F.col("id").alias("frame"))
    m = randomize.material_draws(f, ["a", "b", "b"]).collect()
    assert len(m) == 1800 and {r.surface for r in m} == {"floor", "wall"} and {r.metallic for r in m} == {0, 1}
    assert all(0 <= r.roughness < 1 and 0 <= r.emissive_intensity < 1000 for r in m)
    for part in ("texture", "emissive_texture"):
        assert abs(sum(r[part] == "b" for r in m) / 1800 - 2 / 3) < 0.05
    by = {(r.frame, r.surface): r.roughness for r in m}
    assert sum(by[i, "floor"] == by[i, "wall"] for i in range(900)) == 0
    assert randomize.material_draws(f, []).where("texture IS NULL AND emissive_texture IS NULL").count() == 1800


def test_overrides(spark):
    d = spark.createDataFrame([('{"a": {"b": 1, "c": [1]}}', '{"a": {"c": null}}'), ('{"a": 1}', None)], "c string, o string")
    assert [r[0] for r in d.select(configs.with_overrides(F.col("c"), F.col("o"))).collect()] == ['{"a": {"b": 1, "c": null}}', '{"a": 1}']


def test_trial_paths(tmp_path):
    (tmp_path / "exp").mkdir()
    base = str(tmp_path / "base.yaml")
    with pytest.raises(ValueError, match="0 "):
        jobs.trial_paths(str(tmp_path / "exp"), base)
    (tmp_path / "exp/a.csv").write_text("x\n")
    got = jobs.trial_paths(str(tmp_path / "exp"), base)
    assert (got.csv, got.out_dir, got.extends) == (tmp_path / "exp/a.csv", tmp_path / "exp", "../base.yaml")
    (tmp_path / "exp/b.csv").write_text("x\n")
    with pytest.raises(ValueError, match="2 "):
        jobs.trial_paths(str(tmp_path / "exp"), base)
    got = jobs.trial_paths(str(tmp_path / "exp"), base, csv=str(tmp_path / "exp/b.csv"), out_dir=str(tmp_path / "new/deep"))
    assert got.csv.name == "b.csv" and got.out_dir.is_dir() and got.extends == "../../base.yaml"


def test_sources_with_a_class_map(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, "y", 1), (3, None, 0)], "sample_id int, label string, fold int")
    b = spark.createDataFrame([(4, "z", None, 7)], "sample_id int, label string, fold int, extra int")
    got = samples.mapped_sources({"a": a, "b": b, "c": a.limit(0)}, {"x": "pallet", "z": "pallet"}).collect()
    assert {(r.sample_id, r.source, r.label, r.state, r.extra) for r in got} == {(1, "a", "pallet", "validation", None), (4, "b", "pallet", "training", 7)}
    assert samples.mapped_sources({"a": a}, {}).count() == 0


def test_valid_targets(spark):
    box = [0.5, 0.25, 0.5, 0.125]
    d = spark.createDataFrame([(1, [box, [0.0] * 4, box], [3, -1, 1], [1.0, 0.5, 0.75]), (2, [[0.0] * 4], [-1], [0.0])], "sample_id int, gt_boxes array<array<double>>, gt_labels array<int>, gt_mask array<double>")
    assert [tuple(r) for r in gt.valid_targets(d).orderBy("gt_idx").collect()] == [(1, 0, 3, *box), (1, 1, 1, *box)]


def test_output_arrays_and_batches(spark):
    nested = spark.createDataFrame([(1, [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]], [0.5, 0.25], [2.0, 0.0]), (2, [], [], []), (3, None, None, None)], "sample_id int, boxes array<array<double>>, scores array<double>, labels array<double>")
    assert [tuple(r) for r in preds.from_arrays(nested).orderBy("query_idx").collect()] == [(1, 0, 2, 1.0, 2.0, 3.0, 4.0, 0.5), (1, 1, 0, 5.0, 6.0, 7.0, 8.0, 0.25)]
    alone = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [0.5], [2.0]), (2, [], [], [])], "sample_id int, boxes array<double>, scores array<double>, labels array<double>")
    assert [tuple(r) for r in preds.from_arrays(alone).collect()] == [(1, 0, 2, 1.0, 2.0, 3.0, 4.0, 0.5)]
    row = lambda s: [1.0, 2.0, 3.0, 4.0, s, 1.0]
    batches = spark.createDataFrame([([7, 8, 9], [[row(0.5), row(0.25)], [], [row(0.75)]])], "sample_ids array<int>, packed array<array<array<double>>>")
    assert [(r.sample_id, r.pred_idx, r.label, r.score) for r in preds.unpacked(batches).orderBy("sample_id", "pred_idx").collect()] == [(7, 0, 1, 0.5), (7, 1, 1, 0.25), (9, 0, 1, 0.75)]
