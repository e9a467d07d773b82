"""Files in and out: annotation documents, run folders, labels, trials, configurations, streams."""

import datetime
import json
import pathlib

import pytest
import yaml
from pyspark.sql import functions as F

from detframe.operators import configs, gt, images, randomize, samples
from detframe.sources import coco, kitti, project, trials
from detframe.streaming import frames


def test_coco(spark, tmp_path):
    doc = {"info": {"x": 1}, "images": [{"id": 2, "path": "/dataset/subset-1/a.jpg", "width": 960, "height": 544}, {"id": 1, "path": "///x/subset-9/b.jpg", "width": 1, "height": 1}, {"id": 3, "path": "b.jpg", "width": 1, "height": 1}], "annotations": [{"image_id": 2, "category_id": 7, "bbox": [1, 2, 3, 4], "iscrowd": 0}, {"image_id": 2, "category_id": 3, "bbox": [1.5, 2, 3, 4]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    i, a = coco.read_coco(spark, str(tmp_path / "c.json"))
    coco.land(i, a, str(tmp_path / "landed"))
    a = spark.read.parquet(str(tmp_path / "landed/annotations"))
    assert [r.category_id for r in a.orderBy("ann_pos").collect()] == [7, 3]
    assert coco.box_columns(a).orderBy("ann_pos").first().x == 1.0
    both = {r.image_id: r for r in samples.images_with_annotations(i, a).collect()}
    assert len(both[2].anns) == 2 and both[1].anns == []
    routed = {r.image_id: (r.subset, r.state) for r in samples.routed(i).collect()}
    assert routed == {2: ("subset-1", "validation")}


@pytest.fixture
def runs(tmp_path):
    for run, n in ((2, 2), (10, 1), (3, 1)):
        d = tmp_path / f"palletjack_run_{run}" / "exp"
        (d / "Camera/object_detection").mkdir(parents=True)
        if run != 3:
            (d / "run_config.yaml").write_text(yaml.dump({"run": {"num_frames": n}, "camera": {"fov_min": None}}))
    (tmp_path / "palletjack_run_2/exp/Camera/object_detection/0.txt").write_text("PalletJack 0 0 0 1 2 5 8 0\npalletjack 0 0 0 1 2 3\nperson 0 0 0 1 2 5 8\n")
    return str(tmp_path)


def test_runs(spark, runs):
    f, a = kitti.read_synth(spark, runs)
    assert sorted(r.sample_id for r in f.collect()) == ["run10_exp_frame0", "run2_exp_frame0", "run2_exp_frame1"]
    assert [(r.sample_id, r.category_id, r.x, r.y, r.w, r.h) for r in a.collect()] == [("run2_exp_frame0", 11, 1.0, 2.0, 4.0, 6.0)]
    first = samples.ordered_synth(f, num_samples=1).first()  # text order puts run 10 first
    assert first.sample_id == "run10_exp_frame0"
    assert [r.run_number for r in samples.ordered_synth(f).orderBy("position").collect()] == [2, 2, 10]
    with pytest.raises(ValueError, match=r"desired \[2, 7\], available \[2, 3, 10\], missing \[7\]"):
        kitti.read_synth(spark, runs, [2, 7])
    assert kitti.read_synth(spark, runs, [3])[0].count() == 0 and kitti.read_synth(spark, runs, [])[0].count() == 0
    assert kitti.read_synth(spark, runs, [10])[0].count() == 1
    for empty in (kitti.read_synth(spark, None), kitti.read_synth(spark, runs, wanted=False), kitti.read_synth(spark, runs + "/absent"), kitti.read_synth(spark, runs + "/palletjack_run_3")):
        assert [d.count() for d in empty] == [0, 0] and empty[0].columns == f.columns and empty[1].columns == a.columns
    assert samples.capped(f, 0, ["frame"]).count() == 0 and samples.capped(f, None, ["frame"]).count() == 3


def test_runs_lie_over_the_base(spark, runs):
    base = {"run": {"num_frames": 9, "distractors": "None"}, "render": {"width": 320}, "camera": {"fov_min": 60}}
    (pathlib.Path(runs) / "palletjack_run_3/exp/run_config.yaml").write_text("{}")
    (pathlib.Path(runs) / "palletjack_run_2/exp/Camera/object_detection/0.txt").unlink()
    f, a = kitti.read_synth(spark, runs, base_config=base)
    rows = {r.sample_id: r for r in f.collect()}
    assert len(rows) == 2 + 1 + 9 and a.count() == 0  # no label file at all
    one = rows["run3_exp_frame8"]
    assert (one.image_id, one.width, one.height, one.subset, one.path) == (8, 320, 544, "synth", f"{runs}/palletjack_run_3/exp/Camera/rgb/8.png")
    assert json.loads(rows["run2_exp_frame0"].run_config)["camera"] == {"fov_min": None} and json.loads(one.run_config)["camera"] == {"fov_min": 60}


def test_labels_round_trip(spark, tmp_path):
    rows = [(r, "e", f, k, "palletjack", 1.0 + k, 2.0, 5.0 + k, 8.0 + f) for r in (1, 12) for f in (0, 3) for k in (0, 1, 10)]
    d = spark.createDataFrame(rows, "run_number int, experiment string, frame int, ann_pos int, name string, x1 double, y1 double, x2 double, y2 double")
    kitti.write_labels(d.withColumn("line", kitti.label_line(*[F.col(c) for c in ("name", "x1", "y1", "x2", "y2")])), f"file://{tmp_path}/o")
    for run in (1, 12):
        (tmp_path / f"o/palletjack_run_{run}/e/run_config.yaml").write_text("run: {num_frames: 4}\n")
    back = sorted((r.run_dir, r.frame, r.x, r.w, r.h) for r in kitti.read_labels(spark, f"{tmp_path}/o").collect())
    assert back == sorted((f"palletjack_run_{r}", f, x1, x2 - x1, y2 - y1) for r, _, f, _, _, x1, y1, x2, y2 in rows)
    frame, anns = kitti.read_synth(spark, f"{tmp_path}/o")
    assert frame.count() == 8
    cats = spark.createDataFrame([(11, "pallet_truck", 4)], "category_id int, name string, idx int")
    g = gt.ground_truth(frame, anns, cats).where("sample_id = 'run12_e_frame3'").orderBy("gt_idx").collect()
    assert [(r.gt_idx, r.cls, round(r.cx * 960, 6), round(r.h * 544, 6)) for r in g] == [(i, 4, 3.0 + k, 9.0) for i, k in enumerate((0, 1, 10))]


def test_trials_and_configs(spark, tmp_path):
    p = configs.TRIAL_PREFIX
    row = {p + k: "1" for k in ("camera_height_min", "camera_height_max", "fov_min", "noise_std_min", "noise_std_max", "motion_blur_min", "motion_blur_max", "lighting_intensity_mean", "lighting_intensity_std", "materials_roughness_min", "palletjack_count_per_model")}
    row |= {p + "fov_max": "90.7", p + "materials_roughness_max": "0.12345", p + "distractors": "None"} | {p + f"texture_{i}": t for i, t in enumerate(["b", "a", "", "b", " a "] + [""] * 7, 1)}
    row = {"n_samples": "128"} | row | {"distribution_id": "dist_1"}
    (tmp_path / "t.csv").write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    c = configs.trial_configs(trials.read_trials(spark, str(tmp_path / "t.csv")), "../base.yaml")
    trials.write_configs(c, f"file://{tmp_path}/out")
    y = yaml.safe_load((tmp_path / "out/dist_1.yaml").read_text())
    assert list(y) == ["extends", "run", "camera", "lighting", "materials", "palletjacks"]
    assert y["run"] == {"num_frames": 128, "distractors": "None", "data_dir": "/placeholder"} and y["camera"]["fov_max"] == 90
    assert y["materials"] == {"roughness_min": 1.0, "roughness_max": 0.1235, "textures": [configs.TEXTURE_PREFIX + t for t in "ba"]}
    meta = trials.with_provenance(c, "f.yaml", None, "2024-01-01T00:00:00").first().config.meta
    assert meta.git_commit == "unavailable"


def test_deep_merge():
    base = {"a": {"x": 1, "y": [1, 2]}, "b": 1, "c": {"z": 1}}
    assert configs.merge_objects(base, {"a": {"y": [3], "x": None}, "c": 5, "d": {}}) == {"a": {"x": None, "y": [3]}, "b": 1, "c": 5, "d": {}}


def test_null_override_wins(spark):
    d = spark.createDataFrame([('{"a": {"k": 1, "l": 2}}', '{"a": {"k": null}}')], "b string, o string")
    b, o = F.parse_json("b"), F.parse_json("o")
    r = d.select(F.to_json(configs.merged_path(b, o, "$.a.k")).alias("k"), F.to_json(configs.merged_path(b, o, "$.a.l")).alias("l"), configs.deep_merge(F.col("b"), F.col("o")).alias("m")).first()
    assert r.k == "null" and r.l == "2" and json.loads(r.m) == {"a": {"k": None, "l": 2}}


def test_layers_give_the_columns_of_the_merged_configuration(spark):
    layers = ['{"camera": {"fov_min": 60, "fov_max": 90}, "materials": {"textures": ["/a.jpg"]}, "run": {"distractors": "None"}}', '{"camera": {"fov_min": null, "noise_std_min": 2}}', '{"materials": {"textures": ["/x/b.jpg", "/c.jpg"]}, "render": {"width": 5}}']
    d = spark.createDataFrame([("s", *layers, layers[0]), ("none", None, None, None, None), ("empty", "{}", None, "{}", "{}")], "sample_id string, a string, b string, c string, one string")
    merged = configs.deep_merge(configs.deep_merge(F.col("a"), F.col("b")), F.col("c"))
    d = d.withColumn("run_config", F.parse_json(merged)).withColumns({c: F.parse_json(c) for c in "abc"})
    d = d.withColumns({"run_number": F.lit(3), "experiment": F.lit("e"), "n_annotations": F.lit(2)})
    rows = [sorted(map(str, configs.synth_metadata(d, x).collect())) for x in (("run_config",), ("a", "b", "c"))]
    assert rows[0] == rows[1] and "b.jpg" in rows[0][2]


def test_sentinels(spark):
    d = spark.createDataFrame([("real", None), ("empty", "{}"), ("null", '{"camera": {"fov_min": null}, "run": {"distractors": "None"}}')], "sample_id string, c string")
    d = d.select("sample_id", F.parse_json("c").alias("run_config"), F.lit(None).cast("int").alias("run_number"), F.lit(None).cast("string").alias("experiment"), F.lit(2).alias("n_annotations"))
    m = {r.sample_id: r for r in configs.synth_metadata(d).collect()}
    assert len(m["real"]) == 52
    assert m["real"].synth_experiment == "" and m["real"].synth_num_objects != m["real"].synth_num_objects and m["empty"].synth_run_number != m["empty"].synth_run_number
    assert m["null"].synth_fov_min != m["null"].synth_fov_min and m["null"].synth_distractors == "None" and m["null"].synth_num_objects == 2 and m["null"].synth_jpeg_quality_min == 0
    assert {r.sample_id: r.t for r in d.select("sample_id", samples.data_type(F.col("run_config")).alias("t")).collect()} == {"real": "real", "empty": "synth", "null": "synth"}


def test_project_settings(tmp_path):
    (tmp_path / "p.yaml").write_text("max_gt: 5\ntrain_subsets: [a]\nother: 1\n")
    p = project.load_project(str(tmp_path / "p.yaml"))
    assert p.max_gt == 5 and p.train_subsets == ("a",) and project.load_yaml(str(tmp_path / "no.yaml")) == {}
    assert project.from_root("/r", "x") == "/r/x" and project.from_root("/r", "/x") == "/x"


def test_draws_repeat_and_stay_in_range(spark):
    f = spark.range(2000).select((F.col("id") % 3).alias("run"), F.col("id").alias("frame"))
    d = randomize.frame_draws(f, tilt=(-80.0, -30.0))
    r = d.agg(F.min("camera_z"), F.max("camera_z"), F.min("pitch"), F.max("pitch"), F.avg("intensity"), F.avg(F.col("visible").cast("int"))).first()
    assert 0.4 <= r[0] < r[1] < 4 and -80 <= r[2] < r[3] < -30 and abs(r[4] - 1e5) < 5e4 and 0.08 < r[5] < 0.21
    assert sorted(map(str, d.collect())) == sorted(map(str, randomize.frame_draws(f.repartition(7), tilt=(-80.0, -30.0)).collect()))
    assert randomize.run_draws(f.select("run").distinct()).where("jpeg_quality BETWEEN 95 AND 100").count() == 3
    o = randomize.object_draws(spark.createDataFrame([(1, 1, 1, "None"), (1, 1, 2, "a")], "run int, frame int, object int, asset string"))
    assert o.count() == 1
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    assert randomize.kept_classes(labels, ["a"]).count() == 1 and randomize.kept_classes(labels, []).count() == 2
    assert randomize.expanded(labels, 2).count() == 4 and randomize.expanded(labels, 0).count() == 0


def test_images(spark):
    import numpy as np

    flat = np.full((4, 6, 3), 100, np.uint8)
    rng = np.random.default_rng(1)
    noisy = rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    d = spark.createDataFrame([("flat", bytearray(flat.tobytes()), 4, 6, 3), ("noisy", bytearray(noisy.tobytes()), 4, 6, 3)], "sample_id string, data binary, height int, width int, channels int")
    s = {r.sample_id: r.sharpness for r in images.sharpness(d, 32).collect()}
    assert s["flat"] == pytest.approx(0, abs=1e-12) and s["noisy"] > 1
    t = np.frombuffer(images.image_tensors(d.where("sample_id = 'flat'"), 8).first().tensor, np.float32)
    assert t.shape == (192,) and np.allclose(t, 100 / 255)
    assert images.to_uint8(np.full((1, 3, 2, 2), 0.999, np.float32)).tolist() == np.full((2, 2, 3), 254).tolist()


def test_stream_drops_late_rows(spark, tmp_path):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "ts timestamp, run string, v double"
    spark.createDataFrame([(t(1), "a", 1.0), (t(1), "a", 2.0), (t(9), "a", 5.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = frames.windowed_counts(frames.stream_events(spark, str(tmp_path / "in"), schema), "ts", "run", "v")
    frames.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame([(t(2), "a", 7.0), (t(15), "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.window_start.hour, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 2, 3.0), (9, 1, 5.0)]


def test_order_runs_across_experiments(spark):
    from detframe.plans import catalog

    from .conftest import DATA

    events = {str(r.event_id): r for r in spark.read.parquet(f"{DATA}/events.parquet").collect()}
    got = [r.sample_id for r in catalog.QUERIES["synth_order_all"](spark, DATA).orderBy("position").collect()]
    key = lambda i: (events[i].user_id % 12, events[i].event_type, events[i].event_id)
    assert got == sorted(events, key=key) and len({events[i].event_type for i in got}) > 1
    f = spark.createDataFrame([("s", None, "r", "e", 2, "b"), ("s", None, "r", "e", 1, "a"), ("s", 1, "r", None, 1, "c"), ("t", 1, "r", "e", 1, "d")], "state string, run_number int, run_dir string, experiment string, frame int, sample_id string")
    assert {r.sample_id: r.position for r in samples.ordered_synth(f).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_wanted_runs_are_found_among_many(spark):
    many = spark.range(30_000).select(F.col("id").cast("int").alias("run_number"))
    wanted = list(range(0, 30_000, 1_500)) + [29_999]
    assert sorted(r[0] for r in samples.require_runs(many, wanted).collect()) == sorted(wanted)
    with pytest.raises(ValueError, match=r"missing \[30000\]"):
        samples.require_runs(many, [5, 30_000])
