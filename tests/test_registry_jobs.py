import pytest

from detframe import jobs, registry
from detframe.operators import gt, losses
from detframe.sources import project


def test_registry():
    assert {e.name for e in registry.entries("metric")} >= {"precision", "recall", "f1", "iou", "accuracy"}
    assert registry.get("metric", "fp").direction == "Downward" and len(registry.entries()) >= 17
    with pytest.raises(ValueError):
        registry.register("other", "x", len)
    with pytest.raises(ValueError):
        registry.register("metric", "x", len, "Sideways")


def test_encoders_and_loss_metrics(spark):
    s = spark.createDataFrame([(1,), (2,)], "sample_id long")
    g = spark.createDataFrame([(1, 0, 3, 0.5, 0.25, 0.5, 0.125)], "sample_id long, gt_idx int, cls int, cx double, cy double, w double, h double")
    view = lambda name: {r[0]: r[1] for r in registry.get("encoder", name).function(s, g, max_gt=2).collect()}
    assert view("gt_boxes") == {1: [[0.5, 0.25, 0.5, 0.125], [0.0] * 4], 2: [[0.0] * 4] * 2}
    assert view("gt_labels") == {1: [3, -1], 2: [-1, -1]} and view("gt_valid_mask") == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    assert view("classes")[1][1] == [-1.0] * 5
    assert {registry.get("metric", n).direction for n in ("loss_vfl", "loss_bbox", "loss_giou", "total")} == {"Downward"}
    assert registry.get("encoder", "image") and registry.get("visualizer", "image") and registry.get("source", "all_splits")


def test_project_file_to_criterion(tmp_path):
    (tmp_path / "p.yaml").write_text("max_num_of_objects: 7\nmax_samples:\nsplit: {train_subsets: [a], val_subsets: [b, c]}\ncategories: [{coco_id: 4, name: box, idx: 0}]\nsynth_data: {additional: false}\nloss: {gamma: 3, weight_dict: {loss_bbox: 4}, matcher: {cost_giou: 1.5, alpha: 0.5}}\n")
    p = project.load_project(str(tmp_path / "p.yaml"))
    assert (p.max_gt, p.max_samples, p.train_subsets, p.val_subsets, p.categories, p.synth) == (7, None, ("a",), ("b", "c"), ((4, "box", 0),), {"additional": False})
    options, matcher = losses.settings(p.loss)
    assert options == {"weights": {"loss_vfl": 1.0, "loss_bbox": 4.0, "loss_giou": 2.0}, "alpha": 0.75, "gamma": 3.0}
    assert matcher == {"alpha": 0.5, "gamma": 2.0, "costs": (2.0, 5.0, 1.5)}
    assert losses.settings(None)[0]["weights"] == losses.WEIGHTS


def test_jobs(tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "base.yaml").write_text("run: {num_frames: 5, distractors: warehouse}\ncamera: {fov_min: 60}\n")
    (tmp_path / "base/b.yaml").write_text("extends: ../base.yaml\ncamera: {fov_min: null}\n")
    (tmp_path / "base/a.yaml").write_text("run: {num_frames: 1}\n")
    got = jobs.folder_jobs(str(tmp_path / "base"))
    assert [(j.name, j.frames) for j in got] == [("a", 1), ("b", 5)] and got[1].config["camera"] == {"fov_min": None}
    assert [j.frames for j in jobs.folder_jobs(str(tmp_path / "base"), 7)] == [7, 7]
    with pytest.raises(FileNotFoundError):
        jobs.folder_jobs(str(tmp_path / "none"))
    assert [(j.name, j.frames) for j in jobs.standard_jobs({})] == [("warehouse", 2000), ("additional", 2000), ("None", 1000)]


def test_sized_boxes(spark):
    d = spark.createDataFrame([(20.0, 20.0), (19.0, 30.0), (30.0, 10_000.0)], "w double, h double")
    assert gt.sized_boxes(d).count() == 1
