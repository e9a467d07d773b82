"""Augmentation against loops; draws by range and repetition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.operators import augment

DRAWN = "sample_id long, epoch int, mirrored boolean, zoom double, dx double, dy double, hue double, saturation double, contrast double"


def test_draws(spark):
    s = spark.range(400).withColumnRenamed("id", "sample_id")
    rows = augment.draws(s, 3).collect()
    assert len(rows) == 1200 and rows == augment.draws(s.repartition(7), 3).orderBy("sample_id", "epoch").collect() or sorted(rows) == sorted(augment.draws(s.repartition(7), 3).collect())
    limits = {"zoom": (0.5, 1.5), "dx": (-8, 8), "dy": (-8, 8), "hue": (-25, 25), "saturation": (0.8, 1.2), "contrast": (0.9, 1.1)}
    for c, (low, high) in limits.items():
        values = [r[c] for r in rows]
        assert low <= min(values) < low + 0.05 * (high - low) and high - 0.05 * (high - low) < max(values) <= high and len(set(values)) > 1100
    assert 480 < sum(r.mirrored for r in rows) < 720
    assert len({(r.epoch, r.zoom) for r in rows if r.sample_id == 7}) == 3 and augment.draws(s, 0).count() == 0
    assert sorted(rows) != sorted(augment.draws(s, 3, seed=1).collect())


def test_boxes_equal_a_loop(spark):
    r = random.Random(1)
    drawn = [(i, e, r.random() < 0.5, r.uniform(0.5, 1.5), r.uniform(-8, 8), r.uniform(-8, 8), 0.0, 1.0, 1.0) for i in range(20) for e in range(2)]
    boxes = [(i, k, r.uniform(-20, 950), r.uniform(-20, 540), r.choice([0.0, 15.0, r.uniform(1, 400)]), r.uniform(1, 300)) for i in range(20) for k in range(6)]
    expected = {}
    for i, e, mirrored, zoom, dx, dy, *_ in drawn:
        for j, k, x, y, w, h in boxes:
            if i == j:
                corners = [(zoom * (px - 480) + 480 + dx, zoom * (py - 272) + 272 + dy) for px, py in ((x, y), (x + w, y + h))]
                xs, ys = sorted(960 - c[0] if mirrored else c[0] for c in corners), [c[1] for c in corners]
                x1, x2, y1, y2 = *(min(max(v, 0), 960) for v in xs), *(min(max(v, 0), 544) for v in ys)
                share = (x2 - x1) * (y2 - y1) / (zoom * zoom * w * h) if w * h else 0
                if x2 - x1 >= 20 and y2 - y1 >= 20 and share > 0.3:
                    expected[i, e, k] = (x1, y1, x2 - x1, y2 - y1, share)
    b = spark.createDataFrame(boxes, "sample_id long, k int, x double, y double, w double, h double")
    got = augment.augment_boxes(b, spark.createDataFrame(drawn, DRAWN), 960, 544, min_share=0.3)
    assert got.columns == ["sample_id", "k", "epoch", "x", "y", "w", "h", "share"]
    assert {(x.sample_id, x.epoch, x.k): pytest.approx((x.x, x.y, x.w, x.h, x.share)) for x in got.collect()} == expected and 20 < len(expected) < 200


def rotated(rgb, degrees):
    """Rodrigues' rotation about the grey axis."""
    k, t = np.ones(3) / math.sqrt(3), math.radians(degrees)
    return rgb * math.cos(t) + np.cross(k, rgb) * math.sin(t) + k * (k @ rgb) * (1 - math.cos(t))


def test_colours_equal_a_loop(spark):
    img = np.random.default_rng(1).integers(0, 256, (3, 4, 3), dtype=np.uint8)
    d = spark.createDataFrame([(1, bytearray(img.tobytes()), 3, 4, 3)], "sample_id long, data binary, height int, width int, channels int")
    cases = [(1, e, False, 1.0, 0.0, 0.0, *x) for e, x in enumerate([(0.0, 1.0, 1.0), (120.0, 1.0, 1.0), (17.0, 0.8, 1.1), (-25.0, 1.2, 0.9), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)])]
    got = {x.epoch: np.frombuffer(x.data, np.uint8).reshape(3, 4, 3) for x in augment.augment_images(d, spark.createDataFrame(cases, DRAWN)).collect()}
    for _, e, *_, hue, saturation, contrast in cases:
        for i in range(3):
            for j in range(4):
                rgb = rotated(img[i, j, ::-1] / 255, hue)
                grey = 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]
                rgb = (grey + saturation * (rgb - grey) - 0.5) * contrast + 0.5
                want = np.clip(rgb, 0, 1) * 255
                assert (abs(got[e][i, j, ::-1] - want) <= 0.5 + 1e-6).all()
    assert (got[0] == img).all() and (got[4][..., 0] == got[4][..., 1]).all() and (got[5] == 128).all()
    assert augment.augment_images(d, spark.createDataFrame([], DRAWN)).count() == 0


def test_empty_boxes(spark):
    b = spark.createDataFrame([], "sample_id long, x double, y double, w double, h double")
    assert augment.augment_boxes(b, augment.draws(spark.range(3).withColumnRenamed("id", "sample_id"), 2), 960, 544).count() == 0
    assert augment.augment_boxes(b.select("*", F.lit(1).alias("k")), spark.createDataFrame([], DRAWN), 960, 544).count() == 0
