"""Operators without SQL against plain loops, and box functions against numbers."""

import random

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from detframe.functions import boxes
from detframe.operators import clustering, images
from detframe.operators import gt as gts


def overlap(a, b):
    iw, ih = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return iw * ih / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - iw * ih, 1e-6)


def clusters(rows, eps, least, min_height):
    """By transitive closure over pairs of cores."""
    out = []
    for label in {r[1] for r in rows}:
        g = sorted((r for r in rows if r[1] == label), key=lambda r: (-r[6], r[0]))
        near = {(i, j) for i in range(len(g)) for j in range(len(g)) if 1 - overlap(g[i][2:6], g[j][2:6]) <= eps}
        core = [i for i in range(len(g)) if sum(g[j][6] for j in range(len(g)) if (i, j) in near) >= least]
        group = {i: i for i in core}
        for _ in core:
            group = {i: min(group[j] for j in core if (i, j) in near) for i in core}
        for i in set(range(len(g))) - set(core):
            cores = [j for j in core if (i, j) in near]
            if cores:
                group[i] = group[min(cores, key=lambda j: (-g[j][6], j))]
        for c in set(group.values()):
            m = [g[i] for i in group if group[i] == c]
            s = sum(r[6] for r in m)
            box = [sum(r[k] * r[6] for r in m) / s for k in range(2, 6)]
            if box[3] - box[1] >= min_height:
                out.append((label, len(m), max(r[6] for r in m), *box))
    return sorted(tuple(round(float(x), 6) for x in r) for r in out)


@pytest.mark.parametrize("eps, least, min_height", [(0.15, 0.05, 0.0), (0.5, 1.2, 0.0), (0.7, 0.9, 30.0)])
def test_clusters_equal_a_closure(spark, eps, least, min_height):
    r = random.Random(5)
    rows = []
    for sample in range(12):
        for q in range(r.choice([0, 1, 5, 30])):
            x, y = r.choice([0, 40]) + r.uniform(0, 12), r.choice([0, 60]) + r.uniform(0, 12)
            rows.append((sample, q, r.randrange(2), x, y, x + r.uniform(20, 30), y + r.uniform(20, 40), r.choice([0.3, 0.5, r.random()])))
    rows += [(99, 1, 0, 0.0, 0.0, 9.0, 9.0, 0.5), (99, 2, 0, 0.0, 0.0, 9.0, 9.0, 0.5)]
    d = spark.createDataFrame(rows, "sample_id int, query_idx int, label int, x1 double, y1 double, x2 double, y2 double, score double")
    got = {}
    for c in clustering.cluster_boxes(d, eps, least, min_height).collect():
        got.setdefault(c.sample_id, []).append(tuple(round(float(x), 6) for x in (c.label, c.n, c.score, c.x1, c.y1, c.x2, c.y2)))
    for sample in {r[0] for r in rows}:
        assert sorted(got.get(sample, [])) == clusters([r[1:] for r in rows if r[0] == sample], eps, least, min_height)
    assert clustering.cluster_boxes(d.limit(0)).count() == 0


def bilinear(img, height, width):
    h, w = len(img), len(img[0])
    out = np.zeros((height, width, 3))
    for i in range(height):
        for j in range(width):
            y, x = min(max((i + 0.5) * h / height - 0.5, 0), h - 1), min(max((j + 0.5) * w / width - 0.5, 0), w - 1)
            for a, fy in ((int(y), 1 - y % 1), (min(int(y) + 1, h - 1), y % 1)):
                for b, fx in ((int(x), 1 - x % 1), (min(int(x) + 1, w - 1), x % 1)):
                    out[i, j] += fy * fx * img[a][b].astype(float)
    return out


@pytest.mark.parametrize("shape", [(4, 6, 3), (9, 5, 4), (1, 1, 3)])
def test_tensors_and_sharpness_equal_loops(spark, shape):
    img = np.random.default_rng(2).integers(0, 256, shape, dtype=np.uint8)
    d = spark.createDataFrame([("a", bytearray(img.tobytes()), *shape)], "sample_id string, data binary, height int, width int, channels int")
    rgb = bilinear(img[..., :3], 7, 7)[..., ::-1]
    got = np.frombuffer(images.image_tensors(d, 7, fixed=False).first().tensor, np.float32).reshape(3, 7, 7)
    assert np.allclose(got, rgb.transpose(2, 0, 1) / 255, atol=1e-6)
    grey = rgb @ [0.299, 0.587, 0.114]
    at = lambda i, j: grey[abs(i) if i < 7 else 12 - i, abs(j) if j < 7 else 12 - j]
    lap = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j) for i in range(7) for j in range(7)]
    assert images.sharpness(d, 7, fixed=False).first().sharpness == pytest.approx(np.var(lap), rel=1e-4, abs=1e-3)


def half_even(x):
    low = math.floor(x)
    return low + (x - low > 0.5 or (x - low == 0.5 and low % 2 == 1))


def bilinear_fixed(img, height, width):
    """Byte by byte, with integers, and single precision where weights are made."""
    h, w = len(img), len(img[0])
    one = np.float32(1)

    def taps(i, to, of, hold):
        at = np.float32((i + 0.5) * (of / to) - 0.5)
        low = math.floor(at)
        part = np.float32(at - np.float32(low))
        if hold and (low < 0 or low >= of - 1):
            part = np.float32(0)
        clip = lambda k: min(max(k, 0), of - 1)
        return (clip(low), half_even(float((one - part) * np.float32(2048)))), (clip(low + 1), half_even(float(part * np.float32(2048))))

    out = np.zeros((height, width, 3), np.uint8)
    for i in range(height):
        for j in range(width):
            for c in range(3):
                (y0, b0), (y1, b1) = taps(i, height, h, False)
                row = lambda y: sum(int(img[y][x][c]) * a for x, a in taps(j, width, w, True))  # noqa: E731, B023
                out[i, j, c] = min(max(((((row(y0) >> 4) * b0) >> 16) + (((row(y1) >> 4) * b1) >> 16) + 2) >> 2, 0), 255)
    return out


@pytest.mark.parametrize("shape", [(4, 6, 3), (9, 5, 4), (1, 1, 3), (7, 7, 3), (14, 21, 3)])
def test_fixed_point_images_equal_loops_bit_for_bit(spark, shape):
    img = np.random.default_rng(5).integers(0, 256, shape, dtype=np.uint8)
    d = spark.createDataFrame([("a", bytearray(img.tobytes()), *shape)], "sample_id string, data binary, height int, width int, channels int")
    sized = bilinear_fixed(img[..., :3], 7, 7)
    assert shape != (7, 7, 3) or (sized == img).all()
    got = np.frombuffer(images.image_tensors(d, 7).first().tensor, np.float32).reshape(3, 7, 7)
    assert (got == sized[..., ::-1].transpose(2, 0, 1).astype(np.float32) / np.float32(255)).all()
    grey = [[(9798 * int(p[2]) + 19235 * int(p[1]) + 3735 * int(p[0]) + 16384) >> 15 for p in line] for line in sized]
    at = lambda i, j: grey[abs(i) if i < 7 else 12 - i][abs(j) if j < 7 else 12 - j]
    lap = [at(i - 1, j) + at(i + 1, j) + at(i, j - 1) + at(i, j + 1) - 4 * at(i, j) for i in range(7) for j in range(7)]
    assert images.sharpness(d, 7).first().sharpness == pytest.approx(np.var(lap), rel=1e-12, abs=1e-9)
    assert abs(sized.astype(float) - bilinear(img[..., :3], 7, 7)).max() <= 1


def test_images_are_read_from_files(spark, tmp_path):
    pixels = np.random.default_rng(3).integers(0, 256, (2, 3, 3), dtype=np.uint8)
    rows = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 4) for p in pixels[::-1])  # a BMP: BGR, upside down, lines padded to four bytes
    head = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    head += (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + rows)
    r = images.read_images(spark, str(tmp_path)).first()
    assert (r.height, r.width, r.channels) == (2, 3, 3) and r.sample_id.endswith("a.bmp") and bytes(r.data) == pixels.tobytes()


def test_box_forms(spark):
    d = spark.createDataFrame([(1.0, 2.0, 4.0, 8.0)], "a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    one = lambda cols: list(d.select(*[x.alias(str(i)) for i, x in enumerate(cols)]).first())
    assert one(boxes.xyxy_to_cxcywh(*c)) == [2.5, 5.0, 3.0, 6.0] and one(boxes.kitti_to_xywh(*c)) == [1.0, 2.0, 3.0, 6.0]
    assert one(boxes.cxcywh_to_xyxy(*[x for x in boxes.xyxy_to_cxcywh(*c)])) == [1.0, 2.0, 4.0, 8.0]
    swapped = [c[2], c[1], c[0], c[3]]
    assert one([boxes.giou(c, c, check=True)]) == [1.0]
    with pytest.raises(Exception, match="corners"):
        one([boxes.giou(c, swapped, check=True)])


def test_tensors_leave_in_bounded_batches(spark, monkeypatch):
    d = spark.createDataFrame([(str(i), bytearray([i] * 12), 2, 2, 3) for i in range(50)], "sample_id string, data binary, height int, width int, channels int").coalesce(1)
    t = images.image_tensors(d, 128)
    expected = {str(i): np.full(3 * 128 * 128, i / np.float32(255), np.float32).tobytes() for i in range(50)}
    assert {r.sample_id: bytes(r.tensor) for r in t.collect()} == expected
    given = []
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, run, schema: given.append(run) or self)
    images.image_tensors(d, 128)
    monkeypatch.undo()
    batch = pa.RecordBatch.from_pydict({"sample_id": [str(i) for i in range(50)], "data": [bytes([i] * 12) for i in range(50)], "height": [2] * 50, "width": [2] * 50, "channels": [3] * 50})
    out = list(given[0](iter([batch])))
    assert len(out) > 1 and max(b.nbytes for b in out) <= images.BATCH_BYTES * 1.01 and sum(b.num_rows for b in out) == 50


def test_clusters_of_many_samples_at_once_equal_those_one_by_one():
    """Small and large classes, equal scores, borders; in groups of a class below and above the size that has a matrix."""
    r = random.Random(5)
    samples = []
    for i in range(300):
        at = [(r.uniform(0, 50), r.uniform(0, 50)) for _ in range(3)]
        rows = []
        for q in range(r.choice([1, 2, 4, 7, 8, 9, 40])):
            x, y = (c + r.choice([0, 0, r.uniform(-2, 2)]) for c in r.choice(at))
            rows.append({"query_idx": q, "label": r.randrange(1 + i % 4), "x1": x, "y1": y, "x2": x + r.choice([0, 20, 22]), "y2": y + r.choice([20, 25]), "score": r.choice([0.01, 0.02, 0.3, r.random()])})
        samples.append(r.sample(rows, len(rows)))
    flat = [(i, x) for i, rows in enumerate(samples) for x in rows]
    sample = np.array([i for i, _ in flat])
    for tall in (0.0, 22.0):
        got = clustering.clusters_of(sample, *(np.array([x[c] for _, x in flat]) for c in ("query_idx", "label")), np.array([[x[c] for c in ("x1", "y1", "x2", "y2")] for _, x in flat]), np.array([x["score"] for _, x in flat]), 0.15, 0.05, tall)
        assert sorted(zip(*(c.tolist() for c in got), strict=True)) == [(i, *c) for i, rows in enumerate(samples) for c in clustering.clusters(rows, 0.15, 0.05, tall)]


def test_clusters_of_no_rows(spark):
    d = spark.createDataFrame([], "sample_id long, query_idx int, label int, x1 double, y1 double, x2 double, y2 double, score double")
    assert clustering.cluster_boxes(d).count() == 0


def test_padding_runs_no_function_over_its_constants(spark):
    s = spark.range(3).withColumnRenamed("id", "sample_id")
    g = spark.createDataFrame([(0, 1, 2, 0.1, 0.2, 0.3, 0.4), (0, 0, 1, 0.5, 0.6, 0.7, 0.8), (2, 0, -3, 0.1, 0.1, 0.1, 0.1)], "sample_id long, gt_idx int, cls int, cx double, cy double, w double, h double")
    dense = gts.padded(s, g, 4)
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan[: plan.index("Join")]
    rows = {r.sample_id: r for r in dense.collect()}
    assert rows[0].gt_labels == [1, 2, -1, -1] and rows[0].gt_mask == [1, 1, 0, 0] and rows[0].gt_boxes[2:] == [[0.0] * 4] * 2 and rows[0].gt_padded[2:] == [[-1.0] * 5] * 2
    assert rows[1].gt_mask == [0] * 4 and rows[2].gt_labels == [-3, -1, -1, -1] and rows[2].gt_mask == [0] * 4 and rows[2].gt_boxes[0] == [0.0] * 4
    assert sorted((r.sample_id, r.gt_idx, r.cls) for r in gts.valid_targets(dense).collect()) == [(0, 0, 1), (0, 1, 2)]
