"""Files as executors see them: split documents, sinks with a commit, record shards, listings by tasks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from detframe.operators import randomize
from detframe.sources import coco, json_ranges, kitti, listing, records, staged

ODD = ['a"b', "\\", "{[", '}]"', '\\\\"', "é{", '\n,{"id":1}', "x", "\\\\\\"]


def document(r, n, m, indent=None):
    t = lambda: "".join(r.choice(ODD) for _ in range(r.randint(0, 4)))
    return json.dumps(
        {
            "info": {"d": t(), "images": [{"id": 5, "x": [{"id": 7}]}]}, "licenses": ["a", t()], "images": [{"id": i, "path": t(), "width": 1, "height": 2, "meta": {"annotations": [{"image_id": 4}]}} for i in range(n)],
            t(): t(), "categories": [], "annotations": [{"image_id": r.randrange(n + 1), "category_id": 3, "bbox": [1, 2.5, 3, 4], "seg": [[1, 2], [{"a": t()}]]} for _ in range(m)],
        },
        indent=indent, ensure_ascii=r.random() < 0.5,
    )


def all_rows(*tables):
    return [sorted((tuple(map(str, r)) for r in t.collect())) for t in tables]


@pytest.mark.parametrize("n,m,indent,split", [(3, 5, None, 97), (5, 9, 1, 251), (0, 0, None, 40), (1, 1, None, 10**6), (40, 90, 2, 1500)])
def test_split_documents_equal_whole_ones(spark, tmp_path, n, m, indent, split):
    (tmp_path / "a.json").write_text(document(random.Random(n), n, m, indent))
    assert all_rows(*coco.read_coco_ranges(spark, str(tmp_path / "a.json"), split)) == all_rows(*coco.read_coco(spark, str(tmp_path / "a.json")))


@pytest.mark.parametrize("block", [16, 61, 1 << 20])
def test_ranges_by_plain_functions(tmp_path, monkeypatch, block):
    """Every split and block size of one document, without Spark: borders in strings, escapes and keys."""
    monkeypatch.setattr(json_ranges, "BLOCK", block)
    text = document(random.Random(3), 3, 4).encode()
    path = str(tmp_path / "b.json")
    (tmp_path / "b.json").write_bytes(text)
    whole = json.loads(text)
    at = text.rindex(b'"annotations": [{"image_id"') + len(b'"annotations": ')
    for split in (1, 2, 3, 7, 50, 400, 10**5):
        inside = depth = 0
        got = []
        for r in json_ranges._ranges([(path, len(text))], split):
            s = json_ranges._summary(path, r["start"], r["end"])
            got += json_ranges._records(path, r["start"], r["end"], len(text), inside, depth, at, len(text))
            inside, depth = (inside + s["flips"]) % 2, depth + s["depth"][inside]
        assert [json.loads(g) for g in got] == whole["annotations"] and (inside, depth) == (0, 0)


def test_several_documents_and_many_tasks(spark, tmp_path):
    r = random.Random(9)
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(document(r, 5, 20))
    ranges = json_ranges.plan(spark, str(tmp_path / "*.json"), 400)
    a = json_ranges.array_records(spark, ranges, "annotations")
    assert a.rdd.getNumPartitions() > 8 and a.count() == 60
    assert {(os.path.basename(x.path), x.pos) for x in a.collect()} == {(f"{k}.json", p) for k in range(3) for p in range(20)}
    assert json_ranges.plan(spark, str(tmp_path / "absent*.json")) == [] and coco.read_coco_ranges(spark, str(tmp_path / "absent.json"))[0].count() == 0


# ---- sinks --------------------------------------------------------------------------------------------------------


def test_failed_tasks_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    d = spark.range(40, numPartitions=4)
    content = lambda fails: F.when((F.col("id") == 37) & F.lit(fails), F.raise_error(F.lit("killed midway")).cast("string")).otherwise("x")
    files = lambda fails: d.select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"), content(fails).alias("content"))
    with pytest.raises(Exception, match="killed midway"):
        staged.write_files(files(True), folder)
    assert [f for _, _, fs in os.walk(folder) for f in fs] == []
    staged.write_files(files(False), folder)
    assert sorted(os.listdir(folder)) == ["a"] and len(os.listdir(f"{folder}/a")) == 40


def test_one_file_from_two_tasks_and_paths_outside_are_errors(spark, tmp_path):
    twice = spark.range(2, numPartitions=2).select(F.lit("same").alias("path"), F.lit("x").alias("content"))
    with pytest.raises(Exception, match="two tasks wrote"):
        staged.write_files(twice, str(tmp_path / "o"))
    for path in ("../x", "/x", "", "a/../../x", "_staging-1/x"):
        with pytest.raises(ValueError):
            staged.inside(path)
    with pytest.raises(Exception, match="not a path below"):
        staged.write_files(twice.limit(1).withColumn("path", F.lit("../x")), str(tmp_path / "o"))
    assert not os.path.exists(tmp_path / "x") and [f for _, _, fs in os.walk(tmp_path / "o") for f in fs] == []


def test_files_are_replaced_and_bytes_kept(spark, tmp_path):
    for content in (b"\x00\xff", b""):
        d = spark.createDataFrame([("d/e/f.bin", content)], "path string, content binary")
        staged.write_files(d, f"file://{tmp_path}/b")
        assert (tmp_path / "b/d/e/f.bin").read_bytes() == content
    staged.write_files(d.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


# ---- record shards ------------------------------------------------------------------------------------------------


def crc_loop(data):
    s = 0xFFFFFFFF
    for b in data:
        s ^= b
        for _ in range(8):
            s = (s >> 1) ^ (0x82F63B78 if s & 1 else 0)
    return s ^ 0xFFFFFFFF


def test_checksums():
    r = random.Random(1)
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    blobs = [r.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 8, 63, 64, 65, 1000, 4097, 16384, 20_001)] + [b"\0" * 70, b"\xff" * 3]
    assert records.crc32c(blobs).tolist() == [crc_loop(b) for b in blobs]
    big = r.randbytes(300_000)
    assert records.crc32c([big, big[:-1], b"a"]).tolist() == [crc_loop(big), crc_loop(big[:-1]), crc_loop(b"a")]


def test_examples_round_trip():
    kinds = {"a": "bytes", "b": "int", "c": "float", "d": "int", "e": "bytes"}
    row = {"a": ["é", b"\xff"], "b": [-1, 0, 2**63 - 1, -(2**63), 300], "c": [1.5, -0.0], "d": [], "e": None}
    assert records.decode(records.encode(row, kinds)) == {"a": ["é".encode(), b"\xff"], "b": row["b"], "c": [1.5, -0.0], "d": []}
    # As a protocol-buffer library writes it: unpacked integers, an unknown field, another order.
    other = bytes.fromhex("0a0e0a0c" "0a0162" "1207" "1a05" "0805" "08ac02")
    assert records.decode(other)["b"] == [5, 300]


ROWS = "id long, name string, data binary, ok boolean, xs array<float>, words array<string>, n int"


@pytest.fixture
def shards(spark, tmp_path):
    rows = [(i, f"n{i}é" if i % 5 else None, bytes([i % 256] * (i % 90)), i % 2 == 0, [i / 2, -1.0][: i % 3], ["a", "b"][: i % 3] if i % 4 else None, -i) for i in range(500)]
    d = spark.createDataFrame(rows, ROWS)
    records.write_shards(randomize.hash_split(d, "id", percent=50), str(tmp_path / "s"), ["id"], 10)
    return d, tmp_path / "s"


def test_shards_round_trip(spark, shards):
    d, folder = shards
    names = sorted(os.listdir(folder))
    assert len(names) == 20 and names[0] == "training-shard-00000-of-00010" and names[-1] == "validation-shard-00009-of-00010"
    back = records.read_shards(spark, str(folder), ROWS)
    assert all_rows(back) == all_rows(d) and back.rdd.getNumPartitions() == 20
    assert all_rows(records.read_shards(spark, f"file://{folder}", "n int, absent string").select("n", "absent")) == all_rows(d.select("n", F.lit(None)))
    one = [records.decode(x)["id"][0] for part in records.checked(*_at(folder / names[0])) for x in part]
    assert one == sorted(one)  # in the wanted order
    assert records.read_shards(spark, str(folder.parent / "s"), ROWS).where("id < 0").count() == 0


def _at(path):
    from detframe.storage import store

    return store(str(path))


@pytest.mark.parametrize("where,flip,said", [(0, 1, "checksum of a length"), (7, 1, "checksum of a length"), (14, 64, "checksum of a record"), (-1, 1, "checksum of a record"), (-3, None, "torn record")])
def test_a_flipped_byte_is_found(spark, shards, where, flip, said):
    path = shards[1] / "training-shard-00003-of-00010"
    raw = bytearray(path.read_bytes())
    if flip:
        raw[where] ^= flip
    path.write_bytes(raw if flip else raw[:where])
    with pytest.raises(Exception, match=said):
        records.read_shards(spark, str(shards[1]), ROWS).collect()


# ---- listing ------------------------------------------------------------------------------------------------------


def test_tasks_list_and_pack(spark, tmp_path, monkeypatch):
    for run in (1, 2):
        for e in ("e1", "e2"):
            d = tmp_path / f"palletjack_run_{run}/{e}/{kitti.LABELS}"
            d.mkdir(parents=True)
            for f in range(30):
                (d / f"{f}.txt").write_text(f"palletjack 0 0 0 {f} 2 50 80\r\nperson 0 0 0 1 2 5 8\n\npalletjack 0 0 0 {run} 2 5 8")
            (d / "notes.md").write_text("palletjack 0 0 0 1 2 5 8")
    (tmp_path / "palletjack_run_3").mkdir()
    monkeypatch.setattr(listing, "PACK_FILES", 7)
    seen = []
    real = listing.listed
    monkeypatch.setattr(listing, "listed", lambda s, p, **k: seen.append(p) or real(s, p, **k))
    rows = kitti.read_labels(spark, str(tmp_path)).collect()
    assert seen == [f"{tmp_path}/palletjack_run_*"]  # the driver lists run folders and nothing below
    assert len(rows) == 2 * 2 * 30 * 2 and {r.ann_pos for r in rows} == {0, 3}
    assert {(r.frame, r.x) for r in rows if r.ann_pos == 0} == {(f, float(f)) for f in range(30)} and {r.x for r in rows if r.ann_pos == 3 and r.run_dir.endswith("2")} == {2.0}
    assert kitti.read_labels(spark, str(tmp_path)).rdd.getNumPartitions() == 2 * 9
    files = listing.small_files(spark, [f"{tmp_path}/palletjack_run_1"], f"*/{kitti.LABELS}/*.txt")
    assert files.groupBy("pack").count().where("count > 7").count() == 0 and files.count() == 60
    assert listing.small_files(spark, [], "*").count() == 0 == listing.texts_below(spark, f"{tmp_path}/nothing*", "*").count()


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    d = tmp_path / "palletjack_run_1/e"
    (d / kitti.LABELS).mkdir(parents=True)
    (d / kitti.LABELS / "4.txt").write_text("palletjack 0 0 0 1 2 5 8\n")
    (d / "run_config.yaml").write_text("run: {num_frames: 2}\n")
    plain = all_rows(kitti.read_labels(spark, str(tmp_path)), kitti.read_run_configs(spark, str(tmp_path)))

    def refused(path):
        raise OSError("no such store here")

    monkeypatch.setattr(listing, "store", refused)
    assert all_rows(kitti.read_labels(spark, str(tmp_path)), kitti.read_run_configs(spark, str(tmp_path))) == plain and len(plain[0]) == len(plain[1]) == 1
