"""Frames put together from a stream of configurations and labels that arrive in any order.

Events are rows of one kind: a frame (with its experiment's configuration) or a label line of a frame. A block of frames
of one experiment shares a state: its frames' configurations and labels so far, of each label the latest version. An
event-time timer per block fires when the watermark has passed the block's latest event by `wait`; then each frame that
has a configuration is emitted with its labels in file order, as the batch reader gives it, and the state goes. So a label
may come before its frame, and a frame before or after any of its labels; labels whose frame no configuration names end
with their block. What is later than the watermark is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.kitti import frames

#: Frames that share a state (1024 x 400 labels of 60 bytes at most): Spark's cost of a group is paid once for all of them.
BLOCK = 1024
EVENT = "run_dir string, experiment string, frame int, event_time timestamp, config string, ann_pos long, category_id int, x double, y double, w double, h double"
LABEL = ("ann_pos", "category_id", "x", "y", "w", "h")
ANNOTATIONS = "array<struct<ann_pos:bigint,category_id:int,x:double,y:double,w:double,h:double>>"
#: A state's rows: of each frame its latest configuration (as a place among the texts), and its labels' latest versions.
CONFIGS = np.dtype([("frame", "<i4"), ("at", "<i8"), ("text", "<i4")])
LABELS = np.dtype([("frame", "<i4"), ("ann_pos", "<i8"), ("at", "<i8"), ("category_id", "<i4"), *((c, "<f8") for c in "xywh")])
_NAMES = [c.split()[0] for c in EVENT.split(", ")]


def events(configs: DataFrame, labels: DataFrame) -> DataFrame:
    """EVENT's columns. configs: run_dir, experiment, config, event_time (see read_run_configs); labels: run_dir,
    experiment, frame, event_time and LABEL (see read_labels). Both may be streams."""
    f = frames(configs.select("run_dir", "experiment", "config", "event_time"))
    kinds = dict(c.split() for c in EVENT.split(", "))
    of = lambda d: d.select(*[F.col(c).cast(k).alias(c) if c in d.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    return of(f).unionByName(of(labels))


def _latest(rows: np.ndarray, *key: str) -> np.ndarray:
    """Of rows with one key the highest by all fields; in order of the key, which comes first in the fields."""
    rows = rows[np.lexsort([rows[n] for n in reversed(rows.dtype.names)])]
    last = np.ones(len(rows), bool)
    last[:-1] = reduce(np.logical_or, [rows[k][1:] != rows[k][:-1] for k in key])
    return rows[last]


def _records(dtype: np.dtype, part: pd.DataFrame, **other: np.ndarray) -> np.ndarray:
    out = np.empty(len(part), dtype)
    for name in dtype.names:
        column = part[name] if name not in other else other[name]
        if dtype[name].kind == "i" and pd.isna(column).any():
            raise ValueError(f"an event without {name}")
        out[name] = column
    return out


def _update(wait_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run_dir, experiment, _ = key
        last, texts, configs, labels = state.get if state.exists else (0, "[]", b"", b"")
        texts, configs, labels = json.loads(texts), np.frombuffer(configs, CONFIGS), np.frombuffer(labels, LABELS)
        if state.hasTimedOut:
            state.remove()
            if len(configs):
                low, high = (np.searchsorted(labels["frame"], configs["frame"], side) for side in ("left", "right"))
                lists = {c: [values[a:b] for a, b in zip(low, high, strict=True)] for c in LABEL for values in (np.ascontiguousarray(labels[c]),)}
                yield pd.DataFrame({"run_dir": run_dir, "experiment": experiment, "frame": configs["frame"], "config": [texts[i] for i in configs["text"]], **lists})
            return
        for part in parts:
            has = part["config"].notna().to_numpy()
            if has.any():
                named, own = part[has], texts
                texts = sorted({*own, *named["config"].unique()})  # so that places are in the order of the texts
                at = {t: i for i, t in enumerate(texts)}
                moved = configs.copy()
                moved["text"] = np.array([at[t] for t in own], np.int32)[configs["text"]] if own else configs["text"]
                configs = _latest(np.concatenate((moved, _records(CONFIGS, named, text=named["config"].map(at)))), "frame")
            labels = _latest(np.concatenate((labels, _records(LABELS, part[~has]))), "frame", "ann_pos")
            last = max(last, int(part["at"].max()))
        kept = sorted(set(configs["text"].tolist()))
        configs = configs.copy()
        configs["text"] = np.searchsorted(kept, configs["text"])
        state.update((last, json.dumps([texts[i] for i in kept]), configs.tobytes(), labels.tobytes()))
        state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))
        return
        yield

    return run


def assembled(stream: DataFrame, late: str = "1 hour", wait_seconds: int = 0) -> DataFrame:
    """run_dir, experiment, frame, config, annotations of a stream of events: append mode, each frame once."""
    e = stream.select(*_NAMES).withWatermark("event_time", late)
    e = e.withColumn("at", F.unix_millis("event_time")).withColumn("block", F.floor(F.col("frame") / BLOCK).cast("int"))
    out = "run_dir string, experiment string, frame int, config string, ann_pos array<bigint>, category_id array<int>, x array<double>, y array<double>, w array<double>, h array<double>"
    kept = "last long, texts string, configs binary, labels binary"
    made = e.groupBy("run_dir", "experiment", "block").applyInPandasWithState(_update(wait_seconds * 1000), out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("run_dir", "experiment", "frame", "config", F.arrays_zip(*LABEL).cast(ANNOTATIONS).alias("annotations"))


def assembled_batch(all_events: DataFrame) -> DataFrame:
    """The same rows from a table of events, by joins."""
    key = ["run_dir", "experiment", "frame"]
    configs = all_events.where("config IS NOT NULL").groupBy(*key).agg(F.max(F.struct("event_time", "config"))["config"].alias("config"))
    labels = all_events.where("config IS NULL").groupBy(*key, "ann_pos").agg(F.max(F.struct("event_time", *LABEL[1:])).alias("v"))
    labels = labels.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ann_pos", *[F.col(f"v.{c}").alias(c) for c in LABEL[1:]]))).alias("annotations"))
    return configs.join(labels, key, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(ANNOTATIONS)))
