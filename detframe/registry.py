"""Named operators by kind: what an evaluation runs over every sample, and in which direction a metric is better."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .operators import configs, gt, images, losses, metrics, overlay, preds, profile, samples

KINDS = ("source", "encoder", "metadata", "metric", "loss", "visualizer")


@dataclass(frozen=True)
class Entry:
    kind: str
    name: str
    function: Callable
    direction: str | None = None


_ENTRIES: dict[tuple[str, str], Entry] = {}


def register(kind: str, name: str, function: Callable, direction: str | None = None) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}: one of {KINDS}")
    if direction not in (None, "Upward", "Downward"):
        raise ValueError(f"no direction {direction!r}")
    _ENTRIES[kind, name] = Entry(kind, name, function, direction)
    return function


def get(kind: str, name: str) -> Entry:
    return _ENTRIES[kind, name]


def entries(kind: str | None = None) -> list[Entry]:
    return [e for e in _ENTRIES.values() if kind in (None, e.kind)]


register("source", "splits", samples.routed)
register("source", "all_splits", samples.union_splits)
register("encoder", "image", images.image_tensors)
for _name, _column in (("classes", "gt_padded"), ("gt_boxes", "gt_boxes"), ("gt_labels", "gt_labels"), ("gt_valid_mask", "gt_mask")):
    register("encoder", _name, lambda s, g, column=_column, **options: gt.padded(s, g, **options).select("sample_id", column))
register("encoder", "orig_size", gt.original_size)
register("encoder", "predictions", preds.packed)
register("metadata", "data_type", samples.data_type)
register("metadata", "metadata", profile.sample_profile)
register("metadata", "synth_metadata", configs.synth_metadata)
for _name, _direction in (("precision", "Upward"), ("recall", "Upward"), ("f1", "Upward"), ("iou", "Upward"), ("accuracy", "Upward"), ("tp", "Upward"), ("fp", "Downward"), ("fn", "Downward")):
    register("metric", _name, metrics.sample_metrics, _direction)
register("metric", "Confusion Matrix", metrics.confusion_elements)
for _name in ("loss_vfl", "loss_bbox", "loss_giou", "total"):
    register("metric", _name, losses.criterion, "Downward")
register("loss", "total", losses.criterion, "Downward")
register("visualizer", "boxes", overlay.overlay_boxes)
register("visualizer", "image", images.to_uint8)
