"""Project settings: one YAML file, read by the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from ..operators.samples import CATEGORIES


@dataclass(frozen=True)
class Project:
    image_size: int = 640
    max_gt: int = 400
    score_threshold: float = 0.3
    max_detections: int = 300
    train_subsets: tuple = ("subset-2", "subset-3", "subset-5")
    val_subsets: tuple = ("subset-1", "subset-4")
    max_samples: int | None = None
    synth: dict = field(default_factory=dict)
    #: (category_id, name, class index) of each category.
    categories: tuple = CATEGORIES
    #: Weights, alpha, gamma and matcher; see losses.settings.
    loss: dict = field(default_factory=dict)


#: Names of settings in project files, beside the fields' own.
NAMES = {"max_num_of_objects": "max_gt", "synth_data": "synth"}


def load_project(path: str) -> Project:
    """Known keys of a YAML file, subsets also below `split`; a missing file or a null gives the defaults."""
    import yaml

    p = Path(path)
    raw = (yaml.safe_load(p.read_text()) or {}) if p.exists() else {}
    raw = {NAMES.get(k, k): v for k, v in (raw | (raw.get("split") or {})).items() if v is not None}
    if "categories" in raw:
        raw["categories"] = [(c["coco_id"], c["name"], c["idx"]) for c in raw["categories"]]
    names = {f.name for f in fields(Project)}
    return Project(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names})


def from_root(root: str, path: str) -> str:
    return path if Path(path).is_absolute() else str(Path(root) / path)


def load_yaml(path: str) -> dict:
    """An absent file is an empty configuration."""
    import yaml

    p = Path(path)
    return (yaml.safe_load(p.read_text()) or {}) if p.exists() else {}
