"""Generation jobs: one for each configuration of a folder, or the fixed set of three."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from pathlib import Path

from .operators.configs import merge_objects
from .sources.project import load_yaml

#: Frames of the standard generation by distractor setting.
STANDARD = (("warehouse", 2000), ("additional", 2000), ("None", 1000))


@dataclass(frozen=True)
class Job:
    name: str
    config: dict

    @property
    def frames(self) -> int:
        return int(self.config.get("run", {}).get("num_frames", 0))

    def with_values(self, values: dict) -> Job:
        """Command-line values over everything."""
        return replace(self, config=merge_objects(self.config, values))


def resolved(path: Path) -> dict:
    """A configuration over the one it extends, one level; `extends` is relative to the file."""
    own = load_yaml(str(path))
    parent = own.pop("extends", None)
    return merge_objects(load_yaml(str(path.parent / parent)), own) if parent else own


def folder_jobs(folder: str, frames: int | None = None) -> list[Job]:
    """A job for each *.yaml in text order; a missing or empty folder is an error."""
    files = sorted(Path(folder).glob("*.yaml"))
    if not files:
        raise FileNotFoundError(f"no configurations in {folder}")
    jobs = [Job(f.stem, resolved(f)) for f in files]
    return [j.with_values({"run": {"num_frames": frames}}) for j in jobs] if frames else jobs


def standard_jobs(base: dict) -> list[Job]:
    return [Job(d, merge_objects(base, {"run": {"distractors": d, "num_frames": n}})) for d, n in STANDARD]


@dataclass(frozen=True)
class TrialPaths:
    csv: Path
    out_dir: Path
    #: The base configuration as the generated files name it: relative to them.
    extends: str


def trial_paths(folder: str, base: str, csv: str | None = None, out_dir: str | None = None) -> TrialPaths:
    """Where trials are read and configurations go: by default the only *.csv of the folder, and its folder, which is made."""
    if csv is None:
        found = sorted(Path(folder).glob("*.csv"))
        if len(found) != 1:
            raise ValueError(f"name a trial table: {len(found)} *.csv in {folder}")
        csv = found[0]
    table = Path(csv).absolute()
    out = Path(out_dir).absolute() if out_dir else table.parent
    out.mkdir(parents=True, exist_ok=True)
    return TrialPaths(table, out, os.path.relpath(Path(base).absolute(), out))
