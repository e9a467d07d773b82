"""Sinks with a commit: tasks write below a hidden folder, and their files appear only when the whole job has ended well.

Every attempt of a task has a folder of its own below `<root>/_staging-<job>`. The commit takes the folders of the
attempts that Spark counts and moves their files to their places; what failed or speculative attempts wrote never
leaves the staging folder, which goes at the end and after an abort. A file moves whole. Two attempts with one file are
an error before anything moves. A job whose driver dies leaves a hidden folder and nothing else; run it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..storage import store

MOVERS = 16


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    files: int


class StagedWriter(DataSourceArrowWriter):
    """Moves what tasks staged. A sink says in `stage` how a task's batches become files below a folder."""

    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex

    def stage(self, iterator: Iterator, fs, folder: str) -> int:
        """Write the batches below the folder; the number of files."""
        raise NotImplementedError

    def _staging(self):
        fs, root = store(self.root)
        return fs, root, f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Attempt:
        fs, _, staging = self._staging()
        name = uuid.uuid4().hex
        fs.create_dir(f"{staging}/{name}", recursive=True)
        return Attempt(name, self.stage(iterator, fs, f"{staging}/{name}"))

    def commit(self, messages) -> None:
        import pyarrow.fs as pafs

        fs, root, staging = self._staging()
        moves: dict[str, str] = {}
        for m in messages:
            if m is None or not m.files:
                continue
            base = f"{staging}/{m.name}"
            for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
                if f.is_file:
                    target = f"{root}/{f.path[len(base) + 1 :]}"
                    if target in moves:
                        self.abort(messages)
                        raise ValueError(f"two tasks wrote {target}")
                    moves[target] = f.path
        fs.create_dir(root, recursive=True)
        for d in {t.rsplit("/", 1)[0] for t in moves}:
            fs.create_dir(d, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda move: fs.move(move[1], move[0]), sorted(moves.items())))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs as pafs

        fs, _, staging = self._staging()
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


def inside(path: str) -> str:
    """A relative path that stays below its folder; anything else is an error."""
    if not path or path.startswith(("/", "_staging-")) or ".." in path.split("/"):
        raise ValueError(f"not a path below the sink's folder: {path!r}")
    return path


class FileSetWriter(StagedWriter):
    def stage(self, iterator, fs, folder):
        made, n = {folder}, 0
        for batch in iterator:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = f"{folder}/{inside(path)}"
                parent = to.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(to) as f:
                    f.write(content.encode() if isinstance(content, str) else content or b"")
                n += 1
        return n


class FileSet(DataSource):
    """Sink: each row (path below the folder, content as text or bytes) is a file, overwriting."""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        kinds = [f.dataType.simpleString() for f in schema.fields]
        if len(kinds) != 2 or kinds[0] != "string" or kinds[1] not in ("string", "binary"):
            raise ValueError(f"a file set is (path string, content string or binary), not {kinds}")
        return FileSetWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """files(path, content): all of them appear below the folder, or none. Paths must differ."""
    files.sparkSession.dataSource.register(FileSet)
    files.write.format("file_set").mode("append").option("path", folder).save()
