"""Source trees as a Spark data source: reading a tree in tasks, writing one.

``docquill_tree`` reads a folder on storage that every executor mounts. A few
folders are opened to find enough subtrees, then each task walks its own: a
folder that an exclude pattern matches becomes a ``pruned`` row and is never
listed, files that cannot be read and folders that cannot be listed become
``unreadable`` rows, names that begin with ``_`` or ``.`` are files like any
other. Symbolic links to folders are ``skipped``: a walk through them may not
end.

Written with the same format, every row becomes a file at its own path. Tasks
write into a staging folder beside the target; the driver's commit is one
rename, and an abort removes the staging folder, so a failed job leaves the
target as it was and a retried task writes the same files again. Paths that
leave the tree, and two rows with one path and different texts, fail the job.
"""

from __future__ import annotations

import os
import re
import shutil
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from docquill.functions.globs import globs_regex
from docquill.session import ship_package

FORMAT = "docquill_tree"
SCHEMA = "path string, kind string, text string, error string"
SUBTREES = 64               # subtrees wanted before tasks are dealt
OPENED = 256                # folders that the planner opens at most


def local_path(root: str) -> str | None:
    """The folder of a location that is mounted, None for other schemes."""
    scheme, sep, rest = root.partition(":")
    if sep and "/" not in scheme:
        return "/" + rest.lstrip("/") if scheme == "file" else None
    return root


@dataclass
class Subtree(InputPartition):
    """A folder to walk (``whole``), or entries that are known already."""
    folder: str
    whole: bool
    rows: tuple = ()


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.exclude = re.compile(options["exclude"]) if options.get("exclude") else None
        exts = options.get("exts")
        self.exts = tuple(exts.split(",")) if exts else None

    def _list(self, folder: str):
        """(folders, rows) of one folder, relative to the root."""
        folders, rows = [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            return [], [(folder, "unreadable", None, f"cannot list: {e.strerror}")]
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if self.exclude and self.exclude.search(path):
                rows.append((path, "pruned", None, "excluded"))
            elif e.is_dir(follow_symlinks=False):
                folders.append(path)
            elif e.is_dir():
                rows.append((path, "skipped", None, "link to a folder"))
            elif self.exts and os.path.splitext(e.name)[1] not in self.exts:
                rows.append((path, "skipped", None, "extension"))
            else:
                rows.append((path, "file", None, None))
        return folders, rows

    def partitions(self):
        """Opens folders breadth first until there are enough subtrees."""
        waiting, known, opened = [""], [], 0
        while waiting and len(waiting) < SUBTREES and opened < OPENED:
            folder = waiting.pop(0)
            folders, rows = self._list(folder)
            opened += 1
            waiting += folders
            known += [Subtree(folder, False, tuple(rows[k:k + 1000])) for k in range(0, len(rows), 1000)]
        return known + [Subtree(f, True) for f in waiting] or [Subtree("", False)]

    def _read(self, row):
        path, kind, _, _ = row
        if kind != "file":
            return row
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return path, "file", f.read().decode("utf-8"), None
        except UnicodeDecodeError:
            return path, "unreadable", None, "not UTF-8 text"
        except OSError as e:
            return path, "unreadable", None, f"cannot read: {e.strerror}"

    def read(self, partition):
        yield from map(self._read, partition.rows)
        waiting = [partition.folder] if partition.whole else []
        while waiting:
            folders, rows = self._list(waiting.pop())
            waiting += folders[::-1]
            yield from map(self._read, rows)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.target = options["path"].rstrip("/")
        self.overwrite = overwrite
        if os.path.lexists(self.target) and not overwrite:
            raise ValueError(f"{self.target} exists; write with mode overwrite to replace it")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def _folders(self, place: str) -> None:
        """The folders above a file. The staging folder itself is never made again: once an abort has removed
        it, tasks that still run fail."""
        at = self.staging
        for part in os.path.relpath(os.path.dirname(place), self.staging).split("/"):
            at = os.path.join(at, part)
            try:
                os.mkdir(at)
            except FileExistsError:
                pass

    def _place(self, path: str) -> str:
        parts = (path or "").split("/")
        if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts) or "\0" in path:
            raise ValueError(f"not a path inside the tree: {path!r}")
        return os.path.join(self.staging, *parts)

    def write(self, iterator):
        n = 0
        for row in iterator:
            place, data = self._place(row["path"]), (row["text"] or "").encode("utf-8")
            self._folders(place)
            part = f"{place}.part-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            try:
                os.link(part, place)            # fails where another row or attempt has written the path
            except FileExistsError:
                with open(place, "rb") as f:
                    if f.read() != data:
                        raise ValueError(f"two texts for one path: {row['path']!r}") from None
            finally:
                os.unlink(part)
            n += 1
        return Written(n)

    def commit(self, messages):
        old = None
        if self.overwrite and os.path.lexists(self.target):
            old = f"{self.target}.old-{uuid.uuid4().hex}"
            os.rename(self.target, old)
        os.rename(self.staging, self.target)
        if old:
            shutil.rmtree(old)

    def abort(self, messages):
        for _ in range(50):         # tasks that still run may add files meanwhile
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.lexists(self.staging):
                break
            time.sleep(0.1)


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

    def writer(self, schema, overwrite):
        return TreeWriter(self.options, overwrite)


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TreeSource)


def scan_tree(spark: SparkSession, root: str, exclude=(), exts=()) -> DataFrame:
    """(path, kind, text, error) of everything met under ``root``; kinds are
    ``file``, ``pruned``, ``skipped`` and ``unreadable``. ``exclude``: globs
    that prune files and folders; ``exts``: extensions of wanted files."""
    place = local_path(root)
    if place is None:
        raise ValueError(f"{root}: a tree is read from mounted storage")
    _register(spark)
    reader = spark.read.format(FORMAT).option("path", place)
    rx = globs_regex(exclude) if exclude else None
    if rx:
        reader = reader.option("exclude", rx)
    if exts:
        reader = reader.option("exts", ",".join(exts))
    return reader.load()


def write_tree(files: DataFrame, out: str, overwrite: bool = False, path: str = "path", text: str = "text",
               source_location: str | None = None) -> None:
    """A4: every row's ``text`` as a file at its own ``path`` under ``out``, all or nothing."""
    from docquill.sources.sinks import refuse_input
    refuse_input(out, source_location)
    place = local_path(out)
    if place is None:
        raise ValueError(f"{out}: a tree is written to mounted storage")
    _register(files.sparkSession)
    rows = files.select(F.col(path).alias("path"), F.lit("file").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("error"))
    rows.write.format(FORMAT).option("path", place).mode("overwrite" if overwrite else "append").save()
