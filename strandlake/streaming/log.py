"""Mergeable states appended by a stream, merged level by level, and listed in a manifest."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from strandlake.sources.stores import store_of

Merge = Callable[[DataFrame], DataFrame]


@dataclass
class Manifest:
    """What a log holds: its folders with their levels, the last batch in them, and the folders that the version before held besides."""

    version: int = 0
    last_batch: int = -1
    folders: list[tuple[str, int]] = field(default_factory=list)
    before: list[str] = field(default_factory=list)


class StateLog:
    """States of one kind at ``path``.

    A batch adds a folder of level 0; ``fan`` folders of one level are merged to one of the next. A row is so merged
    once for each level, and after n batches there are less than ``fan`` folders for each of log(n) levels. A batch
    counts from the moment that its manifest has its name: a manifest is written beside and renamed, a
    batch that runs again is passed over, and folders that no manifest lists are swept later. What a
    version replaces stays for one version more, for those that still read it.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Merge, fan: int = 8):
        self.spark, self.path, self.merge, self.fan = spark, path.rstrip("/"), merge, fan

    def manifest(self) -> Manifest:
        store, inner = store_of(self.path)
        if store.get_file_info(inner).type != fs.FileType.Directory:
            return Manifest()
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("manifest-")]
        if not names:
            return Manifest()
        # names are of one length: the last one is the newest
        held = json.loads(store.open_input_file(posixpath.join(inner, max(names))).read())
        return Manifest(held["version"], held["last_batch"], [tuple(f) for f in held["folders"]], held["before"])

    def add(self, state: DataFrame, batch: int) -> None:
        """Append the state of a batch, unless it is there."""
        old = self.manifest()
        if batch <= old.last_batch:
            return
        folders = [*old.folders, (self._write(state), 0)]
        level = 0
        while len(full := [f for f, own in folders if own == level]) >= self.fan:
            folders = [(f, own) for f, own in folders if own != level]
            folders.append((self._write(self.merge(self._read(full))), level + 1))
            level += 1
        kept = {f for f, _ in folders}
        new = Manifest(old.version + 1, batch, folders, [f for f, _ in old.folders if f not in kept])
        self._commit(new)
        self._sweep(new)

    def read(self) -> DataFrame:
        """All states as one."""
        folders = self.manifest().folders
        if not folders:
            raise ValueError(f"no state at {self.path}")
        return self.merge(self._read([f for f, _ in folders]))

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, state: DataFrame) -> str:
        name = f"states-{uuid.uuid4().hex}"
        state.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, m: Manifest) -> None:
        store, inner = store_of(self.path)
        temporary = posixpath.join(inner, f"_{uuid.uuid4().hex}")
        with store.open_output_stream(temporary) as out:
            out.write(json.dumps(m.__dict__).encode())
        store.move(temporary, posixpath.join(inner, f"manifest-{m.version:012d}.json"))

    def _sweep(self, m: Manifest) -> None:
        store, inner = store_of(self.path)
        kept = {f for f, _ in m.folders} | set(m.before)
        for f in store.get_file_info(fs.FileSelector(inner)):
            if f.base_name.startswith("states-") and f.base_name not in kept:
                store.delete_dir(f.path)
            elif f.base_name.startswith("manifest-") and f.base_name < f"manifest-{m.version - 1:012d}.json":
                store.delete_file(f.path)
