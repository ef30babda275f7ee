"""Runs in stages that can be taken up again: a graph of tables, each known by what it was made from.

A stage's key is a digest of its name, version and parameters and of the contents of the tables that it needs. A stage is
written aside, checked, and put in place under its key by one rename, so a stage is there whole or not at all; the run's state is
a log of small files that are only ever added. A run that died is taken up with ``resume``: stages whose key is in place are
read, all others are made. Contents count, not times: if a stage that is made again comes out as before, what follows it stays.

Sources are looked at again whenever a run is taken up; if their contents have changed, the run ends with an error, or with
``changed="rebuild"`` what depends on them is made anew.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Stage:
    """``make`` takes the tables it needs, by name, and a folder of its own for what isn't a table; it returns its table.

    ``check`` gives faults of the table made, beside those it needs; any ends the run. A ``source`` needs nothing, and is made again for each run.
    """

    name: str
    make: Callable[[dict[str, DataFrame], str], DataFrame]
    needs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    version: str = "1"
    check: Callable[[DataFrame, dict[str, DataFrame]], list[str]] | None = None
    source: bool = False


def content_digest(df: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a table's rows, in whatever order and partitions they lie."""
    plain = [F.to_json(c) if kind.startswith("map") or "map<" in kind else F.col(f"`{c}`") for c, kind in sorted(df.dtypes)]
    a, b = F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain)
    n, *sums = df.agg(F.count(F.lit(1)), *(F.sum(h.cast("decimal(20,0)")) for h in (a, b)), F.bit_xor(a)).first()
    shape = json.dumps(sorted(df.dtypes))
    return hashlib.sha256(json.dumps([shape, n, *map(str, sums)]).encode()).hexdigest(), n


class Log:
    """The run's state: each change is a new file, put in place by a rename, and the last one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _files(self) -> list[str]:
        root = self._path(self.folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root) if s.getPath().getName().endswith(".json")) if self.fs.exists(root) else []

    def read(self) -> dict | None:
        files = self._files()
        if not files:
            return None
        found = self.fs.open(self._path(self.folder, files[-1]))
        try:
            return json.loads(bytes(found.readAllBytes()).decode())
        finally:
            found.close()

    def write(self, state: dict) -> None:
        last = int(self._files()[-1].split(".")[0]) if self._files() else 0
        aside = self._path(self.folder, f".{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(state, ensure_ascii=False).encode()))
        finally:
            out.close()
        if not self.fs.rename(aside, self._path(self.folder, f"{last + 1:08d}.json")):
            raise OSError(f"another run writes to {self.folder}")


class Run:
    """A run in ``folder``. ``identity`` is what the run is about: a run that is taken up must have the same."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict, resume: bool = False, changed: str = "refuse"):
        if changed not in ("refuse", "rebuild"):
            raise ValueError("changed must be 'refuse' or 'rebuild'")
        self.spark, self.folder, self.resume, self.changed = spark, folder.rstrip("/"), resume, changed
        self.log = Log(spark, f"{self.folder}/state")
        state = self.log.read()
        if state is not None and not resume:
            raise FileExistsError(f"{folder} has a run; resume it, or take another folder")
        if state is not None and state["identity"] != identity:
            raise ValueError("the run in this folder is about something else")
        self.state = state or {"schema_version": 1, "status": "running", "identity": identity, "stages": {}}
        if state is None:
            self.log.write(self.state)

    def _update(self, stage: str, status: str, **details) -> None:
        old = self.state["stages"].get(stage, {})
        self.state["stages"][stage] = {**({k: old[k] for k in ("digest", "rows") if k in old}), "status": status, **details}
        self.state |= {"status": "failed" if status == "failed" else "running", "current_stage": stage}
        self.log.write(self.state)

    def _key(self, stage: Stage) -> str:
        made_from = {n: self.state["stages"][n]["digest"] for n in stage.needs}
        return hashlib.sha256(json.dumps([stage.name, stage.version, stage.params, made_from], sort_keys=True).encode()).hexdigest()

    def table(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/stages/{stage}/{self.state['stages'][stage]['key']}")

    def _in_place(self, stage: Stage, key: str) -> bool:
        told = self.state["stages"].get(stage.name, {})
        return told.get("status") == "completed" and told.get("key") == key and self.log.fs.exists(self.log._path(f"{self.folder}/stages/{stage.name}/{key}"))

    def run(self, stages: list[Stage]) -> dict[str, str]:
        """Stages in order, each named after those that it needs. Returns what was done: made, resumed or remade, by stage."""
        done: dict[str, str] = {}
        for stage in stages:
            if lacking := [n for n in stage.needs if n not in done]:
                raise ValueError(f"{stage.name} needs {lacking} before it")
            key = self._key(stage)
            if not stage.source and self._in_place(stage, key):
                done[stage.name] = "resumed"
                continue
            done[stage.name] = self._make(stage, key)
        self.state |= {"status": "completed"}
        self.log.write(self.state)
        return done

    def _make(self, stage: Stage, key: str) -> str:
        before = self.state["stages"].get(stage.name, {})
        again = stage.source and self._in_place(stage, key)
        if not again:
            self._update(stage.name, "running", key=key)
        fs, path = self.log.fs, self.log._path
        target, aside = path(f"{self.folder}/stages/{stage.name}/{key}"), path(f"{self.folder}/stages/{stage.name}/.{uuid.uuid4().hex}")
        began = time.monotonic()
        try:
            needed = {n: self.table(n) for n in stage.needs}
            made = stage.make(needed, f"{self.folder}/files/{stage.name}-{key[:16]}")
            made.write.parquet(str(aside))
            made = self.spark.read.schema(made.schema).parquet(str(aside))
            digest, rows = content_digest(made)
            if again and digest == before["digest"]:
                fs.delete(aside, True)
                return "resumed"
            if before.get("digest") not in (None, digest) and stage.source and self.changed == "refuse":
                raise ValueError(f"{stage.name} has changed since the run began; start a new one")
            if faults := stage.check(made, needed) if stage.check else []:
                raise ValueError(f"{stage.name}: {'; '.join(faults)}")
            if fs.exists(target):
                fs.delete(target, True)
            if not fs.rename(aside, target):
                raise OSError(f"can't put {target} in place")
        except Exception as e:
            fs.delete(aside, True)
            kept = {"key": before["key"]} if again else {"key": key}
            self._update(stage.name, "failed", error=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", **kept)
            if again:  # what was in place still is
                self.state["stages"][stage.name] |= {"status": "completed"}
                self.log.write(self.state)
            raise
        self._update(stage.name, "completed", key=key, digest=digest, rows=rows, seconds=round(time.monotonic() - began, 3))
        return "remade" if before.get("digest") else "made"
