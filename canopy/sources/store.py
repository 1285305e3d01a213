"""Versioned snapshots: one folder of Parquet tables for each, an active one a branch, and a pinned, bounded history.

All paths go through Hadoop's file system, so a store may lie anywhere that Spark can write. A snapshot is written beside
its place and moved there when whole; a failed write leaves nothing behind.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("files", "types", "functions", "directories", "scores", "metadata")
KEEP = 10
SCHEMA_VERSION = 1
_ID = re.compile(r"^(\d+)-(.+)$")


@dataclass(frozen=True)
class SnapshotInfo:
    path: str
    snapshot_id: str
    timestamp: int
    pin_name: str | None


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, branch: str = "main", keep: int = KEEP):
        self.spark, self.keep = spark, keep
        self.branch_dir = f"{root.rstrip('/')}/{branch.replace('/', '-')}"
        self.history_dir, self.active, self.scratch = f"{self.branch_dir}/history", f"{self.branch_dir}/active", f"{self.branch_dir}/advise"

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def _delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def _move(self, source: str, target: str) -> None:
        self._fs(target).mkdirs(self._path(target).getParent())
        if not self._fs(target).rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def _read_text(self, path: str) -> str | None:
        if not self._exists(path):
            return None
        rows = self.spark.read.text(path, wholetext=True).collect()
        return rows[0][0] if rows else ""

    def _write_text(self, path: str, text: str) -> None:
        out = self._fs(path).create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write(self, tables: dict[str, DataFrame], *, commit: str = "0000000", model_id: str = "", pin: str | None = None, now_ms: int | None = None) -> str:
        """Rotate the active snapshot into history and write a new one; returns its path."""
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        staging = f"{self.branch_dir}/staging-{uuid.uuid4().hex}"
        facts = {"created_at": str(now_ms if now_ms is not None else int(time.time() * 1000)), "commit_hash": commit, "model_id": model_id, "schema_version": str(SCHEMA_VERSION)}
        if pin:
            facts["pin_name"] = pin
        try:
            for name, df in tables.items():
                df.write.mode("errorifexists").parquet(f"{staging}/{name}")
            self._write_text(f"{staging}/manifest.json", json.dumps(facts))
        except Exception:
            self._delete(staging)
            raise
        self.rotate()
        if pin:
            self._clear_pin(pin)
        self._move(staging, self.active)
        return self.active

    def facts(self, path: str) -> dict[str, str]:
        return json.loads(self._read_text(f"{path}/manifest.json") or "{}")

    def rotate(self) -> str | None:
        """Move the active snapshot to history and drop the oldest unpinned ones beyond the bound."""
        if not self._exists(self.active):
            return None
        f = self.facts(self.active)
        target = f"{self.history_dir}/{f['created_at']}-{f['commit_hash']}"
        if self._exists(target):
            self._delete(target)
        self._move(self.active, target)
        unpinned = [s for s in self.history() if s.pin_name is None]
        for old in unpinned[: max(0, len(unpinned) - self.keep)]:
            self._delete(old.path)
        return target

    def history(self) -> list[SnapshotInfo]:
        """Past snapshots, oldest first."""
        if not self._exists(self.history_dir):
            return []
        out = []
        for status in self._fs(self.history_dir).listStatus(self._path(self.history_dir)):
            name = status.getPath().getName()
            if m := _ID.match(name):
                path = f"{self.history_dir}/{name}"
                out.append(SnapshotInfo(path, name, int(m[1]), self.facts(path).get("pin_name")))
        return sorted(out, key=lambda s: (s.timestamp, s.snapshot_id))

    def resolve(self, name: str) -> SnapshotInfo:
        """By id, else by pin."""
        found = self.history()
        for match in (lambda s: s.snapshot_id == name, lambda s: s.pin_name == name):
            for s in found:
                if match(s):
                    return s
        raise KeyError(f"no snapshot {name}")

    def _set(self, path: str, pin: str | None) -> None:
        f = self.facts(path)
        f.pop("pin_name", None)
        if pin:
            f["pin_name"] = pin
        self._write_text(f"{path}/manifest.json", json.dumps(f))

    def _clear_pin(self, pin: str) -> None:
        for s in self.history():
            if s.pin_name == pin:
                self._set(s.path, None)
        if self._exists(self.active) and self.facts(self.active).get("pin_name") == pin:
            self._set(self.active, None)

    def pin(self, name: str, snapshot: str | None = None) -> None:
        """Give a name to a snapshot (the active one by default); the name moves from whichever had it."""
        path = self.resolve(snapshot).path if snapshot else self.active
        if not self._exists(path):
            raise FileNotFoundError(path)
        self._clear_pin(name)
        self._set(path, name)

    def unpin(self, snapshot: str) -> None:
        s = self.resolve(snapshot)
        if s.pin_name is None:
            raise ValueError(f"{s.snapshot_id} is not pinned")
        self._set(s.path, None)

    def delete(self, snapshot: str) -> None:
        self._delete(self.resolve(snapshot).path)

    def read(self, name: str, snapshot: str | None = None) -> DataFrame:
        path = self.resolve(snapshot).path if snapshot else self.active
        if not self._exists(path):
            raise FileNotFoundError(path)
        return self.spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")

    def cache(self, model_id: str) -> dict[str, DataFrame] | None:
        """The active snapshot's tables if the same model made them, to reuse their vectors."""
        if not self._exists(self.active) or self.facts(self.active).get("model_id") != model_id:
            return None
        return {n: self.read(n) for n in ("files", "types", "functions", "directories") if self._exists(f"{self.active}/{n}")}

    def scores(self, snapshot: str | None = None, prefix: str | None = None) -> DataFrame:
        rows = self.read("scores", snapshot)
        if not prefix:
            return rows
        inside = F.regexp_replace("key", "^[^:]*:", "").startswith(prefix)
        return rows.where(inside | F.col("key").startswith(f"dir:{prefix}"))

    def clone_for_advice(self) -> str:
        """A scratch copy of the active snapshot's tables."""
        self._delete(self.scratch)
        for n in TABLES:
            if self._exists(f"{self.active}/{n}"):
                self.read(n).write.parquet(f"{self.scratch}/{n}")
        self._write_text(f"{self.scratch}/manifest.json", json.dumps(self.facts(self.active)))
        return self.scratch

    def delete_advice(self) -> None:
        self._delete(self.scratch)
