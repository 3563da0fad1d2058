"""Append-only registry of runs: a stage that ends without declaring its rows is a failure."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from harborlight.sources import files


class SilentSuccess(RuntimeError):
    pass


class Run:
    def __init__(self, run_id: str):
        self.run_id, self.rows = run_id, None

    def finish(self, rows: int) -> None:
        self.rows = rows


class Registry:
    """One JSON file a state change; the newest of a run counts, so a failure outlives whatever it interrupted. The folder is on the session's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _write(self, record: dict) -> None:
        files.write_text(self.spark, f"{self.folder}/{record['at'].replace(':', '')}-{uuid.uuid4().hex}.json", json.dumps(record, sort_keys=True))

    @contextmanager
    def run(self, stage: str, fingerprint: str, **params) -> Iterator[Run]:
        now = lambda: datetime.datetime.now(datetime.UTC).isoformat()
        run = Run(f"{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}-{stage}")
        base = {"run_id": run.run_id, "stage": stage, "config": fingerprint, "params": params}
        self._write(base | {"at": now(), "status": "running"})
        try:
            yield run
            if run.rows is None:
                raise SilentSuccess(f"{stage} declared no rows")
        except BaseException as e:
            self._write(base | {"at": now(), "status": "failed", "error": repr(e)})
            raise
        self._write(base | {"at": now(), "status": "ok", "rows": run.rows})

    def records(self) -> list[dict]:
        """The newest state of each run, the latest run first; runs are few, and this is for people and lookups."""
        newest: dict[str, dict] = {}
        for path in files.names(self.spark, self.folder, ".json"):
            r = json.loads(files.read_text(self.spark, path))
            newest[r["run_id"]] = r
        return sorted(newest.values(), key=lambda r: r["run_id"], reverse=True)

    def latest(self, stage: str, **params) -> dict | None:
        """The newest successful run of a stage with these params; others never stand in for it."""
        good = [r for r in self.records() if r["stage"] == stage and r["status"] == "ok" and all(r["params"].get(k) == v for k, v in params.items())]
        return good[0] if good else None
