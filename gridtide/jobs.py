"""Asynchronous query jobs: bounded queue, cancellation, expiry and an audit log."""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from .config import Settings
from .plans.engine import Engine, serialize

OUTPUTS = ("plot-json", "png", "parquet")
PLOTTED = ("timeseries", "heatmap", "find-time", "find-area")
#: A running job's folder holds a file of this name, so that its folder is not cleaned away.
ACTIVE = ".active"
_JOB_FOLDER = re.compile(r"[0-9a-f]{32}")


class QueueFull(RuntimeError):
    """As many jobs wait as may."""


class RendererUnavailable(RuntimeError):
    """Drawing needs an optional library that isn't installed."""


@dataclass
class Job:
    id: str
    query: dict[str, Any]
    outputs: tuple[str, ...]
    owner: str
    state: str = "queued"
    created: float = field(default_factory=time.time)
    finished: float | None = None
    error: str | None = None
    artifacts: dict[str, Any] = field(default_factory=dict)


class JobService:
    """Runs queries of one engine; jobs live in memory, results for ``result_ttl_seconds``."""

    def __init__(self, engine: Engine, settings: Settings, folder: str | Path, workers: int = 2, waiting: int = 10, per_owner: int = 3) -> None:
        self.engine, self.settings, self.folder, self.waiting, self.per_owner = engine, settings, Path(folder), waiting, per_owner
        self._jobs: dict[str, Job] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(workers, "query-job")

    def validate(self, query: dict[str, Any], outputs: tuple[str, ...]) -> dict[str, int]:
        """The plan's cost; ``ValueError`` for a bad or too large request."""
        if not outputs or not set(outputs) <= set(OUTPUTS):
            raise ValueError(f"outputs must be among {', '.join(OUTPUTS)}")
        plan = self.engine.plan(query)
        if "png" in outputs and plan.query.operation.function not in PLOTTED:
            raise ValueError(f"png is only made of {', '.join(PLOTTED)}")
        return self.engine.enforce_limits(plan)

    def submit(self, query: dict[str, Any], outputs: tuple[str, ...] = ("plot-json",), owner: str = "local", client: str = "library") -> Job:
        self.validate(query, outputs)
        self.expire()
        with self._lock:
            active = [j for j in self._jobs.values() if j.state in ("queued", "running")]
            if len(active) >= self.waiting:
                raise QueueFull("the queue is full; try again later")
            if sum(j.owner == owner for j in active) >= self.per_owner:
                raise QueueFull(f"{owner} has {self.per_owner} jobs that haven't ended")
            job = Job(uuid.uuid4().hex, query, tuple(outputs), owner)
            self._jobs[job.id] = job
        append_query_log(self.folder / "query_log.jsonl", job, client)
        self._pool.submit(self._run, job)
        return job

    def _run(self, job: Job) -> None:
        with self._lock:
            if job.state != "queued":
                return
            job.state = "running"
        spark, mark = self.engine.store.spark, self.folder / job.id / ACTIVE
        try:
            mark.parent.mkdir(parents=True, exist_ok=True)
            mark.touch()
            spark.addTag(job.id)
            result = self.engine.execute(job.query)
            payload = serialize(result)
            if len(json.dumps(payload)) > self.settings.limits.output_bytes:
                raise ValueError("the output exceeds the limit")
            if "plot-json" in job.outputs:
                job.artifacts["plot-json"] = payload
            if "png" in job.outputs:
                job.artifacts["png"] = {g["group_id"]: render_png(g["data"]) for g in payload["groups"]}
            if "parquet" in job.outputs:
                job.artifacts["parquet"] = self.engine.write_result(result, str(self.folder / job.id))
            state = "completed"
        except Exception as e:
            state, job.error = "failed", str(e)
        finally:
            spark.removeTag(job.id)
            mark.unlink(missing_ok=True)
            with contextlib.suppress(OSError):  # it holds results
                mark.parent.rmdir()
        with self._lock:
            job.state = "cancelled" if job.state == "cancelled" else state
            job.finished = time.time()

    def get(self, job_id: str, owner: str | None = None) -> Job:
        job = self._jobs.get(job_id)
        if job is None or owner not in (None, job.owner):
            raise KeyError(job_id)
        return job

    def cancel(self, job_id: str) -> Job:
        """A queued job won't start; a running one's Spark work is interrupted."""
        job = self.get(job_id)
        with self._lock:
            was, job.state = job.state, "cancelled" if job.state in ("queued", "running") else job.state
        if was == "running":
            self.engine.store.spark.interruptTag(job_id)
        return job

    def jobs_ahead(self, job_id: str) -> int:
        job = self.get(job_id)
        return sum(j.state == "running" or (j.state == "queued" and j.created < job.created) for j in self._jobs.values() if j is not job) if job.state == "queued" else 0

    def counts(self) -> dict[str, int]:
        states = [j.state for j in self._jobs.values()]
        return {s: states.count(s) for s in ("queued", "running", "completed", "failed", "cancelled", "expired")}

    def expire(self) -> int:
        """Drop results that are older than their time to live."""
        n, now = 0, time.time()
        with self._lock:
            for job in self._jobs.values():
                if job.finished and job.state != "expired" and now - job.finished > self.settings.result_ttl_seconds:
                    job.state, job.artifacts, n = "expired", {}, n + 1
                    shutil.rmtree(self.folder / job.id, ignore_errors=True)
        return n

    def close(self) -> None:
        self._pool.shutdown(wait=True)


def append_query_log(path: Path, job: Job, client: str) -> None:
    """One line per accepted job, in one append."""
    path.parent.mkdir(parents=True, exist_ok=True)
    line = {"job_id": job.id, "submitted_at": datetime.now(UTC).isoformat(timespec="seconds"), "client": client, "owner": job.owner, "outputs": list(job.outputs), "query": json.dumps(job.query, sort_keys=True)}
    at = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(at, (json.dumps(line) + "\n").encode())
    finally:
        os.close(at)


def clean_outputs(folder: Path, older_than: float, active_grace: float = 86_400, dry_run: bool = False, now: float | None = None) -> list[str]:
    """Delete job folders that are older than their time to live; one with a fresh ``.active`` mark stays."""
    now, gone = now or time.time(), []
    for p in sorted(folder.iterdir()) if folder.is_dir() else []:
        if not (p.is_dir() and _JOB_FOLDER.fullmatch(p.name)) or now - p.stat().st_mtime <= older_than:
            continue
        if (mark := p / ".active").exists() and now - mark.stat().st_mtime <= active_grace:
            continue
        gone.append(p.name)
        if not dry_run:
            shutil.rmtree(p)
    return gone


def render_png(payload: dict[str, Any]) -> bytes:
    """A line plot or a map of a group's payload, if the drawing library is there."""
    try:
        import matplotlib
    except ImportError as e:
        raise RendererUnavailable("PNG output needs matplotlib") from e
    import io

    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots()
    if "timestamps" in payload:
        axes.plot(payload["timestamps"], payload["values"])
    else:
        flat = [(a, b, v) for la, lo, va in zip(payload["latitudes"], payload["longitudes"], payload["values"], strict=True) for a, b, v in zip(la, lo, va, strict=True) if v is not None]
        axes.scatter([b for _, b, _ in flat], [a for a, _, _ in flat], c=[v for *_, v in flat])
    out = io.BytesIO()
    figure.savefig(out, format="png")
    pyplot.close(figure)
    return out.getvalue()


class DataObject:
    """A named query template for sessions: fix the dataset, place and time once, ask any function."""

    def __init__(self, engine: Engine, **template: Any) -> None:
        self.engine, self.template = engine, template

    def query(self, function: str, **more: Any):
        return self.engine.execute({**self.template, "function": function, **more})
