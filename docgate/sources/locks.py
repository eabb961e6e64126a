"""One run at a time in an output folder: a lock file with the run's process and heartbeat, taken over when stale."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

NAME = "docgate_run.lock"


class Active(RuntimeError):
    """Another run holds the folder."""


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _read(path: Path) -> dict:
    try:
        found = json.loads(path.read_text())
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def _replace(path: Path, state: dict) -> None:
    fresh = path.with_name(f"{path.name}.new")
    fresh.write_text(json.dumps(state, indent=2, sort_keys=True))
    fresh.replace(path)


def _runs(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def stale(state: dict, seconds: float) -> bool:
    """Whether a lock's run has ended: it says so, its process is gone, or its heartbeat is too old."""
    if state.get("status", "running") != "running":
        return True
    if isinstance(state.get("pid"), int) and state["pid"] > 0 and not _runs(state["pid"]):
        return True
    try:
        beat = datetime.fromisoformat(state["updated_at"])
    except (KeyError, TypeError, ValueError):
        return False
    return (datetime.now(UTC) - beat).total_seconds() > seconds


@dataclass(frozen=True)
class Lock:
    path: Path
    run_id: str

    def beat(self, stage: str, status: str = "running") -> None:
        """Tells that the run goes on; only the run that holds the lock does."""
        if _read(self.path).get("run_id") == self.run_id:
            _replace(self.path, {"run_id": self.run_id, "pid": os.getpid(), "status": status, "stage": stage, "updated_at": _now()})

    def release(self, status: str) -> None:
        self.beat("finished", status)


def acquire(folder: str | Path, run_id: str, seconds: float = 3600) -> Lock:
    """The folder's lock. A stale one is put aside and taken over; one that is held raises Active."""
    path = Path(folder) / NAME
    path.parent.mkdir(parents=True, exist_ok=True)
    state = {"run_id": run_id, "pid": os.getpid(), "status": "running", "stage": "starting", "updated_at": _now()}
    try:
        with path.open("x") as out:
            json.dump(state, out)
    except FileExistsError:
        held = _read(path)
        if not stale(held, seconds):
            raise Active(f"{path} is held by run {held.get('run_id')} (process {held.get('pid')})") from None
        _replace(path.with_suffix(".stale.json"), held)
        _replace(path, state)
    return Lock(path, run_id)
