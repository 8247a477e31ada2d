"""Watching a workspace: polled listings, settled changes, batches of observations, and one process at a time.

The listing and what is known of each path stay on the machine that holds the files and are bounded by discovery's
visits; documents that have settled are read and written by Spark, a batch a tick.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from lodestone.sources import files
from lodestone.sources.store import Store
from lodestone.sources.workspace import Workspace, WorkspaceError
from lodestone.streaming.watch import SETTLE_S, WRITES_PER_S, poll_interval

DISCOVER_S = 10.0


class Watcher:
    """The state of one watching process; ``tick`` looks once."""

    def __init__(self, spark: SparkSession, workspace: Workspace, store: Store, clock=time.monotonic):
        self.spark, self.workspace, self.store, self.clock = spark, workspace, store, clock
        self.known: dict[str, tuple[int, int]] = {}
        self.pending: dict[str, tuple[tuple[int, int], float]] = {}
        self.tracked: set[str] = {r.path for r in store.sources().select("path").collect()}  # at most as many as were discovered
        self.found: set[str] = set()
        self.looked = float("-inf")
        self.observed, self.last_error, self.stopped = 0, None, False

    def scope(self) -> dict[str, tuple[int, int]]:
        """Fingerprints of tracked and discovered paths; discovery itself runs every DISCOVER_S seconds at most."""
        if self.clock() - self.looked >= DISCOVER_S:
            self.found = {r.path for r in files.discovered(self.spark, self.workspace.root).collect() if not files.is_temporary(r.path)}
            self.looked = self.clock()
        out = {}
        for p in sorted(self.found | self.tracked):
            try:
                info = os.stat(self.workspace.root / p, follow_symlinks=False)
                out[p] = (info.st_mtime_ns, info.st_size)
            except OSError:
                continue
        return out

    def observe(self, paths: list[str]) -> tuple[set[str], set[str]]:
        """(written or unchanged, refused for good); the rest failed for now and comes again."""
        done, refused = set(), set()
        readable = []
        for p in paths:
            try:
                files.resolved(self.workspace.root, p)
                with open(self.workspace.root / p, "rb"):
                    readable.append(p)
            except files.Refused as e:
                self.last_error = str(e)
                if not isinstance(e.__cause__, OSError):
                    refused.add(p)
            except OSError as e:
                self.last_error = f"{p}: {e}"
        if readable:
            out, why = self.workspace.seed(self.spark, self.store, readable)
            for r in out.select("path", "status").collect():
                done.add(r.path)
                self.tracked.add(r.path)
                self.observed += r.status != "unchanged"
            refused |= set(why)
            self.last_error = next(iter(why.values()), self.last_error)
        return done, refused

    def baseline(self, retro: bool) -> None:
        """Start from what is there. With ``retro``, tracked files that changed while no one watched are observed first;
        a file that fails for now is left out, so that the next ticks try it again."""
        now = self.scope()
        old = [p for p in now if p in self.tracked] if retro else []
        done, refused = self.observe(old) if old else (set(), set())
        self.known = {p: f for p, f in now.items() if p not in old or p in done or p in refused}

    def tick(self) -> list[str]:
        """Observe what has kept its fingerprint for SETTLE_S seconds; at most WRITES_PER_S a second since the last tick."""
        try:
            if self.workspace.store_id != Workspace.open(self.workspace.root).store_id:
                raise WorkspaceError("the workspace has another identity now")
        except WorkspaceError as e:
            self.last_error, self.stopped = str(e), True
            return []
        now, seen = self.clock(), self.scope()
        self.known = {p: f for p, f in self.known.items() if p in seen}
        self.pending = {p: v for p, v in self.pending.items() if p in seen}
        due = []
        for p, mark in seen.items():
            if self.known.get(p) == mark:
                self.pending.pop(p, None)
            elif p in self.pending and self.pending[p][0] == mark:
                if now - self.pending[p][1] >= SETTLE_S:
                    due.append(p)
            else:
                self.pending[p] = (mark, now)
        due = due[: max(1, int(WRITES_PER_S * max(1.0, now - getattr(self, "ticked", now - 1))))]  # the others wait, none is dropped
        self.ticked = now
        done, refused = self.observe(due) if due else (set(), set())
        for p in done | refused:
            self.known[p] = seen[p]  # what was read, not what the file may be by now
            self.pending.pop(p, None)
        return sorted(done)

    def run(self, enabled, sleep=time.sleep) -> None:
        last = self.clock()
        while enabled() and not self.stopped:
            began = self.clock()
            if self.tick() or self.pending:
                last = began
            write_status(self.workspace, self)
            sleep(poll_interval(self.clock() - began, began - last))


def _file(workspace: Workspace, name: str) -> Path:
    return workspace.folder / name


def write_status(workspace: Workspace, watcher: Watcher) -> None:
    part = _file(workspace, ".watch.part")
    part.write_text(json.dumps({"pid": os.getpid(), "observed": watcher.observed, "tracked": len(watcher.tracked), "pending": len(watcher.pending), "last_error": watcher.last_error}))
    os.replace(part, _file(workspace, "watch.json"))


#: Locks of this process, by file, held while they are open.
_held: dict[str, TextIO] = {}


def _started(pid: int) -> int | None:
    """When a process was started, in the system's ticks; None where that can't be known."""
    try:
        return int(Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[19])
    except (OSError, ValueError, IndexError):
        return None


def _record(workspace: Workspace) -> dict | None:
    """What the holder of the lock wrote; None where no process holds it. The system lets go of a lock when its process ends."""
    try:
        with open(_file(workspace, "watch.lock")) as f:
            try:
                fcntl.flock(f, fcntl.LOCK_SH | fcntl.LOCK_NB)
            except OSError:
                return json.loads(f.read() or "{}")
    except (OSError, ValueError):
        pass
    return None


def holder(workspace: Workspace) -> int | None:
    """The process that holds the lock."""
    return (_record(workspace) or {}).get("pid")


def acquire(workspace: Workspace) -> bool:
    """Take the lock for this process; a second watcher of the workspace gets none."""
    path = str(_file(workspace, "watch.lock"))
    if path in _held:
        return True
    f = open(path, "a+")  # noqa: SIM115
    for _ in range(5):  # one that only looks holds it for a moment
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            time.sleep(0.02)
            continue
        f.truncate(0)
        f.write(json.dumps({"pid": os.getpid(), "started": _started(os.getpid())}))
        f.flush()
        _held[path] = f
        return True
    f.close()
    return False


def release(workspace: Workspace) -> None:
    if f := _held.pop(str(_file(workspace, "watch.lock")), None):
        f.close()


def set_enabled(workspace: Workspace, on: bool) -> bool:
    """Switch watching on or off; returns whether it was on before."""
    was = enabled(workspace)
    _file(workspace, "watcher.json").write_text(json.dumps({"enabled": on}))
    return was


def enabled(workspace: Workspace) -> bool:
    try:
        return bool(json.loads(_file(workspace, "watcher.json").read_text())["enabled"])
    except (OSError, ValueError, KeyError):
        return False


def spawn(workspace: Workspace, fresh: bool) -> int:
    """Start a watching process of its own and return its number."""
    args = [sys.executable, "-m", "lodestone.cli", "--root", str(workspace.root), "watch", "run"] + ["--fresh"] * fresh
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}
    with open(_file(workspace, "watch.log"), "ab") as log:
        return subprocess.Popen(args, stdout=log, stderr=log, stdin=subprocess.DEVNULL, start_new_session=True, env=env).pid


def start(workspace: Workspace) -> str:
    if workspace.profile != "dev":
        raise WorkspaceError("only workspaces of the profile dev are watched")
    fresh = not set_enabled(workspace, True)
    if pid := holder(workspace):
        return f"watching already (process {pid})"
    return f"watching (process {spawn(workspace, fresh)})"


def supervise(workspace: Workspace) -> str | None:
    """Start the watcher again where it should run and does not."""
    if workspace.profile == "dev" and enabled(workspace) and holder(workspace) is None:
        return f"watching again (process {spawn(workspace, False)})"
    return None


def stop(workspace: Workspace, wait_s: float = 10.0, sleep=time.sleep) -> str:
    set_enabled(workspace, False)
    record = _record(workspace)
    if not record or "pid" not in record:
        return "not watching"
    pid = record["pid"]
    if _started(pid) == record.get("started"):  # else the number belongs to another process by now
        with contextlib.suppress(ProcessLookupError):
            os.kill(pid, signal.SIGTERM)
    until = time.monotonic() + wait_s
    while holder(workspace) == pid and time.monotonic() < until:
        sleep(0.1)
    return "stopped" if holder(workspace) is None else f"process {pid} has not ended yet"


def status(workspace: Workspace) -> list[str]:
    pid = holder(workspace)
    out = [f"Watcher: {'running (process ' + str(pid) + ')' if pid else 'enabled, not running' if enabled(workspace) else 'off'}"]
    try:
        data = json.loads(_file(workspace, "watch.json").read_text())
        out += [f"Observed: {data['observed']}", f"Tracked: {data['tracked']}", f"Pending: {data['pending']}"] + [f"Last error: {data['last_error']}"] * bool(data["last_error"])
    except (OSError, ValueError, KeyError):
        pass
    return out
