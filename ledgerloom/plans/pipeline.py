"""A small runner for dependent steps: parallel where they may be, serial against other runs, with a ledger of what ran."""

from __future__ import annotations

import contextlib
import csv
import datetime as dt
import getpass
import os
import platform
import shutil
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

#: Columns of the ledger.
LEDGER = ("run_id", "workflow", "trigger", "day", "step", "number", "of", "after", "state", "queued", "started", "ended", "waited", "seconds", "attempt", "result", "warnings", "error_type", "error", "host", "pid", "user", "python", "spark", "run_state", "run_seconds")


class Busy(RuntimeError):
    """Another run holds the lock."""


@dataclass(frozen=True)
class Step:
    """A named piece of work on a day, after those it names."""

    name: str
    run: Callable[[dt.date], object]
    after: Sequence[str] = ()


@dataclass
class Outcome:
    states: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return all(s == "done" for s in self.states.values())


@contextlib.contextmanager
def serial(folder: str, stale_s: float = 1800, wait_s: float = 0, poll_s: float = 0.2) -> Iterator[None]:
    """Hold a lock that is a folder, made in one step. Its holder keeps it fresh as long as it runs; one that wasn't freshened for `stale_s` is taken over; after waiting `wait_s` for another, Busy. A holder that was taken over leaves the new one's lock alone."""
    token, until = uuid.uuid4().hex, time.monotonic() + wait_s
    while True:
        try:
            os.mkdir(folder)
            break
        except FileExistsError:
            with contextlib.suppress(FileNotFoundError):
                if time.time() - os.stat(folder).st_mtime > stale_s:
                    aside = f"{folder}.{token}"
                    os.rename(folder, aside)  # only one of several can
                    shutil.rmtree(aside, ignore_errors=True)
                    continue
            if time.monotonic() >= until:
                raise Busy(folder) from None
            time.sleep(poll_s)
    mine, done = os.path.join(folder, token), threading.Event()
    open(mine, "w").close()

    def freshen() -> None:
        while not done.wait(stale_s / 4):
            with contextlib.suppress(OSError):
                if os.path.exists(mine):
                    os.utime(folder)

    beat = threading.Thread(target=freshen, daemon=True)
    beat.start()
    try:
        yield
    finally:
        done.set()
        beat.join()
        if os.path.exists(mine):
            shutil.rmtree(folder, ignore_errors=True)


def order(steps: Sequence[Step]) -> list[Step]:
    """Steps with their predecessors first; an unknown name or a circle is an error."""
    by, out, open_ = {s.name: s for s in steps}, [], set()

    def visit(name: str) -> None:
        if name not in by:
            raise ValueError(f"no step {name}")
        if name in open_:
            raise ValueError(f"a circle through {name}")
        if by[name] in out:
            return
        open_.add(name)
        for a in by[name].after:
            visit(a)
        open_.remove(name)
        out.append(by[name])

    for s in steps:
        visit(s.name)
    return out


def record(path: str, rows: Sequence[Mapping[str, object]]) -> None:
    """Append rows to the ledger, a CSV file."""
    new = not os.path.exists(path)
    with open(path, "a", newline="") as f:
        w = csv.DictWriter(f, LEDGER)
        if new:
            w.writeheader()
        w.writerows(rows)


def run(day: dt.date, steps: Sequence[Step], ledger: str | None = None, lock: str | None = None, alert: Callable[[str, str], None] | None = None, parallel: int = 3, workflow: str = "", trigger: str = "manual", attempts: int = 1) -> Outcome:
    """Run the steps for a day. Those whose predecessors are done run side by side, each up to `attempts` times; after a failure nothing new begins, what is left is `skipped`, and `alert(step, error)` is called."""
    steps = order(steps)
    began_run, stamp = time.time(), lambda t: dt.datetime.fromtimestamp(t, dt.UTC).isoformat()
    out, run_id = Outcome(), f"{day}-{int(began_run * 1000)}"
    base = {"run_id": run_id, "workflow": workflow, "trigger": trigger, "day": day, "of": len(steps), "host": socket.gethostname(), "pid": os.getpid(), "user": getpass.getuser(), "python": platform.python_version(), "spark": _spark_version()}
    lines = {s.name: base | {"step": s.name, "number": i + 1, "after": " ".join(s.after), "state": "skipped"} for i, s in enumerate(steps)}

    def timed(s: Step) -> None:
        line, began = lines[s.name], time.time()
        line |= {"started": stamp(began), "waited": round(began - line.pop("queued_at"), 3)}
        for attempt in range(1, attempts + 1):
            line["attempt"] = attempt
            try:
                result = s.run(day)
                line |= {"state": "done", "result": str(result), "error": "", "error_type": "", "warnings": len(getattr(result, "warnings", ()))}
                break
            except Exception as e:  # noqa: BLE001 - any failure ends the run and goes to the ledger
                line |= {"state": "failed", "error_type": type(e).__name__, "error": f"{type(e).__name__}: {e}"[:500]}
        line |= {"ended": stamp(time.time()), "seconds": round(time.time() - began, 3)}

    with serial(lock) if lock else contextlib.nullcontext(), ThreadPoolExecutor(parallel) as pool:
        waiting, going = list(steps), {}
        while waiting or going:
            failed = "failed" in out.states.values()
            for s in [s for s in waiting if not failed and all(out.states.get(a) == "done" for a in s.after)]:
                waiting.remove(s)
                lines[s.name] |= {"queued": stamp(time.time()), "queued_at": time.time()}
                going[pool.submit(timed, s)] = s
            if not going:
                break
            done: set[Future]
            done, _ = wait(going, return_when=FIRST_COMPLETED)
            for f in done:
                s = going.pop(f)
                f.result()
                out.states[s.name] = lines[s.name]["state"]
                if error := lines[s.name].get("error"):
                    out.errors[s.name] = str(error)
                    if alert:
                        alert(s.name, str(error))
        for s in waiting:
            out.states[s.name] = "skipped"
    if ledger:
        whole = {"run_state": "done" if out.ok else "failed", "run_seconds": round(time.time() - began_run, 3)}
        record(ledger, [x | whole for x in lines.values()])
    return out


def _spark_version() -> str:
    import pyspark

    return pyspark.__version__


def done_in(ledger: str, step: str, day: dt.date, workflow: str | None = None) -> bool:
    """Whether a ledger says that the step was done for the day, at its last attempt."""
    if not os.path.exists(ledger):
        return False
    state = ""
    with open(ledger, newline="") as f:
        for r in csv.DictReader(f):
            if r["step"] == step and r["day"] == str(day) and workflow in (None, r["workflow"]):
                state = r["state"]
    return state == "done"


def wait_for(name: str, ledger: str, step: str, workflow: str | None = None, wait_s: float = 3600, poll_s: float = 5, after: Sequence[str] = ()) -> Step:
    """A step that waits until another workflow's ledger says that its step is done for the day; Busy after `wait_s`."""

    def waited(day: dt.date) -> str:
        until = time.monotonic() + wait_s
        while not done_in(ledger, step, day, workflow):
            if time.monotonic() >= until:
                raise Busy(f"{step} isn't done for {day} in {ledger}")
            time.sleep(poll_s)
        return "done"

    return Step(name, waited, after)


def backfill(first: dt.date, last: dt.date, steps: Sequence[Step], **options: object) -> dict[dt.date, Outcome]:
    """Run the steps for each day of a closed range, in order; it ends with the first day that fails."""
    out: dict[dt.date, Outcome] = {}
    day = first
    while day <= last:
        out[day] = run(day, steps, **options)
        if not out[day].ok:
            break
        day += dt.timedelta(days=1)
    return out
