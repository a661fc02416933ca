"""Stages run in one process on one session: a fold over the stages that returns the record of the run."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from fixtura.sources.files import write_report


@dataclass(frozen=True)
class Stage:
    name: str
    work: Callable[[], object]
    optional: bool = False

    def __post_init__(self) -> None:
        if not self.name.strip() or not callable(self.work):
            raise ValueError("a stage needs a name and something to do")


@dataclass(frozen=True)
class Outcome:
    """What became of a stage: success, failed or skipped; how long it took and what it printed."""

    stage: str
    status: str
    seconds: float = 0.0
    printed: str = ""
    message: str = ""


@dataclass(frozen=True)
class Run:
    """The record of a run; `broken` names the stage whose failure skips what comes after it."""

    pipeline: str
    run_id: str
    outcomes: tuple[Outcome, ...] = ()
    broken: str | None = None

    @property
    def succeeded(self) -> bool:
        return self.broken is None

    def or_raise(self) -> Run:
        if self.broken:
            raise RunFailed(self)
        return self


class RunFailed(RuntimeError):
    """Carries the record of the run up to the failure."""

    def __init__(self, run: Run) -> None:
        super().__init__(f"{run.pipeline}: {run.broken} failed")
        self.run = run


def run_id(at: datetime | None = None) -> str:
    """Ids of later runs sort after those of earlier ones."""
    return f"{(at or datetime.now(UTC)).astimezone(UTC):%Y%m%dT%H%M%S%fZ}"


def attempt(stage: Stage) -> Outcome:
    """The stage done, with what it printed; an exception is its outcome."""
    printed, start = io.StringIO(), time.perf_counter()
    message, status = "", "success"
    with contextlib.redirect_stdout(printed):
        try:
            stage.work()
        except Exception as e:  # noqa: BLE001
            status, message = "failed", f"{type(e).__name__}: {e}"
    return Outcome(stage.name, status, time.perf_counter() - start, printed.getvalue(), message)


def run_stages(pipeline: str, stages: list[Stage], continue_after_optional: bool = True) -> Run:
    if not pipeline.strip() or not stages:
        raise ValueError("a pipeline needs a name and stages")

    def step(run: Run, stage: Stage) -> Run:
        if run.broken:
            return replace(run, outcomes=(*run.outcomes, Outcome(stage.name, "skipped", message=f"after {run.broken}")))
        outcome = attempt(stage)
        fatal = outcome.status == "failed" and not (stage.optional and continue_after_optional)
        return replace(run, outcomes=(*run.outcomes, outcome), broken=stage.name if fatal else None)

    return reduce(step, stages, Run(pipeline, run_id()))


def write_run(run: Run, folder: str) -> Path:
    """The run's record, and latest.json pointing to it."""
    path = write_report(asdict(run) | {"succeeded": run.succeeded}, f"{folder}/{run.run_id}.json")
    write_report({"run_id": run.run_id, "path": str(path)}, f"{folder}/latest.json")
    return path
