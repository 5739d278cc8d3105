"""What the services answer, as functions: days, instruments, levels with reviews, charts, and runs of steps."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zone_id
from ..operators.charts import levels_with_events
from ..operators.dml import BEHAVIORS, GRADES, MAX_COMMENT, QUALITIES, delete, upsert, valid_review
from .pipeline import parse_day

REVIEW_KEYS = ["trading_day", "instrument", "zone_id"]
ZONE_TEXT = ["node_types", "center", "lower", "upper"]
#: Lines that a task's log keeps, charts that are remembered, and steps in order.
LOG_LINES, CHARTS, STEPS = 5000, 16, ("1min", "profile", "visual")


def health() -> dict:
    """That the process answers, and what it is."""
    return {"ok": True, "service": "barflow"}


def config() -> dict:
    """What a page needs to know before it asks: the steps of a run, and what a review may say."""
    return {"steps": [*STEPS, "all"], "grades": list(GRADES), "behaviors": list(BEHAVIORS), "qualities": list(QUALITIES), "maxComment": MAX_COMMENT}


def days(catalog: DataFrame) -> DataFrame:
    return catalog.select("day").distinct().orderBy(F.desc("day"))


def instruments(catalog: DataFrame, day: str) -> DataFrame:
    parse_day(day)
    return catalog.filter(F.col("day") == day).orderBy("name")


def levels(level_rows: DataFrame, event_rows: DataFrame, reviews: DataFrame, day: str, instrument: str) -> DataFrame:
    """An instrument's levels (as text) with outcome and review. event_rows needs event_no."""
    parse_day(day)
    own = lambda df: df.filter((F.col("trading_day") == day) & (F.col("instrument") == instrument))
    joined = levels_with_events(own(level_rows), own(event_rows), ZONE_TEXT)
    named = joined.withColumn("zone_id", zone_id(F.col("trading_day"), F.col("instrument"), F.col("node_types"), F.col("lower"), F.col("upper"), F.col("available_time")))
    return named.join(own(reviews), REVIEW_KEYS, "left")


def put_review(reviews: DataFrame, change: DataFrame) -> DataFrame:
    """reviews with the change; a new one for a key replaces all but its created_at. Values out of their lists raise."""
    ok = valid_review(F.col("grade"), F.col("behavior"), F.col("quality"), F.col("comment"))
    return upsert(reviews, change.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid review")))).withColumn("seq", F.lit(0)), REVIEW_KEYS, keep_old=["created_at"])


def drop_review(reviews: DataFrame, key: DataFrame) -> DataFrame:
    return delete(reviews, key, REVIEW_KEYS)


def list_reviews(reviews: DataFrame, day: str, instrument: str | None = None) -> DataFrame:
    out = reviews.filter(F.col("trading_day") == day)
    return (out if instrument is None else out.filter(F.col("instrument") == instrument)).orderBy("instrument", "center")


class Charts:
    """Payloads by file, remembered while its length and time of change stay the same; the oldest goes when there are many."""

    def __init__(self, make: Callable[[str], str], keep: int = CHARTS):
        self.make, self.keep = make, keep
        self.known: OrderedDict[tuple, str] = OrderedDict()

    def get(self, path: str, length: int, modified: object) -> str:
        key = (path, length, modified)
        if key not in self.known:
            self.known[key] = self.make(path)
            while len(self.known) > self.keep:
                self.known.popitem(last=False)
        return self.known[key]


@dataclass
class Task:
    day: str
    steps: list[str]
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "queued"
    step: str | None = None
    started: float = field(default_factory=time.time)
    log: deque = field(default_factory=lambda: deque(maxlen=LOG_LINES))


class Tasks:
    """Runs of steps at the driver: in order, ending at the first failure, one active run a day."""

    def __init__(self, actions: dict[str, Callable[[str, Callable[[str], None]], None]]):
        self.actions, self.all, self.lock, self.changed = actions, {}, threading.Lock(), threading.Condition()

    def start(self, day: str, step: str) -> Task:
        parse_day(day)
        steps = list(STEPS) if step == "all" else [step]
        if any(s not in STEPS for s in steps):
            raise ValueError(f"no step: {step!r}")
        with self.lock:
            if any(t.day == day and t.state in ("queued", "running") for t in self.all.values()):
                raise RuntimeError(f"a run of {day} is active")
            task = Task(day, steps)
            self.all[task.id] = task
        threading.Thread(target=self._run, args=(task,), daemon=True).start()
        return task

    def _tell(self, task: Task, **change) -> None:
        with self.changed:
            for k, v in change.items():
                task.log.append(v) if k == "line" else setattr(task, k, v)
            self.changed.notify_all()

    def _run(self, task: Task) -> None:
        try:
            for step in task.steps:
                self._tell(task, state="running", step=step)
                self.actions[step](task.day, lambda line: self._tell(task, line=line))
            self._tell(task, state="done")
        except Exception as e:  # noqa: BLE001 - the task says so
            self._tell(task, line=f"{type(e).__name__}: {e}")
            self._tell(task, state="failed")

    def listed(self) -> list[Task]:
        return sorted(self.all.values(), key=lambda t: -t.started)

    def events(self, task_id: str, timeout: float = 60) -> Iterator[dict]:
        """What changes in a task, until it has ended."""
        task, seen = self.all[task_id], None
        while True:
            with self.changed:
                now = {"state": task.state, "step": task.step, "log": list(task.log)}
                if now == seen:
                    self.changed.wait(timeout)
                    continue
            yield now
            seen = now
            if now["state"] in ("done", "failed"):
                return
