"""Events, clocks and log set-up, on the driver."""

from __future__ import annotations

import datetime
import json
import logging
import uuid
from collections.abc import Callable
from zoneinfo import ZoneInfo

log = logging.getLogger("brindle")


def now_iso(zone: str = "Asia/Shanghai") -> str:
    return datetime.datetime.now(ZoneInfo(zone)).isoformat()


class Trace:
    """Logs events with a trace id, a start time and bound fields, one JSON line each."""

    def __init__(self, trace_id: str | None = None, clock: Callable[[], str] = now_iso, **bound):
        self.trace_id, self.started_at, self.bound = trace_id or uuid.uuid4().hex, clock(), bound

    def bind(self, **fields) -> Trace:
        return type(self)(self.trace_id, lambda: self.started_at, **(self.bound | fields))

    def event(self, name: str, **fields) -> None:
        log.info(json.dumps({"event": name, "trace_id": self.trace_id, **self.bound, **fields}, ensure_ascii=False, default=str))


class RecordedTrace(Trace):
    """Keeps its events, for tests."""

    def __init__(self, trace_id: str = "trace", clock: Callable[[], str] = lambda: "1970-01-01T00:00:00", **bound):
        super().__init__(trace_id, clock, **bound)
        self.events: list[tuple[str, dict]] = []

    def event(self, name: str, **fields) -> None:
        self.events.append((name, self.bound | fields))


def set_up_logging(path: str | None = None, level: int = logging.INFO) -> None:
    """To the console, and to ``path`` if there is one; a second call changes nothing."""
    if not log.handlers:
        form = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            handler.setFormatter(form)
            log.addHandler(handler)
        log.setLevel(level)
