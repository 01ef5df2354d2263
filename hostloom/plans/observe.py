"""Logging: JSON lines, timings of steps and their statistics, an audit trail, levels for a while."""

from __future__ import annotations

import contextlib
import functools
import json
import logging
import time
from collections import defaultdict
from collections.abc import Callable, Iterator

COLOURS = {"DEBUG": 36, "INFO": 32, "WARNING": 33, "ERROR": 31, "CRITICAL": 35}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out | getattr(record, "fields", {}))


class ColourFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\033[{COLOURS.get(record.levelname, 0)}m{super().format(record)}\033[0m"


def set_up(level: str = "INFO", form: str = "plain", path: str | None = None) -> logging.Logger:
    log = logging.getLogger("hostloom")
    handler = logging.FileHandler(path) if path else logging.StreamHandler()
    handler.setFormatter({"json": JsonFormatter, "colour": ColourFormatter, "plain": logging.Formatter}[form]())
    log.handlers[:] = [handler]
    log.setLevel(level)
    return log


class Timings:
    """Seconds of named steps, and their count, mean, least, most and total."""

    def __init__(self) -> None:
        self.seconds: dict[str, list[float]] = defaultdict(list)

    @contextlib.contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name].append(time.perf_counter() - began)

    def timed(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kwargs):
            with self.step(f.__qualname__):
                return f(*args, **kwargs)

        return run

    def statistics(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "mean": sum(v) / len(v), "min": min(v), "max": max(v), "total": sum(v)} for k, v in self.seconds.items()}


@contextlib.contextmanager
def level(log: logging.Logger, name: str) -> Iterator[None]:
    before = log.level
    log.setLevel(name)
    try:
        yield
    finally:
        log.setLevel(before)


def audit(log: logging.Logger, action: str, **fields: object) -> None:
    log.info("audit %s", action, extra={"fields": {"action": action, **fields}})
