"""A stage graph with a failure policy: optional stages may fail, others stop the run."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    optional: bool = False


@dataclass
class Outcome:
    frames: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def ordered(stages: list[Stage]) -> list[Stage]:
    """Stages after what they need, else in the order given."""
    left, done, out = list(stages), set(), []
    names = {s.name for s in stages}
    while left:
        ready = next((s for s in left if all(n in done or n not in names for n in s.needs)), None)
        if ready is None:
            raise ValueError("stages need each other: " + ", ".join(s.name for s in left))
        left.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out


def run(stages: list[Stage], inputs: dict[str, DataFrame] | None = None) -> Outcome:
    """Frames stay lazy; an optional stage that fails is logged, and so are those that need it."""
    out = Outcome(dict(inputs or {}))
    for s in ordered(stages):
        began = time.time()
        try:
            if missing := [n for n in s.needs if n not in out.frames]:
                raise KeyError(f"{s.name} needs {', '.join(missing)}")
            out.frames[s.name] = s.run(out.frames)
        except Exception as e:
            if not s.optional:
                raise
            log.warning("stage %s failed: %s", s.name, e)
            out.failed[s.name] = str(e)
        out.seconds[s.name] = time.time() - began
    return out
