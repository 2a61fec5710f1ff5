"""Settings from the environment, read once into a plain record."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class Settings:
    poll_attempts: int = 12
    poll_first_wait: float = 1.0
    poll_longest_wait: float = 8.0
    poll_deadline: float = 120.0
    supplemental_pages: int = 2
    lookup_people: bool = False
    lookup_turnover: bool = True
    lookup_pause: float = 0.22

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "LEADWEAVE_") -> Settings:
        """Fields from variables like LEADWEAVE_POLL_ATTEMPTS; the defaults elsewhere."""
        env = dict(os.environ) if env is None else env
        found = {}
        for name, default in cls().__dict__.items():
            raw = env.get(prefix + name.upper())
            if raw is not None:
                found[name] = raw.lower() == "true" if isinstance(default, bool) else type(default)(raw)
        return cls(**found)


def throttled(items: Iterable[T], pause: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Iterator[T]:
    """The items with at least ``pause`` seconds between two: for live lookups inside mapInPandas, one pace a partition."""
    ready = clock()
    for item in items:
        if (wait := ready - clock()) > 0:
            sleep(wait)
        ready = clock() + pause
        yield item
