"""Small state that lives beside the engine: result caches, a circuit breaker, recall records."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Hashable
from typing import Any


class TimedCache:
    """Least recently used entries with a time to live, keyed by the whole query."""

    def __init__(self, size: int = 100, ttl_ms: int = 30 * 60_000):
        self.size, self.ttl_ms = size, ttl_ms
        self._rows: OrderedDict[Hashable, tuple[int, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable, now_ms: int) -> Any | None:
        held = self._rows.get(key)
        if held is None or now_ms - held[0] >= self.ttl_ms:
            self._rows.pop(key, None)
            self.misses += 1
            return None
        self._rows.move_to_end(key)
        self.hits += 1
        return held[1]

    def put(self, key: Hashable, value: Any, now_ms: int) -> None:
        self._rows[key] = (now_ms, value)
        self._rows.move_to_end(key)
        while len(self._rows) > self.size:
            self._rows.popitem(last=False)

    def hit_ratio(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class Breaker:
    """Opens after some failures in a row and lets one call through after a pause."""

    def __init__(self, failures: int = 5, pause_ms: int = 60_000):
        self.failures, self.pause_ms = failures, pause_ms
        self._failed, self._opened = 0, None

    def call(self, work: Callable[[], Any], now_ms: int) -> Any:
        if self._opened is not None and now_ms - self._opened < self.pause_ms:
            raise RuntimeError("the service is paused after failures")
        try:
            out = work()
        except Exception:
            self._failed += 1
            if self._failed >= self.failures:
                self._opened = now_ms
            raise
        self._failed, self._opened = 0, None
        return out


class Memo:
    """One call for each different argument, however often it is asked for."""

    def __init__(self, work: Callable[[Hashable], Any]):
        self._work, self._known = work, {}
        self.calls = 0

    def __call__(self, key: Hashable) -> Any:
        if key not in self._known:
            self.calls += 1
            self._known[key] = self._work(key)
        return self._known[key]


class RecallRecords:
    """The last recalls of each session until it ends or falls silent."""

    def __init__(self, records: int = 5, ttl_ms: int = 30 * 60_000, sessions: int = 256):
        self.records, self.ttl_ms, self.sessions = records, ttl_ms, sessions
        self._held: OrderedDict[str, deque] = OrderedDict()

    def add(self, session: str, query: str, ids: list[str], now_ms: int) -> None:
        self._held.setdefault(session, deque(maxlen=self.records)).append((now_ms, query, list(ids)))
        self._held.move_to_end(session)
        while len(self._held) > self.sessions:
            self._held.popitem(last=False)

    def consume(self, session: str, now_ms: int) -> tuple[str, list[str]] | None:
        """The last query and all ids since, once."""
        fresh = [r for r in self._held.pop(session, ()) if now_ms - r[0] < self.ttl_ms]
        return (fresh[-1][1], list(dict.fromkeys(i for r in fresh for i in r[2]))) if fresh else None

    def silent(self, now_ms: int, after_ms: int = 90_000) -> list[str]:
        return [s for s, held in self._held.items() if now_ms - held[-1][0] >= after_ms]
