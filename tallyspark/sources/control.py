"""Driver-side control of ingestion: state documents, a rate limiter, retries. Small files, no Spark."""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from threading import Lock

STATES = ("not_started", "in_progress", "completed", "failed")
RETRIED = {429, 500, 502, 503, 504}


def write_json(path: str | Path, document: dict) -> None:
    """Write beside the target and rename, so that a reader sees the old document or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        json.dump(document, f, indent=1, sort_keys=True)
    os.replace(name, path)


def raw_path(root: str | Path, kind: str, season: str, season_type: str, game_id: str | None = None) -> Path:
    """Where a payload lies: a season's, or a game's (digits only)."""
    if game_id is not None and not game_id.isdigit():
        raise ValueError(f"not a game id: {game_id}")
    base = Path(root) / kind / season / season_type
    return base / f"{game_id.zfill(10)}.json" if game_id else base.with_suffix(".json")


@dataclass
class Progress:
    """How far a season's ingestion is: the schedule's state, and for each endpoint the games done and failed."""

    schedule: str = "not_started"
    games: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def mark_schedule(self, state: str) -> None:
        if state not in STATES:
            raise ValueError(f"unknown state: {state}")
        self.schedule = state

    def mark_game(self, endpoint: str, game: str, done: bool) -> None:
        sets = self.games.setdefault(endpoint, {"completed": [], "failed": []})
        for name, at in (("completed", done), ("failed", not done)):
            held = set(sets[name])
            (held.add if at else held.discard)(game)
            sets[name] = sorted(held)

    def pending(self, endpoint: str, games: list[str]) -> list[str]:
        """Games not done yet, in their order; failed ones are tried again."""
        done = set(self.games.get(endpoint, {}).get("completed", []))
        return [g for g in games if g not in done]

    def complete(self, endpoint: str, games: list[str]) -> bool:
        return self.schedule == "completed" and not self.pending(endpoint, games)

    def save(self, path: str | Path) -> None:
        write_json(path, asdict(self))

    @classmethod
    def load(cls, path: str | Path) -> Progress:
        return cls(**json.loads(Path(path).read_text())) if Path(path).exists() else cls()


class RateLimiter:
    """At most `limit` calls in any `seconds`, with a little jitter. Thread-safe; the clock can be given."""

    def __init__(self, limit: int = 30, seconds: float = 60.0, jitter: float = 0.25, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limit, self.seconds, self.jitter, self.clock, self.sleep = limit, seconds, jitter, clock, sleep
        self.calls: deque[float] = deque()
        self.lock = Lock()

    def acquire(self) -> None:
        with self.lock:
            now = self.clock()
            while self.calls and self.calls[0] <= now - self.seconds:
                self.calls.popleft()
            wait = self.calls[0] + self.seconds - now if len(self.calls) >= self.limit else 0.0
            if wait > 0:
                self.calls.popleft()
            self.calls.append(now + wait)
        self.sleep(wait + random.uniform(0, self.jitter))


def fetch(get: Callable[[str, dict], tuple[int, dict]], endpoint: str, params: dict, limiter: RateLimiter, attempts: int = 5, most: float = 60.0) -> dict:
    """Call `get` with sorted parameters; wait longer after each failure that may pass (busy, server, connection)."""
    said = "no attempt"
    for n in range(attempts):
        limiter.acquire()
        try:
            status, body = get(endpoint, dict(sorted(params.items())))
            if status == 200:
                return body
            said = f"status {status}"
            if status not in RETRIED:
                break
        except (ConnectionError, TimeoutError) as e:
            said = repr(e)
        limiter.sleep(min(most, 2.0**n) + random.uniform(0, limiter.jitter))
    raise RuntimeError(f"{endpoint}: {said}")
