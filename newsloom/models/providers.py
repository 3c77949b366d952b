"""State of model providers on the driver: order, cool-downs and daily counts. No dataflow."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field
from pathlib import Path

# Seconds.
LONG_PAUSE, LEAST_WAIT, MOST_WAIT, WAIT_BUDGET = 300, 30, 120, 1800
WEAK = ("-1b", "-3b", "nano", "tiny")


def is_weak(name: str, parts: tuple[str, ...] = WEAK) -> bool:
    return any(p in name.lower() for p in parts)


class Ring:
    """Models in the order in which they are tried: what failed goes to the end, what answered to the front."""

    def __init__(self, names: list[str]):
        self.names, self.until = list(names), dict.fromkeys(names, 0.0)

    def failed(self, name: str, now: float, retry_after: float = 0) -> None:
        self.names.remove(name)
        self.names.append(name)
        self.until[name] = now + retry_after

    def answered(self, name: str) -> None:
        self.names.remove(name)
        self.names.insert(0, name)

    def ready(self, now: float) -> list[str]:
        return [n for n in self.names if self.until[n] <= now]

    def wait(self, now: float, budget: float = WAIT_BUDGET) -> float:
        """How long to wait for the first model, between limits and within the budget."""
        return min(max(min(self.until.values(), default=now) - now, LEAST_WAIT), MOST_WAIT, budget)


@dataclass
class Quota:
    """Calls of each provider on one UTC day, kept in a file; a new day begins anew."""

    path: Path
    caps: dict[str, int] = field(default_factory=dict)

    def _load(self, today: datetime.date) -> dict:
        try:
            state = json.loads(self.path.read_text())
        except (OSError, ValueError):
            state = {}
        return state if state.get("date") == today.isoformat() else {"date": today.isoformat(), "providers": {}}

    def note(self, provider: str, now: datetime.datetime, remaining: int | None = None, retry_after: float = 0) -> None:
        """Counts a call; only a long pause blocks the provider."""
        state = self._load(now.date())
        p = state["providers"].setdefault(provider, {"used": 0, "remaining": None, "blocked_until": 0})
        p["used"] += 1
        p["remaining"] = remaining if remaining is not None else p["remaining"]
        p["blocked_until"] = now.timestamp() + retry_after if retry_after >= LONG_PAUSE else 0
        self.path.write_text(json.dumps(state))

    def may(self, provider: str, now: datetime.datetime) -> bool:
        p = self._load(now.date())["providers"].get(provider)
        return not p or (p["used"] < self.caps.get(provider, 1 << 62) and p["remaining"] != 0 and p["blocked_until"] <= now.timestamp())
