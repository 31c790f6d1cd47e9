"""Which datasets to look at next, and which to fetch again."""

from __future__ import annotations

from datetime import datetime, timedelta

# The pace of freshness checks.
COOLDOWN = timedelta(hours=6)
RUNS_PER_TICK = 10
DATASETS_PER_TICK = 15


def next_chunk(names: list[str], at: int, size: int = DATASETS_PER_TICK) -> tuple[list[str], int]:
    """(the names of this tick, where the next tick starts); round the list and from the start again."""
    if not names:
        return [], 0
    at %= len(names)
    end = at + size
    return names[at:end], end if end < len(names) else 0


def due(statuses: list[tuple[str, str]], last_run: dict[str, datetime], now: datetime, most: int = RUNS_PER_TICK) -> list[str]:
    """The stale datasets to fetch now: not fetched within the cooldown, at most so many, the longest waiting first."""
    never = datetime.min.replace(tzinfo=now.tzinfo)
    waiting = [(last_run.get(n, never), i, n) for i, (n, s) in enumerate(statuses) if s == "stale" and (n not in last_run or now - last_run[n] >= COOLDOWN)]
    return [n for _, _, n in sorted(waiting)[:most]]
