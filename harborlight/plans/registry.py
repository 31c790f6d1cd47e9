"""Every plan by name, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

PLANS: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def plan(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def keep(f: Callable) -> Callable:
        PLANS[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


from harborlight.plans import entities, graphs, places, ranks, rollups, search, streams, views  # noqa: E402, F401
