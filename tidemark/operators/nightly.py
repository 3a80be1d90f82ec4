"""The nightly synthesis run: its window, its phases and its stamp."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

OVERLAP = timedelta(hours=24)
PHASES = ("dream", "demand", "wiki", "lint")


def window_start(last_run: datetime | None) -> datetime | None:
    """Units since then are looked at again: the last run less the overlap, or all of them."""
    return None if last_run is None else last_run - OVERLAP


def run(phases: dict[str, Callable[[datetime | None], dict]], last_run: datetime | None, now: datetime, stamp: Callable[[datetime], None]) -> dict[str, dict]:
    """Runs the phases in their fixed order and stamps the run after the last one; a phase that fails ends the run without
    a stamp, so the next run covers the same window. Each phase gets the window's start and returns its report; targeted
    compilation (demand) comes before the pages (wiki), which see its units in the same run."""
    since, reports = window_start(last_run), {}
    for name in PHASES:
        reports[name] = phases[name](since if name == "dream" else None)
    stamp(now)
    return reports
