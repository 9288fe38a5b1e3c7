"""Display choices of the result list, decided on the driver."""

from __future__ import annotations

import math

MODES = ("title", "default", "verbose")
LABELS = {"title": ("Title", "Only titles"), "default": ("Default", "Titles and a short excerpt"), "verbose": ("Verbose", "Titles and a long excerpt")}
PRESET_DAYS = (1, 7, 30, 365)
DAY = 86_400_000


def display_mode(value: object) -> str:
    return value if value in MODES else "default"


def next_mode(mode: str) -> str:
    return MODES[(MODES.index(display_mode(mode)) + 1) % len(MODES)]


def result_columns(mode: str) -> list[str]:
    """Columns a mode shows."""
    return ["title", "path", "score", "tags"] + {"title": [], "default": ["snippet"], "verbose": ["verbose_snippet"]}[display_mode(mode)]


def verbose_context(value: float | None) -> int:
    """Characters of context: rounded, 20 to 1000, 100 for what is no finite number."""
    if value is None or not math.isfinite(value):
        return 100
    return min(1000, max(20, math.floor(value + 0.5)))


def modified_since(days: int, now: int) -> int:
    """Start of a preset of recent days."""
    if days not in PRESET_DAYS:
        raise ValueError(f"{days} is no preset; presets are {PRESET_DAYS}")
    return now - days * DAY


def modified_days(since: int | None, now: int) -> int | None:
    """The preset that ``since`` belongs to, if any."""
    days = None if since is None else round((now - since) / DAY)
    return days if days in PRESET_DAYS else None
