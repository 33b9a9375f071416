"""Settings: an argument, else an environment variable, else a line of a .env file, else the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "FACTLOOM_"


@dataclass(frozen=True)
class Settings:
    tables: str = "tables"
    models: tuple[str, ...] = ()
    budget: int = 150
    deadline: float = 60.0
    offline: bool = False


def _lines(path: str) -> dict[str, str]:
    file = Path(path)
    pairs = (x.removeprefix("export ").partition("=") for x in map(str.strip, file.read_text().splitlines() if file.is_file() else ()) if "=" in x and not x.startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def _read(raw: str, default):
    """The text as a value of the default's kind; what isn't one gives the default."""
    if isinstance(default, tuple):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    if isinstance(default, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on") if raw else default
    try:
        least = 1 if isinstance(default, int) else 0.1
        return default if not raw.strip() else max(least, type(default)(raw.strip())) if isinstance(default, int | float) else raw
    except ValueError:
        return default


def settings(env_file: str = ".env", **given) -> Settings:
    """An empty list of models is a choice; another empty text counts as unset. Numbers are raised to the least that makes sense."""
    file, out = _lines(env_file), {}
    for f in fields(Settings):
        raw = os.environ.get(PREFIX + f.name.upper(), file.get(PREFIX + f.name.upper()))
        out[f.name] = given[f.name] if given.get(f.name) is not None else f.default if raw is None else _read(raw, f.default)
    return Settings(**out)
