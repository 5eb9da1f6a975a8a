"""Settings: environment before file before default, every missing name told at once, secrets masked."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Setting:
    name: str
    default: str | None = None
    secret: bool = False
    required_in: tuple[str, ...] = ()


class MissingSettings(ValueError):
    """Names every setting that a mode needs and does not have."""


def read_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank and other lines are passed over, quotes around values fall."""
    out = {}
    for line in text.splitlines():
        found = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if found and not line.lstrip().startswith("#"):
            value = found[2]
            out[found[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(settings: Iterable[Setting], mode: str, environment: Mapping[str, str], file: Mapping[str, str] | None = None) -> dict[str, str | None]:
    settings = list(settings)
    values = {s.name: next((v for v in (environment.get(s.name), (file or {}).get(s.name), s.default) if v), None) for s in settings}
    missing = [s.name for s in settings if mode in s.required_in and not values[s.name]]
    if missing:
        raise MissingSettings(f"mode {mode} needs {', '.join(missing)}")
    return values


def mask(value: str | None) -> str:
    return "" if not value else "****" if len(value) < 8 else "****" + value[-4:]


def report(settings: Iterable[Setting], values: Mapping[str, str | None]) -> str:
    """A line for each setting; secrets show four characters at most."""
    return "\n".join(f"{s.name}={mask(values.get(s.name)) if s.secret else values.get(s.name) or ''}" for s in settings)


def example(settings: Iterable[Setting]) -> str:
    return "\n".join(f"{s.name}={'' if s.secret else s.default or ''}" for s in settings) + "\n"


def out_of_step(settings: Iterable[Setting], file: Mapping[str, str]) -> tuple[set[str], set[str]]:
    """Names only in the catalogue, and names only in the file."""
    names = {s.name for s in settings}
    return names - set(file), set(file) - names
