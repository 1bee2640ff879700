"""Settings from TOML: a repository's own file, else the user's, else defaults; never merged."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

#: Owners that are always trusted.
TRUSTED_OWNERS = ("actions", "github")


@dataclass(frozen=True)
class Config:
    fetch_remote: bool = False
    severity: str = "low"
    ignore_actions: tuple[str, ...] = ()
    ignore_patterns: tuple[str, ...] = ()
    extra_data_formats: tuple[str, ...] = ()
    trusted_hosts: tuple[str, ...] = ()
    trusted_owners: tuple[str, ...] = ()

    def owners(self) -> list[str]:
        return sorted({o.lower() for o in (*TRUSTED_OWNERS, *self.trusted_owners)})


def severity_rank(severity: str) -> int:
    """high 2, medium 1, everything else 0; in lower case only."""
    return {"high": 2, "medium": 1}.get(severity, 0)


def parse_config(text: str) -> Config | None:
    """Settings from TOML with kebab-case keys; None if it is invalid. Unknown keys are left alone."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None
    flat: dict[str, Any] = {k.replace("-", "_"): v for k, v in raw.items() if k != "ignore"}
    ignore = raw.get("ignore", {})
    if not isinstance(ignore, dict):
        return None
    flat |= {f"ignore_{k}": v for k, v in ignore.items()}
    known: dict[str, Any] = {}
    for f in fields(Config):
        if f.name not in flat:
            continue
        value, want = flat[f.name], type(f.default)
        if want is tuple:
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                return None
            value = tuple(value)
        elif not isinstance(value, want):
            return None
        known[f.name] = value
    return Config(**known)


def load_config(local: str | Path | None = None, user: str | Path | None = None) -> Config:
    """The first of the two files that can be read and is valid."""
    for path in (local, user):
        try:
            found = parse_config(Path(path).read_text()) if path else None
        except (OSError, UnicodeDecodeError):
            found = None
        if found is not None:
            return found
    return Config()
