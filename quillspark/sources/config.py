"""Nested configuration: files, dotted overrides, look-ups, paths."""

from __future__ import annotations

import ast
import json
import os
from collections.abc import Iterable
from pathlib import Path
from typing import Any


def literal(raw: str) -> Any:
    """A Python or JSON-like literal (true, none, 5, 0.3, [1]), else the text itself."""
    known = {"true": True, "false": False, "none": None, "null": None}
    if raw.lower() in known:
        return known[raw.lower()]
    try:
        return ast.literal_eval(raw)
    except (ValueError, SyntaxError):
        return raw


def load_config(path: str | Path, overrides: Iterable[str] = ()) -> dict[str, Any]:
    """A JSON file, or a YAML one where a YAML reader is installed, with ``a.b=value`` overrides on top."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text) or {}
    for item in overrides:
        key, sign, raw = item.partition("=")
        if not sign:
            raise ValueError(f"expected key=value: {item!r}")
        place = config
        *above, last = key.strip().split(".")
        for part in above:
            if not isinstance(place.get(part), dict):
                place[part] = {}
            place = place[part]
        place[last] = literal(raw.strip())
    return config


def get(config: dict[str, Any], dotted: str, default: Any = None) -> Any:
    for part in dotted.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def tagged(path: str | Path, mock: bool) -> Path:
    """Mock runs write beside real ones, under a prefixed name."""
    p = Path(path)
    return p.with_name(f"mock_{p.name}") if mock else p


def load_env(path: str | Path) -> int:
    """Sets the variables of a KEY=VALUE file that aren't set yet; returns how many."""
    p, n = Path(path), 0
    for line in p.read_text(encoding="utf-8").splitlines() if p.exists() else []:
        key, sign, value = line.strip().partition("=")
        if sign and not key.startswith("#") and key.strip() not in os.environ:
            os.environ[key.strip()] = value.strip().strip("\"'")
            n += 1
    return n
