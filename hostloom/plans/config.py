"""Settings: defaults, a file and the environment, merged in this order; checked; read by dotted names."""

from __future__ import annotations

import json
import os
import shutil
from copy import deepcopy
from pathlib import Path
from typing import Any

from ..functions import constants as K

DEFAULTS: dict[str, Any] = {
    "data_sources": [],
    "scan": {"sample_percent": 10, "max_rows_per_table": 100_000, "datasets_filter": [], "tables_filter": []},
    "discovery": {"column_rules": {c: [list(r) for r in rules] for c, rules in K.COLUMN_RULES.items()}},
    "ensemble": {"weights": dict(K.ENSEMBLE_WEIGHTS)},
    "resolution": {"threshold": 0.8, "comparison_threshold": 0.7},
    "output": {"path": "output", "formats": ["parquet", "json"]},
}
PREFIX = "HOSTLOOM_"
PROFILES: dict[str, dict[str, Any]] = {
    "development": {"scan": {"sample_percent": 1, "max_rows_per_table": 1000}},
    "production": {"scan": {"sample_percent": 100, "max_rows_per_table": 1_000_000_000}},
}


def merged(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers win; dicts are merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def from_environment(env: dict[str, str]) -> dict[str, Any]:
    """HOSTLOOM_A__B=1 is {"a": {"b": 1}}; values are JSON where they can be read as such."""
    out: dict[str, Any] = {}
    for name, text in env.items():
        if name.startswith(PREFIX):
            try:
                value = json.loads(text)
            except ValueError:
                value = text
            *path, last = name.removeprefix(PREFIX).lower().split("__")
            at = out
            for part in path:
                at = at.setdefault(part, {})
            at[last] = value
    return out


def flattened(values: dict[str, Any], path: tuple[str, ...] = ()) -> dict[str, str]:
    """The inverse of from_environment."""
    out: dict[str, str] = {}
    for key, value in values.items():
        if isinstance(value, dict) and value:
            out |= flattened(value, (*path, key))
        else:
            out[PREFIX + "__".join((*path, key)).upper()] = json.dumps(value)
    return out


class Config:
    def __init__(self, values: dict[str, Any] | None = None, profile: str | None = None):
        self.values = merged(DEFAULTS, PROFILES[profile] if profile else {}, values or {})

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, profile: str | None = None) -> Config:
        given = json.loads(Path(os.path.expandvars(os.path.expanduser(path))).read_text()) if path else {}
        out = cls(merged(given, from_environment(dict(os.environ) if env is None else env)), profile)
        if wrong := out.problems():
            raise ValueError("; ".join(wrong))
        return out

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    def problems(self) -> list[str]:
        checks = {
            "scan.sample_percent": lambda x: isinstance(x, (int, float)) and 0 < x <= 100,
            "scan.max_rows_per_table": lambda x: isinstance(x, int) and x > 0,
            "resolution.threshold": lambda x: isinstance(x, (int, float)) and 0 <= x <= 1,
            "ensemble.weights": lambda x: isinstance(x, dict) and all(isinstance(w, (int, float)) and w >= 0 for w in x.values()),
            "data_sources": lambda x: isinstance(x, list),
        }
        return [f"{name} has the value {self.get(name)!r}" for name, good in checks.items() if not good(self.get(name))]

    def save(self, path: str) -> None:
        """Writes the settings; what was there is kept beside it as .bak and put back if writing fails."""
        target, backup = Path(path), Path(path + ".bak")
        if target.exists():
            shutil.copy2(target, backup)
        try:
            target.write_text(self.export("json"))
        except OSError:
            if backup.exists():
                shutil.copy2(backup, target)
            raise

    def export(self, form: str = "json") -> str:
        """json, env or yaml (which JSON is a part of)."""
        if form == "env":
            return "\n".join(f"{k}={v}" for k, v in sorted(flattened(self.values).items())) + "\n"
        if form not in ("json", "yaml"):
            raise ValueError(f"no such form: {form}")
        return json.dumps(self.values, indent=2, sort_keys=True)

    def summary(self) -> dict[str, Any]:
        return {"data_sources": len(self.get("data_sources")), "rules": sum(map(len, self.get("discovery.column_rules").values())), "sample_percent": self.get("scan.sample_percent")}
