"""Configuration: nested dataclasses from JSON or YAML with defaults, values of the environment, and back to text."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any, TypeVar, get_args, get_type_hints

T = TypeVar("T")

#: Switches that the environment can set, by name.
SWITCHES = {"ENABLE_ARTIFACTS": True}


def from_dict(kind: type[T], values: Mapping[str, Any]) -> T:
    """A dataclass from a mapping: what it doesn't name is left out, what the mapping doesn't have keeps its default; nested dataclasses, and tuples of them, likewise."""
    hints, out = get_type_hints(kind), {}
    for f in dataclasses.fields(kind):
        if f.name not in values:
            continue
        value, hint = values[f.name], hints[f.name]
        if dataclasses.is_dataclass(hint) and isinstance(value, Mapping):
            value = from_dict(hint, value)
        elif isinstance(value, list):
            item = get_args(hint)[:1]
            made = [from_dict(item[0], v) if item and dataclasses.is_dataclass(item[0]) and isinstance(v, Mapping) else v for v in value]
            value = tuple(made) if getattr(hint, "__origin__", hint) is tuple else made
        out[f.name] = value
    return kind(**out)


def to_dict(config: Any) -> dict[str, Any]:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in dataclasses.asdict(config).items()}


def parsed(text: str, name: str = "") -> dict[str, Any]:
    """JSON, or YAML where its parser is installed."""
    if name.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise RuntimeError("YAML needs the yaml package; JSON does without") from None
        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(kind: type[T], path: str | None = None, env: Mapping[str, str] | None = None, from_env: Mapping[str, str] | None = None) -> T:
    """The file's configuration; without a file the defaults, with fields that from_env fills (field: variable) where these are set."""
    if path and os.path.exists(path):
        return from_dict(kind, parsed(Path(path).read_text(encoding="utf-8"), path))
    env = os.environ if env is None else env
    return from_dict(kind, {f: env[v] for f, v in (from_env or {}).items() if v in env})


def dump(config: Any, path: str) -> None:
    values = to_dict(config)
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump(values, sort_keys=False)
    else:
        text = json.dumps(values, indent=2, ensure_ascii=False)
    Path(path).write_text(text, encoding="utf-8")


def switch(name: str, env: Mapping[str, str] | None = None) -> bool:
    """On where the variable says true in any case, or where it is unset and on by default."""
    value = (os.environ if env is None else env).get(name)
    return SWITCHES.get(name, False) if value is None else value.strip().lower() == "true"
