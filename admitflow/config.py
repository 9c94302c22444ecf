"""Configuration files with inheritance."""

from __future__ import annotations

import json
from pathlib import Path


def deep_merge(base: dict, over: dict) -> dict:
    """Mappings merge, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | Path, _seen: tuple = ()) -> dict:
    """JSON or (with PyYAML) YAML; a "base" key names a file, beside this one, whose settings it extends."""
    path = Path(path).resolve()
    if path in _seen:
        raise ValueError(f"{path} inherits from itself")
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        body = json.loads(text)
    else:
        import yaml

        body = yaml.safe_load(text) or {}
    base = body.pop("base", None)
    return deep_merge(load_config(path.parent / base, (*_seen, path)), body) if base else body
