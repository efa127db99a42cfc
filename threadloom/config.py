"""What to collect, from a file: where to land, and per source its folder, patterns, mode and pace."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from .sources.tail import WINDOW
from .streaming.follow import Follow

__all__ = ["Config", "default", "load", "source_root"]

#: The source collected where none is named, what it leaves out, the landing root, and the seconds between passes.
SOURCE, EXCLUDE, ROOT, INTERVAL_S = "local", ("/private/tmp/**",), "./data", 5.0
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


@dataclass(frozen=True)
class Config:
    """The landing root, and the enabled sources by name."""

    root: str
    sources: tuple[Follow, ...]


def source_root(override: str = "", env: Mapping[str, str] | None = None) -> str:
    """The folder of transcripts: the one given, else what the runtime's own variables say, else its default."""
    env = os.environ if env is None else env
    if override:
        return os.path.abspath(override)
    if own := env.get("CLAUDE_CONFIG_DIR"):
        return os.path.join(own, "projects")
    if shared := env.get("XDG_CONFIG_HOME"):
        return os.path.join(shared, "claude", "projects")
    return os.path.join(env.get("HOME") or str(Path.home()), ".claude", "projects")


def seconds(text: str | float | None) -> float:
    """A duration such as 1m30s or 500ms, or a number of seconds; nothing is 0."""
    if text is None or isinstance(text, (int, float)):
        return float(text or 0)
    found = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not found or "".join(a + b for a, b in found) != text:
        raise ValueError(f"{text!r} is no duration")
    return sum(float(n) * UNITS[u] for n, u in found)


def default(root: str = ROOT) -> Config:
    return Config(root, (Follow(SOURCE, source_root(), root, INTERVAL_S, exclude=EXCLUDE),))


def load(path: str = "", env: Mapping[str, str] | None = None) -> Config:
    """The configuration of a JSON or YAML file (YAML where its library is there); without a path the default one.

    What a source leaves out has its default; a list of sources replaces the default source. ValueError: a source without a
    name, a name that repeats, or a mode that is none.
    """
    if not path:
        return default()
    text = Path(path).read_text()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    found = found or {}
    root = (found.get("storage") or {}).get("root") or ROOT
    sources, names = [], set()
    for i, one in enumerate(found.get("adapters") or ()):
        name, pace = one.get("name") or "", one.get("collector") or {}
        if not name:
            raise ValueError(f"source {i} has no name")
        if name in names:
            raise ValueError(f"two sources are named {name!r}")
        names.add(name)
        window = pace.get("max_delta_bytes") or 0
        made = Follow(
            name, source_root(one.get("source_root") or "", env), root, seconds(pace.get("interval")) or INTERVAL_S, include=tuple(one.get("include") or ()), exclude=tuple(one.get("exclude") or ()),
            window=window if window > 0 else WINDOW, mode=pace.get("mode") or "watch",
        )
        if one.get("enabled"):
            sources.append(made)
    return Config(root, tuple(sources) if found.get("adapters") else default(root).sources)
