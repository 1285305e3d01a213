"""Settings with defaults; what is invalid is left at its default and named in a warning."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

CAPS = {"siblings": 5, "utilities": 3, "symbols": 5, "related": 3, "ancestors": 3, "pattern_members": 3, "companion_members": 2}
GATEWAYS = {"vercel": "AI_GATEWAY_API_KEY", "openrouter": "OPENROUTER_API_KEY", "ollama": None}


@dataclass(frozen=True)
class EngineConfig:
    sensitivity: float = 2.0
    disable: frozenset[str] = frozenset()
    caps: dict[str, int] = field(default_factory=lambda: dict(CAPS))
    keywords: tuple[str, ...] = ()
    dictionary: dict[str, str] = field(default_factory=dict)
    gateway: str | None = None


def _positive(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and x == x and 0 < x < float("inf")


def validate(raw: Any, audits: set[str] | None = None) -> tuple[EngineConfig, list[str]]:
    warnings: list[str] = []
    config = EngineConfig()
    if not isinstance(raw, dict):
        return config, ["the settings are not an object"]
    part = raw.get("audits", {})
    if not isinstance(part, dict):
        warnings.append("audits is not an object")
        part = {}
    if "sensitivity" in part:
        if _positive(part["sensitivity"]):
            config = replace(config, sensitivity=float(part["sensitivity"]))
        else:
            warnings.append("audits.sensitivity must be a positive number")
    names = part.get("disable", [])
    if isinstance(names, list):
        known = {n for n in names if isinstance(n, str) and (audits is None or n in audits)}
        warnings += [f"unknown audit {n!r}" for n in names if n not in known]
        config = replace(config, disable=frozenset(known))
    else:
        warnings.append("audits.disable must be a list")
    caps = raw.get("brief", {})
    if isinstance(caps, dict):
        good = {k: v for k, v in caps.items() if k in CAPS and isinstance(v, int) and not isinstance(v, bool) and v >= 0}
        warnings += [f"brief.{k} is ignored" for k in caps if k not in good]
        config = replace(config, caps=CAPS | good)
    else:
        warnings.append("brief is not an object")
    words = raw.get("keywords", [])
    if isinstance(words, list) and all(isinstance(w, str) for w in words):
        config = replace(config, keywords=tuple(words))
    else:
        warnings.append("keywords must be a list of strings")
    terms = raw.get("dictionary", {})
    if isinstance(terms, dict) and all(isinstance(v, str) for v in terms.values()):
        config = replace(config, dictionary=dict(terms))
    else:
        warnings.append("dictionary must map strings to strings")
    gateway = raw.get("gateway")
    if gateway is not None:
        if gateway in GATEWAYS:
            config = replace(config, gateway=gateway)
        else:
            warnings.append(f"unknown gateway {gateway!r}")
    return config, warnings


def load(text: str | None, audits: set[str] | None = None) -> tuple[EngineConfig, list[str]]:
    """From JSON text; defaults where there is none or it cannot be read."""
    if text is None:
        return EngineConfig(), []
    try:
        return validate(json.loads(text), audits)
    except json.JSONDecodeError as e:
        return EngineConfig(), [f"the settings cannot be read: {e}"]


def parse_sensitivity(given: str | None, default: float) -> float:
    try:
        x = float(given) if given is not None else default
    except ValueError:
        return default
    return x if _positive(x) else default


def validate_descriptions(raw: Any) -> list[dict[str, str]]:
    """A list of {name, description}; anything else is an error."""
    if not isinstance(raw, list):
        raise ValueError("descriptions must be a list")
    for k, entry in enumerate(raw):
        if not isinstance(entry, dict) or not all(isinstance(entry.get(f), str) and entry[f].strip() for f in ("name", "description")):
            raise ValueError(f"entry {k} needs a name and a description")
    return [{"name": e["name"], "description": e["description"]} for e in raw]
