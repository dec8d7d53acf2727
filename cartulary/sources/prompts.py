"""Prompts and configuration in layers, on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping
from copy import deepcopy

_PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def render(template: str, values: Mapping[str, str]) -> str:
    """Each ${name} by its value, once; a missing one is an error, extra ones are ignored."""
    if missing := {n for n in _PLACEHOLDER.findall(template) if n not in values}:
        raise KeyError(f"missing: {sorted(missing)}")
    return _PLACEHOLDER.sub(lambda m: values[m[1]], template)


def merged(base: Mapping, layer: Mapping, lists: str = "replace") -> dict:
    """Deep merge, the later layer winning; lists are replaced or appended."""
    out = deepcopy(dict(base))
    for k, v in layer.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v, lists)
        elif lists == "append" and isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + deepcopy(v)
        else:
            out[k] = deepcopy(v)
    return out


def layered(*layers: Mapping) -> dict:
    """All layers merged, later ones winning."""
    out: dict = {}
    for layer in layers:
        out = merged(out, layer)
    return out


def inline_examples(examples: list[Mapping[str, str]]) -> str:
    return "\n".join(f"Example: {e['input']} -> {e['output']}" for e in examples)


def numbered_examples(examples: list[Mapping[str, str]]) -> str:
    return "\n\n".join(f"Example {i}:\nInput: {e['input']}\nOutput: {e['output']}" for i, e in enumerate(examples, 1))
