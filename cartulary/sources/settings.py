"""Settings from nine levels, later ones winning, and which level each value came from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from cartulary.sources.prompts import merged

#: The levels in their order.
LEVELS = ("defaults", "system", "system drop-ins", "user", "user drop-ins", "profile", "project", "environment", "overrides")
#: Short names of environment variables and what they stand for.
ALIASES = {"LOGLEVEL": "logging.level"}


def leaves(tree: Mapping, prefix: str = "") -> dict[str, object]:
    """Values that are no mappings, by their dotted paths."""
    out: dict[str, object] = {}
    for k, v in tree.items():
        path = f"{prefix}.{k}" if prefix else str(k)
        out |= leaves(v, path) if isinstance(v, Mapping) else {path: v}
    return out


def nested(path: str, value) -> dict:
    """The mapping that has one value at a dotted path."""
    for key in reversed(path.split(".")):
        value = {key: value}
    return value


def variable_path(name: str, defaults: Mapping) -> str:
    """The path that an environment variable's name (without its prefix) stands for: its parts between underscores are
    keys, and as many of them together as the defaults have a key for; MAX_CHARS below EMBEDDING is embedding.max_chars."""
    parts, known, path = name.lower().split("_"), defaults, []
    while parts:
        n = next((n for n in range(len(parts), 0, -1) if isinstance(known, Mapping) and "_".join(parts[:n]) in known), 1)
        key = "_".join(parts[:n])
        path.append(key)
        known = known.get(key) if isinstance(known, Mapping) else None
        parts = parts[n:]
    return ".".join(path)


def typed(text: str, default):
    """A variable's text as the kind of value that the default is; as it is where that fails, for checks to tell."""
    try:
        if isinstance(default, bool):
            return {"true": True, "false": False}[text.strip().lower()]
        if isinstance(default, int | float):
            return type(default)(text)
        return [x.strip() for x in text.split(",") if x.strip()] if isinstance(default, list) else text
    except (KeyError, ValueError):
        return text


@dataclass
class Settings:
    values: dict = field(default_factory=dict)
    #: Of each dotted path, its level and what there set it (a file's or a variable's name).
    origins: dict[str, tuple[str, str]] = field(default_factory=dict)

    def get(self, path: str):
        at = self.values
        for key in path.split("."):
            if not isinstance(at, Mapping) or key not in at:
                raise KeyError(path)
            at = at[key]
        return at

    def origin(self, path: str) -> str:
        level, source = self.origins[path]
        return f"{level}: {source}" if source else level

    def _put(self, tree: Mapping, level: str, source: str) -> None:
        self.values = merged(self.values, tree)
        new = leaves(tree)
        # A value in the place of a mapping takes away what was below, and a mapping what was in its place.
        self.origins = {p: o for p, o in self.origins.items() if not any(p.startswith(f"{q}.") or q.startswith(f"{p}.") for q in new)}
        self.origins |= dict.fromkeys(new, (level, source))


def resolved(
    defaults: Mapping, files: Mapping[str, Mapping[str, Mapping]] | None = None, environment: Mapping[str, str] | None = None, overrides: Mapping[str, object] | None = None,
    prefix: str = "CARTULARY", profile: str | None = None, only: tuple[str, Mapping] | None = None,
) -> Settings:
    """The settings of all levels.

    ``files`` has for each level of files the mappings by file name; drop-ins apply in the order of their names. Of the
    level profile only the file called ``profile`` counts, and one that is named must be there. ``only`` (a name, a
    mapping) stands for all levels of files. Variables of the environment that begin with the prefix name a path (see
    ``variable_path``) and are read as the kind of their default; ``overrides`` are by dotted paths. Lists are replaced.
    """
    out = Settings()
    out._put(defaults, "defaults", "")
    files = dict(files or {})
    if unknown := files.keys() - set(LEVELS[1:7]):
        raise ValueError(f"no levels of files: {sorted(unknown)}")
    if only is not None:
        out._put(only[1], "project", only[0])
    else:
        if profile is not None and profile not in files.get("profile", {}):
            raise LookupError(f"no profile {profile}")
        files["profile"] = {profile: files["profile"][profile]} if profile is not None else {}
        for level in LEVELS[1:7]:
            for name in sorted(files.get(level, {})):
                out._put(files[level][name] or {}, level, name)
    known = leaves(defaults)
    for name in sorted(environment or {}):
        if name.startswith(f"{prefix}_"):
            suffix = name.removeprefix(f"{prefix}_")
            path = ALIASES.get(suffix) or variable_path(suffix, defaults)
            out._put(nested(path, typed(environment[name], known.get(path))), "environment", name)
    for path, value in (overrides or {}).items():
        out._put(nested(path, typed(value, known.get(path)) if isinstance(value, str) else value), "overrides", path)
    return out
