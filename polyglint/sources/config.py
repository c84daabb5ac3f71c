"""Options from a TOML file; the nearest file above a catalogue holds."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from pathlib import Path

from ..operators.rules import Options

#: Names of a configuration file, in the order in which a folder is searched.
NAMES = (".polyglint/polyglint.toml", "polyglint.toml", ".polyglint.toml")
#: Options that are paths; relative ones begin at the configuration file's folder.
_PATHS = ("path_dicts", "path_words", "force_trans_file", "no_trans_file")


def load(text: str, base: str | None = None, **overrides) -> Options:
    """Options from TOML (table ``check``) with overrides; booleans can only be switched on. Unknown keys are ignored."""
    given = tomllib.loads(text).get("check", {})
    names = {f.name: f for f in dataclasses.fields(Options)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names}
    for k in _PATHS:
        if base and isinstance(values.get(k), str) and "/" != values[k][0] and ":" not in values[k]:
            values[k] = f"{base}/{values[k]}"
    for k, v in overrides.items():
        if v is None or (isinstance(v, bool) and not v):
            continue
        values[k] = v
    return Options(**values)


def as_dict(options: Options) -> dict:
    return {f.name: getattr(options, f.name) for f in dataclasses.fields(options)}


def as_json(options: Options) -> str:
    return json.dumps(as_dict(options))


def nearest(path: Path, names: tuple[str, ...] = NAMES) -> Path | None:
    """The first of ``names`` in the folder of ``path`` or the nearest folder above."""
    for folder in path.resolve().parents:
        for name in names:
            if (folder / name).is_file():
                return folder / name
    return None
