"""Project folders: a recipe, Python functions, inputs and secrets."""

from __future__ import annotations

import importlib.util
import os
import re
from dataclasses import dataclass, field
from typing import Any

from ..functions.registry import Registry
from ..script.surface import ScriptError


@dataclass
class Project:
    folder: str
    recipe: str
    inputs: dict[str, Any] = field(default_factory=dict)
    secrets: dict[str, str] = field(default_factory=dict)
    registry: Registry = field(default_factory=Registry)
    settings: dict[str, Any] = field(default_factory=dict)


def _properties(path: str) -> dict[str, str]:
    out = {}
    with open(path) as f:
        for line in f:
            line = line.strip()
            if line and not line.startswith(("#", "!")):
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip()
    return out


def _yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError:
        out: dict[str, Any] = {}
        with open(path) as f:
            for line in f:
                m = re.match(r"\s*([\w.]+)\s*:\s*(.*?)\s*$", line)
                if m and not line.lstrip().startswith("#"):
                    out[m[1]] = m[2].strip("'\"")
        return out
    with open(path) as f:
        value = yaml.safe_load(f) or {}
    if not isinstance(value, dict):
        raise ScriptError(f"{path} must hold a map")
    return value


def _first(folder: str, yaml_name: str, properties_name: str) -> dict[str, Any]:
    if os.path.exists(f"{folder}/{yaml_name}"):
        return _yaml(f"{folder}/{yaml_name}")
    if os.path.exists(f"{folder}/{properties_name}"):
        return _properties(f"{folder}/{properties_name}")
    return {}


def find_recipe(folder: str, name: str | None = None) -> str:
    """recipe.sql, the file asked for, or the only .sql file of the folder."""
    if name:
        if not os.path.exists(f"{folder}/{name}"):
            raise ScriptError(f"{name} is not in {folder}")
        return f"{folder}/{name}"
    if os.path.exists(f"{folder}/recipe.sql"):
        return f"{folder}/recipe.sql"
    found = sorted(f for f in os.listdir(folder) if f.endswith(".sql"))
    if len(found) != 1:
        raise ScriptError(f"{folder} has {len(found)} .sql files; name one with --recipe")
    return f"{folder}/{found[0]}"


def load_functions(folder: str, registry: Registry) -> None:
    """Decorated functions of fixture_*.py, as local.<name>. Equal names are refused."""
    for name in sorted(os.listdir(folder)):
        if name.startswith("fixture_") and name.endswith(".py"):
            spec = importlib.util.spec_from_file_location(name[:-3], f"{folder}/{name}")
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            for value in vars(module).values():
                made = getattr(value, "__evalloom__", None)
                if made is not None:
                    registry.add(made)


def load(folder: str, recipe: str | None = None) -> Project:
    path = find_recipe(folder, recipe)
    with open(path) as f:
        text = f.read()
    secrets = {k: str(v) for k, v in _first(folder, "secrets.yaml", "secret.properties").items()}
    inputs = _first(folder, "inputs.yaml", "input.properties")
    for key, value in inputs.items():
        if isinstance(value, str) and value.startswith("secret.") and value[7:] not in secrets:
            raise ScriptError(f"input {key} refers to {value}, which is not among the secrets")
    project = Project(folder, text, inputs, secrets)
    load_functions(folder, project.registry)
    if os.path.exists(f"{folder}/evalloom.toml"):
        import tomllib

        with open(f"{folder}/evalloom.toml", "rb") as f:
            project.settings = tomllib.load(f).get("run", {})
    return project
