"""Indicators from files of one's own: ``<folder>/<category>/<name>.py``.

Each file defines a function of its own name that takes expressions and
parameters and returns expressions by output name. Nothing of it runs on
executors: only expressions leave the driver.
"""

from __future__ import annotations

import importlib.util
from pathlib import Path

from .plans.registry import OPS, categories, register


def create_dir(path: str, names: list[str] | None = None) -> list[str]:
    """A folder with one for each category."""
    made = []
    for c in names or [c for c in categories() if " " not in c]:
        Path(path, c).mkdir(parents=True, exist_ok=True)
        made.append(c)
    return made


def import_dir(path: str) -> list[str]:
    """Registers the indicators of a folder; their names."""
    found = []
    for file in sorted(Path(path).glob("*/*.py")):
        spec = importlib.util.spec_from_file_location(f"sparktide_custom_{file.stem}", file)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        if not callable(getattr(module, file.stem, None)):
            raise ImportError(f"{file} has no function {file.stem}")
        register(file.stem, file.parent.name, getattr(module, file.stem))
        found.append(file.stem)
    return found


def unregister(name: str) -> None:
    OPS.pop(name, None)
