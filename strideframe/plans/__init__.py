"""Named queries over the standard tables, each with a SQL twin where one exists."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers itself."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
