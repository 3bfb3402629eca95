"""Registered queries, each with the SQL that must give the same rows."""

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    return importlib.import_module(f"{__name__}.registry")
