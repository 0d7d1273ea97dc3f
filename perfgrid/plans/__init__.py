"""Batch plans: fixture views, query registry, recommendation flows."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Imports every module that registers queries."""
    for m in iter_modules(__path__):
        if m.name.startswith("q_"):
            import_module(f"{__name__}.{m.name}")
