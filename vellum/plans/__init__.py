"""Named queries and their SQL, collected for the driver."""

from importlib import import_module

MODULES = ("corpus", "policy", "ordered", "spatial", "values", "adapter", "passes")


def load() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        import_module(f"vellum.plans.{name}")
