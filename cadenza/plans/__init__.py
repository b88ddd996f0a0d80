"""Registered queries: every module adds its entries to the registry when loaded."""

from importlib import import_module

MODULES = ("windows", "joins", "folds", "selection", "composing", "planning", "io_model", "streams", "hot_keys")


def load() -> None:
    for name in MODULES:
        import_module(f"cadenza.plans.{name}")
