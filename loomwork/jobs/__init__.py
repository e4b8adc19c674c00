"""Registered queries, each with its SQL where SQL can express it."""

from importlib import import_module

MODULES = ("retrieval", "store", "graph", "conversations", "scalars", "streams", "code", "code_brace")


def _gather(name):
    found = {}
    for module in MODULES:
        found.update(getattr(import_module(f"{__name__}.{module}"), name, {}))
    return found


def queries():
    return _gather("QUERIES")


def oracles():
    return _gather("ORACLES")
