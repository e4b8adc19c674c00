"""Training-data operators. Nothing outside this subpackage imports it.

``queries()`` and ``oracles()`` gather what each operator module registers.
"""

from importlib import import_module

MODULES = (
    "line_chunks",
    "lsh_forest",
    "mixing",
    "flat_graph",
    "pitman_yor",
    "audio",
    "language_id",
    "token_counts",
    "toxicity",
    "packing",
    "credentials",
    "hard_negatives",
    "whitening",
)


def _gather(name):
    found = {}
    for module in MODULES:
        found.update(getattr(import_module(f"{__name__}.{module}"), name, {}))
    return found


def queries():
    return _gather("QUERIES")


def oracles():
    return _gather("ORACLES")
