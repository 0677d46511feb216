"""The registered queries, one module per operator family."""

from __future__ import annotations

import importlib
from types import ModuleType

FAMILIES = ("retrieval", "evaluation", "text", "quality", "guards", "evidence", "logs", "practice", "knowledge", "graphs",
            "generated", "sources", "streams")


def load() -> ModuleType:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return importlib.import_module(f"{__name__}.registry")
