"""A PySpark-native engine for scoring text collections, measuring the scores, and preparing text for training."""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.2.0"

#: Name -> the module that has it; modules are loaded when a name is first asked for.
_HOMES = {
    "detect": "operators.detect", "score_documents": "plans.score", "score_targets": "plans.score", "LengthStub": "scorers",
    "LogitsScorer": "scorers", "BatchScorer": "scorers", "ScorerUnavailableError": "scorers", "chosen_scorer": "scorers",
    "eval_dataset": "plans.evaluate", "eval_references": "plans.evaluate", "register_functions": "functions.sql",
    "register_resolver": "sources.documents",
}
__all__ = ["__version__", *_HOMES]


def __getattr__(name: str) -> Any:
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_HOMES[name]}", __name__), name)
