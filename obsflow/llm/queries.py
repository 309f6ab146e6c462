"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import importlib

from obsflow.llm import ORACLES, QUERIES

MODULES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"]


def load() -> tuple[dict, dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"obsflow.llm.{m}")
    return QUERIES, ORACLES
