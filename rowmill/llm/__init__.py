"""Operators for training data. Nothing outside this folder imports it."""

from __future__ import annotations

import importlib

MODULES = ("p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "p10")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), attribute, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
