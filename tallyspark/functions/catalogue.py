"""All recipe families."""

from __future__ import annotations

import importlib

from .recipes import RECIPES, Recipe

FAMILIES = ("quant", "classification", "regression", "analytics", "ranking", "stats", "money", "trusted")


def load() -> dict[str, Recipe]:
    """Register every family once."""
    for name in FAMILIES:
        importlib.import_module(f"{__package__}.families.{name}")
    return RECIPES
