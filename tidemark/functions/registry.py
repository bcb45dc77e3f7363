"""Named transforms and statistics, and a configuration of defaults, file and environment."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame


class Transform(Protocol):
    """A step that learns from training rows and changes any rows."""

    def fit(self, train: DataFrame) -> Any: ...

    def transform(self, rows: DataFrame) -> DataFrame: ...


Statistic = Callable[[DataFrame, dict], DataFrame]


class Registry:
    """Factories by name; a name is taken once."""

    def __init__(self) -> None:
        self._items: dict[str, Callable] = {}

    def register(self, name: str, factory: Callable | None = None):
        if factory is None:
            return lambda f: self.register(name, f) or f
        if name in self._items:
            raise ValueError(f"{name} is registered already")
        self._items[name] = factory
        return None

    def get(self, name: str) -> Callable:
        if name not in self._items:
            raise KeyError(f"unknown name: {name}; known are {', '.join(sorted(self._items))}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)


TRANSFORMS, STATISTICS, PROVIDERS = Registry(), Registry(), Registry()

DEFAULTS: dict[str, Any] = {
    "freqs": ["5min", "15min", "1h", "1D"],
    "filters": {"min_liquidity_usd": 250_000.0, "min_vol_h24": 500_000.0, "min_bars": 48, "exclude_stable_pairs": True},
    "costs": {"fee_bps": 30.0, "slippage_bps": 10.0},
}


def merge(base: dict, over: dict) -> dict:
    return {k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in base | over}


def config(path: str | None = None, env: str = "TIDEMARK_") -> dict:
    """Defaults, then a JSON file, then variables such as TIDEMARK_FILTERS__MIN_BARS."""
    out = merge(DEFAULTS, json.load(open(path)) if path else {})
    for key, value in os.environ.items():
        if key.startswith(env) and "__" in key:
            try:
                parsed = json.loads(value)
            except ValueError:
                parsed = value
            for name in reversed(key.removeprefix(env).lower().split("__")):
                parsed = {name: parsed}
            out = merge(out, parsed)
    return out
