"""Walks over free-form JSON text of any shape, for which no typed schema exists.

These are the only Python functions outside the model hook: a recursive walk has
no built-in form. They are Arrow-batched and see one small column.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 6


def _walk(value, depth: int, scalars: bool, out: list[str]) -> list[str]:
    if depth > MAX_DEPTH:
        return out
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict):
        for v in value.values():
            _walk(v, depth + 1, scalars, out)
    elif isinstance(value, list):
        for v in value:
            _walk(v, depth + 1, scalars, out)
    elif scalars and value is not None:
        out.append(str(value))
    return out


def _paths(value, names: frozenset[str], at: str, out: list[str]) -> list[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            if k in names:
                out.append(f"{at}.{k}")
            _paths(v, names, f"{at}.{k}", out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _paths(v, names, f"{at}[{i}]", out)
    return out


def _load(text):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def values(text: Column, scalars: bool = True) -> Column:
    """All strings of a JSON text down to MAX_DEPTH, with other scalars as text; none where it does not parse."""

    @F.pandas_udf("array<string>")
    def walk(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _walk(_load(t), 0, scalars, []))

    return walk(text)


def key_paths(text: Column, names: list[str]) -> Column:
    """Paths ($.a[0].b) of the named keys at any depth."""
    wanted = frozenset(names)

    @F.pandas_udf("array<string>")
    def walk(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _paths(_load(t), wanted, "$", []))

    return walk(text)
