"""Rows of two results as sorted texts, whatever the order of rows and columns."""

from __future__ import annotations

import math

import pandas as pd


def _text(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_text, r)) for r in df.itertuples(index=False, name=None))
