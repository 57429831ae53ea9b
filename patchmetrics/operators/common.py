"""Small planning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

def require_columns(df: DataFrame, cols, what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; have {df.columns}")
