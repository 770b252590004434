"""Comparison of query results."""

from __future__ import annotations

import math

import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns in the order of their names."""

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
            return str(v) if isinstance(v, str) else f"{float(v):.9g}" if not isinstance(v, bool) and str(v) not in ("True", "False") else str(v)
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return str(v.tolist()) if hasattr(v, "tolist") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


def same(spark_df, duck, sql: str) -> None:
    got, want = spark_df.toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
