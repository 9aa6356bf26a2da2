"""Expanding order statistics: exact quantiles of all earlier rows of a series.

A window function would sort each growing frame anew. Here a series is one ordered group
and every value is put into a sorted list once, so a row costs a binary search."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def past_quantile(done: list[float], q: float) -> float:
    """Linear interpolation between the neighbours, as the engine's percentile."""
    at = (len(done) - 1) * q
    low = int(at)
    if at == low or low + 1 >= len(done) or done[low] == done[low + 1]:
        return done[low]
    return (low + 1 - at) * done[low] + (at - low) * done[low + 1]


def expanding_quantiles(x: DataFrame, value: str, names: dict[str, float], by: str = "asset", order: str = "date", lag: int = 1, least: int = 1) -> DataFrame:
    """``x`` with a column per name: that quantile of ``value`` over the rows up to ``lag`` before each
    (null values don't count); null before ``least`` of them."""
    x = x.select(*[c for c in x.columns if c not in names])
    schema = T.StructType([*x.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        v, done = pdf[value].to_numpy(float), []
        out = {n: np.full(len(v), np.nan) for n in names}
        for i in range(len(v)):
            if i >= lag and v[i - lag] == v[i - lag]:
                insort(done, v[i - lag])
            if len(done) >= least:
                for n, q in names.items():
                    out[n][i] = past_quantile(done, q)
        return pdf.assign(**{n: pd.Series(a, index=pdf.index).astype(object).where(~np.isnan(a), None) for n, a in out.items()})

    return x.groupBy(by).applyInPandas(run, schema)
