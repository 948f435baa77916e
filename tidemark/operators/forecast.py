"""Bring your own forecaster."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.baseline import SERIES


def per_series(fit: Callable[[pd.DataFrame], pd.DataFrame], keys=SERIES) -> Callable[[DataFrame], DataFrame]:
    """Forecaster for ``Analysis`` from a function over one series.

    ``fit`` gets the rows of one series (one per hour, ordered by ``ds``) and returns them
    with ``yhat, yhat_lower, yhat_upper``.
    """
    def forecast(series: DataFrame) -> DataFrame:
        out = ", ".join(f"{k} string" for k in keys)
        schema = f"{out}, ds timestamp_ntz, y bigint, yhat double, yhat_lower double, yhat_upper double"
        names = [*keys, "ds", "y", "yhat", "yhat_lower", "yhat_upper"]

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            return fit(frame.sort_values("ds"))[names]

        return series.groupBy(*keys).applyInPandas(one, schema)

    return forecast
