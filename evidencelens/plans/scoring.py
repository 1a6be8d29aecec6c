"""The one plug-in hook: a user's batch function over frames or whole sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_sequences(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, keys: Sequence[str] | None = None, block: int | None = None,
                    order: str = "frame_index") -> DataFrame:
    """Applies ``fn`` to Arrow batches, or per sequence when ``keys`` are given.

    With ``block`` a long sequence is handed over in blocks of frames, so no task receives it whole; a
    function that needs complete sequences leaves it out and accepts their size.
    """
    if keys is None:
        return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
    if block is None:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    blocked = df.withColumn("__block", F.floor(F.col(order) / block))
    return blocked.groupBy(*keys, "__block").applyInPandas(lambda p: fn(p.drop(columns="__block")), schema)
