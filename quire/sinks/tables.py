"""Tables of one job, written below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quire.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so what follows neither computes it again nor loses it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
