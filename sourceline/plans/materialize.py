"""Write an intermediate result once and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import work_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared work folder: lineage ends there, and a lost executor
    costs a re-read instead of a recomputation."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
