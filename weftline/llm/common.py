"""What several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *keys: str, arrival: str | None = None) -> DataFrame:
    """Every record once: one row per key, whichever copy came; rows without a whole key once per content.

    arrival names the column in which repeated rows may differ; it is left out.
    """
    df = df.drop(arrival) if arrival else df
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rest = F.when(~whole, F.to_json(F.struct(*df.columns)))
    return df.withColumn("_rest", rest).dropDuplicates([*keys, "_rest"]).drop("_rest")
