"""Ordered scans that don't need a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previous(df: DataFrame, group: list[str], block: Column, order: list[Column | str], **values: str) -> DataFrame:
    """df with out=column of the row before in the group's order, for each out of values; null for a group's first row.

    block must agree with the order. A task scans one block; what crosses their borders goes through a table with a row per block.
    """
    own = df.withColumn("_block", block)
    inner = W.partitionBy(*group, "_block").orderBy(*order)
    held = F.struct(F.lit(True).alias("_is"), *[F.col(c).alias(out) for out, c in values.items()])
    own = own.withColumn("_lag", F.lag(held).over(inner))
    last = F.max_by(held, F.struct(*order)).alias("_last")
    ends = own.groupBy(*group, "_block").agg(last).withColumn("_carry", F.lag("_last").over(W.partitionBy(*group).orderBy("_block")))
    ends = ends.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, "_block"])], "_carry")
    on = F.lit(True)
    for i, c in enumerate([*group, "_block"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    before = F.coalesce("_lag", "_carry")
    return own.join(ends, on).select(*df.columns, *[before[out].alias(out) for out in values])


def numbered(df: DataFrame, group: list[str], block: Column, order: list[Column | str], out: str) -> DataFrame:
    """df with the row's number from 0 in the group's order, as bigint; block must agree with the order."""
    return prefix_sum(df.withColumn("_nblock", block), group, "_nblock", order, F.lit(1), out).drop("_nblock")


def prefix_sum(df: DataFrame, group: list[str], block: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """The sum of value over the rows of the group that come before a row, as bigint."""
    return prefix_sums(df, group, block, order, **{out: value})


def prefix_sums(df: DataFrame, group: list[str], block: str, order: list[Column | str], **values: Column) -> DataFrame:
    """For each out of values the sum of its value over the rows of the group that come before a row, as bigint.

    The order must agree with that of block. A task scans one block; the blocks' sums are added up in a table with a row per
    block, so even a group that holds most of the rows is spread over its blocks.
    """
    own = df.select("*", *[v.cast("bigint").alias(f"_v{i}") for i, v in enumerate(values.values())])
    n = range(len(values))
    sums = own.groupBy(*group, block).agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in n])
    before = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, block])], *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in n])
    inner = W.partitionBy(*group, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = own.select("*", *[F.coalesce(F.sum(f"_v{i}").over(inner), F.lit(0)).alias(f"_i{i}") for i in n])
    on = F.lit(True)
    for i, c in enumerate([*group, block]):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return own.join(sums, on).select(*df.columns, *[(F.col(f"_i{i}") + F.col(f"_b{i}")).alias(out) for i, out in enumerate(values)])
