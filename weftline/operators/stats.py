"""Exact descriptive statistics over scopes, histograms with empty bins, outliers, and comparisons of two counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import numbered

PERCENTS = (25, 50, 75, 90, 95, 99)
#: Bins of the token counts of utterances: inclusive bounds, the last one open. Fixed values.
TOKEN_BINS = ((0, 0), (1, 5), (6, 10), (11, 20), (21, 40), (41, 80), (81, 120), (121, 160), (161, 250), (251, None))
#: Bins of the token counts of chunks. Fixed values.
CHUNK_BINS = ((0, 255), (256, 383), (384, 511), (512, 639), (640, 767), (768, 1023), (1024, None))


def describe(values: DataFrame, value: str, scope: str | None = None) -> DataFrame:
    """(scope, count, total, min, max, mean, p25 .. p99): over everything (scope null) and per scope in one pass.

    Percentiles are exact, interpolated linearly at (n - 1) p. Null values don't count; a scope of only nulls has count 0 and nulls.
    """
    v = F.col(value)
    aggs = [F.count(v).alias("count"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")]
    aggs.append(F.percentile(v, F.array(*[F.lit(p / 100) for p in PERCENTS])).alias("_p"))
    if scope is None:
        out = values.agg(*aggs).withColumn("scope", F.lit(None).cast("string"))
    else:
        out = values.groupingSets([[], [F.col(scope)]], F.col(scope)).agg(*aggs, F.grouping(scope).alias("_all")).withColumn("scope", F.when(F.col("_all") == 0, F.coalesce(F.col(scope).cast("string"), F.lit(""))))
    return out.select("scope", "count", "total", "min", "max", "mean", *[F.get("_p", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTS)])


def histogram(values: DataFrame, value: str, scope: str | None = None, bins: tuple = TOKEN_BINS) -> DataFrame:
    """(scope, bin, low, high, count, share): every bin of every scope, empty ones too; the scope null is everything."""
    at = F.lit(None).cast("int")
    for i, (low, high) in reversed([*enumerate(bins)]):
        inside = F.col(value) >= low
        at = F.when(inside & (F.col(value) <= high) if high is not None else inside, i).otherwise(at)
    key = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    counts = values.where(F.col(value).isNotNull()).groupBy(F.coalesce(key, F.lit("")).alias("scope"), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # each scope's counts stand for everything too, once they are few
    everything = F.lit(None).cast("string")
    counts = counts.select(F.explode(F.array("scope", everything) if scope else F.array(everything)).alias("scope"), "bin", "n")
    wide = counts.groupBy("scope").agg(F.sum("n").alias("_all"), *[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias(f"_{i}") for i in range(len(bins))])
    each = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(low).alias("low"), F.lit(high).cast("int").alias("high"), F.col(f"_{i}").alias("count")) for i, (low, high) in enumerate(bins)])
    out = wide.withColumn("_b", F.explode(each))
    return out.select("scope", "_b.bin", "_b.low", "_b.high", "_b.count", (F.col("_b.count") / F.col("_all")).alias("share"))


def outliers(values: DataFrame, value: str, *ties: str) -> DataFrame:
    """The rows strictly above the outer fence p75 + 3 (p75 - p25) of all values, with the fence and their rank from 1: largest first, then
    by the columns ties. Ranks are found per value, so that no task sorts all."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    fence = values.agg(p.alias("_p")).select((F.get("_p", F.lit(1)) * 4 - F.get("_p", F.lit(0)) * 3).alias("fence"))
    above = values.crossJoin(F.broadcast(fence)).where(F.col(value) > F.col("fence"))
    return numbered(above, [], -F.col(value), [*ties], "rank").withColumn("rank", F.col("rank") + 1)


def compare(rows: DataFrame, a: str, b: str, limit: int) -> DataFrame:
    """Two counters of the same rows: difference b - a, ratio b / a to 6 digits (null for a = 0), and whether b exceeds the limit."""
    ratio = F.when(F.col(a) != 0, F.round(F.col(b) / F.col(a), 6))
    return rows.withColumn("difference", F.col(b) - F.col(a)).withColumn("ratio", ratio).withColumn("exceeds", F.col(b) > limit)


#: What is said of ratios and of differences.
SPREAD = (("median", 50), ("p75", 75), ("p90", 90), ("p95", 95), ("p99", 99))


def compare_summary(compared: DataFrame, a: str, b: str, scope: str) -> DataFrame:
    """(scope, rows, total_a, total_b, overall_ratio, less, equal, more, exceeding; min, mean, median, p75, p90, p95, p99 and max of the
    ratios and of the signed differences) over everything and per scope."""
    d, kinds = F.col("difference"), ("ratio", "difference")
    spread = [x for c in kinds for x in (F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}"), F.percentile(c, F.array(*[F.lit(p / 100) for _, p in SPREAD])).alias(f"_{c}"))]
    out = compared.groupingSets([[], [F.col(scope)]], F.col(scope)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(a).alias("total_a"),
        F.sum(b).alias("total_b"),
        F.count_if(d < 0).alias("less"),
        F.count_if(d == 0).alias("equal"),
        F.count_if(d > 0).alias("more"),
        F.count_if("exceeds").alias("exceeding"),
        *spread,
        F.grouping(scope).alias("_all"),
    )
    name = F.when(F.col("_all") == 0, F.coalesce(F.col(scope).cast("string"), F.lit("")))
    ratio = F.when(F.col("total_a") != 0, F.col("total_b") / F.col("total_a"))
    told = [x for c in kinds for x in (f"min_{c}", f"mean_{c}", *[F.get(f"_{c}", F.lit(i)).alias(f"{n}_{c}") for i, (n, _) in enumerate(SPREAD)], f"max_{c}")]
    return out.select(name.alias("scope"), "rows", "total_a", "total_b", ratio.alias("overall_ratio"), "less", "equal", "more", "exceeding", *told)


def first_largest(rows: DataFrame, value: str, ordinal: str, scope: str) -> DataFrame:
    """Per scope the row with the largest value, the first by ordinal on ties; rows of null value never win over others."""
    order = W.partitionBy(scope).orderBy(F.desc_nulls_last(value), ordinal)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def largest(rows: DataFrame, value: str, *ties: str) -> DataFrame:
    """The row with the largest value of all, the first by ties."""
    return rows.orderBy(F.desc_nulls_last(value), *ties).limit(1)


def target_position(rows: DataFrame, value: str, target: int, scope: str) -> DataFrame:
    """(scope, rows, and of below, equal and above their number and percentage, most_over, most_under, and the mean, median, p95 and largest
    deviation) against a target, over everything and per scope."""
    v: Column = F.col(value)
    away = F.abs(v - target)
    out = rows.groupingSets([[], [F.col(scope)]], F.col(scope)).agg(
        F.count(v).alias("rows"),
        F.count_if(v < target).alias("below"),
        F.count_if(v == target).alias("equal"),
        F.count_if(v > target).alias("above"),
        F.max(F.greatest(v - target, F.lit(0))).alias("most_over"),
        F.max(F.greatest(target - v, F.lit(0))).alias("most_under"),
        F.avg(away).alias("mean_deviation"),
        F.percentile(away, F.array(F.lit(0.5), F.lit(0.95))).alias("_p"),
        F.max(away).alias("max_deviation"),
        F.grouping(scope).alias("_all"),
    )
    name = F.when(F.col("_all") == 0, F.coalesce(F.col(scope).cast("string"), F.lit("")))
    percent = [F.when(F.col("rows") > 0, F.col(c) * 100 / F.col("rows")).alias(f"{c}_percent") for c in ("below", "equal", "above")]
    return out.select(name.alias("scope"), "rows", "below", "equal", "above", *percent, "most_over", "most_under", "mean_deviation", F.get("_p", F.lit(0)).alias("median_deviation"), F.get("_p", F.lit(1)).alias("p95_deviation"), "max_deviation")
