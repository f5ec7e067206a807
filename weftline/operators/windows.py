"""Variable-length windows: from every row forward until a sum is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import cut

from .ordered import prefix_sums


def to_threshold(rows: DataFrame, group: str, order: str, tokens: str, thresholds: list[int], held: int = 5000, span: int = 200_000) -> DataFrame:
    """(group, order, threshold, rows, reached): from each row the number of rows and the sum at which the threshold is first reached.

    Both are null for a tail that never reaches it. Windows stay in their group. order is a whole number, tokens must not be negative, thresholds
    be positive. As of: each start looks, in the order of running sums, for the first row whose running sum is at least its own start plus
    the threshold, so one sort replaces the join of every row with all later ones. Sums are run in blocks of held numbers of the
    order, and searched in stretches of span tokens; the first row of the next stretch that has one answers for a stretch's end.
    """
    narrow = rows.select(group, order, F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("_n"), F.floor(F.col(order) / held).alias("_block"))
    summed = prefix_sums(narrow, [group], "_block", [order], _sum=F.col("_n"), _pos=F.lit(1)).withColumn("_cum", F.col("_sum") + F.col("_n"))
    summed = cut(summed.select(group, order, "_pos", "_n", "_cum"))
    # kind 0: a start, at the sum it needs; kind 1: a row, at the sum it gives. A start stands before rows of equal sum.
    starts = summed.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    starts = starts.withColumn("v", F.col("_cum") - F.col("_n") + F.col("threshold")).withColumn("kind", F.lit(0))
    gives = summed.select("*", F.lit(None).cast("int").alias("threshold"), F.col("_cum").alias("v"), F.lit(1).alias("kind"))
    both = starts.unionByName(gives).withColumn("_span", F.floor(F.col("v") / span))
    hit = F.when(F.col("kind") == 1, F.struct("_pos", "_cum"))
    ahead = W.partitionBy(group, "_span").orderBy(F.desc("v"), F.desc("kind"), F.desc("_pos")).rowsBetween(W.unboundedPreceding, 0)
    first = both.groupBy(group, "_span").agg(F.min_by(F.struct("_pos", "_cum"), F.when(F.col("kind") == 1, F.struct("v", "_pos"))).alias("_first"))
    later = W.partitionBy(group).orderBy(F.desc("_span")).rowsBetween(W.unboundedPreceding, -1)
    first = first.withColumn("_later", F.last("_first", ignorenulls=True).over(later)).select(F.col(group).alias("_g"), F.col("_span").alias("_s"), "_later")
    out = both.withColumn("_own", F.last(hit, ignorenulls=True).over(ahead)).where("kind = 0")
    out = out.join(first, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_span") == F.col("_s"))).withColumn("_hit", F.coalesce("_own", "_later"))
    return out.select(group, order, "threshold", (F.col("_hit._pos") - F.col("_pos") + 1).alias("rows"), (F.col("_hit._cum") - F.col("_cum") + F.col("_n")).alias("reached"))


def threshold_stats(windows: DataFrame, group: str) -> DataFrame:
    """(scope, threshold, starts, reaching, tails, and min, median, p95 and max rows, mean sum) over everything and per group."""
    out = windows.groupingSets([[F.col("threshold")], [F.col(group), F.col("threshold")]], F.col(group), F.col("threshold")).agg(
        F.count(F.lit(1)).alias("starts"),
        F.count("rows").alias("reaching"),
        F.min("rows").alias("min_rows"),
        F.percentile("rows", F.array(F.lit(0.5), F.lit(0.95))).alias("_p"),
        F.max("rows").alias("max_rows"),
        F.avg("reached").alias("mean_reached"),
        F.grouping(group).alias("_all"),
    )
    scope = F.when(F.col("_all") == 0, F.col(group).cast("string"))
    return out.select(scope.alias("scope"), "threshold", "starts", "reaching", (F.col("starts") - F.col("reaching")).alias("tails"), "min_rows", F.get("_p", F.lit(0)).alias("median_rows"), F.get("_p", F.lit(1)).alias("p95_rows"), "max_rows", "mean_reached")
