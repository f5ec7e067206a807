"""Packing documents into containers of fixed capacity by sum-of-squares placement.

Items arrive one by one. Of all fill levels at which a container stands open, and of a new container, an item takes the one that
leaves the smallest sum of squared counts of containers per level; the counts are a level array. Shards of a bounded number of
items are packed at the same time, each in a task. What remains partly filled after a round is an item of the next, with
fewer shards, until one shard is left or a round gains nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import token_count
from weftline.session import cut

from .common import once


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0 in order of opening; sizes are 1..capacity."""
    count = np.zeros(capacity + 1, np.int64)  # containers per fill level; full ones don't matter
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, fresh = np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        # moving a container from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h] + 1), or 1 - 2 N[h] if it is full then
        top = capacity - size
        gain = count[size : size + top + 1] - count[: top + 1]
        gain = 2 * gain + 2
        gain[top] = 1 - 2 * count[top] if top else 0
        gain[0] = 2 * count[size] + 1 if size < capacity else 0
        gain[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        least = gain.min()
        level = int(np.flatnonzero(gain == least)[-1])  # of equal ones the fullest
        if level:
            box = open_at[level].pop()
            count[level] -= 1
        else:
            box, fresh = fresh, fresh + 1
        if level + size < capacity:
            open_at[level + size].append(box)
            count[level + size] += 1
        out[i] = box
    return out


def _round(items: DataFrame, level: int, tasks: int) -> DataFrame:
    """items (container_name, capacity, shard, item, size) -> the same with box, a name unique over shards and rounds."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("item")
        capacity, shard = group.column("capacity")[0].as_py(), group.column("shard")[0].as_py()
        boxes = place(group.column("size").to_numpy(), capacity)
        return group.select(["container_name", "capacity", "item", "size"]).append_column("box", pa.array([f"{level}-{shard}-{b}" for b in boxes]))

    # a shard is much work for few bytes, so partitions aren't merged by size
    return items.repartition(tasks, "container_name", "shard").groupBy("container_name", "shard").applyInArrow(run, "container_name string, capacity int, item string, size int, box string")


def _sharded(items: DataFrame, held: int) -> tuple[DataFrame, int, int]:
    """A shard number for every item, so that shards hold about held items; the most shards of any container kind, and tasks for all."""
    counts = {r[0]: -(-r[1] // held) for r in items.groupBy("container_name").count().collect()}  # a row per kind of container
    shards = F.lit(1)
    for name, n in counts.items():
        shards = F.when(F.col("container_name") == name, n).otherwise(shards)
    return items.withColumn("shard", F.pmod(F.xxhash64("item", "container_name"), shards).cast("int")), max(counts.values(), default=0), min(max(sum(counts.values()), 1), 10_000)


def pack(docs: DataFrame, containers: DataFrame, held: int = 20_000) -> DataFrame:
    """(container_name, capacity_tokens, container, doc_id, part, first_token, tokens): each document's parts in containers.

    docs: (doc_id, tokens), ids unique. Only a document of more tokens than the capacity is cut, into full containers and a
    rest. A document without tokens takes no room and has a row with part 0 and container null. Containers without a positive
    capacity take nothing and are left out.
    """
    kinds = F.broadcast(containers.where("capacity_tokens > 0").select("container_name", "capacity_tokens").dropDuplicates(["container_name"]))  # a row per kind of container
    each = cut(docs.select("doc_id", "tokens")).crossJoin(kinds)  # texts are read and counted once
    empty = each.where("tokens = 0").select("container_name", "capacity_tokens", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("part"), F.lit(0).alias("first_token"), F.lit(0).alias("tokens"))
    parts = F.sequence(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("int"))
    cuts = each.where("tokens > 0").withColumn("part", F.explode(parts))
    cuts = cuts.withColumn("first_token", (F.col("part") - 1) * F.col("capacity_tokens")).withColumn("size", F.least(F.col("tokens") - F.col("first_token"), F.col("capacity_tokens")).cast("int"))
    cuts = cuts.withColumn("item", F.concat_ws("/", "doc_id", "part"))
    items = cuts.where("size < capacity_tokens").select("container_name", F.col("capacity_tokens").alias("capacity"), "item", "size")
    sharded, shards, tasks = _sharded(items, held)
    now = cut(_round(sharded, 0, tasks))
    where = now.select("container_name", "item", "box")
    level = 0
    while shards > 1:
        # boxes with room left are the next round's items
        left = now.groupBy("container_name", "capacity", "box").agg(F.sum("size").cast("int").alias("size")).where("size < capacity").withColumnRenamed("box", "item")
        before = shards
        sharded, shards, tasks = _sharded(left, held)
        level += 1
        now = cut(_round(sharded, level, tasks))
        moved = now.select("container_name", F.col("item").alias("box"), F.col("box").alias("_to"))
        where = where.join(moved, ["container_name", "box"], "left").select("container_name", "item", F.coalesce("_to", "box").alias("box"))
        if shards >= before:
            break
    columns = ["container_name", "capacity_tokens", F.col("box").alias("container"), "doc_id", "part", "first_token", F.col("size").alias("tokens")]
    placed = cuts.where("size < capacity_tokens").join(where, ["container_name", "item"]).select(*columns)
    full = cuts.where("size = capacity_tokens").withColumn("box", F.concat(F.lit("full-"), "item")).select(*columns)  # has a container for itself
    return placed.unionByName(full).unionByName(empty)


def counted_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens): each document once with the tokens of its whole text, 0 for null."""
    rows = documents.select("doc_id", token_count(F.col("text")).alias("tokens"))
    return once(rows.where(F.col("doc_id").isNotNull()), "doc_id")


def cut_documents(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, doc_id) of the documents that stand in more than one of the containers that were packed."""
    placed = pack(counted_documents(documents), containers).where("container IS NOT NULL")
    each = placed.groupBy("container_name", "doc_id").agg(F.min("container").alias("_one"), F.max("container").alias("_other"))
    return each.where("_one != _other").select("container_name", "doc_id")


def fill_report(placed: DataFrame) -> DataFrame:
    """(container_name, capacity_tokens, documents, tokens, containers, least_containers, fill): how full the containers are."""
    filled = placed.where(F.col("container").isNotNull())
    out = filled.groupBy("container_name", "capacity_tokens").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"), F.count_distinct("container").alias("containers"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return out.withColumn("least_containers", least).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
