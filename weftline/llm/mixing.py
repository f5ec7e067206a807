"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal tokens. Slot n's point, the fractional part of n times the golden ratio, falls into the part
of [0, 1) that the cumulative weights give to a source, so every stretch of the mix holds every source nearly at its share.
Slots are ranked per source, and the source's documents, shuffled anew for each repeat and laid end to end, are cut into blocks of
a slot's tokens; the slot with rank r takes block r. Blocks beyond the last permitted repeat don't exist: such slots stay empty
and the report says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.ordered import prefix_sum
from weftline.session import cut

GOLDEN = 0.6180339887498949
CHUNK = 100_000
#: How many targets times repeats are sent to every task; beyond, they are joined by a shuffle.
MOST_DRAWN = 20_000


def source_key(source: Column) -> Column:
    """Sources are compared trimmed and in lower case."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _targets(targets: DataFrame, block: int) -> DataFrame:
    """Each target with its stretch of [0, 1), the mix's slots and the tokens of a slot."""
    kept = targets.select("mix_name", "source", "target_share", "max_repeats", "budget_tokens").where("mix_name IS NOT NULL AND source IS NOT NULL AND target_share >= 0 AND budget_tokens >= 0")
    upto = W.partitionBy("mix_name").orderBy("source")
    whole = W.partitionBy("mix_name")
    out = kept.withColumn("_key", source_key(F.col("source"))).withColumn("_all", F.sum("target_share").over(whole))
    out = out.withColumn("_hi", F.sum("target_share").over(upto.rowsBetween(W.unboundedPreceding, 0)) / F.col("_all"))
    out = out.withColumn("_lo", F.coalesce(F.sum("target_share").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / F.col("_all"))
    slots = F.greatest(F.ceil(F.col("budget_tokens") / block), F.lit(1))
    return out.withColumn("_slots", slots).withColumn("_each", F.col("budget_tokens") / F.col("_slots"))


def schedule(targets: DataFrame) -> DataFrame:
    """(mix_name, source, slot, rank): the source of every slot and the slot's rank among its source's."""
    mixes = targets.where("_hi > _lo").groupBy("mix_name").agg(F.max("_slots").alias("_slots"), F.array_sort(F.collect_list(F.struct("_lo", "source"))).alias("_parts"))  # a row per mix, as many parts as targets
    chunks = mixes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_slots") - 1) / CHUNK)))).repartition("mix_name", "chunk")
    last = F.least(F.col("_slots"), (F.col("chunk") + 1) * CHUNK) - 1
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    point = (F.col("slot") + 0.5) * GOLDEN % 1
    source = F.element_at(F.filter("_parts", lambda p: p["_lo"] <= F.col("_point")), -1)["source"]
    slots = slots.withColumn("_point", point).select("mix_name", source.alias("source"), "chunk", "slot")
    return prefix_sum(slots, ["mix_name", "source"], "chunk", ["slot"], F.lit(1), "rank").drop("chunk")


def _plan(docs: DataFrame, targets: DataFrame, block: int, held: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets with demand and supply, the slots, and the uses of documents: those that the source's slots take, by rank, and as many
    more of the permitted ones as its share of the budget needs."""
    docs = cut(docs.where("tokens > 0 AND doc_id IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("_key"), "tokens"))
    wanted = _targets(targets, block)
    slots = schedule(wanted)
    supply = docs.groupBy("_key").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("documents"))
    demand = slots.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("slots"))
    wanted = wanted.join(supply, "_key", "left").join(demand, ["mix_name", "source"], "left").na.fill(0, ["available_tokens", "documents", "slots"])
    goal = F.col("target_share") * F.col("budget_tokens")
    wanted = wanted.withColumn("wanted_tokens", goal)
    need = F.greatest(F.col("slots") * F.col("_each"), F.col("wanted_tokens"))
    repeats = F.least(F.col("max_repeats"), F.floor(need / F.col("available_tokens")) + 1)
    drawn = wanted.where("(slots > 0 OR wanted_tokens > 0) AND available_tokens > 0 AND max_repeats > 0 AND _each > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), (repeats - 1).cast("int"))))
    drawn = drawn.select("mix_name", "source", "_key", "_each", "slots", "wanted_tokens", "available_tokens", "documents", "repeat")
    drawn = cut(drawn)  # a row per target and repeat: small unless targets are many
    uses = docs.join(F.broadcast(drawn) if drawn.count() <= MOST_DRAWN else drawn, "_key")
    # the order of a repeat is that of a hash, whose high bits are the block of the scan
    uses = uses.withColumn("_at", F.xxhash64("doc_id", "repeat", "mix_name").bitwiseAND(2**40 - 1))
    uses = uses.withColumn("_block", F.floor(F.col("_at") * F.ceil(F.col("documents") / held) / 2**40))
    uses = prefix_sum(uses, ["mix_name", "source", "repeat"], "_block", ["_at", "doc_id"], F.col("tokens"), "_before")
    start = F.col("_before") + F.col("repeat") * F.col("available_tokens")
    uses = uses.withColumn("rank", F.floor(start / F.col("_each"))).where((F.col("rank") < F.col("slots")) | (start < F.col("wanted_tokens")))
    return wanted, slots, uses


def mix(docs: DataFrame, targets: DataFrame, block: int = 512, held: int = 50_000) -> DataFrame:
    """(mix_name, slot, place, source, doc_id, repeat, tokens): the documents of every mix in its order.

    docs: (doc_id, source, tokens), ids unique. Documents without tokens, id or source aren't drawn; targets without mix, source or a
    share and budget of at least 0 are left out; sources without documents leave their slots empty.
    """
    _, slots, uses = _plan(docs, targets, block, held)
    placed = uses.join(slots, ["mix_name", "source", "rank"])
    place = F.row_number().over(W.partitionBy("mix_name", "slot").orderBy("_before", "doc_id"))
    return placed.select("mix_name", "slot", place.alias("place"), "source", "doc_id", "repeat", "tokens")


def shares(docs: DataFrame, targets: DataFrame, block: int = 512, held: int = 50_000) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, documents_used, most_uses, available_tokens, wanted_tokens, slots,
    empty_slots, short): what every target of the mix got.

    short: what the source's slots take, with the permitted uses that its slots leave over, ends before its share of the budget. The
    draw goes on to that share where the schedule deals fewer slots, so this holds exactly when the source's tokens, as often as
    they may be repeated, are less than the share.
    """
    wanted, slots, uses = _plan(docs, targets, block, held)
    placed = uses.join(slots, ["mix_name", "source", "rank"], "left")
    inside = F.col("slot").isNotNull()
    each = placed.groupBy("mix_name", "source", "doc_id").agg(F.sum(F.when(inside, F.col("tokens"))).alias("tokens"), F.count("slot").alias("uses"), F.sum(F.when(~inside, F.col("tokens"))).alias("_over"))
    got = each.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("uses") > 0).alias("documents_used"), F.max("uses").alias("most_uses"), F.sum("_over").alias("_over"))
    out = wanted.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents_used", "most_uses", "_over"])
    total = F.sum("tokens").over(W.partitionBy("mix_name"))  # as many rows as targets
    full = F.floor(F.col("available_tokens") * F.col("max_repeats") / F.col("_each"))
    return out.select(
        "mix_name",
        "source",
        "target_share",
        F.when(total > 0, F.col("tokens") / total).alias("actual_share"),
        "tokens",
        "documents_used",
        "most_uses",
        "available_tokens",
        "wanted_tokens",
        "slots",
        F.greatest(F.col("slots") - F.coalesce(full, F.lit(0)), F.lit(0)).alias("empty_slots"),
        (F.col("tokens") + F.col("_over") < F.col("wanted_tokens")).alias("short"),
    )


def short_sources(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source) of the targets that their source can't meet within the permitted repeats."""
    return shares(docs, targets).where("short").select("mix_name", "source")
