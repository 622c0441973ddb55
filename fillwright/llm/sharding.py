"""Shards by fixed virtual slots.

A record is hashed into one of ``SLOTS`` virtual slots and stays there for
good. A map, stored in versions, gives each slot its shard. Bytes and rows are
summed per slot, and rebalancing edits the map: whole slots move from a shard
that holds too many bytes to one that holds too few. A slot that alone holds
more than one part in ``HEAVY`` of all bytes, as records alike in id and text
make it, is dealt to slots of its own behind the others, which then move like
any slot. Everything that decides is a table of ``SLOTS + 2 * HEAVY`` rows at
most; records meet it in one join of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 16_384
SHARDS = 40
HEAVY = 4096  # a slot with more than such a part of all bytes is dealt to several
ROW_BYTES = 16  # added to the text's bytes for each record


def virtual_slot(*keys: str | Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record; null keys hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def slot_totals(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    """Rows and bytes of each slot in use: at most ``SLOTS`` rows, summed before the shuffle."""
    return records.groupBy(slot).agg(F.count("*").alias("slot_rows"), F.sum(size).alias("slot_bytes"))


def heavy_slots(totals: DataFrame, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """(virtual_slot, parts, first): slots over their part of all bytes, and the slots they are dealt to."""
    share = F.ceil(F.sum("slot_bytes").over(Window.partitionBy()) / F.lit(heavy))
    parts = F.least(F.col("slot_rows"), F.ceil(F.col("slot_bytes") / F.col("_share"))).cast("int")
    found = totals.withColumn("_share", share).withColumn("parts", parts).where("parts > 1")
    before = Window.orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = F.lit(slots) + F.coalesce(F.sum("parts").over(before), F.lit(0))
    return found.select("virtual_slot", "parts", first.cast("int").alias("first"))


def spread_heavy(records: DataFrame, row: str, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """``records`` with the rows of heavy slots dealt to further slots by ``row``, a
    number of their own; give a stored table, as it is read again for the totals."""
    deals = heavy_slots(slot_totals(records), slots, heavy)
    # at most ``heavy`` slots can be over one part in ``heavy`` of the bytes
    joined = records.join(F.broadcast(deals), "virtual_slot", "left")
    dealt = F.col("first") + F.pmod(F.xxhash64(row), F.col("parts")).cast("int")
    return joined.withColumn("virtual_slot", F.coalesce(dealt, F.col("virtual_slot"))).drop("parts", "first")


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots are dealt to shards in turn."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).alias("version"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), 0)


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of ``slot_map``: shards (0 to ``shards - 1``) nearly equal in bytes.

    Slots are walked from the heaviest to the lightest, and each goes to the
    shard with the fewest bytes so far, or stays where it is if its shard has
    no more. One fold over ``SLOTS`` entries, as an expression. Slots without
    records stay; those of a shard that no longer exists are moved.
    """
    held = slot_map.join(totals, "virtual_slot", "left").select("virtual_slot", "shard", "version", F.coalesce("slot_bytes", F.lit(0)).alias("bytes"))
    entry = F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard")
    row = held.agg(F.sort_array(F.collect_list(entry)).alias("entries"), (F.max("version") + 1).alias("version"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<array<int>>").alias("parts"), F.array().cast("array<int>").alias("part"))

    def step(state, item):
        loads = state["loads"]
        least = F.array_min(loads)
        own = F.get(loads, item["shard"])
        stay = (item["shard"] < shards) & ((own <= least) | (item["less"] == 0))
        return _bound(F.when(stay, item["shard"]).otherwise((F.array_position(loads, least) - 1).cast("int")), lambda to: moved(state, item, to))

    def moved(state, item, to):
        loads = F.transform(state["loads"], lambda load, i: F.when(i == to, load - item["less"]).otherwise(load))
        part = F.concat(state["part"], F.array(to))
        full = F.size(state["part"]) >= 127
        return F.struct(
            loads.alias("loads"),
            F.when(full, F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"),
            F.when(full, F.array().cast("array<int>")).otherwise(part).alias("part"),
        )

    placed = F.aggregate("entries", start, step, lambda s: F.concat(F.flatten(s["parts"]), s["part"]))
    pairs = row.select("version", F.arrays_zip(F.col("entries.virtual_slot").alias("virtual_slot"), placed.alias("shard")).alias("pairs"))
    # explode_outer: explode would add a filter that folds all slots a second time.
    return pairs.select(F.explode_outer("pairs").alias("p"), "version").select("p.virtual_slot", "p.shard", "version")


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` with one more shard: slots move only into the new one.

    Which slots move is decided by their hash alone, one of ``shards + 1``.
    """
    moves = F.pmod(F.xxhash64(F.lit("grown"), F.lit(shards), "virtual_slot"), F.lit(shards + 1)) == 0
    return slot_map.select("virtual_slot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).alias("shard"), (F.col("version") + 1).alias("version"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add one version to the stored maps; earlier versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest if none is named."""
    maps = spark.read.parquet(path)
    wanted = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == wanted).select("virtual_slot", "shard", "version")


def sized_records(records: DataFrame, keys: list[str | Column], text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``records`` with ``size`` and ``virtual_slot``; input columns so named give way.

    ``keys`` should tell records apart: with a checksum of the text beside the id,
    rows without an id are spread as well.
    """
    return records.withColumns({"size": record_size(text), "virtual_slot": virtual_slot(*keys, slots=slots)})


def assign_shards(records: DataFrame, slot_map: DataFrame, totals: DataFrame, order: list[str]) -> DataFrame:
    """``records`` (with ``virtual_slot``) with ``shard`` and ``slot``, the gapless place in the shard.

    Places follow ``order`` inside a virtual slot, and virtual slots follow one
    another inside a shard, so only one virtual slot's rows are ever ranked
    together. Repeated rows get places of their own, in any order.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(totals, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    ranked = records.drop("shard", "slot", "version").withColumn("_place", F.row_number().over(inside))
    # The map has at most SLOTS rows (under 1 MB), whatever the input.
    return ranked.join(F.broadcast(places), "virtual_slot").withColumn("slot", F.col("_first") + F.col("_place") - 1).drop("_first", "_place")
