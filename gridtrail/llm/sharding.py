"""Sharding by fixed virtual slots, in DataFrame and SQL functions only.

Method. Each record's id, or its text where that is null, is hashed to one of SLOTS virtual slots; bytes and rows are
aggregated per slot, which leaves a table of SLOTS rows at any input size. A slot that holds more than
one in SPLIT of all rows, as many repeated rows make, is dealt to parts by the rows' numbers in the first reading. A
slot-to-shard map deals the slots and parts out, heaviest first, each to the shard that is lightest so
far. Maps are stored with a version, and a rebalancing or a new shard edits the last one, so that only
rows of the moved slots move.

Defined results. A null text has no bytes (its CRC-32 is 0, its size 1) and counts as an empty one; null
ids are told apart by their texts; repeated rows are all placed. Ties in a slot are numbered in the order
of id and CRC. Texts of any length are read whole, and a row is never split, so a shard that gets a very
long one may be that much heavier. An empty table gives no rows. Other columns of the input aren't read
by ``assign``, and their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column

#: Virtual slots: three hexadecimal digits of the MD5 of the id, or for want of one of a colon and the text's CRC-32.
SLOTS = 4096
#: A slot with more than one in SPLIT of all rows, and more than SPLIT_ROWS, is dealt to parts.
SPLIT, SPLIT_ROWS = 1024, 1000


def slot_of(key: Column, crc: Column) -> Column:
    """The virtual slot of an id, or of the CRC where it is null, the same on every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.concat(F.lit(":"), crc.cast("string")))), 1, 3), 16, 10).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, virtual slot and number (unique in this reading) of each row."""
    text = column(docs, text_col).cast("string")
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    return docs.select(
        column(docs, id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        slot_of(column(docs, id_col), crc).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row"),
    )


def split(records: DataFrame) -> DataFrame:
    """records with part, the part of its slot that a row is dealt to; 0 but in slots of very many rows.

    records must be a written table, so that the rows' numbers stay. At most SPLIT slots are broadcast.
    """
    slots = records.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(SPLIT_ROWS), F.floor(F.sum("n").over(Window.partitionBy()) / SPLIT))  # over SLOTS rows
    heavy = slots.withColumn("most", most).where("n > most").select("virtual_slot", F.ceil(F.col("n") / F.col("most")).cast("int").alias("parts"))
    out = records.join(F.broadcast(heavy), "virtual_slot", "left")
    return out.withColumn("part", F.pmod("row", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts", "row")


def slot_bytes(records: DataFrame) -> DataFrame:
    """One row for each slot and part in use: bytes and rows; at most SLOTS + 2 * SPLIT rows."""
    return records.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def build_map(weights: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (virtual_slot, part, shard, bytes, rows, first_row, version).

    first_row is the position in its shard of the slot's first row, slots in the order of their numbers.
    One fold over the sorted list of slots and parts keeps the shards' loads.
    """
    listed = weights.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("w"), "virtual_slot", "part", "rows"))).alias("slots"))
    fold = f"""
        aggregate(slots,
          struct(array_repeat(0L, {shards}) as loads, cast(array() as array<int>) as picks),
          (acc, x) -> element_at(transform(array(array_position(acc.loads, array_min(acc.loads))), p ->
            struct(transform(acc.loads, (l, k) -> if(k + 1 = p, l - x.w, l)) as loads, array_append(acc.picks, cast(p - 1 as int)) as picks)), 1),
          acc -> acc.picks)"""
    dealt = listed.select(F.explode(F.arrays_zip("slots", F.expr(fold).alias("picks"))).alias("d"))
    dealt = dealt.select(F.col("d.slots.virtual_slot").alias("virtual_slot"), F.col("d.slots.part").alias("part"), F.col("d.picks").alias("shard"), (-F.col("d.slots.w")).alias("bytes"), F.col("d.slots.rows").alias("rows"))
    return numbered(dealt).withColumn("version", F.lit(1))


def numbered(dealt: DataFrame) -> DataFrame:
    """The map with first_row anew."""
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("first_row", F.coalesce(F.sum("rows").over(ahead), F.lit(0).cast("long")))


def grow_map(last: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard (number shards): it takes slots from the others, which exchange none.

    Of each shard the slots are run through in the order of their hash, and those go whose running
    bytes fall in the part that the new shard is due.
    """
    run = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot", "part"), "virtual_slot", "part")
    whole = Window.partitionBy("shard")
    due = F.sum("bytes").over(run) * (shards + 1) <= F.sum("bytes").over(whole)
    moved = last.withColumn("due", due).withColumn("shard", F.when(F.col("due"), F.lit(shards)).otherwise(F.col("shard")))
    return numbered(moved.drop("due", "first_row")).withColumn("version", F.col("version") + 1)


def rebalance_map(last: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version for changed weights: overfull shards give up their last slots, which go to the lightest.

    Slots stay where they are as far as a shard's share of the bytes lets them; new slots count as given up.
    """
    now = weights.join(last.select("virtual_slot", "part", "shard", "version"), ["virtual_slot", "part"], "left")
    version = F.max("version").over(Window.partitionBy())
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot", "part"))
    now = now.select("virtual_slot", "part", "bytes", "rows", version.alias("version"), F.when(run <= share, F.col("shard")).alias("shard"))
    loads = ", ".join(f"coalesce(sum(bytes) filter (where shard = {k}), 0L)" for k in range(shards))
    open_slots = "sort_array(collect_list(struct(-bytes as w, virtual_slot, part, rows)) filter (where shard is null))"
    state = now.agg(F.expr(f"array({loads})").alias("loads"), F.expr(open_slots).alias("slots"), F.max("version").alias("version"))
    fold = """
        aggregate(slots, struct(loads as loads, cast(array() as array<int>) as picks),
          (acc, x) -> element_at(transform(array(array_position(acc.loads, array_min(acc.loads))), p ->
            struct(transform(acc.loads, (l, k) -> if(k + 1 = p, l - x.w, l)) as loads, array_append(acc.picks, cast(p - 1 as int)) as picks)), 1),
          acc -> acc.picks)"""
    dealt = state.select("version", F.explode(F.arrays_zip("slots", F.expr(fold).alias("picks"))).alias("d"))
    dealt = dealt.select(F.col("d.slots.virtual_slot").alias("virtual_slot"), F.col("d.slots.part").alias("part"), (-F.col("d.slots.w")).alias("bytes"), F.col("d.slots.rows").alias("rows"), "version", F.col("d.picks").alias("shard"))
    stay = now.where("shard is not null").select(dealt.columns)
    return numbered(stay.unionByName(dealt)).withColumn("version", F.col("version") + 1)


def save_map(edited: DataFrame, folder: str) -> None:
    """Add this version to the stored maps; older versions stay."""
    edited.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the last one by default."""
    maps = spark.read.parquet(folder)
    if version is None:
        newest = maps.agg(F.max("version").alias("version"))
        return maps.join(F.broadcast(newest), "version").select(maps.columns)
    return maps.where(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records with shard and slot, the row's position in its shard, gapless from 0.

    The map has at most SLOTS + 2 * SPLIT rows and is broadcast. Rows are numbered within their part of
    a virtual slot, so no task needs a whole shard, nor a slot of very many rows.
    """
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32"))
    placed = records.withColumn("inside", inside - 1)
    placed = placed.join(F.broadcast(slot_map.select("virtual_slot", "part", "shard", "first_row", "version")), ["virtual_slot", "part"])
    return placed.withColumn("slot", F.col("first_row") + F.col("inside")).drop("inside", "first_row")


def write_shards(docs: DataFrame, slot_map: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs by shard (folders shard=K), all columns kept, as the map says; rows of a slot of several parts go to any of these."""
    clash = [c for c in docs.columns if c.lower() == "shard"]
    renamed = docs.withColumnsRenamed({c: f"{c}_of_record" for c in clash})
    crc = F.coalesce(F.crc32(column(renamed, text_col).cast("string")), F.lit(0))
    slot = slot_of(column(renamed, id_col), crc)
    shards = slot_map.groupBy("virtual_slot").agg(F.array_sort(F.collect_list(F.struct("part", "shard"))).alias("shards"))
    at = F.broadcast(shards.select(F.col("virtual_slot").alias("__slot"), F.col("shards.shard").alias("__shards")))
    out = renamed.withColumn("__slot", slot).withColumn("__row", F.monotonically_increasing_id()).join(at, "__slot")
    out = out.withColumn("shard", F.expr("__shards[cast(pmod(__row, size(__shards)) as int)]"))
    out.drop("__slot", "__row", "__shards").write.partitionBy("shard").parquet(folder)
