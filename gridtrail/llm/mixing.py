"""Mixing sources to target weights by Pfair scheduling; rows are placed in DataFrame and SQL functions.

Method. A source's rows, in hashed order, are cut into blocks of BLOCK rows. With weight w (a share of
the sequence), its k-th block may start at slot floor(k / w) and is due by slot ceil((k + 1) / w);
among the blocks that may start, the earliest due goes next. One block is placed a slot, so every
prefix of the sequence holds each source's share to within one block. When a source's share is used up,
the rest share by their weights; windows are then those of the fluid schedule that serves all sources
at once, and the bound holds against it from the first slot to the last. The driver orders the blocks,
not the rows, in exact integers of the given weights.

Defined results. Every row gets a place, none is dropped or repeated. Null sources are one source;
ids may be null or repeated. Without target weights, each source weighs the square root of its rows.
Sources without a weight come after all others; a weight whose source has no rows is ignored. There may
be any number of sources; the driver holds a few numbers of each, and eight bytes a block. Texts aren't
read and of any length. Weights below zero count as none. Columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column

#: Rows of a block.
BLOCK = 64
#: Rows of a source that are numbered together, about; larger sources are dealt to as many parts by hash.
CHUNK = 5000
#: Blocks of a source whose slots are sent as one row, and blocks in all whose slots are broadcast; more are joined by a shuffle.
SLOTS, BROADCAST = 1024, 1 << 20


def whole(weights: dict) -> dict:
    """The weights in exact proportion, as integers."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()])
    return {k: int(w * unit) for k, w in exact.items()}


def fluid(blocks: dict, weights: dict) -> Iterator:
    """The sources of all slots: earliest deadline first within the windows of the exact fluid schedule.

    At virtual time v the fluid schedule has served min(n, w * v) blocks of a source of n blocks and weight
    w; their sum is the time in slots. It is linear between the virtual times at which sources end.
    """
    if not blocks:
        return
    names = sorted(blocks, key=str)
    n, w = [blocks[k] for k in names], list(whole({k: weights[k] for k in names}).values())
    ends = sorted({Fraction(a, b) for a, b in zip(n, w, strict=True)})
    near = [float(e) for e in ends]
    gone, going = [0] * (len(ends) + 1), [0] * (len(ends) + 1)
    for i in range(len(names)):
        j = bisect.bisect_left(ends, Fraction(n[i], w[i])) + 1
        gone[j] += n[i]
        going[j] -= w[i]
    going[0] = sum(w)
    gone, going = list(itertools.accumulate(gone)), list(itertools.accumulate(going))

    def time(k: int, i: int) -> tuple[int, int]:
        """Floor and ceiling of the slot at which the fluid schedule has served k blocks of source i."""
        j = bisect.bisect_left(near, k / w[i])
        # floats may be off by one or so
        while j < len(ends) and ends[j].numerator * w[i] < k * ends[j].denominator:
            j += 1
        while j and ends[j - 1].numerator * w[i] > k * ends[j - 1].denominator:
            j -= 1
        slot, rest = divmod(gone[j] * w[i] + going[j] * k, w[i])
        return slot, slot + (rest > 0)

    waiting: list[tuple] = []  # release, source, block, deadline of the block
    ready: list[tuple] = [(time(1, i)[1], i, 0) for i in range(len(names))]
    heapq.heapify(ready)
    for slot in range(sum(n)):
        while waiting and waiting[0][0] <= slot:
            _, i, k, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, k))
        _, i, k = heapq.heappop(ready)
        yield names[i]
        if k + 1 < n[i]:
            heapq.heappush(waiting, (time(k + 1, i)[0], i, k + 1, time(k + 2, i)[1]))


def slots(blocks: dict, weights: dict) -> dict:
    """The slots of each source's blocks, in order."""
    out: dict = {k: array("q") for k, n in blocks.items() if n}
    slot = 0
    weighed = {k: None for k in out if (weights.get(k) or 0) > 0}
    for part, aims in ((weighed, weights), ([k for k in out if k not in weighed], dict.fromkeys(out, 1))):
        for k in fluid({k: blocks[k] for k in part}, aims):
            out[k].append(slot)
            slot += 1
    return out


def schedule(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs as a struct column ``row``, with source, block_no, slot and position (order of the mix, gaps after short blocks)."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), column(docs, source_col).cast("string").alias("source"), F.xxhash64(column(docs, id_col)).alias("h"), F.xxhash64(*[column(docs, f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]).alias("tie"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = rows.withColumn("key", key)
    found = rows.groupBy("key").agg(F.count("*").alias("n")).toArrow()  # a row for each source
    counts = dict(zip(*(c.to_pylist() for c in found.columns), strict=True))
    aims = {k: math.sqrt(n) for k, n in counts.items()} if weights is None else {("n" if k is None else f"s{k}"): w for k, w in weights.items()}
    blocks = {k: -(-n // block) for k, n in counts.items()}
    plan = slots(blocks, {k: aims.get(k, 0) for k in counts})
    pieces = [(k, a // SLOTS, s[a : a + SLOTS]) for k, s in plan.items() for a in range(0, len(s), SLOTS)]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
    places = pa.table([pa.array([p[i] for p in pieces], t) for i, t in enumerate(kinds)], ["key", "piece", "slots"])
    places = spark.createDataFrame(places)
    sent = F.broadcast if sum(blocks.values()) <= BROADCAST else lambda df: df.hint("merge")

    parts = spark.createDataFrame(pa.table([pa.array(list(counts), pa.string()), pa.array([-(-n // CHUNK) for n in counts.values()], pa.int32())], ["key", "subs"]))
    dealt = lambda df: df.join(sent(parts), "key").withColumn("sub", F.pmod(F.col("h"), F.col("subs")).cast("int"))
    rows = dealt(rows)
    rows = rows.withColumn("inside", F.row_number().over(Window.partitionBy("key", "sub").orderBy("h", "tie")) - 1)
    # a row for each CHUNK rows or source, so joined by a shuffle on the parts
    sizes = docs.select(F.xxhash64(column(docs, id_col)).alias("h"), column(docs, source_col).cast("string").alias("source"))
    sizes = dealt(sizes.select("h", key.alias("key"))).groupBy("key", "sub").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("key").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "sub", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("before"))
    rows = rows.join(sizes, ["key", "sub"])
    rows = rows.withColumn("rank", F.col("before") + F.col("inside"))
    rows = rows.withColumn("block_no", F.floor(F.col("rank") / block))
    rows = rows.withColumn("piece", F.expr(f"block_no div {SLOTS}")).join(sent(places), ["key", "piece"])
    rows = rows.withColumn("slot", F.expr(f"slots[cast(block_no % {SLOTS} as int)]"))
    position = F.col("slot") * block + F.col("rank") % block
    return rows.select("row", "source", "block_no", "slot", position.alias("position"))


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, all and unchanged, partitioned and sorted in the order of the mix."""
    placed = schedule(docs, weights, block, id_col, source_col).select("row", "position")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
