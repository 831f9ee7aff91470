"""Connected components by shuffles, and numbering without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Scratch


#: A value that more rows share than one in HEAVY of all, and than HEAVY_ROWS, is looked up by broadcast.
HEAVY, HEAVY_ROWS = 1024, 1000


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, n: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """rows with column value of the table's row of equal key, null where there is none; keys of the table are unique, a null is none.

    Rows of a key that very many share would meet in one task. Their keys, HEAVY at most, are looked up
    first and sent to all tasks, and the rows themselves, and those without a key, are dealt out by their number.
    n is the number of rows, counts (key, n) the rows of each key; both are counted where they aren't given,
    and rows are then read twice, so they should be written ones. Keys that are structs are joined as they are.
    """
    table = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    n = rows.count() if n is None else n
    limit = max(HEAVY_ROWS, n // HEAVY)
    if n <= 10 * HEAVY_ROWS or isinstance(rows.schema[key].dataType, T.StructType):
        return rows.join(table, F.col(key) == F.col("_key"), "left").withColumnRenamed("_value", value).drop("_key")
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    heavy = counts.where(F.col("n") > limit).select(F.col(key).alias("_heavy"))
    heavy = heavy.join(table, F.col("_heavy") == F.col("_key"), "left").select("_heavy", F.col("_value").alias("_found"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    common = F.col("_heavy").isNotNull()
    alone = (-1 - F.monotonically_increasing_id()).cast("string").cast(rows.schema[key].dataType)
    apart = F.when(common | F.col(key).isNull(), alone).otherwise(F.col(key))
    out = out.withColumn("_apart", apart).join(table, F.col("_apart") == F.col("_key"), "left")
    found = F.when(common, F.col("_found")).when(F.col(key).isNotNull(), F.col("_value"))
    return out.withColumn(value, found).drop("_heavy", "_found", "_apart", "_key", "_value")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for each node of the edges (u, v): comp is the smallest node reachable.

    Each round hooks every node to its smallest lower neighbour, halves the paths twice and contracts
    the edges, all by shuffles on the node, nodes of very many edges by broadcast; edges shrink until
    none is left. Nothing is collected.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    first = scratch.keep(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), f"{name}-edges-0")
    left, hooks, edges_in_all = first, [], 0
    while n := left.count():
        k, edges_in_all = len(hooks) + 1, edges_in_all or n
        large = n > 10 * HEAVY_ROWS
        hook = left.groupBy("u").agg(F.min("v").alias("v"))
        hook = scratch.keep(hook, f"{name}-near-{k}") if large else hook
        for turn in range(2):
            up = hook.select(F.col("u").alias("v"), F.col("v").alias("w"))
            hook = looked_up(hook, "v", up, "w", n).select("u", F.coalesce("w", "v").alias("v"))
            hook = scratch.keep(hook, f"{name}-far-{k}-{turn}") if large and not turn else hook
        hooks.append(scratch.keep(hook, f"{name}-hook-{k}"))
        left = looked_up(left, "u", hooks[-1].select("u", F.col("v").alias("a")), "a", n)
        left = scratch.keep(left, f"{name}-half-{k}") if large else left
        left = looked_up(left, "v", hooks[-1].select(F.col("u").alias("v"), F.col("v").alias("b")), "b", n)
        left = left.select("a", F.coalesce("b", "v").alias("b")).where("a <> b")
        left = left.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        left = scratch.keep(left, f"{name}-edges-{k}")
        scratch.drop(f"{name}-near-{k}", f"{name}-far-{k}-0", f"{name}-half-{k}")
        if k > 1:
            scratch.drop(f"{name}-edges-{k - 1}")
    nodes = first.select(F.col("v").alias("node")).distinct()
    nodes = hooks[0].select(F.col("u").alias("node")).union(nodes).distinct() if hooks else nodes  # all upper ends have a hook
    labels, n = nodes.withColumn("comp", F.col("node")), 2 * edges_in_all  # nodes, at most
    if n > 10 * HEAVY_ROWS:
        labels = scratch.keep(labels, f"{name}-labels-0")
    for k, hook in enumerate(hooks):  # a few rounds; every node follows its component's path
        to = hook.select(F.col("u").alias("comp"), F.col("v").alias("to"))
        labels = looked_up(labels, "comp", to, "to", n).select("node", F.coalesce("to", "comp").alias("comp"))
        labels = scratch.keep(labels, f"{name}-labels-{k + 1}") if n > 10 * HEAVY_ROWS and k + 1 < len(hooks) else labels
    labels = scratch.keep(labels, f"{name}-labels")
    scratch.drop(*(f"{name}-hook-{k + 1}" for k in range(len(hooks))), *(f"{name}-labels-{k}" for k in range(len(hooks))), f"{name}-edges-0", f"{name}-edges-{len(hooks)}")
    return labels


def numbered(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """rows with a column name of 1, 2, ... in the given order, which must be total.

    Rows are range-partitioned and counted per partition; only the table of partition counts is summed
    up in one place, and broadcast, one row a partition.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = scratch.keep(placed, f"{name}-placed")
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counts = counts.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
