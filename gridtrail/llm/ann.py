"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact inner products.

Method. Vectors get one more component that makes all norms equal (the largest), which turns largest
inner product into least Euclidean distance. Hashes are floor((a.x + b) / width) of normal a. A coarse
level of two-celled hashes, cut at the sample's median, parts the vectors into groups of about
GROUP_ROWS; only there are vectors shuffled, once each. In a group, TABLES tables of finer hashes are
made. A query visits the groups, and in a group the buckets of each table, in the order of the
estimated chance that a neighbour lies there, given where the query lies in its own cells and how far
the wanted neighbours are, until the chance reaches COVER or TARGET. The candidates of all tables are
merged and scored exactly.

How far they are is guessed for each query from a bounded sample. A query first visits its own group,
and there its likeliest buckets; the k-th distance that it finds bounds the true one, so the lesser of
it and the guess says what to visit next, and a query that still finds its k-th further away than that
visits the further buckets and groups that this distance asks for. So the chances hold for each query,
however the distances differ. A query that its buckets leave with fewer than k candidates visits all of
the group, and one that its groups leave with fewer visits all groups.

Chances of buckets aren't enumerated over perturbations but taken for the buckets in use, down to the
chance that simulated neighbours exceed with the wanted probability; so any chance can be attained with
any number of hashes, and no query scans all for want of probes. Every vector is indexed. A group of
more than GROUP_ROWS vectors, as a very common vector makes, is split by hash into parts that are all
visited, and one that more than QUERY_ROWS queries visit is copied for each so many.

Defined results. Vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor do null ids. Shorter vectors count as filled up with zeros. Rows, not ids, are candidates:
each row of a repeated id is found under that id, and is a query of its own if the id is asked for. A query
has as many rows as there are candidates, at most ``k``. Ties go to the smaller id. An empty table, and
one without a query, give no rows. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, small_batches

#: Tables in a group.
TABLES = 4
#: Estimated chance that a wanted neighbour is in a visited bucket, and that it is in a visited group.
TARGET, COVER = 0.975, 0.985
#: Vectors of a group, about, and the queries that one task takes for it.
GROUP_ROWS, QUERY_ROWS = 1 << 15, 1 << 15
#: The sample for the guess of distances and the coarse cuts: rows and components, at most.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 1 << 20
#: Bucket width as a multiple of the vectors' spread along a projection, and hashes of a bucket at most.
WIDTH, HASHES = 2.0, 12
#: Simulated neighbours of a query, and queries taken together.
DRAWS, BATCH = 256, 64
#: Chance below which a group is left out of a query's order; all of these together stay below 1 - COVER.
LEAST_CHANCE = 1e-7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part; x keeps single precision where the input has it."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    out = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vector_col).cast("array<float>" if single else "array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return out.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(fine)


_ERF = np.frompyfunc(math.erf, 1, 1)


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function."""
    return 0.5 + 0.5 * _ERF(z / math.sqrt(2)).astype(float)


class Lift:
    """Vectors with a component that makes all norms equal, and queries scaled to that norm."""

    def __init__(self, norm: float):
        self.norm = norm

    def data(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def query(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, initial=1e-300)[:, None]
        return np.concatenate([q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))], axis=1)

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from each query vectors of these inner products are; without a score, as far as can be."""
        unit = score / self.norm / np.sqrt((q * q).sum(axis=1))
        return np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(unit), unit, -1)))


class Groups:
    """The coarse level: cuts of some projections at the sample's medians, and the guess of a query's distance."""

    def __init__(self, n: int, norm: float, sample: np.ndarray, names: np.ndarray, k: int, seed: int = 11):
        self.lift = Lift(norm)
        self.bits = max(0, math.ceil(math.log2(n / GROUP_ROWS))) if n > GROUP_ROWS else 0
        self.sample, self.names = self.lift.data(sample), names
        self.a = np.random.default_rng(seed).normal(size=(self.sample.shape[1], self.bits))
        self.cut = np.median(self.sample @ self.a, axis=0)
        self.rank = min(max(0, round(k * len(sample) / n) - 1), max(0, len(sample) - 2))

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The group of each vector, or the likeliest one of each query."""
        side = (self.lift.query(x) if query else self.lift.data(x)) @ self.a >= self.cut
        return side @ (1 << np.arange(self.bits, dtype=np.int64))

    def guess(self, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How far each query's k-th neighbour may be, from the sample without the query's own row."""
        near = self.lift.query(q) @ self.sample.T
        near[own[:, None] == self.names[None]] = -np.inf
        if near.shape[1] < 2:
            return np.full(len(q), math.sqrt(2))
        inner = -np.partition(-near, self.rank, axis=1)[:, self.rank]
        return np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(inner), inner, 0)))

    def order(self, q: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """For each query, the groups to visit in the order of their chance, until it reaches COVER."""
        at = self.lift.query(q) @ self.a - self.cut
        own = at >= 0
        stay = normal(np.abs(at) / np.maximum(far, 1e-9)[:, None])
        out = []
        for i in range(len(q)):
            keys, chance = np.zeros(1, dtype=np.int64), np.ones(1)
            for j in range(self.bits):
                here = np.int64(own[i, j]) << j
                keys = np.concatenate([keys | here, keys | (here ^ (1 << j))])
                chance = np.concatenate([chance * stay[i, j], chance * (1 - stay[i, j])])
                some = chance >= LEAST_CHANCE
                keys, chance = keys[some], chance[some]
            order = np.argsort(-chance, kind="stable")
            stop = int(np.searchsorted(np.cumsum(chance[order]), COVER)) + 1
            out.append(keys[order[:stop]])
        return out


class Table:
    """One hash table over the vectors of a group: its buckets in use, and their chances for queries."""

    def __init__(self, lifted: np.ndarray, hashes: int, rng: np.random.Generator):
        self.a = rng.normal(size=(lifted.shape[1], hashes))
        along = lifted @ self.a
        self.width = max(WIDTH * float(along.std(axis=0).mean()), 1e-9)
        self.b = rng.uniform(0, self.width, hashes)
        cells = np.floor((along + self.b) / self.width).astype(np.int64)
        self.low = cells.min(axis=0)
        # far cells of a few outliers share one, so that each hash has few
        cells = np.minimum(cells - self.low, 63)
        self.counts = cells.max(axis=0) + 1
        buckets, self.bucket_of = np.unique(cells, axis=0, return_inverse=True)
        self.bucket_of = self.bucket_of.reshape(-1)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        self.one_hot = np.zeros((int(self.counts.sum()), len(buckets)), dtype=np.float32)
        for m in range(hashes):
            self.one_hot[self.starts[m] + buckets[:, m], np.arange(len(buckets))] = 1
        self.noise = rng.normal(size=(DRAWS, hashes))

    def logs(self, asked: np.ndarray, far: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
        """The log chance of each bucket for each query, and the least one to visit for a chance of need."""
        at = (asked @ self.a + self.b) / self.width - self.low  # query, hash: in cells
        scale = np.maximum(far, 1e-9)[:, None] / self.width
        parts, simulated = [], np.zeros((len(asked), DRAWS))
        for m in range(len(self.counts)):
            n = int(self.counts[m])
            edges = np.arange(n + 1, dtype=float)
            edges[0], edges[-1] = -np.inf, np.inf  # the outer cells in use hold what is beyond
            chance = np.diff(normal((edges[None] - at[:, m : m + 1]) / scale), axis=1)
            logs = np.log(np.maximum(chance, 1e-30))
            parts.append(logs)
            drawn = np.clip(np.floor(at[:, m : m + 1] + self.noise[None, :, m] * scale), 0, n - 1).astype(np.int64)
            simulated += np.take_along_axis(logs, drawn, axis=1)
        least = np.quantile(simulated, 1 - need, axis=1)
        return np.concatenate(parts, axis=1).astype(np.float32) @ self.one_hot, least - 1e-3


class Index:
    """The tables of one group, and exact search among the rows that they give."""

    def __init__(self, lift: Lift, x: np.ndarray, ids: np.ndarray, names: np.ndarray, seed: int = 23):
        self.lift, self.x, self.ids, self.names = lift, x, ids, names
        rng = np.random.default_rng(seed)
        hashes = min(HASHES, max(3, round(0.75 * math.log2(max(len(x), 2)))))
        lifted = lift.data(x)
        self.tables = [Table(lifted, hashes, rng) for _ in range(TABLES)]
        #: Rows scored, and queries that scored all for want of k.
        self.visited, self.short = 0, 0

    def search(self, q: np.ndarray, own: np.ndarray, guess: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, row's place, score) of each query's k best, in order; own: the names of the queries' own rows.

        bound: how far each query's k-th best of other groups is; 2, as far as can be, where none is known.
        """
        bound = np.full(len(q), 2.0) if bound is None else bound
        asked = self.lift.query(q)
        order = np.lexsort(np.floor((asked @ self.tables[0].a[:, :3]) / self.tables[0].width).T)
        out = []
        for at in range(0, len(q), BATCH):
            some = order[at : at + BATCH]
            i, j, score = self._batch(q[some], asked[some], own[some], guess[some], bound[some], k)
            out.append((some[i], j, score))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _batch(self, q: np.ndarray, asked: np.ndarray, own: np.ndarray, guess: np.ndarray, bound: np.ndarray, k: int) -> tuple:
        need = 1 - (1 - TARGET) ** (1 / TABLES)
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        held = None
        # the likeliest bucket of each table, then those that the guess asks for, then those that the found distance asks for
        far = guess
        for turn in range(3):
            open_, short = np.arange(len(q)), np.zeros(len(q), dtype=bool)
            if turn == 1:
                far = np.minimum(guess, np.minimum(bound, self._kth(q, held, k)))
            elif turn == 2:
                found = np.minimum(bound, self._kth(q, held, k))
                short = (found >= 2) & (np.bincount(held[0], minlength=len(q)) < min(k, len(self.x) - 1))
                open_ = np.flatnonzero(short | (found > far * (1 + 1e-9)))
                far, short = found, short[open_]
                self.short += int(short.sum())
            if not len(open_):
                break
            fresh = np.zeros((len(open_), len(self.x)), dtype=bool)
            for table in self.tables:
                logs, least = table.logs(asked[open_], far[open_], need)
                hit = logs >= (least if turn else logs.max(axis=1))[:, None]
                fresh |= hit[:, table.bucket_of]
            fresh[short] = True
            fresh &= ~seen[open_]
            seen[open_] |= fresh
            held = self._best(q, own, open_, fresh, held, k)
        self.visited += int(seen.sum())
        return held

    def _kth(self, q: np.ndarray, held: tuple, k: int) -> np.ndarray:
        """The distance of each query's k-th best so far; of those with fewer, as far as can be."""
        i, _, score = held
        least = np.full(len(q), -np.inf)
        full = np.bincount(i, minlength=len(q)) >= min(k, len(self.x) - 1)
        low = np.full(len(q), np.inf)
        np.minimum.at(low, i, score)
        least[full] = low[full]
        return np.minimum(self.lift.distance(q, least), 2.0)

    def _best(self, q: np.ndarray, own: np.ndarray, open_: np.ndarray, fresh: np.ndarray, held: tuple | None, k: int) -> tuple:
        """The k best of what is held and of the fresh rows: larger scores first, then smaller ids."""
        fresh &= own[open_][:, None] != self.names[None]
        rows = np.flatnonzero(fresh.any(axis=0))
        picks = [held] if held is not None else []
        for a in range(0, len(rows), 1 << 14):
            part = rows[a : a + (1 << 14)]
            rough = np.where(fresh[:, part], q[open_] @ self.x[part].T, -np.inf)
            rough = np.where(np.isnan(rough), -np.inf, rough)
            if rough.shape[1] > k:
                least = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
                # products of a block may differ in the last bits, so near ones pass and are summed alike below
                some = np.isfinite(least)
                least[some] -= 1e-9 * (1 + np.abs(least[some])) + 1e-12 * float(np.abs(rough[np.isfinite(rough)]).max(initial=0))
                i, j = np.nonzero((rough >= least[:, None]) & fresh[:, part])
            else:
                i, j = np.nonzero(fresh[:, part])
            for b in range(0, len(i), 1 << 16):
                who, which = open_[i[b : b + (1 << 16)]], part[j[b : b + (1 << 16)]]
                picks.append((who, which, (self.x[which] * q[who]).sum(axis=1)))
                if len(picks) > 4:
                    picks = [self._cut(picks, k)]
        return self._cut(picks, k) if picks else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _cut(self, picks: list[tuple], k: int) -> tuple:
        i, j, score = (np.concatenate(c) for c in zip(*picks, strict=True))
        order = np.lexsort((self.names[j], self.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        return i[keep], j[keep], score[keep]


def _rows(x: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors as rows of dim components; shorter ones are filled up with zeros."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    sizes = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None] < sizes[:, None]] = flat
    return out


def _filled(x: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(x), dim))
    for i, v in enumerate(x):
        out[i, : len(v)] = v
    return out


_VISITS = "quid long, g long, far double, bound double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row whose id is in queries, by largest inner product."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ann")
    data = scratch.keep(usable(vectors, id_col, vector_col).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    wide = F.transform("x", lambda v: v.cast("double"))
    facts = data.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate(wide, F.lit(0.0), lambda a, v: a + v * v))).alias("m"), F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform(wide, F.abs))).alias("top")).first()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    n, dim = facts["n"], facts["d"]
    norm = facts["m"] if math.isfinite(facts["m"]) and facts["m"] > 0 else facts["top"] * math.sqrt(dim)
    taken = data.orderBy(F.xxhash64("id"), "uid").limit(max(64, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))).select("uid", "x").toArrow()
    groups = Groups(n, norm, _rows(taken.column("x"), dim), taken.column("uid").to_numpy(), k)

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(groups.of(_rows(batch.column("x"), dim))), *batch.columns], ["g", *batch.schema.names])

    def visiting(turn: int):
        """The groups of a turn: a query's own; those that the lesser of guess and found k-th distance asks for; those that the found one does.

        A query that has found fewer than k goes to all groups in the last turn.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every, names = _rows(batch.column("x"), dim), batch.column("uid").to_numpy()
                for a in range(0, len(every), 256):
                    q, uid = every[a : a + 256], names[a : a + 256]
                    far = groups.guess(q, uid)
                    home = groups.of(q, query=True)
                    if not turn:
                        yield _visits(uid, far, np.full(len(q), 2.0), [home[i : i + 1] for i in range(len(q))])
                        continue
                    found, first = (batch.column(c).to_numpy(zero_copy_only=False)[a : a + 256] for c in ("least", "first"))
                    reach = lambda score: np.where(np.isnan(score), 2.0, groups.lift.distance(q, np.nan_to_num(score)))  # noqa: E731, B023
                    asked_for = np.minimum(far, reach(first))
                    lists = [np.setdiff1d(x, h) for x, h in zip(groups.order(q, asked_for), home, strict=True)]
                    if turn == 1:
                        yield _visits(uid, asked_for, reach(first), lists)
                        continue
                    far = reach(found)
                    open_ = np.flatnonzero(np.isnan(found) | (far > asked_for * (1 + 1e-9)))
                    more = groups.order(q[open_], far[open_])
                    more = [np.setdiff1d(np.arange(1 << groups.bits) if np.isnan(found[i]) else x, np.append(lists[i], home[i])) for i, x in zip(open_, more, strict=True)]
                    yield _visits(uid[open_], far[open_], far[open_], more)

        return run

    def _visits(uid: np.ndarray, far: np.ndarray, bound: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(x) for x in lists]
        flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(uid, sizes)), pa.array(flat.astype(np.int64)), pa.array(np.repeat(far, sizes)), pa.array(np.repeat(bound, sizes))], ["quid", "g", "far", "bound"])

    kind = data.schema["x"].dataType.simpleString()
    placed = data.mapInArrow(placing, f"g long, id long, x {kind}, uid long") if groups.bits else data.select(F.lit(0).cast("long").alias("g"), "id", "x", "uid")
    asked = data.join(usable(queries, id_col, vector_col).select("id").distinct(), "id", "left_semi")
    asked = scratch.keep(asked.select("uid", "id", "x"), "asked")
    # one row for each group
    sizes = scratch.keep(placed.groupBy("g").agg(F.ceil(F.count("*") / (2 * GROUP_ROWS)).cast("int").alias("parts")), "sizes")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Each query's best in one part of a group."""
        if not len(left) or not len(right):
            return pd.DataFrame({"quid": [], "vec_id": [], "score": []}).astype({"quid": "int64", "vec_id": "int64", "score": "float64"})
        right, left = right.sort_values("uid"), left.sort_values("quid")
        ids = right["id"].to_numpy()
        index = Index(groups.lift, _filled(right["x"], dim), ids, right["uid"].to_numpy())
        own = left["quid"].to_numpy()
        i, j, score = index.search(_filled(left["x"], dim), own, left["far"].to_numpy(), k, left["bound"].to_numpy())
        return pd.DataFrame({"quid": own[i], "vec_id": ids[j], "score": score})

    best = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id")

    def visited(visits: DataFrame, name: str) -> DataFrame:
        """The best found of each query by its visits."""
        visits = scratch.keep(visits, f"{name}-visits")
        load = visits.groupBy("g").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("copies"))
        layout = scratch.keep(sizes.join(load, "g"), f"{name}-layout")
        rows = placed.join(layout, "g").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        there = visits.join(layout, "g").withColumn("copy", F.pmod(F.xxhash64("quid"), F.col("copies")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        there = there.join(asked.select(F.col("uid").alias("quid"), "x"), "quid")
        keys = ["g", "part", "copy"]
        return there.select(*keys, "quid", "far", "bound", "x").groupBy(*keys).cogroup(rows.select(*keys, "uid", "id", "x").groupBy(*keys)).applyInPandas(compare, "quid long, vec_id long, score double")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = scratch.keep(merged(visited(asked.mapInArrow(visiting(0), _VISITS), "turn-0")).drop("rank"), "found-0")
    # k rows for each query at most
    kth = lambda found, name: found.groupBy("quid").agg(F.when(F.count("*") >= min(k, n - 1), F.min("score")).alias(name))
    first = kth(found, "first").withColumnRenamed("quid", "uid")
    for turn in (1, 2) if groups.bits else ():
        now = asked.join(first, "uid", "left").join(kth(found, "least").withColumnRenamed("quid", "uid"), "uid", "left")
        more = visited(now.mapInArrow(visiting(turn), _VISITS), f"turn-{turn}")
        found = scratch.keep(merged(found.unionByName(more)).drop("rank"), f"found-{turn}")
    out = merged(found).join(asked.select(F.col("uid").alias("quid"), F.col("id").alias("query_id")), "quid")
    return out.select("query_id", "rank", "vec_id", "score")
