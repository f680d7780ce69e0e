"""Approximate nearest neighbours by multiprobe p-stable hashing; distances are exact, in double precision.

Each of ``tables`` hash tables cuts ``k`` Gaussian projections into cells of one width. A query visits its own cell and
then perturbed ones in the order of their estimated success: with its 2k walls ranked by distance, a set of crossed walls
scores the sum of the expected squared distances of its ranks, so the order of the sets is one list for all queries, and
the ranking of its walls makes them cells. Cells hold their vectors, so candidates are ranked where they lie: a vector
travels once a table, a query's vector once to each part that holds cells it visits. The nearest of each part are merged.

``fit`` sets width, k and the number of probes on at most ``SAMPLE`` distinct vectors, picked by a hash of the id: it
estimates the distance of the tenth neighbour in the whole table from the sample (tail of the distances to the power of
the local dimension), takes k for cells of about OCCUPANCY vectors, and simulates neighbours at that distance until
the probes find ``goal`` of them. Every vector is indexed, whatever the size of the table. Queries whose probes found
fewer than asked for, as those of outliers, of small clusters beside a dense one and of tiny tables, are compared with
every class.

Equal vectors form one class, which keeps its smallest ids only, as many as a result may need: a vector that a third of
the rows share is stored once, and ties still go to the smaller ids. Cells above LIMIT vectors are split, and queries
visit every part.

Null, empty and zero vectors, those with null or non-finite components, those of another length than most of the
sample's, and null ids take no part. Repeated rows count once. An id names one vector: where its rows differ, the one
with the least hash stands. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, tasks, tidied, written

SAMPLE = 2000
OCCUPANCY = 64
#: Vectors of a cell that one part holds.
LIMIT = 512
MOST_PROBES = 256
#: Short queries that are broadcast at once, and compared in one product.
SCANNED = 20_000
BLOCK = 500
#: Rows up to which a set of ids or hashes is broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def wall_sets(k: int, most: int) -> np.ndarray:
    """The first ``most`` sets of crossed walls by expected score, as marks over the 2k ranks; the empty set first.

    The wall of rank j (from 1) lies at an expected squared distance of j (j + 1) / (4 (k + 1) (k + 2)) of the width,
    mirrored for the farther half. Ranks j and 2k + 1 - j are the two walls of one projection, of which one is crossed.
    """
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far_ = 1 - (k + 1 - j) / (k + 1) + (k + 1 - j) * (k + 2 - j) / (4 * (k + 1) * (k + 2))
    cost = [*near.tolist(), *far_.tolist()]
    out = [np.zeros(2 * k, bool)]
    heap = [(cost[0], (0,))]
    while heap and len(out) < most:
        c, chosen = heapq.heappop(heap)
        if all(2 * k - 1 - i not in chosen for i in chosen):
            marks = np.zeros(2 * k, bool)
            marks[list(chosen)] = True
            out.append(marks)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*chosen, last + 1)))
    return np.array(out)


class Index:
    """Projections of all tables: keys of vectors, and keys in probing order of queries."""

    def __init__(self, dim: int, k: int, width: float, tables: int, probes: int, seed: int = 0):
        rng = np.random.default_rng([seed, k])
        self.dim, self.k, self.width, self.tables = dim, k, width, tables
        self.a = rng.normal(size=(tables, dim, k))
        self.b = rng.uniform(0, 1, size=(tables, k))
        self.sets = wall_sets(k, probes)

    def place(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.a[table] / self.width + self.b[table]

    def key(self, cells: np.ndarray, table: int) -> np.ndarray:
        out = np.full(len(cells), table + 1, np.uint64)
        for j in range(cells.shape[1]):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, j].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def own(self, x: np.ndarray, table: int) -> np.ndarray:
        return self.key(np.floor(self.place(x, table)).astype(np.int64), table)

    def visits(self, x: np.ndarray, table: int) -> np.ndarray:
        """Keys that each query visits, in probing order: queries x probes."""
        place = self.place(x, table)
        cells = np.floor(place)
        walls = np.concatenate((place - cells, 1 - (place - cells)), 1)
        rank = np.argsort(np.argsort(walls, 1, kind="stable"), 1, kind="stable")
        step = self.sets[:, rank[:, self.k :]].astype(np.int64) - self.sets[:, rank[:, : self.k]]  # probes x queries x k
        visited = cells.astype(np.int64)[None] + step
        return self.key(visited.reshape(-1, self.k), table).reshape(len(self.sets), -1).T


def far(sample: np.ndarray, n: int, neighbours: int = 10) -> float:
    """Distance within which nine in ten vectors have their tenth neighbour, in a table of n."""
    d = []
    m = min(20, len(sample) - 1)
    for x in sample[:300]:
        s = np.sort(np.sqrt(((sample - x) ** 2).sum(1)))[1 : m + 1]
        s = s[s > 0]
        if len(s) > 1:
            dim = 1 / max(1e-3, np.mean(np.log(s[-1] / s[:-1])))
            d.append(s[-1] * min(1.0, (neighbours / n) / (len(s) / len(sample))) ** (1 / dim))
    return float(np.quantile(d, 0.9)) if d else 1.0


def fit(sample: np.ndarray, n: int, tables: int = 2, goal: float = 0.97, seed: int = 0) -> Index:
    """An index for n vectors like those of the sample."""
    dim = sample.shape[1]
    d = far(sample, n)
    width = 1.9 * d
    rng = np.random.default_rng(seed)
    cells = np.floor(sample @ rng.normal(size=(dim, 64)) / width + rng.uniform(size=64))
    share = [np.unique(c, return_counts=True)[1] / len(c) for c in cells.T]
    entropy = max(1e-3, float(np.mean([-(p * np.log(p)).sum() for p in share])))
    k = max(1, min(24, math.ceil(math.log(max(1.0, n / OCCUPANCY)) / entropy)))
    queries = sample[rng.permutation(len(sample))[:400]]
    off = rng.normal(size=queries.shape)
    near = queries + off * (d / np.linalg.norm(off, axis=1, keepdims=True))
    while True:
        index = Index(dim, k, width, tables, MOST_PROBES, seed)
        rank = np.full(len(queries), MOST_PROBES + 1)
        for t in range(tables):
            hit = index.visits(queries, t) == index.own(near, t)[:, None]
            rank = np.where(hit.any(1), np.minimum(rank, hit.argmax(1) + 1), rank)
        probes = int(np.sort(rank)[math.ceil(goal * len(rank)) - 1])
        if probes <= MOST_PROBES or k == 1:
            index.sets = index.sets[:probes]
            return index
        k -= 1


def vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype]:
    """(id, x): valid vectors as bytes of their own precision, four or eight a component, with no negative zero."""
    kind = df.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    x = F.col("x")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("x"))
    valid = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = rows.filter(F.col("id").isNotNull() & x.isNotNull() & F.coalesce(valid, F.lit(False)))
    dtype = np.dtype(np.float32 if single else np.float64)

    def packed(batches):
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) * dtype.itemsize
            x = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["id", "x"])

    return rows.mapInArrow(tidied(packed), T.StructType([rows.schema["id"], T.StructField("x", T.BinaryType())])), dtype


def matrix(column: pa.Array, dtype: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim).astype(np.float64)


def few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(c, x, ids): each distinct vector with its ``keep`` smallest ids, c the smallest.

    Hashes and ids alone tell which ids have several vectors and which vectors several ids; only those of the latter are
    shuffled, as many of each task as a result may need.
    """
    rows = rows.withColumn("h", F.xxhash64("x"))
    keys = written(rows.select("id", "h"), "keys", 4)
    several = written(keys.groupBy("id").agg(F.min("h").alias("_least"), F.max("h").alias("_most")).filter("_least != _most").select("id", "_least"), "several", 8)
    if n := several.count():
        rows = rows.join(few(several, n), "id", "left").filter("_least IS NULL OR h = _least").drop("_least")
        keys = keys.join(few(several, n), "id", "left").filter("_least IS NULL OR h = _least").drop("_least")
    again = written(keys.groupBy("h").count().filter("count > 1").select("h"), "again", 8)
    n = again.count()
    if not n:
        return rows.select(F.col("id").alias("c"), "x", F.array("id").alias("ids"))
    single = rows.join(few(again, n), "h", "left_anti").select(F.col("id").alias("c"), "x", F.array("id").alias("ids"))
    id_type = _arrow(rows.schema["id"])

    def local(batches):
        held: dict[bytes, list] = {}

        def out():
            pairs = [(x, i) for x, ids in held.items() for i in ids]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], id_type)], names=["x", "id"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = held.setdefault(x, [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > keep:
                        ids.remove(max(ids))
            if len(held) > 50_000:
                yield out()
        if held:
            yield out()

    schema = T.StructType([T.StructField("x", T.BinaryType()), rows.schema["id"]])
    many = rows.join(few(again, n), "h", "left_semi").select("id", "x").mapInArrow(tidied(local), schema).distinct()
    many = many.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("r") <= keep)
    many = many.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return single.unionByName(many.select(F.col("ids")[0].alias("c"), "x", "ids"))


def _arrow(field: T.StructField):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def nearest(short: np.ndarray, asked: list, keep: int, id_type: pa.DataType, dtype: np.dtype) -> Callable:
    """Arrow function over (c, x) batches: the ``keep`` nearest classes of each short query among a task's, exact.

    Products bound the distances; those that may count are computed anew."""

    def scan(batches):
        bound = np.full(len(short), np.inf)
        best: list[dict] = [{} for _ in asked]
        squares = (short**2).sum(1)
        for b in batches:
            ids = b.column(0).to_pylist()
            if not ids:
                continue
            x = matrix(b.column(1), dtype, short.shape[1])
            sizes = (x**2).sum(1)
            for at in range(0, len(short), BLOCK):
                y = short[at : at + BLOCK]
                slack = 1e-9 * (squares[at : at + BLOCK] + sizes.max())
                d2 = squares[at : at + BLOCK, None] + sizes[None, :] - 2 * (y @ x.T)
                if len(ids) >= keep:
                    bound[at : at + BLOCK] = np.fmin(bound[at : at + BLOCK], np.partition(d2, keep - 1, axis=1)[:, keep - 1] + slack)
                # not greater, so that overflow (nan) is compared too
                for q, row in enumerate(~(d2 > (bound[at : at + BLOCK] + slack)[:, None]), at):
                    near = best[q]
                    may = np.flatnonzero(row)
                    for i, d in zip(may.tolist(), np.sqrt(((x[may] - short[q]) ** 2).sum(1)).tolist()):
                        near[ids[i]] = d
                    if len(near) > 4 * keep:
                        best[q] = dict(sorted(near.items(), key=lambda p: (p[1], p[0]))[:keep])
        for at in range(0, len(best), BLOCK):
            found = [(asked[q], c, d) for q in range(at, min(at + BLOCK, len(best))) for c, d in sorted(best[q].items(), key=lambda p: (p[1], p[0]))[:keep]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], id_type), pa.array([f[1] for f in found], id_type), pa.array([f[2] for f in found], pa.float64())], names=["q", "c", "d"])

    return scan


def search(df: DataFrame, is_query: Callable[[Column], Column], id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = 10, tables: int = 2, goal: float = 0.97, seed: int = 0) -> DataFrame:
    """query_id, rank (from 1), id, score (Euclidean distance): the nearest found of each query, the query left out.

    is_query: condition on the id column that picks the queries."""
    spark = df.sparkSession
    keep = neighbours + 1
    rows, dtype = vectors(df, id_col, vec_col)
    held = written(classes(rows, keep), "classes")
    id_field = rows.schema["id"]
    id_type = _arrow(id_field)
    picked = [np.frombuffer(r["x"], dtype).astype(np.float64) for r in held.orderBy(F.xxhash64("c"), "c").limit(SAMPLE).select("x").collect()]
    if not picked:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", id_field.dataType), T.StructField("rank", T.IntegerType()), T.StructField(id_col, id_field.dataType), T.StructField("score", T.DoubleType())]))
    dim = max((len(x) for x in picked), key=[len(x) for x in picked].count)
    held = held.filter(F.octet_length("x") == dtype.itemsize * dim)
    index = fit(np.array([x for x in picked if len(x) == dim]), held.count(), tables, goal, seed)
    points = held.select("c", "x")
    several = held.filter(F.size("ids") > 1).select("c", "ids")
    asked = held.select("c", F.explode("ids").alias("q")).filter(is_query(F.col("q")))
    # a class keeps its smallest ids only: queries among its others are found by their vectors
    if not several.filter(F.size("ids") > neighbours).isEmpty():
        full = held.filter(F.size("ids") > neighbours).select("c", "x")
        others = rows.filter(is_query(F.col("id"))).select(F.col("id").alias("q"), "x").distinct().join(full, "x").select("c", "q")
        asked = asked.union(others).distinct()
    asked = written(asked, "queries", 4)
    n_tables, parts = index.tables, tasks(spark)

    def cells(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), dtype, dim)
                for t in range(n_tables):
                    yield pa.RecordBatch.from_arrays([pa.array(index.own(x, t)), b.column(0), b.column(1)], names=["key", "c", "x"])

    def probes(batches):
        """(part, c, x, keys): a query with the keys that it visits in a part."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                x = matrix(some.column(1), dtype, dim)
                for c, v, keys in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), np.concatenate([index.visits(x, t) for t in range(n_tables)], 1)):
                    keys = np.unique(keys)
                    part = part_of(keys, parts)
                    keys = keys[np.argsort(part, kind="stable")]
                    ends = np.cumsum(np.bincount(part, minlength=parts))
                    to = np.unique(part)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends[to]), pa.int32()), pa.array(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([c] * len(to), id_type), pa.array([v] * len(to), pa.binary()), lists], names=["part", "c", "x", "keys"])

    stored = points.mapInArrow(tidied(cells), T.StructType([T.StructField("key", T.LongType()), T.StructField("c", id_field.dataType), T.StructField("x", T.BinaryType())]))
    full = stored.groupBy("key").count().filter(F.col("count") > LIMIT).select("key", F.ceil(F.col("count") / LIMIT).cast("int").alias("pieces"))
    full = written(full, "full-cells", 8)  # a LIMIT-th of the stored vectors at most
    n_full = full.count()
    schema_p = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("c", id_field.dataType), T.StructField("x", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    visiting = points.join(asked.select("c").distinct(), "c").mapInArrow(tidied(probes), schema_p)
    stored = stored.withColumn("part", F.pmod(F.col("key"), F.lit(parts)).cast("int"))
    cols = ["part", "kind", "key", "c", "x", "keys"]
    none = F.lit(None)
    if n_full:  # pieces of a full cell go to parts of their own, and so do all queries that visit it
        stored = stored.join(few(full, n_full), "key", "left")
        piece = F.pmod(F.xxhash64("c"), F.coalesce("pieces", F.lit(1)))
        stored = stored.withColumn("part", F.when(F.col("pieces").isNotNull(), F.pmod(F.pmod(F.col("key"), F.lit(parts)) + piece, F.lit(parts)).cast("int")).otherwise(F.col("part")))
        spread = visiting.select("c", F.explode("keys").alias("key")).join(few(full, n_full), "key")
        spread = spread.select("c", "key", F.explode(F.sequence(F.lit(0), F.least("pieces", F.lit(parts)) - 1)).alias("piece"))
        spread = spread.select(F.pmod(F.pmod(F.col("key"), F.lit(parts)) + F.col("piece"), F.lit(parts)).cast("int").alias("part"), "c", "key")
        spread = spread.groupBy("part", "c").agg(F.collect_list("key").alias("keys"))  # at most as many keys as probes
        visiting = visiting.unionByName(spread.join(points, "c"))
    both = visiting.select("part", F.lit(0).alias("kind"), none.cast("long").alias("key"), "c", "x", "keys")
    both = both.union(stored.select("part", F.lit(1).alias("kind"), "key", "c", "x", none.cast("array<long>").alias("keys")))
    both = both.select(*cols).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "key")

    def rank(batches):
        """Queries of a part come first; its vectors then stream past them, cell by cell."""
        ids: list = []
        visitors: dict[int, list[int]] = {}
        qx: list[np.ndarray] = []
        best: dict[int, dict] = {}
        at = None

        def out():
            found = [(ids[q], c, d) for q, near in best.items() for c, d in near.items()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], id_type), pa.array([f[1] for f in found], id_type), pa.array([f[2] for f in found], pa.float64())], names=["q", "c", "d"])

        for b in batches:
            part, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            key = b.column(2).fill_null(0).to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(kind) != 0)) + 1), b.num_rows]
            for s, e in zip(cut[:-1], cut[1:]):
                if s == e:
                    continue
                if part[s] != at:
                    if best:
                        yield out()
                    at, ids, qx, visitors = part[s], [], [], {}
                if kind[s] == 0:
                    for c, v, keys in zip(*(b.column(i).slice(s, e - s).to_pylist() for i in (3, 4, 5))):
                        for k in keys:
                            visitors.setdefault(k, []).append(len(ids))
                        ids.append(c)
                        qx.append(np.frombuffer(v, dtype))
                    continue
                queries = visitors.get(int(key[s]))
                if not queries:
                    continue
                names = b.column(3).slice(s, e - s).to_pylist()
                x = matrix(b.column(4).slice(s, e - s), dtype, dim)
                for q in queries:
                    d = np.sqrt(((x - qx[q]) ** 2).sum(1))
                    near = best.setdefault(q, {})
                    top = np.argpartition(d, keep)[:keep] if len(d) > 4 * keep else np.arange(len(d))
                    if len(top) < len(d):  # ties with the last go to the smaller id
                        top = np.flatnonzero(d <= d[top].max())
                    for i in top.tolist():
                        near[names[i]] = float(d[i])
                    if len(near) > 4 * keep:
                        best[q] = dict(sorted(near.items(), key=lambda p: (p[1], p[0]))[:keep])
            if len(best) > 20_000:
                yield out()
        if best:
            yield out()

    near_schema = T.StructType([T.StructField("q", id_field.dataType), T.StructField("c", id_field.dataType), T.StructField("d", T.DoubleType())])

    def merged(near: DataFrame) -> DataFrame:
        """q, near: the nearest ids of each query, itself left out."""
        near = near.distinct().withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).filter(F.col("r") <= keep)
        near = near.join(several, "c", "left").select(F.col("q").alias("c"), "d", F.explode(F.coalesce("ids", F.array("c"))).alias("id"))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("d", "id"))).filter(F.col("r") <= keep)
        near = near.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("near"))
        out = asked.join(near, "c", "left").select("q", "c", F.coalesce("near", F.array()).alias("near"))
        return out.withColumn("near", F.slice(F.filter("near", lambda p: p["id"] != F.col("q")), 1, neighbours))

    out = written(merged(both.mapInArrow(tidied(rank), near_schema)), "found", 4)
    left = written(out.filter(F.size("near") < neighbours).select("c").distinct().join(points, "c"), "short", 8)
    scans, block = [], []

    def scan():
        compare = nearest(np.array([np.frombuffer(r["x"], dtype) for r in block]).astype(np.float64), [r["c"] for r in block], keep, id_type, dtype)
        scans.append(written(points.mapInArrow(tidied(compare), near_schema), "scanned", 8))
        block.clear()

    for row in left.toLocalIterator():
        block.append(row)
        if len(block) == SCANNED:
            scan()
    if block:
        scan()
    if scans:
        again = merged(reduce(DataFrame.union, scans)).join(left.select("c"), "c", "left_semi")
        out = out.join(left.select("c"), "c", "left_anti").unionByName(again)
    out = out.select("q", F.posexplode("near"))
    return out.select(F.col("q").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("col.id").alias(id_col), F.col("col.d").alias("score"))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a cell."""
    return keys % parts
