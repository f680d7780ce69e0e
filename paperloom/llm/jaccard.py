"""N-gram Jaccard join by T-occurrence search with DivideSkip; exact, whatever the corpus looks like.

A document's set holds its distinct ``words``-word shingles, ASCII letters lower-cased; a document with fewer words has
its whole sequence as the only shingle; a document without words (or with null text) has none and links with nothing.
Two documents link when den * intersection >= num * union. Every link comes from ``Lists.search``.

1. Documents with equal sets form a class, named by a number of its own (partial minima before the shuffle). A set
   with fewer than num / (den - num) shingles links with no other set.
2. Each class lists the shingles of a fixed hash region, 1.6 times the prefix that the threshold needs. Document
   frequencies over all classes order them, rarest first. A class too short for the region adds others by hash.
3. Inverted lists are kept by shingle and length band. The smaller set of a linked pair has one of its rarest
   n - 2 n num / (num + den) + 1 shingles (it is *short* there) in common with the rarest of the larger one, as many as
   the sizes of the band ask for; so a class enters the lists of its own band and of the bands below that it may link
   with. A list without a short class, or with one class only, is dropped.
4. The classes of lists with the same smallest short class form the block of that class, the centre. (block, class)
   pairs grow with the lists, not with their squares, and every linked pair meets in a block.
5. In a block, sets probe inverted lists of all shingles in the order of their sizes. Postings of sets that are
   already joined with the probe, or outside the lengths it may link with, leave the lists first. DivideSkip sets the
   longest lists aside, merges the short ones on a heap, skipping what cannot reach the count, and looks each candidate
   up in the long ones by binary search; what reaches the count is compared exactly.
6. A block above ``members`` sets or ``limit`` shingles is cut into parts, each with the centre, searched as in 5. Sets
   that have too many shingles which no other set of their block has are then done. Of the others, those outside the
   block's largest component so far probe every part in tiles of bounded size. No list, block or candidate is capped.
7. Links become components (``graph.components``).

Null ids return null components and link with nothing. Repeated rows are one document and all returned. Rows that share
an id but not a set are documents of their own: an id alone joins nothing. Ids may have any type that has an order.
Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_words, mix, small_batches, steps, tasks, texts_of, tidied, windows, written
from .graph import components

#: DivideSkip's weight of a binary search against heap steps, small because searches go to all lists at once; values of
#: one such search.
MU = 0.0003
PROBED = 256
#: Shingles, and sets, of a block that one task compares at once (400,000 shingles are 20 MB or so with their lists).
LIMIT = 400_000
MEMBERS = 64
#: Probes, and sets of a part, when those that miss the centre of a cut block are compared.
TILE = 512
#: Parts of a cut block whose shingles meet in one slice, as far as it goes by their number.
SLICE = 28
#: Length bands between a size and the largest that it may link with.
BANDS = 2
#: Ids up to which the wanted ones are broadcast (16 bytes each); beyond it the texts are shuffled.
BROADCAST_IDS = 2_000_000


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = hash_words(raw.lower().split())
    if not len(h):
        return h
    if len(h) < words:
        return mix(windows(h, len(h)) + np.uint64(len(h)))
    return np.unique(windows(h, words))


def least_overlap(n: int, num: int, den: int, m: int | None = None) -> int:
    """Shingles that sets of n and m share at least when they link; without m, of n and any size."""
    return -(-num * n // den) if m is None else -(-num * (n + m) // (num + den))


def linked(both: int, n: int, m: int, num: int, den: int) -> bool:
    return den * both >= num * (n + m - both)


def divide_skip(lists: list | np.ndarray, need: int, starts: np.ndarray | None = None) -> list[int]:
    """Values that occur in at least ``need`` of the sorted lists, in ascending order.

    With ``starts``, ``lists`` holds all lists one after the other; starts names their first positions and the end.
    """
    if starts is None:
        starts, lists = np.cumsum([0, *map(len, lists)]), np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
    lens = np.diff(starts)
    if need <= 0 or len(lens) < need:
        return []
    order = np.argsort(lens, kind="stable")
    aside = min(need - 1, int(need / (MU * math.log2(int(lens[order[-1]]) + 1) + 1)))
    short, long = order[: len(order) - aside], order[len(order) - aside :]
    values, found = merge_skip([lists[starts[i] : starts[i + 1]].tolist() for i in short.tolist()], need - aside)
    if aside and len(values):
        # a binary search in all lists at once: keys of (list, value) are in order
        wide = int(lists.max()) + 1
        keys = np.repeat(np.arange(len(lens)), lens) * wide + lists
        for at in range(0, len(values), PROBED):
            asked = (long[:, None] * wide + values[None, at : at + PROBED]).ravel()
            hit = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
            found[at : at + PROBED] += hit.reshape(len(long), -1).sum(0)
    return values[found >= need].tolist()


def merge_skip(lists: list[list[int]], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in at least ``count`` of the lists, with how many hold them: a heap merge that skips what cannot reach it."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    values, found = [], []
    while len(heap) >= count:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
        if len(popped) >= count:
            values.append(value)
            found.append(len(popped))
            for _, i, at in popped:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        while heap and len(popped) < count - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        floor = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], floor, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))
    return np.array(values, np.int64), np.array(found, np.int64)


class Lists:
    """Inverted lists of the shingles of some sets; ``short`` marks those that may be the smaller set of a link here."""

    def __init__(self, sets: list[np.ndarray], short: list[bool], num: int, den: int):
        self.sets, self.short, self.num, self.den = sets, np.array(short, bool), num, den
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.cumsum([0, *self.sizes])
        flat, self.run = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.owners = owner[np.argsort(self.run, kind="stable")]
        self.lens = np.bincount(self.run, minlength=len(flat))
        self.begins = np.cumsum(self.lens) - self.lens
        #: shingles of each set that another one has too
        self.common = np.bincount(owner[self.lens[self.run] > 1], minlength=len(sets))

    def open_to(self, p: int) -> np.ndarray:
        """Which sets set p may link with, by their sizes, marks and common shingles."""
        n, m = int(self.sizes[p]), self.sizes
        need = -(-self.num * (n + m) // (self.num + self.den))
        fits = (m * self.num <= n * self.den) & (m * self.den >= n * self.num) & (self.common >= need) & (self.common[p] >= need)
        fits &= ((m >= n) & self.short[p]) | ((m <= n) & self.short)
        fits[p] = False
        return fits

    def search(self, p: int, wanted: np.ndarray) -> list[int]:
        """The wanted sets that link with set p."""
        runs = self.run[self.starts[p] : self.starts[p + 1]]
        lens = self.lens[runs]
        inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        owners = self.owners[np.repeat(self.begins[runs], lens) + inside]
        keep = wanted[owners]
        owners, which = owners[keep], np.repeat(np.arange(len(runs)), lens)[keep]
        if not len(owners):
            return []
        need = least_overlap(len(runs), self.num, self.den, int(self.sizes[owners].min()))
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        if len(first) < need:
            return []
        query, found = self.sets[p], divide_skip(owners, need, np.append(first, len(owners)))
        return [y for y in found if linked(len(np.intersect1d(query, self.sets[y], assume_unique=True)), len(query), len(self.sets[y]), self.num, self.den)]


def block_links(sets: list[np.ndarray], short: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever links among the sets; the smaller set of a link probes."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lists = Lists([sets[i] for i in order], [short[i] for i in order], num, den)
    root, rank, out = np.arange(len(sets)), np.arange(len(sets)), []
    for p in range(len(sets) - 1):
        if not lists.short[p]:
            continue
        wanted = lists.open_to(p) & (rank > p) & (root != root[p])
        if wanted.any():
            for y in lists.search(p, wanted):
                out.append((order[p], order[y]))
                root[root == root[y]] = root[p]
    return out


def by_group(batches, n_keys: int):
    """(key, list of rows) of batches sorted by their first ``n_keys`` columns; rows are tuples of the other columns."""
    key, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns[:-1]] + [texts_of(batch.columns[-1])]
        for row in zip(*cols):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _batches(rows, names, types):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, int]:
    """id, tk (text_key), n, set digest (h1, h2), rc (shingles in the region), toks (those and what the prefix lacks), and the region's edge."""
    share = min(1.0, 1.6 * (den - num) / den)
    edge = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    fields = [df.schema[id_col].dataType, *[T.LongType()] * 4, T.IntegerType(), T.ArrayType(T.LongType())]
    schema = T.StructType([T.StructField(a, b) for a, b in zip(("id", "tk", "n", "h1", "h2", "rc", "toks"), fields)])

    def run(batches):
        for part in steps(batches, 2):
            rows = []
            for raw in texts_of(part.column(2)):
                s = shingles(raw, words)
                n = len(s)
                h = xxhash.xxh3_128_digest(s.tobytes())
                tok = np.sort(s.view(np.int64))
                rc = int(np.searchsorted(tok, edge))
                p = n - least_overlap(n, num, den) + 1 if n else 0
                rows.append((n, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), rc, tok[: max(rc, p)]))
            cols = list(zip(*rows))
            ends = np.cumsum([0, *map(len, cols[4])])
            toks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cols[4]), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), toks], names=schema.names)

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), schema), edge


def candidate_blocks(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(c, k, n, short): class k of n shingles shares a list with short class c, the smallest such; c != k, distinct."""
    rows = classes.select("k", "rc", F.posexplode("toks").alias("pos", "tok"))
    rows = rows.select("k", F.when(F.col("pos") >= F.col("rc"), F.col("pos") + 1).alias("place"), "tok")
    df = rows.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    rows = rows.join(df, "tok")
    # shingles of the region come before others, those of one class only before the rest
    own = Window.partitionBy("k")
    rows = rows.withColumn("r", F.sum(F.col("place").isNull().cast("int")).over(own))
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.col("place").isNotNull(), "df", "tok")))
    rows = rows.join(classes.select("k", "n", "rc"), "k")
    rows = rows.withColumn("place", F.coalesce(F.col("place").cast("long"), F.col("rc") - F.col("r") + F.col("rank"))).filter(F.expr(f"place <= n - ceil({num}L * n / {den}) + 1"))
    # bands of sizes; a size near an edge counts with both where only rounding tells them apart
    scale, low, eps = BANDS / math.log(den / num), f"ceil({num}L * n / {den})", 1e-9
    band = lambda size, d: f"cast(floor(ln({size}) * {scale!r} + {d!r}) as int)"
    rows = rows.withColumn("own", F.expr(band("n", 0.0))).withColumn("band", F.expr(f"explode(sequence({band(low, -eps)}, {band('n', eps)}))"))
    smallest = f"greatest({low}, floor(exp(band / {scale!r}) - 1e-6) - 1)"
    share = lambda m: f"n - cast(ceil({num}L * (n + {m}) / {num + den}) as long) + 1"
    rows = rows.withColumn("short", F.expr(f"band = own AND place <= {share('n')}")).filter(F.expr(f"short OR place <= {share(smallest)}"))
    rows = written(rows.select("tok", "band", "k", "n", "short"), "prefixes", 4)
    lists = rows.groupBy("tok", "band").agg(F.min(F.when(F.col("short"), F.col("k"))).alias("c"), F.min("k").alias("a"), F.max("k").alias("b"))
    lists = lists.filter("c IS NOT NULL AND a != b").select("tok", "band", "c")
    return rows.join(lists, ["tok", "band"]).filter("c != k").groupBy("c", "k", "n").agg(F.max("short").alias("short"))


def joined_classes(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, limit: int = LIMIT, members: int = MEMBERS, tile: int = TILE) -> DataFrame:
    """(id, component) of classes' numbers: the components of all links; classes without a link are left out."""
    spark = df.sparkSession
    able = classes.filter(F.col("n") * (den - num) >= num)
    pairs = written(candidate_blocks(able.select("k", "n", "rc", "toks"), num, den), "blocks", 8)
    wanted = pairs.select("k").union(pairs.select(F.col("c").alias("k"))).distinct().join(classes.select("k", "id", "tk"), "k")
    wanted = written(wanted, "wanted", 8)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = texts.withColumn("tk", text_key(F.col("text"))).join(wanted, ["id", "tk"]).select("k", "text")
    texts = written(texts, "texts")  # repeated rows stay; they probe as often and change no link
    cut = pairs.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / limit)).alias("parts")).filter("parts > 1")
    cut = written(cut, "cut", 8)  # few: their sizes sum to that of all pairs
    n_cut = cut.count()
    cut = F.broadcast(cut) if n_cut <= BROADCAST_IDS else cut
    whole = pa.int64()

    def laid(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.join(texts, "k").select(*keys, "k", *[c for c in rows.columns if c not in (*keys, "k")], "text")
        return rows.repartition(tasks(spark), *keys).sortWithinPartitions(*keys)

    def meet(batches):
        """Links in a part and, where the block is cut, the part's shingles, packed, with their set if it is the only one."""
        names, kinds = ["c", "a", "b", "slice", "hashes", "owners"], [whole, whole, whole, pa.int32(), pa.binary(), pa.binary()]

        def found():
            for (c, _), rows in by_group(batches, 2):
                sets = [shingles(r[-1], words) for r in rows]
                for i, j in block_links(sets, [r[1] for r in rows], num, den):
                    yield c, rows[i][0], rows[j][0], None, None, None
                others, parts = [i for i, r in enumerate(rows) if r[0] != c], rows[0][2]
                if not others or not parts:
                    continue
                flat, first, n = np.unique(np.concatenate([sets[i] for i in others]), return_index=True, return_counts=True)
                owner = np.repeat([rows[i][0] for i in others], [len(sets[i]) for i in others])[first]
                owner[n > 1] = -1
                piece = (mix(flat) % np.uint64(-(-parts // SLICE))).astype(np.int64)
                for q in np.unique(piece).tolist():
                    here = piece == q
                    yield c, None, None, q, flat[here].tobytes(), owner[here].astype(np.int64).tobytes()

        yield from _batches(found(), names, kinds)

    def lone(batches):
        """How many shingles of a slice each set alone has."""

        def found():
            for (c, _), rows in by_group(batches, 2):
                hashes, owner = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((0, np.uint64), (1, np.int64)))
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                same = hashes[1:] == hashes[:-1]
                once = ~np.concatenate((same, [False])) & ~np.concatenate(([False], same)) & (owner >= 0)
                yield from ((c, *x) for x in zip(*(y.tolist() for y in np.unique(owner[once], return_counts=True))))

        yield from _batches(found(), ["c", "k", "own"], [whole, whole, whole])

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    parted = pairs.join(cut, "c", "left").select("c", F.coalesce(F.pmod(F.xxhash64("k"), F.col("parts")), F.lit(0)).alias("i"), "k", "short", "parts")
    centres = pairs.select("c").distinct().join(cut, "c", "left").withColumn("n", F.coalesce("parts", F.lit(1)))
    centres = centres.select("c", every("n").alias("i"), F.col("c").alias("k"), F.lit(True).alias("short"), "parts")
    met = laid(parted.union(centres), texts, ["c", "i"]).mapInArrow(tidied(meet), "c long, a long, b long, slice int, hashes binary, owners binary")
    met = written(met, "met")
    found = components(met.filter("slice IS NULL").select("a", "b"))
    if not n_cut:
        return found
    found = written(found, "found", 8)

    # sets that keep enough shingles which another set of their block has may link with one of another part
    own = met.filter("slice IS NOT NULL").select("c", "slice", "hashes", "owners").repartition(tasks(spark), "c", "slice").sortWithinPartitions("c", "slice")
    own = own.mapInArrow(tidied(lone), "c long, k long, own long").groupBy("c", "k").agg(F.sum("own").alias("own"))
    large = pairs.join(cut.select("c"), "c")
    least = large.filter("short").groupBy("c").agg(F.min("n").alias("least"))
    alive = large.select("c", "k", "n", "short").join(least, "c").join(own, ["c", "k"], "left")
    smallest = f"greatest(least, cast(ceil({num}L * n / {den}) as long))"
    alive = alive.filter(F.expr(f"(n - coalesce(own, 0)) * {num + den} >= {num} * (n + {smallest})"))
    alive = alive.join(found.select(F.col("id").alias("k"), "component"), "k", "left").select("c", "k", "n", "short", F.coalesce("component", "k").alias("root"))
    alive = written(alive, "alive", 8)
    # one component of a block, the largest, needs no comparison inside it: all others probe
    most = alive.groupBy("c", "root").agg(F.count("*").alias("m")).groupBy("c").agg(F.max(F.struct("m", "root")).alias("x")).select("c", F.col("x.root").alias("most"))
    pieces = lambda rows, name: rows.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / limit)).alias(name))
    rest = alive.join(most, "c").filter("root != most").drop("most")
    left = written(pieces(rest, "tiles").join(pieces(alive, "pieces"), "c").join(most, "c"), "left", 8)
    if left.isEmpty():
        return found
    left = F.broadcast(left) if n_cut <= BROADCAST_IDS else left

    def probe(batches):
        """Sets of a tile probe the lists of a part."""

        def links():
            for _, rows in by_group(batches, 3):
                asks = np.array([r[3] for r in rows])
                if asks.all():
                    continue
                lists = Lists([shingles(r[-1], words) for r in rows], [r[1] for r in rows], num, den)
                root = np.array([r[2] for r in rows], np.int64)
                for p in np.flatnonzero(asks).tolist():
                    wanted = lists.open_to(p) & ~asks & (root != root[p])
                    if wanted.any():
                        for y in lists.search(p, wanted):
                            yield rows[p][2], rows[y][2]
                            root[root == root[y]] = root[p]

        yield from _batches(links(), ["a", "b"], [whole, whole])

    rows = alive.join(left, "c")
    asked = rows.select("k").distinct()
    few = texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, "k", "left_semi")
    tiles = rows.filter("root != most").select("c", F.pmod(F.xxhash64("k"), F.col("tiles")).alias("j"), every("pieces").alias("i"), "k", "short", "root", F.lit(True).alias("asks"))
    parts = rows.select("c", every("tiles").alias("j"), F.pmod(F.xxhash64("k"), F.col("pieces")).alias("i"), "k", "short", "root", F.lit(False).alias("asks"))
    more = components(laid(tiles.union(parts), few, ["c", "j", "i"]).mapInArrow(tidied(probe), "a long, b long"))
    more = more.select(F.col("id").alias("component"), F.col("component").alias("wider"))
    out = found.join(more, "component", "left").select("id", F.coalesce("wider", "component").alias("component"))
    lone = more.select(F.col("component").alias("id"), F.col("wider").alias("component")).join(found.select("id"), "id", "left_anti")
    return out.union(lone)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, limit: int = LIMIT, members: int = MEMBERS, tile: int = TILE) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links, its own included), text_key, first for every row.

    first: no document of the component has a smaller (id, text_key); rows without words or id are first.
    """
    if not 0 < num <= den:
        raise ValueError("num / den lies above 0 and is 1 at most")
    docs, _ = signatures(df, id_col, text_col, words, num, den)
    docs = written(docs, "sets")
    full = docs.filter("id IS NOT NULL AND n > 0")
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("id", "tk", "n", "rc", "toks")).alias("x")).select(F.monotonically_increasing_id().alias("k"), "h1", "h2", "x.*")
    classes = written(classes, "classes", 2)
    roots = classes.select("h1", "h2", "id", "tk", F.col("k").alias("root"))
    if num < den:
        found = joined_classes(df, classes, id_col, text_col, words, num, den, limit, members, tile)
        ends = written(classes.select("k", "id", "tk").join(found.withColumnRenamed("id", "k"), "k"), "ends", 8)
        firsts = ends.groupBy("component").agg(F.min(F.struct("id", "tk")).alias("f")).select("component", "f.id", "f.tk")
        moved = ends.select("k", "component").join(firsts, "component").select("k", F.col("id").alias("f_id"), F.col("tk").alias("f_tk"))
        roots = classes.select("k", "h1", "h2", "id", "tk").join(moved, "k", "left")
        roots = roots.select("h1", "h2", F.coalesce("f_id", "id").alias("id"), F.when(F.col("f_id").isNull(), F.col("tk")).otherwise(F.col("f_tk")).alias("tk"))
    roots = roots.select("h1", "h2", F.col("id").alias("f_id"), F.col("tk").alias("f_tk"))
    out = docs.select("id", "tk", "n", "h1", "h2").join(roots, ["h1", "h2"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    first = alone | ((F.col("id") == F.col("f_id")) & (F.col("tk") == F.col("f_tk")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("f_id")).alias("component_id"), F.col("tk").alias("text_key"), first.alias("first"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, columns unchanged, of which one document of each component stays: the one with the smallest id.

    Of several texts that share this id one stays, and of repeated rows one. Rows without id or without words stay, but for
    those that repeat an id and a text.
    """
    found = written(join(df, id_col, text_col, **how).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_tk"), "first"), "groups", 8)
    gone = found.filter("NOT first").select("_id", "_tk").distinct()
    here = (F.col(id_col) == F.col("_id")) & (text_key(F.col(text_col)) == F.col("_tk"))
    kept = df.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, here, "left_anti")
    again = found.filter("first AND _id IS NOT NULL").groupBy("_id", "_tk").count().filter("count > 1").select("_id", "_tk")
    if again.isEmpty():
        return kept
    twice = kept.join(again, here, "left_semi")
    return kept.join(again, here, "left_anti").unionByName(twice.dropDuplicates([id_col, text_col]))
