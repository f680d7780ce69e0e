"""Distinct by key with a stated winner, known-duplicate merges, attachments, fuzzy title clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def one_per_key(rows: DataFrame, keys: list[str], position: list[str], last: bool = False) -> DataFrame:
    """First (or last) row of each key by position, which must order rows totally.

    A minimum of (position, row) is kept per key, so each task sends one row a key and a hot key is no burden.
    """
    others = [c for c in rows.columns if c not in {*keys, *position}]
    packed = F.struct(*position, *others)
    out = rows.groupBy(*keys).agg((F.max if last else F.min)(packed).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*position, *others)]).select(*rows.columns)


def known_duplicates(rows: DataFrame, titles: DataFrame, has_attachment: Column, position: str) -> DataFrame:
    """Rows of listed titles (a ``title`` column) merged to one, one with an attachment first; every other row stays."""
    listed = titles.select("title").distinct()
    hit = rows.join(listed, "title", "left_semi").withColumn("_p", (~has_attachment).cast("int"))
    others = [c for c in rows.columns if c not in ("title", position)]
    merged = hit.groupBy("title").agg(F.min(F.struct("_p", position, *others)).alias("_x")).select("title", "_x.*").select(*rows.columns)
    return rows.join(listed, "title", "left_anti").unionByName(merged)


def explode_attachments(rows: DataFrame, attachments: str = "attachments", title: str = "title") -> DataFrame:
    """One row an attachment (struct of url, name); a row without any stays, with null file_url and index 0."""
    out = rows.withColumn("_n", F.coalesce(F.size(attachments), F.lit(0))).select("*", F.posexplode_outer(attachments).alias("_i", "_a")).drop(attachments)
    i = F.coalesce("_i", F.lit(0))
    out = out.withColumn("file_url", F.col("_a.url")).withColumn("attachment_index", i).withColumn("attachment_count", F.greatest(F.col("_n"), F.lit(0)))
    new = F.when(F.col("_i").isNull(), F.col(title)).otherwise(text.attachment_title(F.col(title), F.col("_a.name"), i))
    return out.withColumn(title, new).drop("_i", "_a", "_n")


def distinct_links(links: Column) -> Column:
    """First link of each url in an array of (url, label) structs, in order."""
    kept = F.transform(links, lambda x, i: F.when(F.array_position(F.transform(links, lambda y: y["url"]), x["url"]) == i + 1, x))
    return F.array_compact(kept)


def refuse_groups(rows: DataFrame) -> DataFrame:
    """Rows of single documents; a row that stands for a group of documents raises."""
    return rows.filter(F.when(F.col("is_group"), F.raise_error(F.lit("a group row must be expanded first")).isNull()).otherwise(True))


def copies_after_rekey(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows with ``copy``: all but the first of each key."""
    first = rows.groupBy(key).agg(F.min(position).alias("_first"))
    return rows.join(first, key).withColumn("copy", F.col(position) != F.col("_first")).drop("_first")


def bits(a: str) -> dict[str, int]:
    """Positions of each character, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def alike(a: str, b: str, threshold: float, bits_b: dict[str, int] | None = None) -> bool:
    """Ratcliff-Obershelp ratio of a against b reaches the threshold.

    Bounds come first: matched characters are a common subsequence, the longest of which is found with numbers as bit
    vectors.
    """
    from difflib import SequenceMatcher

    if a == b:
        return True
    s = len(a) + len(b)
    if 2 * min(len(a), len(b)) < threshold * s:
        return False
    at, full = bits(b) if bits_b is None else bits_b, (1 << len(b)) - 1
    v = full
    for c in a:
        if u := v & at.get(c, 0):
            v = (v + u | v - u) & full
    if 2 * (len(b) - v.bit_count()) < threshold * s:
        return False
    return SequenceMatcher(None, a, b).ratio() >= threshold


class Tile:
    """Titles as arrays: lengths, codes of characters by position, counts by code, bits of positions by code."""

    def __init__(self, titles: list[str]):
        import numpy as np

        self.titles, self.n = titles, len(titles)
        self.length = np.array([len(x) for x in titles], np.int64)
        wide = max(1, int(self.length.max()))
        table = np.full(256, 37, np.uint8)  # 37: any other character, taken as equal, which only loosens a bound; 38: none
        table[list(b" abcdefghijklmnopqrstuvwxyz0123456789")] = np.arange(37)
        raw = b"".join(x.encode("latin-1", "replace").ljust(wide) for x in titles)
        self.codes = table[np.frombuffer(raw, np.uint8).reshape(self.n, wide)]
        self.codes[np.arange(wide) >= self.length[:, None]] = 38
        self.counts = np.bincount((np.arange(self.n)[:, None] * 39 + self.codes).ravel(), minlength=self.n * 39).reshape(self.n, 39)[:, :38]

    def bits(self):
        """Bits of the first 64 positions by code; complete for titles of 64 characters or fewer."""
        import numpy as np

        out, all_ = np.zeros((self.n, 39), np.uint64), np.arange(self.n)
        for p in range(min(64, self.codes.shape[1])):
            out[all_, self.codes[:, p]] |= np.uint64(1 << p)
        out[:, 38] = 0
        return out

    def levels(self, caps):
        """Counts up to the caps in unary, so that a dot product is a sum of minima; what lies above a cap as a number."""
        import numpy as np

        code, level = np.repeat(np.arange(38), caps), np.concatenate([np.arange(c) for c in caps])
        return np.hstack([self.counts[:, code] > level, np.maximum(self.counts - caps, 0)]).astype(np.float32)


def common(x: Tile, y: Tile, u, v, threshold: float):
    """Longest common subsequences of titles u of x, of 64 characters or fewer, and v of y; -1 if they are too short to matter."""
    import numpy as np

    at, out = x.bits().ravel(), np.full(len(u), -1, np.int64)
    for k in range(0, len(u), 8192):
        p, q = u[k : k + 8192], v[k : k + 8192]
        live, base, codes = np.arange(k, k + len(p)), p * 39, y.codes[q].T.astype(np.int64)
        need, size = threshold * (x.length[p] + y.length[q]) / 2 - 1e-9, y.length[q]
        state = np.full(len(p), 2**64 - 1, np.uint64)
        for c in range(int(size.max())):
            hit = state & at.take(base + codes[c])
            state = (state + hit) | (state - hit)
            if c % 8 == 7:
                # each character to come adds one at most
                may = np.bitwise_count(~state) + np.maximum(size - c - 1, 0) >= need
                if np.count_nonzero(may) < 0.7 * len(may):
                    live, base, codes, need, size, state = live[may], base[may], codes[:, may], need[may], size[may], state[may]
                    if not len(live):
                        break
        out[live] = np.bitwise_count(~state)
    return out


def candidates(x: Tile, y: Tile, same: bool, threshold: float):
    """Arrays (u, v) of pairs of titles of x and y that may be alike, likely ones first.

    M matched characters of two titles of s characters together need 2M >= threshold * s. The letters that both hold
    bound M, by one matrix product for all pairs; then the longest common subsequence does, for pairs within 64 bits.
    """
    import numpy as np

    caps = np.minimum(np.sort(x.counts, 0)[-1 - x.n // 250], np.sort(y.counts, 0)[-1 - y.n // 250])
    caps = np.minimum(caps, 64)
    half, one = np.float32(threshold / 2), lambda t: np.ones((t.n, 1), np.float32)
    a = np.hstack([x.levels(caps), -half * x.length[:, None].astype(np.float32), one(x)])
    b = np.hstack([y.levels(caps), one(y), -half * y.length[:, None].astype(np.float32)]).T.copy()
    us, vs = [], []
    for k in range(0, x.n, 256):
        found = np.flatnonzero((a[k : k + 256] @ b) >= -0.01)
        u, v = found // y.n + k, found % y.n
        if same:
            u, v = u[u < v], v[u < v]
        us.append(u), vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    s = x.length[u] + y.length[v]
    most = np.minimum(x.length[u], y.length[v])
    left = x.length[u] <= 64
    right = ~left & (y.length[v] <= 64)
    if left.any():
        most[left] = common(x, y, u[left], v[left], threshold)
    if right.any():
        most[right] = common(y, x, v[right], u[right], threshold)
    share = 2 * most / np.maximum(s, 1)
    may = np.flatnonzero(2 * most >= threshold * s - 1e-9)
    may = may[np.argsort(-share[may], kind="stable")]
    return u[may], v[may]


def similar_titles(titles: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Edges (a, b) between titles (tid, feed, norm) of a feed that are alike, enough to join all that are.

    A feed is cut into tiles, each a row; each pair of tiles is a unit of work, which gives a spanning forest of its links.
    """
    import pyarrow as pa

    from .graph import kept

    sizes = kept(titles.groupBy("feed").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")), "feeds")
    rows = titles.join(sizes, titles["feed"].eqNullSafe(sizes["feed"])).select(titles["feed"], "tid", "norm", "n")
    rows = rows.groupBy("feed", "n", F.pmod(F.xxhash64("tid"), F.col("n")).cast("int").alias("t")).agg(F.collect_list(F.struct("tid", "norm")).alias("x"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    rows = rows.select("feed", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", F.col("x.tid").alias("tids"), F.col("x.norm").alias("norms"))

    def edges(group):
        (i, j, _, left, a), (_, _, _, right, b) = group[0], group[-1]
        same = i == j
        if not same and len(group) == 1:
            return  # the other tile is empty
        x = Tile(a)
        root: dict[int, int] = {}

        def top(k):
            while (up := root.get(k, k)) != k:
                root[k] = k = root.get(up, up)
            return k

        us, vs = candidates(x, x if same else Tile(b), same, threshold)
        for k in range(0, len(us), 16384):
            for u, v in zip(us[k : k + 16384].tolist(), vs[k : k + 16384].tolist()):
                p, q = top(left[u]), top(right[v])
                if p != q and (alike(a[u], b[v], threshold) or alike(b[v], a[u], threshold)):
                    root[p] = q
                    yield left[u], right[v]

    def run(batches):
        key, held = None, []

        def out():
            found = list(edges(held))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                feed, i, j, t, tids, norms = (c[k].as_py() for c in batch.columns)
                if key != (feed, i, j) and held:
                    yield out()
                    held = []
                key = (feed, i, j)
                held.append((i, j, t, tids, norms))
        if held:
            yield out()

    n = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "feed", "i", "j").sortWithinPartitions("feed", "i", "j").mapInArrow(run, "a long, b long")


def fuzzy_clusters(rows: DataFrame, feed: str = "feed", position: str = "position", threshold: float = 0.85, tile: int = 2048) -> DataFrame:
    """Rows with ``cluster``: the position of the first row of their group, in one greedy pass over each feed.

    A row joins the first group whose representative title is similar enough (Ratcliff-Obershelp over normalised
    titles) and whose date and status are equal or missing on one side; the group then takes over what it lacked. The
    result depends on the order. A row can only join a title that it is alike to, so the pass over a feed falls apart into
    passes over the components of alike titles: none holds more than its component, and the result is the same.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from .graph import components, kept

    slim = rows.select(F.col(feed).alias("feed"), F.col(position).alias("position"), text.matching_title(F.col("title")).alias("norm"), F.trim(F.coalesce("listed_date", F.lit(""))).alias("listed_date"), F.trim(F.coalesce("status", F.lit(""))).alias("status"))
    titles = kept(slim.select("feed", "norm").distinct().withColumn("tid", F.monotonically_increasing_id()), "titles")
    groups = components(similar_titles(titles, threshold, tile)).withColumnRenamed("id", "tid")
    titles = titles.join(groups, "tid", "left").select(F.col("feed").alias("_f"), F.col("norm").alias("_n"), F.coalesce("component", "tid").alias("unit"))
    slim = slim.join(titles, slim["feed"].eqNullSafe(F.col("_f")) & (slim["norm"] == F.col("_n"))).select("unit", "feed", "position", "norm", "listed_date", "status")
    kinds = [to_arrow_type(slim.schema[c].dataType) for c in ("feed", "position", "position")]

    def clusters(unit):
        found, seen = [], {}
        for p, norm, date, status in unit:
            for g in found:
                if (date and g[2] and date != g[2]) or (status and g[3] and status != g[3]):
                    continue
                if (norm, g[1]) not in seen:
                    seen[norm, g[1]] = alike(norm, g[1], threshold, g[4])
                if seen[norm, g[1]]:
                    g[2], g[3] = g[2] or date, g[3] or status
                    yield p, g[0]
                    break
            else:
                found.append([p, norm, date, status, bits(norm)])
                yield p, p

    def run(batches):
        key, held, out = None, [], []

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["feed", "position", "cluster"])

        for batch in batches:
            for unit, name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (unit, name) and held:
                    out += [(key[1], *x) for x in clusters(held)]
                    held = []
                key = (unit, name)
                held.append(row)
                if len(out) > 8192:
                    yield full()
                    out = []
        if held:
            out += [(key[1], *x) for x in clusters(held)]
        if out:
            yield full()

    schema = T.StructType([slim.schema["feed"], slim.schema["position"], T.StructField("cluster", slim.schema["position"].dataType)])
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = slim.repartition(n, "unit").sortWithinPartitions("unit", "feed", "position").mapInArrow(run, schema)
    found = found.select(F.col("feed").alias("_f"), F.col("position").alias("_p"), "cluster")
    return rows.join(found, rows[feed].eqNullSafe(F.col("_f")) & (rows[position] == F.col("_p"))).drop("_f", "_p")


def representatives(clustered: DataFrame, priority: list[str], feed: str = "feed", position: str = "position", section: str = "source_section") -> DataFrame:
    """One row a cluster: the best source section, then title and link; without such a section the first row."""
    rank = F.lit(len(priority))
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col(section) == name, i).otherwise(rank)
    listed = rank < len(priority)
    keyed = clustered.withColumns({"_r": rank, "_t": F.when(listed, F.col("title")), "_l": F.when(listed, F.col("pdf_link"))})
    return one_per_key(keyed, [feed, "cluster"], ["_r", "_t", "_l", position]).select(*clustered.columns)
