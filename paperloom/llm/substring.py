"""Substring dedup by level-wise doubling of repeated word windows.

A word is removed when a window of ``window`` consecutive words that covers it also starts in a document with a smaller
id; windows are judged on the input. Lengths double from a short base up to the window, and only windows whose shorter
windows repeat across documents are looked at again:

* at each length a full window is stood for by its shorter window with the least hash, so equal full windows name
  equal short ones and a quarter of the positions or so are sent;
* a task first compares what it holds: hashes in several of its documents are settled there and each hash leaves the
  task once, however many documents share it. Hashes go, packed in arrays, to the buckets that own them; a bucket
  settles what two tasks share, and sends the positions to the buckets that own the documents. Documents with repeated
  windows go on to the next length, until no candidate survives or the window is reached;
* at the full length the smallest id of each hash decides. ``repeats`` goes on doubling beyond the window until no
  candidate survives, to say how long the repeated passages are.

There is a bucket for each BUCKET bytes of text. A task takes its buckets one after the other, in the order in which Spark
sorts them, and holds one, whatever the size of the corpus. Only hashes, ids and positions are shuffled; texts are read
again for the documents that survive. Windows are compared by 96 bits at the full length, where they decide, and by 64
below it, where a collision only keeps a candidate longer.

Null texts have no words. Rows with a null id take no part and keep their text, and so do rows that share an id but not a
text. Repeated rows are one document and all returned. Texts shorter than the window keep all words; empty tables give
empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_words, mix, per_text, steps, tasks, texts_of, tidied, windows, written

#: Hashes that a task compares at once (40 bytes each).
HELD = 1_500_000
#: Ids up to which the wanted ones are broadcast (16 bytes each); beyond it the texts are shuffled.
BROADCAST_IDS = 2_000_000
SHORTEST = 10
#: Bytes of text to a bucket of hashes, and settled runs that a task collects before it deals them out.
BUCKET = 8 << 20
SETTLED = 500_000
#: Rows of a batch.
ROWS = 64


def lengths(window: int) -> list[int]:
    """Lengths of the levels: halves of the window, rounded up, in ascending order, until one is at most SHORTEST."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def stand_ins(h: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``length`` words, and for each full window the position of its least one (leftmost)."""
    short = windows(h, length)
    m = len(h) - window + 1
    if m <= 0:
        return short, np.empty(0, np.int64)
    least, at = short[:m].copy(), np.arange(m)
    for j in range(1, window - length + 1):
        other = short[j : j + m]
        less = other < least
        least = np.where(less, other, least)
        at[less] = np.flatnonzero(less) + j
    return short, at


def positions_of(runs: list[int], n: int) -> np.ndarray:
    """Mask of n positions from runs."""
    mask = np.zeros(n, bool)
    for a, b in zip(runs[0::2], runs[1::2]):
        mask[a:b] = True
    return mask


def checks(h: np.ndarray, window: int) -> np.ndarray:
    """Another 32 bits of each window of word hashes, independent of ``windows``."""
    n = len(h) - window + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(window if n > 0 else 0):
        out = (out ^ h[i : i + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(31)
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


class Level:
    """Compares the windows of one length inside a task. Rows: bucket, hashes, checks, pos, several, ids, ends.

    Packed rows go to the buckets that own their hashes. several marks a hash that the task has in more than one
    document; at the last level each hash leaves the task with its smallest document only. Positions that are settled
    here (below the last level: repeated; at it: removed) travel with them as ``ids`` with start ``pos`` and ``ends``.
    """

    def __init__(self, length: int, before: int | None, window: int, id_type: pa.DataType, buckets: int):
        self.length, self.before, self.window, self.id_type, self.buckets = length, before, window, id_type, buckets
        self.last = length == window
        self.kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.binary()]

    def picked(self, raw: bytes, marks: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, checks and positions to compare; checks are zero below the last level."""
        words = raw.split()
        none = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(words) < self.window:
            return none
        h = hash_words(words)
        alive = None
        if self.before:
            _, at = stand_ins(h, self.before, self.window)
            alive = positions_of(marks or [], len(h))[at]
        if self.last:
            pos = np.arange(len(h) - self.window + 1) if alive is None else np.flatnonzero(alive)
            return windows(h, self.window)[pos], checks(h, self.window)[pos], pos
        short, at = stand_ins(h, self.length, self.window)
        pos = np.unique(at if alive is None else at[alive])
        return short[pos], np.zeros(len(pos), np.uint32), pos

    def batches(self, rows):
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), self.kinds)], names=ROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), self.kinds)], names=ROW)

    def flush(self, held: list[tuple]):
        ids = sorted({x[0] for x in held})
        rank = {x: i for i, x in enumerate(ids)}
        doc = np.repeat([rank[x[0]] for x in held], [len(x[1]) for x in held]).astype(np.int64)
        hashes, check, pos = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        by, doc, new, group, ends = grouped(hashes, check, doc)
        hashes, check, pos = hashes[by], check[by], pos[by]
        first = np.flatnonzero(new)
        several = (doc[ends - 1] != doc[first])[group]
        if self.last:
            sent = doc == doc[first][group]
            settled = ~sent
        else:
            sent, settled = ~several | new, several
        id_array = pa.array(ids, self.id_type)
        yield from self.packed(hashes[sent], check[sent], doc[sent], pos[sent], several[sent], id_array)
        if settled.any():
            who, starts, stops = runs_by(doc[settled], pos[settled])
            for at in range(0, len(who), HELD):
                some = slice(at, at + HELD)
                # any bucket will do: they pass it on to those of the documents
                yield int(hashes[0] % np.uint64(self.buckets)), None, None, i4(starts[some]), None, id_array.take(pa.array(who[some])), i4(stops[some])

    def packed(self, hashes, check, doc, pos, several, id_array):
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((pos, doc, bucket))
        hashes, check, doc, pos, several, bucket = hashes[order], check[order], doc[order], pos[order].astype("<i4"), several[order].astype(np.int8), bucket[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            yield int(bucket[x]), hashes[x:y].tobytes(), check[x:y].tobytes() if self.last else None, pos[x:y].tobytes(), several[x:y].tobytes(), id_array.take(pa.array(doc[x:y])), None

    def __call__(self, batches):
        yield from self.batches(self.sent(batches))

    def sent(self, batches):
        held, size = [], 0
        for part in steps(batches):
            marks = part.column(2).to_pylist() if self.before else [None] * part.num_rows
            for i, raw, mark in zip(part.column(0).to_pylist(), texts_of(part.column(1)), marks):
                hashes, check, pos = self.picked(raw, mark)
                if not len(hashes):
                    continue
                held.append((i, hashes, check, pos))
                size += len(hashes)
                if size >= HELD:
                    yield from self.flush(held)
                    held, size = [], 0
        if size:
            yield from self.flush(held)

    def compare(self, batches):
        """Rows sorted by bucket to settled rows, dealt to the buckets of documents."""
        yield from self.batches(self.settled(batches))

    def settled(self, batches):
        done: list[tuple] = []
        size = 0
        for rows in by_bucket(batches):
            for r in rows:
                if r[1] is None:
                    done.append((r[5], np.frombuffer(r[3], "<i4"), np.frombuffer(r[6], "<i4")))
                    size += len(r[5])
            rows = [r for r in rows if r[1] is not None]
            if rows:
                found = self.again(rows)
                if found is not None:
                    done.append(found)
                    size += len(found[0])
            if size >= SETTLED:
                yield from self.dealt(done)
                done, size = [], 0
        if done:
            yield from self.dealt(done)

    def again(self, rows: list[tuple]):
        """Ids, starts and ends of the windows of a bucket that are settled here."""
        hashes, pos, several = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((1, np.uint64), (3, "<i4"), (4, np.int8)))
        check = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows]) if self.last else np.zeros(len(hashes), np.uint32)
        ids, doc = ranked(pa.concat_arrays([r[5] for r in rows]))
        by, doc, new, group, ends = grouped(hashes, check, doc)
        pos, several = pos[by], several[by]
        first = np.flatnonzero(new)
        if self.last:
            settled = doc > doc[first][group]
        else:
            repeated = (doc[ends - 1] != doc[first]) | (np.maximum.reduceat(several, first) > 0)
            settled = repeated[group] & (several == 0)
        if settled.any():
            who, starts, stops = runs_by(doc[settled], pos[settled])
            return ids.take(pa.array(who)), starts, stops

    def dealt(self, done: list[tuple]):
        """Settled runs as one row for each bucket of documents."""
        ids = pa.concat_arrays([d[0] for d in done])
        starts, stops = (np.concatenate([d[i] for d in done]) for i in (1, 2))
        bucket = np.array([xxhash.xxh3_64_intdigest(str(x)) % self.buckets for x in ids.to_pylist()], np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, starts, stops, ids = bucket[order], starts[order], stops[order], ids.take(pa.array(order))
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            yield int(bucket[x]), None, None, i4(starts[x:y]), None, ids.slice(x, y - x), i4(stops[x:y])

    def merged(self, batches):
        """Settled rows, sorted by the documents' buckets, to (id, runs)."""
        for rows in by_bucket(batches):
            starts, stops = (np.concatenate([np.frombuffer(r[i], "<i4") for r in rows]) for i in (3, 6))
            ids, doc = ranked(pa.concat_arrays([r[5] for r in rows]))
            order = np.lexsort((starts, doc))
            flat = np.stack((starts[order], stops[order]), 1).ravel()
            ends = 2 * np.searchsorted(doc[order], np.arange(len(ids) + 1))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=["id", "runs"])


def i4(x: np.ndarray) -> bytes:
    return np.asarray(x).astype("<i4").tobytes()


def by_bucket(batches):
    """Rows of batches sorted by bucket, one bucket's at a time; ids stay arrays."""
    bucket, held = None, []
    for batch in batches:
        ids = batch.column(5)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 6)))):
            if row[0] != bucket and held:
                yield held
                held = []
            bucket = row[0]
            held.append((*row[:5], ids[i].values, row[5]))
    if held:
        yield held


def grouped(hashes: np.ndarray, check: np.ndarray, doc: np.ndarray):
    """Order by (hash, check, document); documents in it, where groups begin, each row's group, each group's end."""
    by = np.lexsort((doc, check, hashes))
    a, b = hashes[by], check[by]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return by, doc[by], new, np.cumsum(new) - 1, np.concatenate((np.flatnonzero(new)[1:], [len(new)]))


def ranked(ids: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct ids in order, and the index of each id in them."""
    import pyarrow.compute as pc

    distinct = pc.unique(ids)
    distinct = distinct.take(pc.sort_indices(distinct))
    return distinct, pc.index_in(ids, distinct).to_numpy(zero_copy_only=False).astype(np.int64)


def runs_by(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each run of consecutive positions."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    begin = np.concatenate(([True], (doc[1:] != doc[:-1]) | (np.diff(pos) > 1)))
    first = np.flatnonzero(begin)
    last = np.concatenate((first[1:], [len(pos)])) - 1
    return doc[first], pos[first], pos[last] + 1


ROW = ["bucket", "hashes", "checks", "pos", "several", "ids", "ends"]


def _schema(id_type) -> T.StructType:
    kinds = [T.LongType(), *[T.BinaryType()] * 4, T.ArrayType(id_type), T.BinaryType()]
    return T.StructType([T.StructField(a, b) for a, b in zip(ROW, kinds)])


def _texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """id, text, runs of the documents in marks (id, runs); their ids are broadcast while few."""
    if marks.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(marks.select("id")), "id", "left_semi")
    return docs.join(marks, "id").select("id", "text", "runs")


def repeated_starts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """id, runs: starts of the document's windows that also start in a document with a smaller id, as start, end pairs."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, id_type = df.sparkSession, df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    kinds = docs.select("id", F.xxhash64("text").alias("tk"), F.octet_length("text").alias("size"))
    kinds = kinds.groupBy("id").agg(F.min("tk").alias("a"), F.max("tk").alias("b"), F.sum("size").alias("size"))
    total = kinds.agg(F.sum("size").alias("size"), F.count_if(F.col("a") != F.col("b")).alias("several")).first()
    if total["several"]:
        several = written(kinds.filter("a != b").select("id"), "several", 8)
        docs = docs.join(F.broadcast(several) if total["several"] <= BROADCAST_IDS else several, "id", "left_anti")
    parts = tasks(spark)
    buckets = max(parts, -(-(total["size"] or 0) // BUCKET))
    runs = T.StructType([T.StructField("id", id_type), T.StructField("runs", T.ArrayType(T.IntegerType()))])
    schema, rows, before = _schema(id_type), docs, None

    def dealt(sent: DataFrame) -> DataFrame:
        return sent.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")

    for length in lengths(window):
        level = Level(length, before, window, to_arrow_type(id_type), buckets)
        settled = dealt(dealt(rows.mapInArrow(tidied(level.__call__), schema)).mapInArrow(tidied(level.compare), schema))
        marks = written(settled.mapInArrow(tidied(level.merged), runs), f"marks-{length}", 4)
        if length == window or marks.isEmpty():
            break
        rows, before = _texts(docs, marks), length
    return marks


def covered(runs: list[int], n: int, window: int) -> np.ndarray:
    """Mask of the words that the windows starting in ``runs`` cover."""
    change = np.zeros(n + 1, np.int64)
    for a, b in zip(runs[0::2], runs[1::2]):
        change[a] += 1
        change[min(n, b + window - 1)] -= 1
    return np.cumsum(change)[:n] > 0


def cut(raw: bytes, runs: list[int], window: int) -> bytes:
    """The text without the covered words and the white space after each."""
    words = raw.split()
    gone, at, out = covered(runs, len(words), window), 0, []
    for i, w in enumerate(words):
        start = raw.index(w, at)
        stop = start + len(w)
        while stop < len(raw) and raw[stop] in b" \t\n\x0b\x0c\r":
            stop += 1
        if not gone[i]:
            out.append(raw[start:stop])
        at = stop
    return b"".join(out)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for every row."""
    sha = lambda words: hashlib.sha256(b" ".join(words)).hexdigest()
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def whole():
        return lambda texts: [list(c) for c in zip(*((len(w), sha(w)) for w in map(bytes.split, texts)))]

    every = per_text(docs, "id", "text", T.StructType([T.StructField("n_words", T.LongType()), T.StructField("whole", T.StringType())]), whole)

    def kept(batches):
        for part in steps(batches):
            rows = []
            for raw, runs in zip(texts_of(part.column(1)), part.column(2).to_pylist()):
                words = raw.split()
                gone = covered(runs, len(words), window)
                rows.append((int(gone.sum()), sha([w for w, g in zip(words, gone.tolist()) if not g])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "n_removed", "kept"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    less = _texts(docs, repeated_starts(docs, "id", "text", window)).mapInArrow(tidied(kept), schema)
    less = less.groupBy("id").agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept"))
    out = every.join(less, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """The rows with repeated passages cut from their text; other columns are kept."""
    starts = repeated_starts(df, id_col, text_col, window)
    names = df.columns
    if starts.count() <= BROADCAST_IDS:
        touched = df.join(F.broadcast(starts.select(F.col("id").alias(id_col))), id_col, "left_semi")
        same = df.join(F.broadcast(starts.select(F.col("id").alias(id_col))), id_col, "left_anti")
    else:
        touched, same = df.join(starts.select(F.col("id").alias(id_col)), id_col, "left_semi"), df.join(starts.select(F.col("id").alias(id_col)), id_col, "left_anti")
    spare = "_runs"
    while spare in names:
        spare = "_" + spare
    touched = touched.join(starts.select(F.col("id").alias(id_col), F.col("runs").alias(spare)), id_col).select(*names, spare)
    at = names.index(text_col)

    def run(batches):
        for part in steps(batches, at):
            texts = [cut(t, r, window).decode("utf-8", "replace") for t, r in zip(texts_of(part.column(at)), part.column(len(names)).to_pylist())]
            cols = [part.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return same.select(*names).unionByName(touched.mapInArrow(tidied(run), df.schema))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """id, length, windows: how many windows of window, 2 * window, ... words of a document also start in a smaller id.

    Stops at the first length that leaves no candidate.
    """
    out, length, rest = None, window, df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    while True:
        starts = repeated_starts(rest, "id", "text", length)
        counts = starts.select("id", F.lit(length).alias("length"), F.expr("aggregate(sequence(0, cast(size(runs) / 2 - 1 as int)), 0L, (s, i) -> s + runs[2 * i + 1] - runs[2 * i])").alias("windows"))
        if starts.isEmpty():
            return (counts if out is None else out).withColumnRenamed("id", id_col)
        out = counts if out is None else out.union(counts)
        # a longer repeat needs the smaller document too, which shares a repeated window: only such documents go on
        rest = written(rest.join(holders(rest, starts, length), "id", "left_semi"), "rest")
        length *= 2


def holders(docs: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """Ids of the documents that hold a window listed in starts, the smaller documents included."""

    def listed(batches):
        for part in steps(batches):
            got = []
            for raw, runs in zip(texts_of(part.column(1)), part.column(2).to_pylist()):
                w = windows(hash_words(raw.split()), window)
                got.append(w[positions_of(runs, len(w))])
            flat = np.unique(np.concatenate(got)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64())], names=["hash"])

    def all_windows(batches):
        for part in steps(batches):
            got = [np.unique(windows(hash_words(raw.split()), window)) for raw in texts_of(part.column(1))]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(got).view(np.int64), pa.int64())], names=["id", "hash"])

    wanted = _texts(docs, starts).mapInArrow(tidied(listed), "hash long").distinct()
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("hash", T.LongType())])
    return docs.filter("id IS NOT NULL").select("id", "text").mapInArrow(tidied(all_windows), schema).join(wanted, "hash").select("id").distinct()
