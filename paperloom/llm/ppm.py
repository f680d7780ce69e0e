"""Prediction by partial matching over bytes: a pretrained context trie scores documents.

A text is its words, ASCII letters lower-cased, joined by one space and followed by an end symbol. The model predicts
each byte from the ``order`` bytes before it (a pad stands before the start). Contexts seen ``least`` times or more are
used, longest first. Escape estimation is method D: with n observations of d symbols, a symbol seen c times has
(2c - 1) / 2n and the escape d / 2n. Symbol exclusion: after an escape, what the longer context predicts is left out of
the shorter one's counts; the last resort is uniform over the symbols that no context has predicted.

The trie is its longest strings with counts; shorter contexts are sums over them. A symbol's code length depends on
its string alone, so it is found once for each distinct string of the corpus:

1. Each input partition (a chunk) sends its distinct strings and word hashes with training counts, as packed arrays,
   to the buckets that own them: strings by the last three bytes of context, which all longer contexts share. There is
   a bucket for each BUCKET bytes of training text, so that a bucket does not grow with the corpus.
2. A task takes its buckets one after the other, in the order in which Spark sorts them: it adds the counts up, derives
   the code length of every string, and answers the chunks that asked. Contexts of two bytes and fewer come from a
   table of byte triples, summed beforehand: at most 255^3 numbers (200 MB), in practice some 100,000.
3. Each chunk's texts meet its answers, and sums over the document give the score. N and V, sums over all chunks and
   buckets, enter the base last.

Everything sent grows with the corpus, and nothing but the table of triples is broadcast. Lengths are doubles, counts 64-bit.
Hashes of words have 63 bits.

Null texts are empty (one end symbol). Null ids are neither trained on nor held out. Repeated rows count each time.
An empty table gives an empty result; without training rows every symbol has 1/255.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_words, mix, small_batches, steps, tasks, texts_of, tidied, written

PAD, END = b"\xff", b"\xfe"
SYMBOLS = 255
#: Bytes of text that are coded at once, and that one step holds.
PIECE = 1 << 19
STEP = 1 << 20
#: Bytes of training text to a bucket; a bucket's distinct strings are a fraction of it.
BUCKET = 16 << 20
#: Rows of a batch between the steps.
ROWS = 64
_END_TOKEN = b"\n"  # no word holds white space
_TOKEN = np.uint64(1 << 63)  # word hashes have this bit, strings of up to seven bytes have not
_BYTE = np.uint64(8)


def normal(raw: bytes) -> tuple[bytes, list[bytes]]:
    words = raw.lower().split()
    return b" ".join(words), words


def strings(docs: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the order + 1 bytes that end at each symbol of the texts, and the text each belongs to; PIECE by PIECE."""
    data = b"".join(PAD * order + d + END for d in docs)
    which = np.repeat(np.arange(len(docs)), [len(d) + 1 + order for d in docs])
    for start in range(0, len(data), PIECE):
        a = np.frombuffer(data[start : start + PIECE + order], np.uint8).astype(np.uint64)
        n = len(a) - order
        if n <= 0:
            return
        code = a[:n].copy()
        for j in range(1, order + 1):
            code <<= _BYTE
            code |= a[j : j + n]
        real = (code & np.uint64(255)) != np.uint64(255)  # not the pad
        yield code[real], which[start + order : start + order + n][real]


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Tally:
    """Distinct keys with training counts, kept small while it grows."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weigh: bool) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.held.append((u, n if weigh else np.zeros(len(u), np.int64)))
        self.size += len(u)
        if len(self.held) > 1 and self.size > 2 * len(self.held[0][0]) + 2_000_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.held) > 1:
            self.held = [add_up(*(np.concatenate(x) for x in zip(*self.held)))]
        self.size = len(self.held[0][0])
        return self.held[0]


def level(keys: np.ndarray, n: np.ndarray, j: int) -> tuple:
    """Strings of j + 1 bytes with their counts, their contexts of j bytes, and each context's observations and symbols."""
    mask = np.uint64((1 << 8 * (j + 1)) - 1)
    keys, n = add_up(keys & mask, n)
    context, ci = np.unique(keys >> _BYTE, return_inverse=True)
    return mask, keys, n, context, np.bincount(ci, n, len(context)), np.bincount(ci, minlength=len(context)), ci


def code_lengths(strings_: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | list[tuple], order: int, least: int) -> np.ndarray:
    """log10 probability of the last byte of each string. counts: training counts of the strings (sorted, distinct).

    low: triples and their counts, for contexts of two bytes and fewer, or the three levels made of them.
    """
    trained = counts > 0
    if not isinstance(low, list):
        low = [level(*low, j) for j in (2, 1, 0)]
    levels = [level(strings_[trained], counts[trained], j) for j in range(order, 2, -1)] + low
    total = np.zeros(len(strings_))
    done = np.zeros(len(strings_), bool)
    out_n, out_d = np.zeros(len(strings_)), np.zeros(len(strings_))  # excluded at this level
    for i, (mask, keys, n, context, cn, cd, ci) in enumerate(levels):
        if not len(keys):
            continue
        x = strings_ & mask
        at = np.minimum(np.searchsorted(context, x >> _BYTE), len(context) - 1)
        seen = (context[at] == x >> _BYTE) & ((cn[at] >= least) | (i == order))
        k = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[k] == x
        rest_n, rest_d = cn[at] - out_n, cd[at] - out_d
        active = seen & ~done & (rest_d > 0)
        h, e = active & hit, active & ~hit
        total[h] += np.log10((2 * n[k[h]] - 1) / (2 * rest_n[h]))
        total[e] += np.log10(rest_d[e] / (2 * rest_n[e]))
        done |= h
        if i < order:
            shorter, m = levels[i + 1][1], levels[i + 1][2]
            below = m[np.searchsorted(shorter, keys & levels[i + 1][0])]
            excluded = np.bincount(ci, below, len(context))
            out_n, out_d = np.where(seen, excluded[at], out_n), np.where(seen, cd[at], out_d)
    total[~done] += -np.log10(SYMBOLS - len(levels[-1][1]))
    return total


class Lookup:
    """Values of keys, most of them by one probe of a hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weight: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.table = np.zeros(1 << self.bits, np.int32)
        by = np.argsort(weight[order], kind="stable")  # frequent keys last, so that they stay
        self.table[self.slot(self.keys[by])] = by

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.empty(0)
        at = self.table[self.slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        if len(wrong):
            at[wrong] = np.minimum(np.searchsorted(self.keys, keys[wrong]), len(self.keys) - 1)
            if (self.keys[at[wrong]] != keys[wrong]).any():
                raise ValueError("a chunk's texts changed between the two passes")
        return self.values[at]


def pack(keys: np.ndarray) -> bytes:
    """48-bit or 64-bit keys, byte by byte position, which compresses better."""
    return keys.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def owner(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that owns a key: by three bytes of context for strings, by themselves for words."""
    token = keys >= _TOKEN
    return (mix(np.where(token, keys, (keys >> _BYTE) & np.uint64(0xFFFFFF))) % np.uint64(buckets)).astype(np.int64)


def _words(words: list[bytes]) -> np.ndarray:
    return hash_words(words) | _TOKEN


def gather(order: int, buckets: int):
    """Chunk texts to rows (bucket, chunk, keys, counts), one for each bucket that owns a key of the chunk."""

    def run(batches):
        grams, tokens, chunk = Tally(), Tally(), None
        for part in steps(batches, 2, STEP):
            chunk = part.column(0)[0].as_py()
            for train in (True, False):
                rows = part.filter(pa.compute.equal(part.column(1), pa.scalar(train)))
                texts = [normal(x) for x in texts_of(rows.column(2))]
                if not texts:
                    continue
                for code, _ in strings([t for t, _ in texts], order):
                    grams.add(code, train)
                tokens.add(_words([w for _, ws in texts for w in (*ws, _END_TOKEN)]), train)
        if chunk is None:
            return
        keys, counts = (np.concatenate(x) for x in zip(grams.settle(), tokens.settle()))
        bucket = owner(keys, buckets)
        by = np.argsort(bucket, kind="stable")
        keys, counts, bucket = keys[by], counts[by].astype(np.uint64), bucket[by]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(first[1:], len(keys))
        for at in range(0, len(first), ROWS):
            cut = list(zip(first[at : at + ROWS].tolist(), ends[at : at + ROWS].tolist()))
            cols = ([int(bucket[x]) for x, _ in cut], [chunk] * len(cut), [pack(keys[x:y]) for x, y in cut], [pack(counts[x:y]) for x, y in cut])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "keys", "counts"])

    return run


def answer(order: int, least: int, low):
    """Rows sorted by bucket to rows (chunk, keys, values, weight, v).

    values: code lengths of strings as doubles, training counts of words as integers; weight: how often a key occurs, on a
    logarithmic scale; v: the bucket's distinct training words, in the first of its rows alone.
    """
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())

    def one(rows: list[tuple], levels: list[tuple]):
        keys = [unpack(k) for _, k, _ in rows]
        all_keys, total = add_up(np.concatenate(keys), np.concatenate([unpack(c).astype(np.int64) for *_, c in rows]))
        split = int(np.searchsorted(all_keys, _TOKEN))
        values = total.view(np.uint64).copy()
        values[:split] = code_lengths(all_keys[:split], total[:split], levels, order, least).view(np.uint64)
        weight = np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8)
        v = int((total[split:] > 0).sum())
        out = []
        for i, ((chunk, _, _), k) in enumerate(zip(rows, keys)):
            at = np.searchsorted(all_keys, k)
            out.append((chunk, pack(k), pack(values[at]), weight[at].tobytes(), v if i == 0 else 0))
            if len(out) == ROWS:
                yield out
                out = []
        if out:
            yield out

    def run(batches):
        levels = [level(*low.value, j) for j in (2, 1, 0)]

        def groups():
            bucket, held = None, []
            for batch in batches:
                for b, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if b != bucket and held:
                        yield held
                        held = []
                    bucket = b
                    held.append(row)
            if held:
                yield held

        for held in groups():
            for rows in one(held, levels):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["chunk", "keys", "values", "weight", "v"])

    return run


def apply(order: int, names: list[str]):
    """Rows sorted by (chunk, kind), the answers of all buckets before the texts, to a row for each text.

    known: sum of log10(c + 1) over its tokens. v: the sum over a chunk's answers, in its first row alone.
    """
    out_names = ["id", "held_out", "train", "n_tokens", "n_known", "known", "score", "v"]

    def run(batches):
        chunk, answers, grams, tokens, v = None, [], None, None, 0
        for part in steps(batches, names.index("text"), STEP):
            col = {name: part.column(i) for i, name in enumerate(names)}
            for c in col["chunk"].unique().to_pylist():
                rows = pa.compute.equal(col["chunk"], pa.scalar(c, pa.int32()))
                if c != chunk:
                    chunk, answers, grams = c, [], None
                given = part.filter(pa.compute.and_(rows, pa.compute.equal(col["kind"], pa.scalar(0, pa.int32()))))
                answers += zip(*(given.column(names.index(x)).to_pylist() for x in ("keys", "values", "weight", "v")))
                texts = part.filter(pa.compute.and_(rows, pa.compute.equal(col["kind"], pa.scalar(1, pa.int32()))))
                if not texts.num_rows:
                    continue
                if grams is None:
                    keys, values = (np.concatenate([unpack(a[i]) for a in answers]) for i in (0, 1))
                    weight = np.concatenate([np.frombuffer(a[2], np.uint8) for a in answers])
                    v, answers = sum(a[3] for a in answers), []
                    word = keys >= _TOKEN
                    grams, tokens = Lookup(keys[~word], values[~word].view(np.float64), weight[~word]), Lookup(keys[word], values[word].view(np.int64), weight[word])
                    del keys, values, weight, word
                docs = [normal(x) for x in texts_of(texts.column(names.index("text")))]
                score = np.zeros(len(docs))
                for code, which in strings([d for d, _ in docs], order):
                    score += np.bincount(which, grams(code), len(docs))
                c = tokens(_words([w for _, ws in docs for w in (*ws, _END_TOKEN)])).astype(np.float64)
                of = np.repeat(np.arange(len(docs)), [len(ws) + 1 for _, ws in docs])
                n_tokens = np.bincount(of, minlength=len(docs))
                n_known = np.bincount(of, c > 0, len(docs)).astype(np.int64)
                known = np.bincount(of, np.log10(c + 1), len(docs))
                first = np.zeros(len(docs), np.int64)
                first[0], v = v, 0
                yield pa.RecordBatch.from_arrays([*(texts.column(names.index(x)) for x in ("id", "held_out", "train")), pa.array(n_tokens, pa.int64()), *map(pa.array, (n_known, known, score, first))], names=out_names)

    return run


def triples(batches):
    """Counts of byte triples of the training texts; at most 255^3 rows a task."""
    sums = np.zeros(1 << 24, np.int64)
    for part in steps(batches, 0, STEP):
        for code, _ in strings([normal(x)[0] for x in texts_of(part.column(0))], 2):
            sums += np.bincount(code.astype(np.int64), minlength=1 << 24)
    at = np.flatnonzero(sums)
    for i in range(0, len(at), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65536], pa.int32()), pa.array(sums[at[i : i + 65536]])], names=["code", "n"])


def score(df: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5, least: int = 3) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. order: 3 to 6."""
    if not 3 <= order <= 6:
        raise ValueError("order is 3 to 6")
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.spark_partition_id().alias("chunk"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    low = docs.filter("train").select("text").mapInArrow(tidied(triples), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    size = int(low["n"].sum())  # symbols of the training texts
    low = spark.sparkContext.broadcast((low["code"].to_numpy(np.uint64), low["n"].to_numpy(np.int64)))
    parts = tasks(spark)
    buckets = max(parts, -(-size // BUCKET))
    sent = docs.select("chunk", "train", "text").mapInArrow(tidied(gather(order, buckets)), "bucket long, chunk int, keys binary, counts binary")
    sent = sent.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    told = sent.mapInArrow(tidied(answer(order, least, low)), "chunk int, keys binary, values binary, weight binary, v long")
    id_type = df.schema[id_col].dataType
    nothing = lambda t: F.lit(None).cast(t)
    told = told.select("chunk", F.lit(0).alias("kind"), nothing(id_type).alias("id"), nothing("boolean").alias("held_out"), nothing("boolean").alias("train"), nothing("string").alias("text"), "keys", "values", "weight", "v")
    texts = docs.select("chunk", F.lit(1).alias("kind"), "id", "held_out", "train", "text", *(nothing("binary").alias(c) for c in ("keys", "values", "weight")), nothing("long").alias("v"))
    both = told.union(texts).repartitionById(parts, F.pmod("chunk", F.lit(parts))).sortWithinPartitions("chunk", "kind")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("train", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("known", "score")), T.StructField("v", T.LongType())])
    out = written(both.mapInArrow(tidied(apply(order, both.columns)), schema), "scores")
    total = out.agg(F.sum(F.when(F.col("train"), F.col("n_tokens"))).alias("n"), F.sum("v").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    base = F.col("known") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
