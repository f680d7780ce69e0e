"""Language identification of spans: script ranges narrow the candidates, then Viterbi over per-word scores.

Model: letter trigrams of lower-cased UTF-8, hashed into a fixed table of smoothed log probabilities for each language,
with the share of each script that a language's training words use. It is fitted on at most ``SAMPLE`` labelled rows,
those with the least hashes of id and text (the bound is the only sampling here), and its size is ``SLOTS`` x languages
numbers; more than MOST_LANGUAGES labels raise an error. Letters are those of Unicode category L.

A word's score for a language is its sum of trigram log probabilities; a language whose training words hardly use the
word's script is no candidate. Viterbi picks a language for each word with ``penalty`` for each switch. Most texts
have one language throughout; that path is proven best without the recursion when no run of words favours another
language by more than the penalty (k runs of other languages between or beside words of the main one cost k switches
at least) and the main language beats the best other language of each word in sum (no path without it is better).

lang_pred: the language with most bytes of words in the path. score: the share of those bytes, times the chance that
the language has against the others over its words. Null texts and texts without a letter give ``und`` and 0. Rows
without a label take no part in training; no labelled row at all gives ``und`` throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text, small_batches, steps, texts_of, tidied

SLOTS = 1 << 18
#: Labelled rows that training reads at most.
SAMPLE = 20_000
#: Labels that a model may have; each costs SLOTS numbers on the driver and in every worker.
MOST_LANGUAGES = 200
LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}\x00-\x7f]+")
# First UTF-8 bytes of scripts' ranges. 0 no letter, 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew, 5 Arabic, 6 South and South-East Asian, 7 kana and Han, 8 Hangul, 9 other.
SCRIPTS = [(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xD7, 4), (0xD8, 0xDD, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 9), (0xE3, 0xE9, 7), (0xEA, 0xED, 8), (0xF0, 0xF4, 9)]
N_SCRIPTS = 10
_LEAD = np.zeros(256, np.uint8)
for _a, _b, _s in SCRIPTS:
    _LEAD[_a : _b + 1] = _s
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def plain(text: str) -> str:
    """Lower case, with a space for signs beyond ASCII that are no letters or marks: dashes, spaces, emoji, numbers."""
    text = text.lower()
    return text if text.isascii() else _NO_LETTERS.sub(" ", text)


def trigrams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigrams of a lower-cased text's words, where each word's trigrams start, each word's bytes and script.

    ``raw`` is ``plain`` text: a word is a run of ASCII letters and bytes from 0x80, between which all else is space.
    """
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    inside = _IN_WORD[b]
    x = np.where(inside, b, 32).astype(np.uint32)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2] + 1, edge[1::2] + 1  # a word is [start, end)
    if not len(starts):
        return np.empty(0, np.int64), starts, starts, starts
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(14)
    keep = inside[1:-1]  # a trigram belongs to the word of its middle byte
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    script = np.maximum.reduceat(_LEAD[b][1:-1][keep], first)
    return code[keep], first, lens, script


def pick(df: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows (_t, _l), by the least hashes; only hashes are ranked."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"), F.xxhash64(F.col(text_col), F.col(id_col)).alias("_h"))
    end = rows.select("_h").orderBy("_h").limit(sample + 1).agg(F.max("_h"), F.count("*")).first()
    return (rows if end[1] <= sample else rows.filter(F.col("_h") < end[0])).drop("_h")


class Model:
    """names, log probabilities (SLOTS x languages), allowed (scripts x languages)."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        total = counts.sum(1, keepdims=True)
        self.logp = np.ascontiguousarray(np.log((counts + 0.05) / (total + 0.05 * SLOTS)).T.astype(np.float32)) if names else None
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.allowed = (share > 0.001).T if names else None


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """Counts are summed on the executors; the driver gets SLOTS and N_SCRIPTS numbers a language at most."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for lang, at in sums.items():
                i = np.flatnonzero(at)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(i)), pa.array(i, pa.int64()), pa.array(at[i])], names=["lang", "slot", "n"])
            sums.clear()

        for part in steps(batches, 0):
            if len(sums) > 32:
                yield from out()
            for raw, lang in zip(texts_of(part.column(0)), part.column(1).to_pylist()):
                code, first, _, script = trigrams(plain(raw.decode("utf-8", "replace")).encode())
                at = sums.setdefault(lang, np.zeros(SLOTS + N_SCRIPTS, np.int64))
                if len(first):
                    at[:SLOTS] += np.bincount(code, minlength=SLOTS)
                    at[SLOTS:] += np.bincount(script, minlength=N_SCRIPTS)
        yield from out()

    small_batches(df.sparkSession)
    picked = pick(df, text_col, lang_col, id_col, sample)
    if df.filter(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in {lang_col}")
    rows = picked.mapInArrow(tidied(run), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), SLOTS + N_SCRIPTS))
    if len(rows):
        counts[rows["lang"].map(place).to_numpy(int), rows["slot"].to_numpy(int)] = rows["n"]
    return Model(names, counts[:, :SLOTS], counts[:, SLOTS:])


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word for (words x languages) scores."""
    total = scores.sum(0)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, [best]], 0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), 0)
    if (gain - low).max() <= penalty:
        other = scores.copy()
        other[:, best] = -np.inf
        if scores.shape[1] == 1 or total[best] >= other.max(1).sum():
            return np.full(len(scores), best)
    rows = scores.tolist()
    at, steps_back = rows[0], []
    for row in rows[1:]:
        top = max(at)
        floor = top - penalty
        steps_back.append((at, floor, at.index(top)))
        at = [(x if x >= floor else floor) + y for x, y in zip(at, row)]
    path = [at.index(max(at))]
    for at, floor, top in reversed(steps_back):
        path.append(path[-1] if at[path[-1]] >= floor else top)
    return np.array(path[::-1])


class Labeller:
    def __init__(self, model: Model, penalty: float = 12.0):
        self.m, self.penalty = model, penalty

    def words(self, text: str):
        code, first, lens, script = trigrams(plain(text).encode())
        if not len(first):
            return None
        scores = np.add.reduceat(self.m.logp[code].astype(np.float64), first, axis=0)
        allowed = self.m.allowed[script]
        allowed |= ~allowed.any(1, keepdims=True)
        return np.where(allowed, scores, scores.min(1, keepdims=True) - 20.0), lens

    def predict(self, text: str) -> tuple[str, float]:
        if not self.m.names or not LETTER.search(text) or (found := self.words(text)) is None:
            return "und", 0.0
        scores, lens = found
        path = viterbi(scores, self.penalty)
        share = np.bincount(path, lens, len(self.m.names))
        best = int(share.argmax())
        own = scores[path == best].sum(0)
        own = np.exp(np.clip((own - own[best]) / max(1.0, np.sqrt((path == best).sum())), -50, 50))
        return self.m.names[best], float(share[best] / share.sum() / own.sum())

    def spans(self, text: str) -> list[tuple[str, int]]:
        """(language, words) of each run of the best path."""
        if not self.m.names or (found := self.words(text)) is None:
            return []
        path = viterbi(found[0], self.penalty)
        cut = np.flatnonzero(np.diff(path)) + 1
        return [(self.m.names[int(path[a])], int(b - a)) for a, b in zip([0, *cut], [*cut, len(path)])]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """id, lang_pred, score."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        label = Labeller(held.value, penalty)

        def f(texts):
            got = [label.predict(t.decode("utf-8", "replace")) for t in texts]
            return [[a for a, _ in got], [b for _, b in got]]

        return f

    return per_text(df, id_col, text_col, out, make)


def keep(df: DataFrame, model: Model, least: float = 0.4, text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """The rows, all columns unchanged, whose language is known and scores ``least`` at least."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        label = Labeller(held.value, penalty)
        for part in steps(batches, at):
            good = [a != "und" and b >= least for a, b in (label.predict(t.decode("utf-8", "replace")) for t in texts_of(part.column(at)))]
            yield part.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(tidied(run), df.schema)


def label_spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """id, spans: array of (lang, words) in text order."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())])

    def make():
        label = Labeller(held.value, penalty)
        return lambda texts: [[[{"lang": a, "words": n} for a, n in label.spans(t.decode("utf-8", "replace"))] for t in texts]]

    return per_text(df, id_col, text_col, T.StructType([T.StructField("spans", T.ArrayType(span))]), make)
