"""Temperature mixing of sources, in DataFrame and SQL functions only.

Weights are source token shares to the power ``alpha``, normalised. ``alpha`` is bisected to meet a target entropy (a
share of the entropy of equal weights) or a limit on how often a source is repeated. A source's quota is its weight of
the token budget: a number, or by default the least budget that passes every source once.

A source's stream is one permutation of its documents after another. Documents are dealt to blocks by a hash of their
id; each pass orders the blocks and the documents inside a block by hashes of (seed, pass, block or id). Running sums
over blocks, then inside blocks, give every document's first token in the stream; those that start within the quota
are taken, the one that crosses its end included, and so is all of a pass that the quota covers, documents without
tokens at its end too. Blocks hold some BLOCK_DOCS documents or, in a source of over BLOCK_DOCS^2, as many as it has
blocks; block totals meet in one window over a source and a block's documents in another, so neither holds more than the
square root of a hot source. More than MOST_SOURCES sources raise an error: their totals meet in one row.

An entropy that no exponent meets (sources that share the largest total) raises a warning and leaves MOST_ALPHA.

A null source is a source of its own; a null text has no tokens. A source without tokens has weight 0 and is passed
once. Repeated rows are separate documents; so are rows that share an id, which their lengths and texts order. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

ROUNDS = 60
BLOCK_DOCS = 1000
MOST_SOURCES = 100_000
#: First upper end of the exponent for an entropy, doubled up to DOUBLINGS times until the target lies below it.
MOST_ALPHA = 8.0
DOUBLINGS = 20


def _meets(target: str) -> str:
    """SQL: whether exponent ``a`` lies below the one sought, over tokens ``s`` (array, all > 0) with maximum ``most``."""
    z = "aggregate(s, 0D, (x, t) -> x + pow(t / most, a))"
    if target == "entropy":
        return f"ln({z}) - a * aggregate(s, 0D, (x, t) -> x + pow(t / most, a) * ln(t / most)) / nullif({z}, 0D) > goal * ln(size(s))"
    return "pow(array_max(s) / nullif(array_min(s), 0D), 1 - a) > goal"


def weights(totals: DataFrame, target: str, goal: float, budget: float | None) -> DataFrame:
    """source, tokens, docs -> and alpha, weight, quota, met. One row holds all sources' totals while alpha is bisected."""
    one = totals.agg(F.array_sort(F.collect_list(F.struct("source", "tokens", "docs"))).alias("all"), F.max("tokens").cast("double").alias("most"))
    one = one.withColumn("s", F.expr("transform(filter(all, x -> x.tokens > 0), x -> cast(x.tokens as double))")).withColumn("goal", F.lit(float(goal)))
    mid = "(r.lo + r.hi) / 2"

    def below(a: str) -> str:
        return _meets(target).replace("pow(t / most, a)", f"pow(t / most, {a})").replace("a * agg", f"{a} * agg").replace("1 - a", f"1 - {a}")

    step = below(mid)
    if target == "entropy":
        one = one.withColumn("top", F.expr(f"aggregate(sequence(1, {DOUBLINGS}), {MOST_ALPHA}D, (h, i) -> if({below('h')}, 2 * h, h))"))
        one = one.withColumn("met", ~F.coalesce(F.expr(below("top")), F.lit(False))).withColumn("top", F.when(F.col("met"), F.col("top")).otherwise(F.lit(MOST_ALPHA)))
    else:
        one = one.withColumn("top", F.lit(1.0)).withColumn("met", F.lit(True))
    one = one.withColumn("r", F.expr(f"aggregate(sequence(1, {ROUNDS}), named_struct('lo', 0D, 'hi', top), (r, i) -> if({step}, named_struct('lo', {mid}, 'hi', r.hi), named_struct('lo', r.lo, 'hi', {mid})))"))
    # written, so that the optimizer does not put the bisection wherever alpha is named
    one = written(one.select("all", "most", "s", "met", F.expr("r.hi").alias("alpha")), "mix-alpha", 8)
    one = written(one.withColumn("z", F.expr("aggregate(s, 0D, (x, t) -> x + pow(t / most, alpha))")), "mix-sum", 8)
    one = one.withColumn("all", F.expr("transform(all, x -> named_struct('source', x.source, 'tokens', x.tokens, 'docs', x.docs, 'weight', if(x.tokens > 0, pow(x.tokens / most, alpha) / nullif(z, 0D), 0D)))"))
    spent = F.lit(float(budget)) if budget is not None else F.expr("array_max(transform(filter(all, x -> x.tokens > 0), x -> x.tokens / x.weight))")
    one = one.withColumn("budget", F.coalesce(spent, F.lit(0.0)))
    return one.select("alpha", "met", "budget", F.explode("all").alias("x")).select("x.*", "alpha", "met", F.round(F.col("x.weight") * F.col("budget")).cast("long").alias("quota"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: str = "entropy", goal: float = 0.9, budget: float | None = None, seed: int = 0, with_key: bool = False) -> DataFrame:
    """id, source, pass (from 0), start (the document's first token in its source's stream), n_tokens, weight, alpha.

    One row for each time that a document is taken; ordering a source's rows by start gives its stream. On request also
    text_key, a hash of the text, and quota.
    """
    if target not in ("entropy", "repeats"):
        raise ValueError("target is entropy or repeats")
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n"), F.xxhash64(F.col(text_col)).alias("tk"))
    docs = written(docs.withColumn("h", F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")), "mix-tokens")
    sources = written(docs.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "mix-sources", 8)
    if sources.count() > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources in {source_col}")
    sources = written(weights(sources, target, goal, budget), "mix-weights", 8)
    if not sources.filter("NOT met").isEmpty():
        warnings.warn(f"no exponent brings these sources to an entropy of {goal}; {MOST_ALPHA} is used", stacklevel=2)
    sources = sources.withColumn("blocks", F.ceil(F.col("docs") / F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.sqrt("docs"))))).withColumn("passes", F.greatest(F.lit(1), F.ceil(F.try_divide("quota", "tokens"))))
    sources = sources.withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")))  # a key without nulls
    docs = docs.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))).join(sources.select(F.col("source").alias("key"), "blocks"), "key")
    docs = docs.withColumn("block", F.pmod(F.col("h"), F.col("blocks"))).drop("blocks", "h")
    blocks = docs.groupBy("key", "block").agg(F.sum("n").alias("b_tokens")).join(sources.withColumnRenamed("source", "key"), "key")
    blocks = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("pass"), F.col("key"), F.col("block")))
    before = Window.partitionBy("key", "pass").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("b_start", F.col("pass") * F.col("tokens") + F.coalesce(F.sum("b_tokens").over(before), F.lit(0)))
    whole = F.col("quota") >= (F.col("pass") + 1) * F.col("tokens")
    blocks = blocks.withColumn("whole", whole).filter(F.col("whole") | (F.col("b_start") < F.greatest(F.col("quota"), F.lit(1))))
    out = docs.join(blocks.select("key", "block", "pass", "b_start", "whole", "quota", "weight", "alpha"), ["key", "block"])
    inside = Window.partitionBy("key", "pass", "block").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("pass"), F.col("id"))), "id", "n", "tk").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("start", F.col("b_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter(F.col("whole") | (F.col("start") < F.greatest(F.col("quota"), F.lit(1))))
    more = [F.col("tk").alias("text_key"), "quota"] if with_key else []
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "pass", "start", F.col("n").alias("n_tokens"), F.round("weight", 9).alias("weight"), F.round("alpha", 9).alias("alpha"), *more)
