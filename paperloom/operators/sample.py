"""Deterministic samples: rows are ordered by a hash of seed and id, so any partitioning draws the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(seed), F.col(id_col)).cast("binary"))


def uniform(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows; a top-k per task, so the order is never a full sort."""
    return rows.orderBy(hash_order(id_col, seed), id_col).limit(n)


def quotas(weights: DataFrame, n: int, stratum: str = "stratum", weight: str = "weight") -> DataFrame:
    """stratum, weight, quota by largest remainder; quotas sum to n. Ties go to the smaller stratum name."""
    everything = Window.partitionBy()
    out = weights.withColumn("_exact", F.lit(float(n)) * F.col(weight) / F.sum(weight).over(everything))
    out = out.withColumn("_floor", F.floor("_exact"))
    out = out.withColumn("_left", F.lit(n) - F.sum("_floor").over(everything))
    by = Window.partitionBy().orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), stratum)
    return out.withColumn("quota", (F.col("_floor") + (F.row_number().over(by) <= F.col("_left")).cast("long")).cast("long")).select(stratum, weight, "quota")


def stratified(rows: DataFrame, stratum: str, id_col: str, weights: DataFrame, n: int, seed: int) -> DataFrame:
    """Rows of each stratum up to its quota, capped by what it holds. Each task keeps its best rows first.

    A stratum's rows pass a window in hash order; rows that cannot be drawn (beyond n by hash in their own sub-group
    of 1/64) are dropped before it, so a hot stratum sends at most 64 n rows.
    """
    q = quotas(weights, n, stratum, "weight").select(stratum, "quota")
    order = [hash_order(id_col, seed), F.col(id_col)]
    salted = Window.partitionBy(stratum, F.pmod(F.xxhash64(id_col), F.lit(64))).orderBy(*order)
    small = rows.withColumn("_s", F.row_number().over(salted)).filter(F.col("_s") <= n).drop("_s").join(q, stratum)
    return small.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter("_r <= quota").drop("_r", "quota")


def half_and_half(rows: DataFrame, id_col: str, is_first: Column, n: int, seed: int) -> DataFrame:
    """Half of n from rows where is_first holds and half from the rest; either side makes up for the other."""
    flagged = rows.withColumn("first_side", F.coalesce(is_first, F.lit(False)))
    a, b = (uniform(flagged.filter(F.col("first_side") if s else ~F.col("first_side")), id_col, n, seed).withColumn("_r", F.row_number().over(Window.partitionBy("first_side").orderBy(hash_order(id_col, seed), id_col))) for s in (True, False))
    both = a.unionByName(b)
    sizes = Window.partitionBy()
    na, nb = F.count(F.when(F.col("first_side"), 1)).over(sizes), F.count(F.when(~F.col("first_side"), 1)).over(sizes)
    take_a = F.least(F.greatest(F.lit(n // 2), n - nb), na)
    take_b = F.least(F.lit(n) - take_a, nb)
    return both.withColumn("_take", F.when(F.col("first_side"), take_a).otherwise(take_b)).filter("_r <= _take").drop("_r", "_take")


def census_and_sample(rows: DataFrame, stratum: str, census: list[str], sampled: str, id_col: str, is_first: Column, n: int, seed: int) -> DataFrame:
    """All rows of the census strata, and half_and_half of the sampled one."""
    part = half_and_half(rows.filter(F.col(stratum) == sampled), id_col, is_first, n, seed).drop("first_side")
    return rows.filter(F.col(stratum).isin(census)).unionByName(part)


def systematic(rows: DataFrame, stratum: str, position: str, n: int = 10, pieces: int = 64) -> DataFrame:
    """Every (count div n)-th row of a stratum by position, n at most.

    A stratum is cut into pieces by quantiles of its positions. Only piece counts are summed over a stratum, and only the
    pieces that hold a wanted rank are ordered, so a hot stratum is never sorted as a whole. Null positions take no part.
    """
    rows = rows.filter(F.col(position).isNotNull())
    cuts = F.percentile_approx(position, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("_cuts")
    strata = rows.groupBy(F.col(stratum).alias("_s")).agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("_step"), cuts)
    placed = rows.join(strata, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(position)))).drop("_cuts")
    sizes = placed.groupBy("_s", "_piece", "_step").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sizes.withColumn("_before", before).withColumn("_next", F.ceil(F.col("_before") / F.col("_step")) * F.col("_step"))
    wanted = wanted.filter((F.col("_next") < F.col("_before") + F.col("_n")) & (F.col("_next") < F.col("_step") * n)).select(F.col("_s").alias("_w"), F.col("_piece").alias("_p"), "_before")
    held = placed.join(wanted, F.col("_s").eqNullSafe(F.col("_w")) & (F.col("_piece") == F.col("_p")))
    rank = F.row_number().over(Window.partitionBy("_s", "_piece").orderBy(position)) - 1 + F.col("_before")
    out = held.withColumn("_i", rank).filter((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < n))
    return out.select(*rows.columns)


def pages(rows: DataFrame, page_col: str, n: int, seed: int) -> DataFrame:
    """Page 1 and n - 1 others by hash."""
    return rows.filter(F.col(page_col) == 1).unionByName(uniform(rows.filter(F.col(page_col) != 1), page_col, n - 1, seed))


def recent_years(rows: DataFrame, year: Column, asof_year: int, years: int = 3) -> DataFrame:
    return rows.filter(year > asof_year - years)
