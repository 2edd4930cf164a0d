"""Exact and approximate tests and corrections. Fisher's test runs over Arrow batches, everything else is Catalyst expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.ranges import range_of
from strandlake.session import cut

#: Tables whose probability exceeds the observed one by no more than this share count as equally extreme.
EPSILON = 1e-7
#: Terms are taken so many at a time, until one adds less than this share, or is too small for a double.
STEPS, ENOUGH, TINY = 64, 1e-18, 1e-307
#: Distinct p of a family are ranked in ranges of about so many.
RANGE_ROWS = 1_000_000


def _factors(k: np.ndarray, right: bool, row: np.ndarray, column: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The weight of the table next to that with ``k`` in its first cell, as a multiple of its weight; 0 at the end of the support."""
    if right:
        return np.maximum(row - k, 0) * np.maximum(column - k, 0) / np.maximum((k + 1) * (rest - column + k + 1), 1)
    return np.maximum(k, 0) * np.maximum(rest - column + k, 0) / np.maximum((row - k + 1) * (column - k + 1), 1)


def fisher_p(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, greater: bool) -> np.ndarray:
    """p of many tables at once, by the ratios of neighbouring tables outward from the likeliest one.

    Memory is constant in the counts: of each table only the current term and two sums are held, and a walk stops when
    its terms no longer matter.
    """
    row, column, rest = (x.astype(np.float64) for x in (a + b, a + c, c + d))
    seen = a.astype(np.float64)
    mode = np.clip(np.floor((row + 1) * (column + 1) / (row + rest + 2)), np.maximum(0, column - rest), np.minimum(row, column))
    observed = np.ones(len(a))
    for right in (True, False):
        left_to_go = np.where(right, seen - mode, mode - seen)
        k = mode.copy()
        while len(live := np.flatnonzero((left_to_go > 0) & (observed > 0))):
            at = k[live, None] + np.arange(STEPS) * (1 if right else -1)
            step = _factors(at, right, *(x[live, None] for x in (row, column, rest)))
            step[np.arange(STEPS) >= left_to_go[live, None]] = 1.0
            observed[live] *= step.prod(axis=1)
            k[live] += STEPS if right else -STEPS
            left_to_go[live] -= STEPS
    limit = observed * (1 + EPSILON)
    total = np.ones(len(a))
    tail = (mode >= seen if greater else limit >= 1).astype(np.float64)
    for right in (True, False):
        k, term = mode.copy(), np.ones(len(a))
        live = np.arange(len(a))
        while len(live):
            at = k[live, None] + np.arange(STEPS) * (1 if right else -1)
            terms = term[live, None] * np.cumprod(_factors(at, right, *(x[live, None] for x in (row, column, rest))), axis=1)
            total[live] += terms.sum(axis=1)
            counted = at + (1 if right else -1) >= seen[live, None] if greater else terms <= limit[live, None]
            tail[live] += np.where(counted, terms, 0).sum(axis=1)
            term[live] = terms[:, -1]
            k[live] += STEPS if right else -STEPS
            last = term[live]
            # a walk goes on while it has not come to its tail, and while its terms still add to the sums
            before = (k[live] < seen[live]) & right if greater else last > limit[live]
            sums = total[live] if greater and not right else tail[live]
            live = live[(last > TINY) & (before | (last > ENOUGH * sums))]
    return np.minimum(1.0, tail / total)


def _fisher(a: Column, b: Column, c: Column, d: Column, greater: bool) -> Column:
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        cells = [pc.fill_null(x, -1).to_numpy(zero_copy_only=False) for x in (a, b, c, d)]
        known = np.min(cells, axis=0) >= 0
        p = np.full(len(known), np.nan)
        where = np.flatnonzero(known)
        for at in range(0, len(where), 4096):
            own = where[at : at + 4096]
            p[own] = fisher_p(*(x[own] for x in cells), greater)
        return pa.array(p, mask=~known)

    run.__annotations__ = dict.fromkeys(("a", "b", "c", "d", "return"), pa.Array)
    return F.arrow_udf(run, "double")(*(x.cast("long") for x in (a, b, c, d)))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """p of the table [[a, b], [c, d]]: all tables as improbable as it. Degenerate margins give 1, nulls and negatives null."""
    return _fisher(a, b, c, d, False)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Upper tail: tables with at least ``a`` in the first cell."""
    return _fisher(a, b, c, d, True)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a·d / (b·c); infinite where only the denominator is 0, null where a margin is 0."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    return F.when(empty, F.lit(None).cast("double")).when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / (b * c))


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0, to about 1e-12: the series of positive terms below 3, Laplace's continued fraction from there on."""

    def folded(numbers: list[int], step) -> Column:
        # 2z² rides along, so that it is computed once
        start = F.struct((2 * z * z).alias("q"), F.lit(1.0).alias("x"))
        return F.aggregate(F.array(*map(F.lit, numbers)), start, lambda acc, k: F.struct(acc["q"].alias("q"), step(acc["q"], acc["x"], k.cast("double")).alias("x")), lambda acc: acc["x"])

    series = folded([2 * n + 1 for n in range(60, 0, -1)], lambda q, x, k: 1.0 + q / k * x)
    fraction = folded([*range(60, 0, -1)], lambda q, x, k: 1.0 + k / q / x)
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 3, 1 - 2 * z * scale * series).otherwise(scale / z / fraction)


def logit_coefficient(mc: Column, uc: Column, mt: Column, ut: Column) -> tuple[Column, Column]:
    """Slope of modified ~ treatment and its Wald p in closed form; (null, 1) where a cell is 0."""
    mc, uc, mt, ut = (x.cast("double") for x in (mc, uc, mt, ut))
    whole = F.least(mc, uc, mt, ut) > 0
    coef = F.log(mt * uc / (ut * mc))
    z = F.abs(coef) / F.sqrt(1 / mc + 1 / uc + 1 / mt + 1 / ut)
    return F.when(whole, coef), F.when(whole, erfc(z / math.sqrt(2))).otherwise(1.0)


def bh_fdr(df: DataFrame, family: list[str], p_col: str = "pvalue", out: str = "fdr", least: int = 1) -> DataFrame:
    """Benjamini-Hochberg within each family; null p gets 1 and does not count.

    Families with fewer than ``least`` values of p are left out; where it is over 1, so are rows without p.

    The step-up runs over the distinct p of a family, counted first with map-side combine. They are cut to
    ranges of about ``RANGE_ROWS`` between quantiles: ranks and least steps are found within a range, and a table of
    one row for each family and range carries the counts below and the least step above.
    """
    counted = cut(df.where(F.col(p_col).isNotNull()).groupBy(*family, p_col).agg(F.count("*").alias("_n")))
    ranges = math.ceil(counted.count() / RANGE_ROWS)
    edges = sorted(set(counted.approxQuantile(p_col, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    ranged = counted.withColumn("_range", range_of(F.col(p_col), edges))
    keys = [*family, "_range"]
    across = Window.partitionBy(*family)
    below, above = across.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), across.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys).agg(F.sum("_n").alias("_own"))
    totals = totals.withColumns({"_below": F.coalesce(F.sum("_own").over(below), F.lit(0)), "_m": F.sum("_own").over(across)}).where(F.col("_m") >= least)
    up, down = Window.partitionBy(*keys).orderBy(p_col), Window.partitionBy(*keys).orderBy(F.desc(p_col))
    stepped = ranged.join(totals, keys).withColumn("_step", F.col(p_col) * F.col("_m") / (F.col("_below") + F.sum("_n").over(up)))
    least_above = stepped.groupBy(*keys).agg(F.min("_step").alias("_least")).withColumn("_above", F.min("_least").over(above)).drop("_least")
    steps = stepped.join(least_above, keys).withColumn(out, F.least(F.lit(1.0), F.min("_step").over(down), F.coalesce("_above", F.lit(1.0)))).select(*family, p_col, out)
    return df.join(steps, [*family, p_col], "left" if least < 2 else "inner").withColumn(out, F.coalesce(out, F.lit(1.0)))
