"""Exact medians of any number of rows by rounds of narrowing, without sorting or holding them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import Scratch

#: A group is cut to so many slots in a round; what is left of it is held at once when it has no more rows than this.
SLOTS, HELD = 4096, 200_000


def magnitude(x: Column) -> Column:
    """A monotone image of doubles that grows with the logarithm of their size, the infinite ones at its ends."""
    size = F.when(x == 0, 0.0).when(F.abs(x) == float("inf"), 4096.0).otherwise(F.log2(F.abs(x)) + 1100)
    return F.signum(x) * size


def exact_medians(rows: DataFrame, keys: list[str], value: Column, most_rounds: int = 40) -> DataFrame:
    """``keys`` and ``median``: the middle value of each group, or the mean of the two middle ones.

    Each round counts a group's values in ``SLOTS`` slots between its bounds and narrows the bounds to the slots
    that hold the middle ranks, by size and by value in turn, so that values of any spread are told apart. Null and NaN do not count, and groups without a value are left out; null keys are a group.
    """
    scratch = Scratch()
    long = rows.select(*[F.col(k) for k in keys], value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = long.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # _one and _two: the middle ranks from 0 on, among the values within the bounds
    bounds = scratch.cut(whole.withColumns({"_one": F.expr("(_n - 1) div 2"), "_two": F.expr("_n div 2")}))
    done = []
    joined = lambda a, b: a.join(b, [a[k].eqNullSafe(b[k]) for k in keys]).drop(*[b[k] for k in keys]) if keys else a.crossJoin(F.broadcast(b))
    for number in range(most_rounds):
        same = F.col("_low") == F.col("_high")
        done.append(bounds.where(same | F.col("_median").isNotNull() if "_median" in bounds.columns else same).select(*keys, F.coalesce("_median", "_low").alias("median") if "_median" in bounds.columns else F.col("_low").alias("median")))
        left = bounds.where(~same & F.col("_median").isNull() if "_median" in bounds.columns else ~same)
        few = left.where(F.col("_n") <= HELD).select(*keys, "_low", "_high", "_one", "_two")
        wide = left.where(F.col("_n") > HELD).select(*keys, "_low", "_high", "_one", "_two")
        inside = F.col("_v").between(F.col("_low"), F.col("_high"))
        held = joined(long, few).where(inside).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_vs"), F.first("_one").alias("_one"), F.first("_two").alias("_two"))
        done.append(held.select(*keys, ((F.get("_vs", F.col("_one").cast("int")) + F.get("_vs", F.col("_two").cast("int"))) / 2).alias("median")))
        if wide.isEmpty():
            break
        # where the bounds lie too far apart for a difference, only sizes tell
        by_size = F.lit(number % 2 == 0) | (F.col("_high") - F.col("_low") == float("inf"))
        image = lambda x: F.when(by_size, magnitude(x)).otherwise(x)
        low, high = image(F.col("_low")), image(F.col("_high"))
        share = F.coalesce(F.try_divide(image(F.col("_v")) - low, high - low), F.lit(0.0))
        slot = F.least(F.floor(share * SLOTS), F.lit(SLOTS - 1))
        counted = joined(long, wide).where(inside).groupBy(*keys, "_one", "_two", slot.alias("_slot")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("_below", below)
        has = lambda rank: (F.col("_below") <= F.col(rank)) & (F.col(rank) < F.col("_below") + F.col("_n"))
        hit = placed.where(has("_one") | has("_two"))
        # both ranks in one slot: its bounds; in two: the end of the one and the beginning of the other
        apart = F.count("*") > 1
        bounds = scratch.cut(
            hit.groupBy(*keys).agg(
                F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
                F.max(F.col("_one") - F.col("_below")).alias("_one"), F.max(F.col("_two") - F.col("_below")).alias("_two"),
                F.when(apart, (F.max(F.when(has("_one"), F.col("_high"))) + F.max(F.when(has("_two"), F.col("_low")))) / 2).alias("_median"),
            )
        )
    else:
        raise RuntimeError(f"medians did not settle in {most_rounds} rounds")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
