"""Classifier metrics from (label, score) rows, without collecting scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.ranges import range_of
from strandlake.session import cut


#: Distinct scores are summed in ranges of about so many.
RANGE_ROWS = 1_000_000


def steps(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Each distinct score with its positives and negatives (_p, _n), those from it up (tp, fp), and those in all (_pos, _neg).

    Rows collapse to distinct scores first. Running sums go by ranges of scores between quantiles: each
    range is summed in a task of its own, from what the table of range sums has for those above it.
    """
    counts = cut(scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n")))
    parts = math.ceil(counts.count() / RANGE_ROWS)
    edges = sorted(set(counts.approxQuantile("threshold", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    ranged = counts.withColumn("_range", -range_of(F.col("threshold"), edges))
    # one row a range
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn"))
    sums = sums.select("_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(n) for c, n in (("_rp", "_ap"), ("_rn", "_an"))], *[F.sum(c).over(every).alias(n) for c, n in (("_rp", "_pos"), ("_rn", "_neg"))])
    down = Window.partitionBy("_range").orderBy(F.desc("threshold"))
    return ranged.join(F.broadcast(sums), "_range").select("threshold", "_p", "_n", "_pos", "_neg", (F.sum("_p").over(down) + F.col("_ap")).alias("tp"), (F.sum("_n").over(down) + F.col("_an")).alias("fp"))


def curve_points(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row for each distinct score, from high to low: tp and fp at that threshold with the ROC and PR coordinates."""
    none = F.lit(0)
    return steps(scored, label, score).select("threshold", "tp", "fp", (F.col("fp") / F.nullif("_neg", none)).alias("fpr"), (F.col("tp") / F.nullif("_pos", none)).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """roc_auc (ties count half) and average precision (sum of recall steps times precision)."""
    pos, neg = F.nullif("_pos", F.lit(0)), F.nullif("_neg", F.lit(0))
    # what stood above a score is what is there without its own rows
    roc = F.col("_n") / neg * (2 * F.col("tp") - F.col("_p")) / pos / 2
    ap = F.col("_p") / pos * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps(scored, label, score).agg(F.sum(roc).alias("roc_auc"), F.sum(ap).alias("avg_precision"))


def confusion(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Counts at a threshold, with accuracy and precision, recall and F1 of class 1."""
    said = F.col(score) >= threshold
    counts = scored.agg(F.count_if(said & (F.col(label) == 1)).alias("tp"), F.count_if(said & (F.col(label) == 0)).alias("fp"), F.count_if(~said & (F.col(label) == 1)).alias("fn"), F.count_if(~said & (F.col(label) == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    none = F.lit(0)
    return counts.withColumns(
        {
            "accuracy": (tp + tn) / F.nullif(tp + fp + fn + tn, none),
            "precision_1": F.coalesce(tp / F.nullif(tp + fp, none), F.lit(0.0)),
            "recall_1": F.coalesce(tp / F.nullif(tp + fn, none), F.lit(0.0)),
            "f1_1": F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, none), F.lit(0.0)),
        }
    )


def histogram(rows: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal bins between the least and the greatest value; the greatest falls into the last one. Empty bins have no row."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return rows.select(*(by or [])).limit(0).withColumns({"bin": F.lit(0), "n": F.lit(0).cast("long"), "density": F.lit(0.0)})
    width = (high - low) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("density", F.col("n") / (total * F.lit(float(width))))
