"""Model features of differential sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence
from strandlake.operators.selection import exact_medians

NUMERIC = ["baseline_stoichiometry", "gc_content", "drach_motif", "relative_position", "gene_length", "log_coverage_ctrl", "log_coverage_treat", "coverage_ratio", "mean_probability_ctrl", "mean_probability_treat"]
CATEGORICAL = ["transcript_region", "pathway_annotation", "gene_biotype"]


def sequence_features(sites: DataFrame, tiles: DataFrame | None, tile_size: int = 1_000_000, reach: int = 25) -> DataFrame:
    """gc_content, drach_motif and kmer_context around each site.

    ``tiles`` (reference_name, tile_id, tile_start, seq) come from the FASTA source and overlap by
    ``reach``, so a site finds its whole window in one tile. An unknown reference gives null, false
    and an empty string.
    """
    if tiles is None:
        return sites.withColumns({"gc_content": F.lit(None).cast("double"), "drach_motif": F.lit(False), "kmer_context": F.lit("")})
    keyed = sites.withColumn("tile_id", F.floor(F.col("ref_pos") / tile_size))
    joined = keyed.join(tiles, ["reference_name", "tile_id"], "left")
    at = F.col("ref_pos") - F.col("tile_start")
    return joined.select(*sites.columns, sequence.gc_content(F.col("seq"), at).alias("gc_content"), sequence.is_drach(F.col("seq"), at).alias("drach_motif"), sequence.kmer(F.col("seq"), at).alias("kmer_context"))


def coverage_features(rows: DataFrame) -> DataFrame:
    """Logs and ratios of coverage and stoichiometry."""
    return rows.withColumns(
        {
            "log_coverage_ctrl": F.log1p("total_reads_ctrl"),
            "log_coverage_treat": F.log1p("total_reads_treat"),
            "coverage_ratio": F.col("total_reads_treat") / F.greatest("total_reads_ctrl", F.lit(1)),
            "baseline_stoichiometry": F.col("stoichiometry_ctrl"),
            "stoichiometry_change_ratio": F.col("stoichiometry_treat") / F.greatest("stoichiometry_ctrl", F.lit(0.001)),
        }
    )


def one_hot(rows: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 columns ``{column}_{level}`` for every level in order. Levels are the few values of a categorical column."""
    out = {}
    for c in columns:
        for level in sorted(r[0] for r in rows.select(c).where(F.col(c).isNotNull()).distinct().collect()):
            out[f"{c}_{level}"] = F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
    return rows.withColumns(out)


def impute_median(rows: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Nulls of each column as its median; 0 where the column has none.

    Exact medians of all columns are found together by rounds of narrowing; ``accuracy`` takes a quantile sketch
    of that accuracy instead.
    """
    if accuracy is None:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("e"))
        found = {r["i"]: r["median"] for r in exact_medians(long.select("e.i", "e.v"), ["i"], F.col("v")).collect()}
        middle = {c: found.get(i) for i, c in enumerate(columns)}
    else:
        middle = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in columns]).first()
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c] if middle[c] is not None else 0.0)) for c in columns})


def stratified_split(rows: DataFrame, label: str, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test``: the first share of each label in the order of a hash of the key.

    The share is cut by the hash's quantile counts rather than by sorting a label in one task: rows
    fall into 4096 hash slots, whole slots below the cut are test rows, and only the slot at the cut
    is ordered row by row.
    """
    h = F.xxhash64(*[F.col(k).cast("string") for k in key], F.lit(seed))
    slotted = rows.withColumns({"_h": h, "_slot": F.pmod(F.shiftright(h, 20), F.lit(4096))})
    counts = slotted.groupBy(label, "_slot").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_slot")
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_take": F.round(F.sum("_n").over(Window.partitionBy(label)) * test_share)})
    joined = slotted.join(F.broadcast(counts), [label, "_slot"])
    within = F.row_number().over(Window.partitionBy(label, "_slot").orderBy("_h", *key))
    return joined.withColumn("is_test", F.col("_before") + within <= F.col("_take")).select(*rows.columns, "is_test")


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    """n_neg, n_pos, and the weight of a positive row."""
    counts = rows.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"), F.count_distinct(label).alias("n_classes"))
    return counts.withColumn("scale_pos_weight", F.col("n_neg") / F.greatest("n_pos", F.lit(1)))
