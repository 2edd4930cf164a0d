"""Per-site modification fractions from per-read calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.selection import exact_medians

SITE = ["reference_name", "ref_pos", "mod_type", "strand"]
#: A call is modified from this 8-bit probability on; sites need this many calls.
PROBABILITY_THRESHOLD, MIN_COVERAGE = 191, 10


def clean_probability(p: Column) -> Column:
    """A number, 0 where it is none."""
    x = p.try_cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def modification_filter(calls: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """Calls of the given types, before anything is aggregated; None keeps all."""
    return calls if types is None else calls.where(F.col("mod_type").isin(*types))


def site_counts(calls: DataFrame, threshold: int = PROBABILITY_THRESHOLD, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Mergeable state of every site: counts and sums of p and p². Sites with a null key are left out."""
    p = clean_probability(F.col("probability"))
    keys = [*by, *SITE]
    rows = calls.dropna(subset=keys).withColumn("_p", p)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_count"), F.count_if(F.col("_p") >= F.lit(threshold / 255.0)).alias("modified_count"), F.sum("_p").alias("prob_sum"), F.sum(F.col("_p") * F.col("_p")).alias("prob_sq_sum")
    )


def summed_counts(states: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """States of the same sites as one, however many there are."""
    return states.groupBy(*by, *SITE).agg(*[F.sum(c).alias(c) for c in ("total_count", "modified_count", "prob_sum", "prob_sq_sum")])


def merge_counts(a: DataFrame, b: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    return summed_counts(a.unionByName(b), by)


def finalize(counts: DataFrame, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    """Fractions of the sites with enough calls; the median is stated as the mean, the deviation is of the population."""
    n = F.col("total_count")
    mean = F.col("prob_sum") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("prob_sq_sum") / n - mean * mean))
    kept = counts.where(n >= min_coverage)
    others = [c for c in counts.columns if c not in ("total_count", "modified_count", "prob_sum", "prob_sq_sum")]
    return kept.select(
        *others, n.alias("total_reads"), F.col("modified_count").alias("modified_reads"), (F.col("modified_count") / n).alias("stoichiometry"), mean.alias("mean_probability"), mean.alias("median_probability"), deviation.alias("std_probability")
    )


def stoichiometry(calls: DataFrame, threshold: int = PROBABILITY_THRESHOLD, min_coverage: int = MIN_COVERAGE, types: Sequence[str] | None = None) -> DataFrame:
    return finalize(site_counts(modification_filter(calls, types), threshold), min_coverage)


def stoichiometry_exact(calls: DataFrame, threshold: int = PROBABILITY_THRESHOLD, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    """Coverage in distinct reads, exact median and sample deviation."""
    rows = calls.dropna(subset=["sample", *SITE]).withColumn("_p", clean_probability(F.col("probability")))
    grouped = rows.groupBy("sample", *SITE).agg(
        F.count_distinct("read_id").alias("total_reads"),
        F.count_if(F.col("_p") >= F.lit(threshold / 255.0)).alias("modified_reads"),
        F.avg("_p").alias("mean_probability"),
        F.median("_p").alias("median_probability"),
        F.stddev_samp("_p").alias("std_probability"),
    )
    return grouped.where(F.col("total_reads") >= min_coverage).withColumn("stoichiometry", F.col("modified_reads") / F.col("total_reads"))


def extraction_summary(calls: DataFrame, approximate: bool = False) -> DataFrame:
    """One row a sample: calls, reads, sites, references. ``approximate`` trades exact distinct counts for sketches."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return calls.groupBy("sample").agg(F.count("*").alias("total_mod_calls"), distinct("read_id").alias("unique_reads"), distinct(F.struct("reference_name", "ref_pos")).alias("unique_sites"), distinct("reference_name").alias("unique_transcripts"))


def modification_summary(calls: DataFrame, approximate: bool = False) -> DataFrame:
    """Calls, mean and median probability of each sample and type, in long form."""
    p = clean_probability(F.col("probability"))
    keys, counts = ["sample", "mod_type"], [F.count("*").alias("calls"), F.avg(p).alias("mean_prob")]
    if approximate:
        return calls.groupBy(*keys).agg(*counts, F.percentile_approx(p, 0.5, 10_000).alias("median_prob"))
    # one row a group on both sides
    found, middle = calls.groupBy(*keys).agg(*counts), exact_medians(calls, keys, p).toDF("_s", "_m", "median_prob")
    return found.join(middle, found["sample"].eqNullSafe(middle["_s"]) & found["mod_type"].eqNullSafe(middle["_m"]), "left").drop("_s", "_m")


#: Sizes of the stored sketches: distinct counts within about 1 %, ranks of quantiles within about 0.7 %.
HLL_BITS, KLL_SIZE = 14, 400


def summary_states(calls: DataFrame) -> DataFrame:
    """Mergeable state of each sample and type: calls, the sum of p, sketches of reads and of sites, and one of p."""
    p = clean_probability(F.col("probability"))
    # a sketch takes a binary form of any key
    read, site = F.col("read_id").cast("string"), F.concat_ws("\t", "reference_name", F.col("ref_pos").cast("string"))
    return calls.groupBy("sample", "mod_type").agg(
        F.count("*").alias("calls"), F.sum(p).alias("prob_sum"), F.hll_sketch_agg(read, HLL_BITS).alias("reads"), F.hll_sketch_agg(site, HLL_BITS).alias("sites"), F.kll_sketch_agg_double(p, KLL_SIZE).alias("probs")
    )


def merged_summary(states: DataFrame) -> DataFrame:
    """States of the same sample and type as one, however many there are."""
    return states.groupBy("sample", "mod_type").agg(
        F.sum("calls").alias("calls"), F.sum("prob_sum").alias("prob_sum"), F.hll_union_agg("reads").alias("reads"), F.hll_union_agg("sites").alias("sites"), F.kll_merge_agg_double("probs", KLL_SIZE).alias("probs")
    )


def finalize_summary(states: DataFrame) -> DataFrame:
    """Calls and mean exactly; distinct reads and sites and the quartiles of p by the sketches."""
    quantile = lambda q: F.kll_sketch_get_quantile_double("probs", F.lit(q))
    return states.select(
        "sample", "mod_type", "calls", (F.col("prob_sum") / F.col("calls")).alias("mean_prob"), F.hll_sketch_estimate("reads").alias("unique_reads"), F.hll_sketch_estimate("sites").alias("unique_sites"),
        quantile(0.25).alias("q1_prob"), quantile(0.5).alias("median_prob"), quantile(0.75).alias("q3_prob"),
    )


def normalize_columns(calls: DataFrame) -> DataFrame:
    """Positional names for chunks without a header: eight columns, the first of which is named by a number."""
    names = ["sample", "read_id", *SITE[:2], "mod_type", "mod_code", "probability", "strand"]
    if not calls.columns or not calls.columns[0].isdigit():
        return calls
    if len(calls.columns) < 8:
        raise ValueError("a chunk of calls has eight columns")
    return calls.select(*calls.columns[:8]).toDF(*names)
