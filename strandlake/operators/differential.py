"""Two conditions compared site by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import minus_log10
from strandlake.functions.stats import bh_fdr, fisher_two_sided, logit_coefficient, odds_ratio
from strandlake.operators.sites import SITE

VALUES = ["total_reads", "modified_reads", "stoichiometry", "mean_probability", "median_probability"]
FAMILY = ["control", "treatment", "mod_type"]
#: The false discovery rate and the least change of a significant site, and the rate of ``significant_bh``.
FDR, MIN_DELTA, BH_ALPHA = 0.05, 0.10, 0.05
#: Fixed value: a family of fewer sites is not tested.
MIN_SITES = 2


def merge_conditions(sites: DataFrame, comparisons: list[tuple[str, str]]) -> DataFrame:
    """Sites of both samples of each comparison, side by side.

    All sites are grouped once with one conditional value per side, so a comparison needs no join and
    no second shuffle. Comparisons are a short list from the configuration.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("control"), F.lit(t).alias("treatment")) for c, t in comparisons])
    sided = sites.select("*", F.explode(F.filter(pairs, lambda p: (p["control"] == F.col("sample")) | (p["treatment"] == F.col("sample")))).alias("_pair"))
    rows = sided.select("*", "_pair.control", "_pair.treatment")
    side = {"ctrl": F.col("sample") == F.col("control"), "treat": F.col("sample") == F.col("treatment")}
    values = [F.max(F.when(on, F.col(v))).alias(f"{v}_{s}") for s, on in side.items() for v in VALUES]
    both = rows.groupBy("control", "treatment", *SITE).agg(*values)
    merged = both.where(F.col("total_reads_ctrl").isNotNull() & F.col("total_reads_treat").isNotNull())
    delta = F.col("stoichiometry_treat") - F.col("stoichiometry_ctrl")
    return merged.withColumns({"delta_stoichiometry": delta, "abs_delta_stoichiometry": F.abs(delta)})


def cells() -> tuple[Column, Column, Column, Column]:
    """Modified and unmodified reads of control and treatment."""
    return F.col("modified_reads_ctrl"), F.col("total_reads_ctrl") - F.col("modified_reads_ctrl"), F.col("modified_reads_treat"), F.col("total_reads_treat") - F.col("modified_reads_treat")


def run_tests(merged: DataFrame, method: str = "fisher") -> DataFrame:
    """test_statistic and pvalue of every site: odds ratio (control over treatment) or logit slope (treatment against control).

    The test runs once for each distinct table of counts.
    """
    if method not in ("fisher", "logistic"):
        raise ValueError(f"no such test: {method}")
    keys = ["modified_reads_ctrl", "total_reads_ctrl", "modified_reads_treat", "total_reads_treat"]
    mc, uc, mt, ut = cells()
    statistic, p = (odds_ratio(mc, uc, mt, ut), fisher_two_sided(mc, uc, mt, ut)) if method == "fisher" else logit_coefficient(mc, uc, mt, ut)
    tables = merged.select(*keys).distinct().withColumns({"test_statistic": statistic, "pvalue": F.coalesce(p, F.lit(1.0))})
    return merged.join(tables, keys)


def classify(tested: DataFrame, fdr: float = FDR, min_delta: float = MIN_DELTA) -> DataFrame:
    """fdr by family, and what it makes of each site; families of one site are left out."""
    significant = (F.col("fdr") < fdr) & (F.col("abs_delta_stoichiometry") >= min_delta)
    direction = F.when(significant & (F.col("delta_stoichiometry") > 0), "increased").when(significant & (F.col("delta_stoichiometry") < 0), "decreased").otherwise("unchanged")
    return bh_fdr(tested, FAMILY, least=MIN_SITES).withColumns({"significant_bh": F.col("fdr") <= BH_ALPHA, "is_significant": significant, "direction": direction})


def differential(sites: DataFrame, comparisons: list[tuple[str, str]], method: str = "fisher", fdr: float = FDR, min_delta: float = MIN_DELTA) -> DataFrame:
    return classify(run_tests(merge_conditions(sites, comparisons), method), fdr, min_delta)


def volcano(results: DataFrame) -> DataFrame:
    logs = {"neg_log10_pvalue": minus_log10(F.col("pvalue")), "neg_log10_fdr": minus_log10(F.col("fdr"))}
    return results.withColumns(logs).select("control", "treatment", "reference_name", "ref_pos", "mod_type", "strand", "delta_stoichiometry", "pvalue", "fdr", "is_significant", "direction", *logs)
