"""Gene-set enrichment by the upper-tail Fisher test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.stats import bh_fdr, fisher_greater, odds_ratio


def distinct_genes(rows: DataFrame, gene: str = "gene_name") -> DataFrame:
    return rows.where(F.col(gene).isNotNull()).select(F.upper(F.col(gene).cast("string")).alias("gene")).distinct()


def significant_genes(results: DataFrame, gene: str = "gene_name") -> DataFrame:
    return distinct_genes(results.where("is_significant"), gene)


def top_genes(results: DataFrame, n: int = 100, gene: str = "gene_name") -> DataFrame:
    """Genes of the n rows of largest change: what is used where no site is significant."""
    tie = [c for c in ("reference_name", "ref_pos", "mod_type", "strand") if c in results.columns]
    return distinct_genes(results.orderBy(F.desc("abs_delta_stoichiometry"), *tie).limit(n), gene)


def enrich(significant: DataFrame, background: DataFrame, sets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row for each set with a gene in the background.

    ``significant`` and ``background`` have distinct upper-case gene, ``sets`` (pathway, gene). The
    set table is a parameter; its genes are grouped after a join by gene, and only counts are wide.
    """
    n_sig = significant.agg(F.count("*").alias("n_sig"))
    n_all = background.agg(F.count("*").alias("n_all"))
    members = sets.select("pathway", F.upper("gene").alias("gene")).distinct().join(background, "gene")
    marked = members.join(significant.withColumn("_sig", F.lit(True)), "gene", "left")
    hit = F.col("_sig").isNotNull()
    counts = marked.groupBy("pathway").agg(F.count("*").alias("pathway_size"), F.count_if(hit).alias("overlap_count"), F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("gene")))), "; ").alias("overlap_genes"))
    # two one-row tables of totals
    rows = counts.join(F.broadcast(n_sig)).join(F.broadcast(n_all))
    a, b = F.col("overlap_count"), F.col("n_sig") - F.col("overlap_count")
    c, d = F.col("pathway_size") - F.col("overlap_count"), F.col("n_all") - F.col("n_sig") - F.col("pathway_size") + F.col("overlap_count")
    expected = F.col("n_sig") * F.col("pathway_size") / F.greatest("n_all", F.lit(1))
    fold = (a / F.greatest("n_sig", F.lit(1))) / (F.col("pathway_size") / F.greatest("n_all", F.lit(1)))
    tested = rows.withColumns({"expected": expected, "fold_enrichment": fold, "odds_ratio": odds_ratio(a, b, c, d), "pvalue": F.coalesce(fisher_greater(a, b, c, d), F.lit(1.0)), "_family": F.lit(0)})
    return bh_fdr(tested, ["_family"]).drop("_family", "n_sig", "n_all").withColumn("significant", F.col("fdr") <= alpha)


def enrich_libraries(significant: DataFrame, background: DataFrame, libraries: dict[str, DataFrame], alpha: float = 0.05) -> DataFrame:
    """``enrich`` for each of several gene-set libraries, a family of tests each; libraries are few and named by the caller."""
    parts = [enrich(significant, background, sets, alpha).withColumn("library", F.lit(name)) for name, sets in libraries.items()]
    return reduce(DataFrame.unionByName, parts)
