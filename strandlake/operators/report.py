"""The tables behind reports and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.differential import FAMILY
from strandlake.operators.sites import SITE

#: Ties in every sorted report go by comparison and site.
ORDER = [*FAMILY[:2], *SITE]


def significant_sites(results: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """Significant sites by fdr; ``n`` and ``offset`` give one page."""
    rows = results.where("is_significant").orderBy("fdr", "pvalue", *ORDER)
    return rows if n is None else rows.offset(offset).limit(n)


#: The columns of the report's page of significant sites, and the names that they have there.
PAGE = {"gene_name": "Gene", "reference_name": "Chr", "ref_pos": "Position", "region": "Region", "metatranscript_pos": "Meta Pos", "delta_stoichiometry": "Δ Stoich", "fdr": "FDR", "direction": "Direction"}


def region_page(results: DataFrame, n: int = 30, digits: int = 4) -> DataFrame:
    """The first ``n`` significant sites with their transcript region, by fdr, in display form; absent columns are left out."""
    first = significant_sites(results, n)
    shown = lambda c: F.coalesce(F.format_number(c, digits), F.lit("—")) if dict(first.dtypes)[c] in ("double", "float") else F.col(c)
    return first.select(*[shown(c).alias(name) for c, name in PAGE.items() if c in first.columns])


def table_page(results: DataFrame, n: int = 200) -> DataFrame:
    """The rows of a table's first page on the dashboard; the whole table goes to CSV by the sink."""
    return significant_sites(results, n)


def largest_changes(results: DataFrame, n: int = 100) -> DataFrame:
    return results.orderBy(F.desc("abs_delta_stoichiometry"), *ORDER).limit(n)


def stoichiometry_summary(sites: DataFrame) -> DataFrame:
    """By sample and type: sites, references, mean and median fraction and coverage."""
    return sites.groupBy("sample", "mod_type").agg(
        F.count("*").alias("n_sites"), F.avg("stoichiometry").alias("mean_stoichiometry"), F.median("stoichiometry").alias("median_stoichiometry"), F.median("total_reads").alias("median_coverage"), F.avg("total_reads").alias("mean_coverage"), F.count_distinct("reference_name").alias("n_references")
    )


def overall_summary(sites: DataFrame) -> DataFrame:
    return sites.agg(F.count("*").alias("total_sites"), F.count_distinct("reference_name").alias("unique_transcripts"), F.bround(F.avg("stoichiometry"), 4).alias("mean_stoichiometry"), F.bround(F.median("total_reads"), 1).alias("median_coverage"))


def by_modification(sites: DataFrame) -> DataFrame:
    return sites.groupBy("mod_type").agg(F.count("*").alias("n_sites"), F.avg("stoichiometry").alias("mean_stoichiometry"), F.median("total_reads").alias("median_coverage"))


def overview(results: DataFrame) -> DataFrame:
    """Sites tested, significant, and by direction."""
    return results.agg(F.count("*").alias("total_sites"), F.count_if("is_significant").alias("significant_sites"), F.count_if(F.col("direction") == "increased").alias("increased"), F.count_if(F.col("direction") == "decreased").alias("decreased"))


def value_counts(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if n is None else counts.limit(n)


def dashboard_filter(results: DataFrame, mod_types: list[str] | None = None, directions: list[str] | None = None, only_significant: bool = False, regions: list[str] | None = None) -> DataFrame:
    """Rows that pass every filter that is set."""
    tests = [F.col(c).isin(*v) for c, v in (("mod_type", mod_types), ("direction", directions), ("region", regions)) if v is not None]
    if only_significant:
        tests.append(F.col("is_significant"))
    return results.where(reduce(lambda a, b: a & b, tests)) if tests else results


def pathway_table(enriched: DataFrame) -> DataFrame:
    """Display form of the enrichment: by p, counts as overlap/size, formatted numbers."""
    return enriched.orderBy("pvalue", "pathway").select(
        "pathway", F.concat_ws("/", F.col("overlap_count").cast("string"), F.col("pathway_size").cast("string")).alias("overlap"), F.format_number("fold_enrichment", 2).alias("fold"), F.format_number("pvalue", 4).alias("p"), F.format_number("fdr", 4).alias("fdr"), F.when(F.col("significant"), "YES").otherwise("no").alias("significant")
    )


def highlight(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    return rows.withColumn("highlight", F.coalesce(F.col(column) < threshold, F.lit(False)))


def result_counts(tables: dict[str, DataFrame | None], schema: str = "result string, status string, n_rows long") -> DataFrame:
    """Rows of each result, or that it is empty or not found. Results are few and named by the caller."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    parts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("result"), F.when(F.col("n_rows") > 0, "loaded").otherwise("empty").alias("status"), "n_rows") if t is not None else spark.createDataFrame([(name, "not found", 0)], schema) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def chat_context(tables: dict[str, DataFrame], n: int = 10, most: int = 3000) -> str:
    """The first rows of each result as text for an assistant, cut to ``most`` characters."""
    lines = [f"{name}:\n" + "\n".join(str(r.asDict()) for r in t.limit(n).collect()) for name, t in tables.items()]
    return "\n\n".join(lines)[:most]
