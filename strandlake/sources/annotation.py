"""GTF annotations and gene-set files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import gtf_attribute
from strandlake.sources.fasta import read_fasta

__all__ = ["MODEL_FEATURES", "genes", "parse_gtf", "read_fasta", "read_gmt", "read_gtf", "transcript_features"]

MODEL_FEATURES = ["five_prime_utr", "three_prime_utr", "UTR", "CDS", "transcript"]


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Features from GTF lines (``value``): 0-based half-open; comments and lines of fewer than nine fields go."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 9)
    col = lambda i: F.get("f", F.lit(i))
    return rows.select(
        col(0).alias("chrom"), (col(3).try_cast("long") - 1).alias("start"), col(4).try_cast("long").alias("end"), col(6).alias("strand"), col(2).alias("feature"), *[gtf_attribute(col(8), a).alias(a) for a in ("transcript_id", "gene_id", "gene_name", "gene_type", "gene_biotype")]
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def transcript_features(gtf: DataFrame) -> DataFrame:
    return gtf.where(F.col("feature").isin(*MODEL_FEATURES)).select("chrom", "start", "end", "strand", "feature", "transcript_id", F.coalesce("gene_name", F.lit("")).alias("gene_name"))


def genes(gtf: DataFrame) -> DataFrame:
    return gtf.where("feature = 'gene'").select("chrom", "start", "end", "strand", F.coalesce("gene_id", "gene_name").alias("gene_id"), F.coalesce("gene_name", "gene_id").alias("gene_name"), F.coalesce("gene_type", "gene_biotype", F.lit("unknown")).alias("gene_biotype"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, gene) from a GMT file: name, description, genes."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("pathway"), F.explode(F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0)))).alias("gene")).where("gene != ''").distinct()
