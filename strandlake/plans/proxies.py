"""The driver's tables in the shapes that the operators take, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import table

CALLS_SQL = """
    select l_linestatus as sample, l_orderkey as read_id, concat('S', l_suppkey) as reference_name, l_partkey % 4 as ref_pos,
           l_returnflag as mod_type, case when l_linenumber % 2 = 0 then '+' else '-' end as strand, l_discount * 10 as probability
    from lineitem
"""
GENES_SQL = """
    select concat('chr', p_partkey % 5) as chrom, p_partkey as gstart, p_partkey + p_size as gend, p_partkey as gene_id, p_name as gene_name, p_brand as gene_biotype
    from part
"""
SITES_SQL = "select distinct concat('chr', l_suppkey % 5) as chrom, l_partkey as ref_pos, case when l_suppkey % 2 = 0 then '+' else '-' end as strand from lineitem"


def calls_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_linestatus").alias("sample"),
        F.col("l_orderkey").alias("read_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("reference_name"),
        (F.col("l_partkey") % 4).alias("ref_pos"),
        F.col("l_returnflag").alias("mod_type"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("l_discount") * 10).alias("probability"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "lineitem"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrom"), key.alias("start"), (key + F.col("p_size")).alias("end"), key.alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_brand").alias("gene_biotype"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sites on chromosomes."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), F.col("l_partkey").alias("ref_pos"), F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    return lines.distinct()


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a transcript of 60 bases with two coding parts between the untranslated ends; spans overlap."""
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    minus = key % 2 == 1
    first, last = F.when(minus, "three_prime_utr").otherwise("five_prime_utr"), F.when(minus, "five_prime_utr").otherwise("three_prime_utr")
    rows = [(F.lit("transcript"), 0, 60), (first, 0, 10), (F.lit("CDS"), 10, 20), (F.lit("CDS"), 30, 45), (last, 50, 60)]
    features = F.array(*[F.struct(f.alias("feature"), (key + a).alias("start"), (key + b).alias("end")) for f, a, b in rows])
    return parts.select(
        F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrom"), F.when(minus, "-").otherwise("+").alias("strand"), F.concat(F.lit("T"), key.cast("string")).alias("transcript_id"), F.col("p_name").alias("gene_name"), F.explode(features).alias("_f")
    ).select("chrom", "_f.start", "_f.end", "strand", "_f.feature", "transcript_id", "gene_name")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places and all integers as long, for comparison across engines."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # adding 0.0 turns -0.0 into 0.0
            out[f.name] = F.round(F.col(f.name).cast("double"), places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out)
