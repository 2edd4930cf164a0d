"""Genomic interval joins as equi-joins on position bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bins of one level are so many times as long as those of the level below.
GROWTH = 8


def overlap_join(sites: DataFrame, intervals: DataFrame, keys: list[str], pos: str = "ref_pos", start: str = "start", end: str = "end", bin_size: int = 10_000) -> DataFrame:
    """Every pair of a site [pos, pos+1) and a half-open interval that holds it, within equal ``keys``.

    Bins come in levels, each ``GROWTH`` times as long as those below. An interval stands at the first level whose
    bins are as long as itself, so in one bin there or, across a border, in two, whatever its length; a site looks
    into one bin of each level that intervals stand at. That makes an equi-join on (keys, level, bin) that hashes,
    sorts and splits skew like any other, and a pair meets in exactly one bin. Null positions and empty intervals
    match nothing.
    """
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log(length / F.lit(float(bin_size))) / math.log(GROWTH))).cast("int")
    leveled = intervals.where(F.col(start) < F.col(end)).withColumn("_level", level)
    # at most a dozen: they grow with the logarithm of the longest interval
    levels = sorted(r["_level"] for r in leveled.select("_level").distinct().collect())
    size = F.lit(bin_size) * F.pow(F.lit(float(GROWTH)), F.col("_level"))
    binned = leveled.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))))
    points = sites.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", F.floor(F.col(pos) / size))
    return points.join(binned, [*keys, "_level", "_bin"]).where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_level", "_bin")


def assign_gene(sites: DataFrame, genes: DataFrame, site_key: list[str], bin_size: int = 10_000) -> DataFrame:
    """Each site with the shortest gene that holds it, whatever its strand; ties go to the smaller start, then id.

    ``sites`` has chrom and ref_pos, ``genes`` chrom, start, end, gene_id, gene_name, gene_biotype.
    Unmatched sites get the reference name, ``unknown``, null length and relative position 0.5.
    """
    own = genes.select("chrom", "start", "end", "gene_id", "gene_name", "gene_biotype")
    hits = overlap_join(sites.select(*dict.fromkeys([*site_key, "chrom", "ref_pos"])), own, ["chrom"], bin_size=bin_size)
    length = F.col("end") - F.col("start")
    best = F.min(F.struct(length.alias("gene_length"), F.col("start").alias("gene_start"), "gene_id", "gene_name", "gene_biotype")).alias("_gene")
    chosen = hits.groupBy(*site_key).agg(best)
    g = F.col("_gene")
    return sites.join(chosen, site_key, "left").select(
        *sites.columns,
        g["gene_id"].alias("gene_id"),
        F.coalesce(g["gene_name"], F.col("chrom")).alias("gene_name"),
        F.coalesce(g["gene_biotype"], F.lit("unknown")).alias("gene_biotype"),
        g["gene_length"].alias("gene_length"),
        F.when(g["gene_length"] > 0, (F.col("ref_pos") - g["gene_start"]) / g["gene_length"]).otherwise(0.5).alias("relative_position"),
    )


def region_of_position(relative):
    """Third of a gene by relative position, strand ignored; ``nan`` outside [0, 1]."""
    return F.when(relative.between(0, 0.15), "5UTR").when((relative > 0.15) & (relative <= 0.85), "CDS").when((relative > 0.85) & (relative <= 1), "3UTR").otherwise("nan")


def without_annotation(sites: DataFrame) -> DataFrame:
    """The columns of ``assign_gene`` where there is no annotation."""
    return sites.withColumns({"gene_name": F.col("reference_name"), "gene_biotype": F.lit("unknown"), "gene_length": F.lit(None).cast("long"), "relative_position": F.lit(0.5), "transcript_region": F.lit("unknown")})


def pathway_annotation(rows: DataFrame, labels: DataFrame, gene: str = "gene_name") -> DataFrame:
    """The pathway label of a gene name in any case, else ``other``. The label table has fixed content and is broadcast."""
    keyed = F.broadcast(labels.select(F.col("gene").alias("_gene"), F.col("label").alias("pathway_annotation")))
    return rows.join(keyed, F.upper(gene) == F.col("_gene"), "left").drop("_gene").withColumn("pathway_annotation", F.coalesce("pathway_annotation", F.lit("other")))
