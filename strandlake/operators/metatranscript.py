"""Sites on the common 5'UTR - CDS - 3'UTR coordinate of their transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.intervals import overlap_join

REGIONS = ["5UTR", "CDS", "3UTR", "intergenic"]
#: Feature names of annotations and the region they make; order of precedence.
FEATURES = {"five_prime_utr": ("5UTR", 0), "CDS": ("CDS", 1), "three_prime_utr": ("3UTR", 2)}


def split_utr(features: DataFrame) -> DataFrame:
    """Features named ``UTR`` as five or three prime, by the coding span and strand of their transcript.

    Here and below joins are merged by hint: by the size of its file, which counts no exploded row, Spark would
    broadcast an annotation that the driver can't hold.
    """
    span = features.where("feature = 'CDS'").groupBy("transcript_id").agg(F.min("start").alias("_low"), F.max("end").alias("_high"))
    before = F.col("end") <= F.col("_low")
    named = F.when(F.col("feature") != "UTR", F.col("feature")).when(before == (F.col("strand") == "+"), "five_prime_utr").otherwise("three_prime_utr")
    return features.join(span.hint("merge"), "transcript_id", "left").withColumn("feature", named).drop("_low", "_high")


def region_table(features: DataFrame) -> DataFrame:
    """Regions of the transcripts with the bases of the same kind before them and in all, from the transcript's 5' end.

    Regions without a transcript row are left out. Repeated transcript rows count once, the last in
    (start, end, gene) order.
    """
    kind = F.create_map(*[F.lit(x) for f, (r, _) in FEATURES.items() for x in (f, r)])
    tx = features.where("feature = 'transcript'").groupBy("transcript_id").agg(F.max(F.struct("start", "end", "gene_name")).alias("_t"))
    tx = tx.select("transcript_id", F.col("_t.start").alias("tx_start"), F.col("_t.end").alias("tx_end"), F.col("_t.gene_name").alias("gene_name"))
    parts = features.where(F.col("feature").isin(*FEATURES)).select("transcript_id", "chrom", "strand", "start", "end", F.try_element_at(kind, F.col("feature")).alias("region"))
    size = F.col("end") - F.col("start")
    minus = F.col("strand") == "-"
    own = Window.partitionBy("transcript_id", "region")
    ordered = own.orderBy(F.when(minus, -F.col("start")).otherwise(F.col("start")), F.when(minus, -F.col("end")).otherwise(F.col("end"))).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns({"bases_before": F.coalesce(F.sum(size).over(ordered), F.lit(0)), "region_length": F.sum(size).over(own)})
    return summed.join(tx.hint("merge"), "transcript_id")


def annotate(sites: DataFrame, features: DataFrame, site_key: list[str], bin_size: int = 10_000) -> DataFrame:
    """``sites`` (chrom, ref_pos, strand) with metatranscript_pos, region, gene_name and transcript_id.

    A site takes the transcript of its strand that starts last (then ends last, then by id) among
    those where it lies in a region; elsewhere it is intergenic.
    """
    regions = region_table(split_utr(features)).hint("merge")
    hits = overlap_join(sites.select(*dict.fromkeys([*site_key, "chrom", "ref_pos", "strand"])), regions, ["chrom", "strand"], bin_size=bin_size)
    hits = hits.where("ref_pos >= tx_start and ref_pos < tx_end")
    rank = F.create_map(*[F.lit(x) for r, n in FEATURES.values() for x in (r, n)])
    offset = F.col("bases_before") + F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("ref_pos")).otherwise(F.col("ref_pos") - F.col("start"))
    place = rank[F.col("region")] + offset / F.col("region_length")
    # one partial aggregate picks the transcript: the largest by start, end and id, and in it the first region
    best = hits.groupBy(*site_key).agg(F.max(F.struct("tx_start", "tx_end", "transcript_id", (-rank[F.col("region")]).alias("_rank"), (-F.col("start")).alias("_s"), place.alias("metatranscript_pos"), "region", "gene_name")).alias("_best"))
    b = F.col("_best")
    return sites.join(best.hint("merge"), site_key, "left").select(
        *sites.columns, b["metatranscript_pos"].alias("metatranscript_pos"), F.coalesce(b["region"], F.lit("intergenic")).alias("region"), F.coalesce(b["gene_name"], F.lit("")).alias("gene_name"), F.coalesce(b["transcript_id"], F.lit("")).alias("transcript_id")
    )


def summary(annotated: DataFrame) -> DataFrame:
    """Counts of every type in every region, zeros included."""
    regions = F.array(*map(F.lit, REGIONS))
    dense = annotated.select("mod_type").where("mod_type is not null").distinct().withColumn("region", F.explode(regions))
    counted = annotated.groupBy("mod_type", "region").agg(
        F.count("*").alias("total_sites"), F.count_if("is_significant").alias("significant"), F.count_if(F.col("is_significant") & (F.col("direction") == "increased")).alias("increased"), F.count_if(F.col("is_significant") & (F.col("direction") == "decreased")).alias("decreased")
    )
    return dense.join(counted, ["mod_type", "region"], "left").na.fill(0)


def direction_counts(annotated: DataFrame) -> DataFrame:
    """Sites of each region by direction, one column a direction."""
    return annotated.groupBy("region").pivot("direction", ["increased", "decreased", "unchanged"]).count().na.fill(0)


def region_shares(annotated: DataFrame) -> DataFrame:
    """Percent of annotated sites in each region, of all and of the significant ones."""
    real = annotated.where(F.col("region").isin(*REGIONS[:3]))
    counted = real.groupBy("region").agg(F.count("*").alias("n_all"), F.count_if("is_significant").alias("n_sig"))
    total = Window.partitionBy(F.lit(0))
    share = lambda c: 100.0 * F.col(c) / F.greatest(F.sum(c).over(total), F.lit(1))
    return counted.withColumns({"pct_all": share("n_all"), "pct_sig": share("n_sig")})
