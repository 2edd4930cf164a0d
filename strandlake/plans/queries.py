"""Registered queries of the modification analytics, each with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import genesets, mm, sequence
from strandlake.operators import differential as diff
from strandlake.operators import enrichment, features, intervals, metatranscript, metrics, ml, report, sites
from strandlake.plans import proxies
from strandlake.plans.proxies import CALLS_SQL, GENES_SQL, SITES_SQL, rounded
from strandlake.session import cut, shared_folder, table
from strandlake.sources import alignments, annotation, bam, fasta
from strandlake.sources import results as results_tables
from strandlake.streaming import sites as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, results rounded, with its SQL if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL shared by several statements -----------------------------------------------------------

KEYS = "reference_name, ref_pos, mod_type, strand"
COUNTS_SQL = f"""
    select sample, {KEYS}, count(*) as total_count, count(case when probability >= 191::double / 255 then 1 end) as modified_count,
           sum(probability) as prob_sum, sum(probability * probability) as prob_sq_sum
    from ({CALLS_SQL}) group by sample, {KEYS}
"""
STOICH_SQL = f"""
    select sample, {KEYS}, total_count as total_reads, modified_count as modified_reads, modified_count::double / total_count as stoichiometry,
           prob_sum / total_count as mean_probability, prob_sum / total_count as median_probability,
           sqrt(greatest(0, prob_sq_sum / total_count - (prob_sum / total_count) * (prob_sum / total_count))) as std_probability
    from ({COUNTS_SQL}) where total_count >= 10
"""
MERGED_SQL = f"""
    select 'F' as control, 'O' as treatment, c.reference_name, c.ref_pos, c.mod_type, c.strand,
           c.total_reads as total_reads_ctrl, c.modified_reads as modified_reads_ctrl, c.stoichiometry as stoichiometry_ctrl, c.mean_probability as mean_probability_ctrl, c.median_probability as median_probability_ctrl,
           t.total_reads as total_reads_treat, t.modified_reads as modified_reads_treat, t.stoichiometry as stoichiometry_treat, t.mean_probability as mean_probability_treat, t.median_probability as median_probability_treat,
           t.stoichiometry - c.stoichiometry as delta_stoichiometry, abs(t.stoichiometry - c.stoichiometry) as abs_delta_stoichiometry
    from ({STOICH_SQL}) c join ({STOICH_SQL}) t
      on c.sample = 'F' and t.sample = 'O' and c.reference_name = t.reference_name and c.ref_pos = t.ref_pos and c.mod_type = t.mod_type and c.strand = t.strand
"""


def fisher_sql(tables: str, greater: bool = False) -> str:
    """(a, b, c, d, p) of distinct tables of the statement ``tables``."""
    lf = lambda x: f"lgamma(({x})::double + 1)"
    lp = lambda k: f"({lf('a+b')} + {lf('c+d')} + {lf('a+c')} + {lf('b+d')} - {lf('a+b+c+d')} - {lf(k)} - {lf(f'a+b-{k}')} - {lf(f'a+c-{k}')} - {lf(f'd-a+{k}')})"
    keep = "k >= a" if greater else f"{lp('k')} <= {lp('a')} + 1e-7"
    return f"""
        select a, b, c, d, least(1.0, sum(case when {keep} then exp({lp('k')}) else 0 end)) as p
        from (select distinct a, b, c, d, unnest(generate_series(greatest(0, a - d), least(a + b, a + c))) as k from ({tables}))
        group by a, b, c, d
    """


CELLS_SQL = "select modified_reads_ctrl as a, total_reads_ctrl - modified_reads_ctrl as b, modified_reads_treat as c, total_reads_treat - modified_reads_treat as d from m"
ODDS_SQL = "case when a + b = 0 or c + d = 0 or a + c = 0 or b + d = 0 then null when b * c = 0 then 'Infinity'::double else a::double * d / (b::double * c) end"


def diff_sql(fdr: float = 0.05, delta: float = 0.10) -> str:
    return f"""
        with m as materialized ({MERGED_SQL}), f as ({fisher_sql(CELLS_SQL)}),
        tested as (
            select m.*, {ODDS_SQL} as test_statistic, f.p as pvalue
            from m join f on a = modified_reads_ctrl and b = total_reads_ctrl - modified_reads_ctrl and c = modified_reads_treat and d = total_reads_treat - modified_reads_treat
        ),
        ranked as (select *, rank() over (partition by mod_type order by pvalue) + count(*) over (partition by mod_type, pvalue) - 1 as rk, count(*) over (partition by mod_type) as n from tested),
        adjusted as (select *, least(1.0, min(pvalue * n / rk) over (partition by mod_type order by pvalue desc)) as fdr from ranked),
        results as (
            select * exclude (rk, n), fdr <= 0.05 as significant_bh, fdr < {fdr} and abs_delta_stoichiometry >= {delta} as is_significant,
                   case when fdr < {fdr} and abs_delta_stoichiometry >= {delta} and delta_stoichiometry > 0 then 'increased'
                        when fdr < {fdr} and abs_delta_stoichiometry >= {delta} and delta_stoichiometry < 0 then 'decreased' else 'unchanged' end as direction
            from adjusted where n >= 2
        )
    """


#: In random data nothing passes 0.05; reports are tried at a looser rate.
LOOSE = 1.01
R6 = lambda *names: ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


def stoich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.stoichiometry(proxies.calls(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str, fdr: float = 0.05) -> DataFrame:
    return diff.differential(stoich(spark, sf_dir), [("F", "O")], fdr=fdr)


# --- sites --------------------------------------------------------------------------------------


@query(f"select sample, {KEYS}, total_count, modified_count, {R6('prob_sum', 'prob_sq_sum')} from ({COUNTS_SQL})")
def site_counts(spark, sf_dir):
    return sites.site_counts(proxies.calls(spark, sf_dir))


@query(f"select sample, {KEYS}, total_count, modified_count, {R6('prob_sum', 'prob_sq_sum')} from ({COUNTS_SQL})")
def site_counts_merged(spark, sf_dir):
    """States of two halves of the calls, merged."""
    calls = proxies.calls(spark, sf_dir)
    half = F.col("read_id") % 2 == 0
    return sites.merge_counts(sites.site_counts(calls.where(half)), sites.site_counts(calls.where(~half)))


@query(f"select sample, {KEYS}, total_count, modified_count, {R6('prob_sum', 'prob_sq_sum')} from ({COUNTS_SQL})")
def site_counts_streaming(spark, sf_dir):
    """The same states by Structured Streaming over files of calls, two files a batch."""
    out = cut(table(spark, sf_dir, "lineitem").repartition(4))
    folder = shared_folder(spark).rstrip("/") + "/" + out.inputFiles()[0].split("/")[-2]
    return streaming.counts_of_files(spark, folder, out.schema, proxies.calls_of, f"{folder}-counts", f"{folder}-progress", 2)


@query(f"""select sample, mod_type, count(*) as calls, round(avg(probability), 6) as mean_prob, true as reads_near, true as sites_near, true as quartiles_near from ({CALLS_SQL}) group by sample, mod_type""")
def summary_streaming(spark, sf_dir):
    """Summaries from sketches that a stream stored, two files a batch: distinct counts within 4 % of the exact ones, quartiles within 2 % of ranks."""
    out = cut(table(spark, sf_dir, "lineitem").repartition(4))
    folder = shared_folder(spark).rstrip("/") + "/" + out.inputFiles()[0].split("/")[-2]
    got = streaming.summary_of_files(spark, folder, out.schema, proxies.calls_of, f"{folder}-summary", f"{folder}-summary-progress", 2)
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.04 * F.col(y)
    exact = proxies.calls(spark, sf_dir).join(F.broadcast(got), ["sample", "mod_type"]).groupBy("sample", "mod_type", got["calls"], "mean_prob", "unique_reads", "unique_sites")
    shares = [(F.count_if(F.col("probability") < F.col(q)) <= (s + 0.02) * F.count("*")) & (F.count_if(F.col("probability") <= F.col(q)) >= (s - 0.02) * F.count("*")) for q, s in (("q1_prob", 0.25), ("median_prob", 0.5), ("q3_prob", 0.75))]
    counted = exact.agg(F.count_distinct("read_id").alias("_r"), F.count_distinct(F.struct("reference_name", "ref_pos")).alias("_s"), (shares[0] & shares[1] & shares[2]).alias("quartiles_near"))
    return counted.select("sample", "mod_type", "calls", "mean_prob", near("unique_reads", "_r").alias("reads_near"), near("unique_sites", "_s").alias("sites_near"), "quartiles_near")


@query(f"select sample, {KEYS}, total_reads, modified_reads, {R6('stoichiometry', 'mean_probability', 'median_probability', 'std_probability')} from ({STOICH_SQL})")
def stoichiometry(spark, sf_dir):
    return stoich(spark, sf_dir)


@query(f"select sample, {KEYS}, total_reads, modified_reads, {R6('stoichiometry', 'mean_probability', 'median_probability', 'std_probability')} from ({STOICH_SQL}) where mod_type in ('A', 'N')")
def stoichiometry_of_types(spark, sf_dir):
    return sites.stoichiometry(proxies.calls(spark, sf_dir), types=["A", "N"])


@query(f"""
    select sample, {KEYS}, count(distinct read_id) as total_reads, count(case when probability >= 191::double / 255 then 1 end) as modified_reads,
           round(avg(probability), 6) as mean_probability, round(median(probability), 6) as median_probability, round(stddev_samp(probability), 6) as std_probability,
           round(count(case when probability >= 191::double / 255 then 1 end)::double / count(distinct read_id), 6) as stoichiometry
    from ({CALLS_SQL}) group by sample, {KEYS} having count(distinct read_id) >= 10
""")
def stoichiometry_exact(spark, sf_dir):
    return sites.stoichiometry_exact(proxies.calls(spark, sf_dir))


@query(f"""
    select sample, count(*) as total_mod_calls, count(distinct read_id) as unique_reads, count(distinct (reference_name, ref_pos)) as unique_sites, count(distinct reference_name) as unique_transcripts
    from ({CALLS_SQL}) group by sample
""")
def extraction_summary(spark, sf_dir):
    return sites.extraction_summary(proxies.calls(spark, sf_dir))


@query(f"select sample, mod_type, count(*) as calls, round(avg(probability), 6) as mean_prob, round(median(probability), 6) as median_prob from ({CALLS_SQL}) group by sample, mod_type")
def modification_summary(spark, sf_dir):
    return sites.modification_summary(proxies.calls(spark, sf_dir))


@query("select count(*) as n, round(sum(case when isnan(p) then 0 else p end), 6) as total from (select coalesce(try_cast(case when l_linenumber = 1 then 'n/a' when l_linenumber = 2 then 'NaN' else l_discount::varchar end as double), 0) as p from lineitem)")
def probability_coercion(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") == 1, "n/a").when(F.col("l_linenumber") == 2, "NaN").otherwise(F.col("l_discount").cast("string"))
    return table(spark, sf_dir, "lineitem").select(sites.clean_probability(raw).alias("p")).agg(F.count("*").alias("n"), F.sum("p").alias("total"))


# --- differential -------------------------------------------------------------------------------

SIDES = [f"{v}_{s}" for v in ("stoichiometry", "mean_probability", "median_probability") for s in ("ctrl", "treat")]
MERGED_COLUMNS = f"control, treatment, {KEYS}, total_reads_ctrl, modified_reads_ctrl, total_reads_treat, modified_reads_treat, {R6(*SIDES, 'delta_stoichiometry', 'abs_delta_stoichiometry')}"


@query(f"select {MERGED_COLUMNS} from ({MERGED_SQL})")
def merged_conditions(spark, sf_dir):
    return diff.merge_conditions(stoich(spark, sf_dir), [("F", "O")])


@query(f"{diff_sql()} select {MERGED_COLUMNS}, {R6('test_statistic', 'pvalue', 'fdr')}, significant_bh, is_significant, direction from results")
def differential_sites(spark, sf_dir):
    """Flagship: stoichiometry of two conditions, exact tests, false discovery rates, classes."""
    return results(spark, sf_dir)


LOGIT_SQL = f"""
    with m as materialized ({MERGED_SQL}), t as (select {KEYS}, modified_reads_ctrl::double as mc, (total_reads_ctrl - modified_reads_ctrl)::double as uc, modified_reads_treat::double as mt, (total_reads_treat - modified_reads_treat)::double as ut from m),
    z as (select *, case when least(mc, uc, mt, ut) > 0 then ln(mt * uc / (ut * mc)) end as coef, case when least(mc, uc, mt, ut) > 0 then abs(ln(mt * uc / (ut * mc))) / sqrt(1/mc + 1/uc + 1/mt + 1/ut) / sqrt(2.0) end as x from t),
    e as (select *, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(90), lambda n: (case when n % 2 = 0 then 1 else -1 end) * exp((2 * n + 1) * ln(x) - lgamma(n + 1.0)) / (2 * n + 1))) as tail from z)
    select {KEYS}, round(coef, 6) + 0.0 as test_statistic, round(case when x is null or x = 0 then 1.0 when x > 4.5 then 0.0 else tail end, 6) + 0.0 as pvalue
    from e
"""


@query(LOGIT_SQL)
def logistic_tests(spark, sf_dir):
    merged = diff.merge_conditions(stoich(spark, sf_dir), [("F", "O")])
    return diff.run_tests(merged, "logistic").select("reference_name", "ref_pos", "mod_type", "strand", "test_statistic", "pvalue")


VOLCANO_SQL = f"round(-log10(greatest(pvalue, 1e-300)), 6) + 0.0 as neg_log10_pvalue, round(-log10(greatest(fdr, 1e-300)), 6) + 0.0 as neg_log10_fdr"


@query(f"{diff_sql()} select control, treatment, {KEYS}, {R6('delta_stoichiometry', 'pvalue', 'fdr')}, is_significant, direction, {VOLCANO_SQL} from results")
def volcano(spark, sf_dir):
    return diff.volcano(results(spark, sf_dir))


SITE_ROW = f"control, treatment, {KEYS}, {R6('delta_stoichiometry', 'pvalue', 'fdr')}, direction"
SITE_COLUMNS = ["control", "treatment", *sites.SITE, "delta_stoichiometry", "pvalue", "fdr", "direction"]
# ties of p in the last bits must not decide a page: both engines sort rounded values
PAGE_ORDER = f"round(fdr, 9), round(pvalue, 9), control, treatment, {KEYS}"


def page(df: DataFrame) -> DataFrame:
    return df.withColumns({"fdr": F.round("fdr", 9), "pvalue": F.round("pvalue", 9)})


@query(f"{diff_sql(LOOSE)} select {SITE_ROW} from results where is_significant")
def significant_sites(spark, sf_dir):
    return report.significant_sites(results(spark, sf_dir, LOOSE)).select(SITE_COLUMNS)


@query(f"{diff_sql(LOOSE)} select {SITE_ROW} from results where is_significant order by {PAGE_ORDER} limit 30")
def significant_top_30(spark, sf_dir):
    return report.significant_sites(page(results(spark, sf_dir, LOOSE)), 30).select(SITE_COLUMNS)


@query(f"{diff_sql(LOOSE)} select {SITE_ROW} from results where is_significant order by {PAGE_ORDER} limit 30 offset 30")
def significant_next_30(spark, sf_dir):
    return report.significant_sites(page(results(spark, sf_dir, LOOSE)), 30, 30).select(SITE_COLUMNS)


@query(f"{diff_sql(LOOSE)} select {SITE_ROW} from results where is_significant order by {PAGE_ORDER} limit 200")
def first_table_page(spark, sf_dir):
    return report.table_page(page(results(spark, sf_dir, LOOSE))).select(SITE_COLUMNS)


@query(f"{diff_sql()} select {SITE_ROW} from results order by round(abs_delta_stoichiometry, 9) desc, control, treatment, {KEYS} limit 100")
def largest_changes_100(spark, sf_dir):
    rounded_delta = results(spark, sf_dir).withColumn("abs_delta_stoichiometry", F.round("abs_delta_stoichiometry", 9))
    return report.largest_changes(rounded_delta, 100).select(SITE_COLUMNS)


@query(f"{diff_sql(LOOSE)} select {SITE_ROW} from results where mod_type in ('A', 'R') and direction in ('increased') and is_significant")
def dashboard_sites(spark, sf_dir):
    return report.dashboard_filter(results(spark, sf_dir, LOOSE), ["A", "R"], ["increased"], True).select(SITE_COLUMNS)


@query(f"{diff_sql(LOOSE)} select count(*) as total_sites, count(case when is_significant then 1 end) as significant_sites, count(case when direction = 'increased' then 1 end) as increased, count(case when direction = 'decreased' then 1 end) as decreased from results")
def overview(spark, sf_dir):
    return report.overview(results(spark, sf_dir, LOOSE))


@query(f"{diff_sql()} select {KEYS}, round(pvalue, 6) + 0.0 as pvalue, pvalue < 0.05 as highlight from results")
def highlighted_sites(spark, sf_dir):
    return report.highlight(results(spark, sf_dir), "pvalue", 0.05).select(*sites.SITE, "pvalue", "highlight")


@query("select distinct control, treatment from (select 'F' as control, 'O' as treatment from lineitem)")
def compared_pairs(spark, sf_dir):
    return diff.merge_conditions(stoich(spark, sf_dir), [("F", "O")]).select("control", "treatment").distinct()


# --- summaries ----------------------------------------------------------------------------------


@query(f"""
    select sample, mod_type, count(*) as n_sites, round(avg(stoichiometry), 6) as mean_stoichiometry, round(median(stoichiometry), 6) as median_stoichiometry,
           round(median(total_reads), 6) as median_coverage, round(avg(total_reads), 6) as mean_coverage, count(distinct reference_name) as n_references
    from ({STOICH_SQL}) group by sample, mod_type
""")
def stoichiometry_summary(spark, sf_dir):
    return report.stoichiometry_summary(stoich(spark, sf_dir))


@query(f"select count(*) as total_sites, count(distinct reference_name) as unique_transcripts, round(avg(stoichiometry), 4) as mean_stoichiometry, round(median(total_reads), 1) as median_coverage from ({STOICH_SQL})")
def overall_summary(spark, sf_dir):
    return report.overall_summary(stoich(spark, sf_dir))


@query(f"select mod_type, count(*) as n_sites, round(avg(stoichiometry), 6) as mean_stoichiometry, round(median(total_reads), 6) as median_coverage from ({STOICH_SQL}) group by mod_type")
def summary_by_modification(spark, sf_dir):
    return report.by_modification(stoich(spark, sf_dir))


@query(f"select reference_name, count(*) as n from ({STOICH_SQL}) group by reference_name order by n desc, reference_name limit 20")
def top_references(spark, sf_dir):
    return report.value_counts(stoich(spark, sf_dir), "reference_name", 20)


HISTOGRAM_SQL = """
    with x as ({rows}), r as (select min(v) as lo, max(v) as hi from x), b as (select least({bins} - 1, floor((v - lo) / ((hi - lo) / {bins}::double)))::bigint as bin, lo, hi from x, r)
    select bin, count(*) as n, round(count(*) / (sum(count(*)) over () * ((max(hi) - max(lo)) / {bins}::double)), 6) as density from b group by bin
"""


@query(HISTOGRAM_SQL.format(rows="select o_totalprice as v from orders", bins=50))
def price_histogram(spark, sf_dir):
    """The histogram operator on a continuous column."""
    return metrics.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 50)


@query(HISTOGRAM_SQL.format(rows=f"select least(total_reads, 20) as v from ({STOICH_SQL})", bins=5))
def coverage_histogram(spark, sf_dir):
    """Coverage with its tail clipped into the last bin."""
    return metrics.histogram(stoich(spark, sf_dir).withColumn("total_reads", F.least("total_reads", F.lit(20))), "total_reads", 5)


@query(f"select mod_type, strand, format('{{:.3f}}', round(avg(stoichiometry), 3)) as shown from ({STOICH_SQL}) group by mod_type, strand")
def formatted_fractions(spark, sf_dir):
    return stoich(spark, sf_dir).groupBy("mod_type", "strand").agg(F.format_number(F.round(F.avg("stoichiometry"), 3), 3).alias("shown"))


@query("""
    select name, case when lower(name) like '%plasma%' then 'plasma_treated' else 'untreated' end as condition,
           case when lower(name) like '%hypoxia%' then 'hypoxia' when lower(name) like '%normoxia%' then 'normoxia' else '?' end as oxygen
    from (select concat(c_name, case c_custkey % 4 when 0 then '_normoxia' when 1 then '_hypoxia_plasma' when 2 then '_plasma' else '' end) as name from customer)
""")
def sample_conditions(spark, sf_dir):
    k = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(k == 0, "_normoxia").when(k == 1, "_hypoxia_plasma").when(k == 2, "_plasma").otherwise(""))
    return table(spark, sf_dir, "customer").select(name.alias("name")).select("name", sequence.condition_of_sample(F.col("name")).alias("condition"), sequence.oxygen_of_sample(F.col("name")).alias("oxygen"))


@query("""
    select 'calls' as result, 'loaded' as status, (select count(*) from lineitem) as n_rows
    union all select 'nothing', 'empty', 0 union all select 'absent', 'not found', 0
""")
def result_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return report.result_counts({"calls": lines, "nothing": lines.where("l_orderkey is null"), "absent": None})


# --- annotation ---------------------------------------------------------------------------------

ASSIGNED_SQL = f"""
    with s as ({SITES_SQL}), g as ({GENES_SQL}),
    h as (select s.*, g.*  exclude (chrom), row_number() over (partition by s.chrom, s.ref_pos, s.strand order by gend - gstart, gstart, gene_id) as rn
          from s join g on s.chrom = g.chrom and ref_pos >= gstart and ref_pos < gend),
    a as (select s.chrom, s.ref_pos, s.strand, h.gene_id, coalesce(h.gene_name, s.chrom) as gene_name, coalesce(h.gene_biotype, 'unknown') as gene_biotype, h.gend - h.gstart as gene_length,
                 coalesce((s.ref_pos - h.gstart)::double / (h.gend - h.gstart), 0.5) as relative_position
          from s left join h on s.chrom = h.chrom and s.ref_pos = h.ref_pos and s.strand = h.strand and h.rn = 1)
"""
REGION_SQL = "case when relative_position between 0 and 0.15 then '5UTR' when relative_position <= 0.85 then 'CDS' when relative_position <= 1 then '3UTR' else 'nan' end"
SITE_ID = ["chrom", "ref_pos", "strand"]


def assigned(spark, sf_dir):
    return intervals.assign_gene(proxies.positions(spark, sf_dir), proxies.genes(spark, sf_dir), SITE_ID, bin_size=64)


@query(f"{ASSIGNED_SQL} select chrom, ref_pos, strand, gene_id, gene_name, gene_biotype, gene_length, round(relative_position, 6) as relative_position, {REGION_SQL} as transcript_region from a")
def gene_annotation(spark, sf_dir):
    return assigned(spark, sf_dir).withColumn("transcript_region", intervals.region_of_position(F.col("relative_position")))


@query(f"with s as ({SITES_SQL}), g as ({GENES_SQL}) select s.chrom, ref_pos, count(*) as n_genes, min(gend - gstart) as shortest from s join g on s.chrom = g.chrom and ref_pos >= gstart and ref_pos < gend group by s.chrom, ref_pos")
def gene_overlaps(spark, sf_dir):
    hits = intervals.overlap_join(proxies.positions(spark, sf_dir), proxies.genes(spark, sf_dir), ["chrom"], bin_size=64)
    return hits.groupBy("chrom", "ref_pos").agg(F.count("*").alias("n_genes"), F.min(F.col("end") - F.col("start")).alias("shortest"))


@query(f"{ASSIGNED_SQL} select {REGION_SQL} as transcript_region, count(*) as n from a group by 1")
def region_counts(spark, sf_dir):
    rows = assigned(spark, sf_dir).select(intervals.region_of_position(F.col("relative_position")).alias("transcript_region"))
    return report.value_counts(rows, "transcript_region")


@query(f"select sample, {KEYS}, reference_name as gene_name, 'unknown' as gene_biotype, null::bigint as gene_length, 0.5::double as relative_position, 'unknown' as transcript_region from ({STOICH_SQL})")
def sites_without_annotation(spark, sf_dir):
    return intervals.without_annotation(stoich(spark, sf_dir).select("sample", *sites.SITE))


GENE_LIST = sorted({g for _, g in genesets.pairs(genesets.CURATED_SETS)} | {g for _, g in genesets.pairs(genesets.PATHWAY_LABELS)})
SYMBOL_SQL = f"([{', '.join(repr(g) for g in GENE_LIST)}, 'XYZ', 'cdkn2a'])[1 + p_partkey % {len(GENE_LIST) + 2}]"
LABELS_SQL = f"(values {', '.join(f'({g!r}, {n!r})' for n, g in genesets.pairs(genesets.PATHWAY_LABELS))}) as v(gene, label)"
SETS_SQL = f"(values {', '.join(f'({n!r}, {g!r})' for n, g in genesets.pairs(genesets.CURATED_SETS))}) as v(pathway, gene)"


def symbols(spark, sf_dir) -> DataFrame:
    """Parts that carry gene symbols in turn, with the changes of large parts significant."""
    names = F.array(*map(F.lit, [*GENE_LIST, "XYZ", "cdkn2a"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % (len(GENE_LIST) + 2)).cast("int")).alias("gene_name"), (F.col("p_size") > 49).alias("is_significant"), F.col("p_retailprice").alias("abs_delta_stoichiometry"), F.col("p_partkey").alias("ref_pos"))


@query(f"select p_partkey, {SYMBOL_SQL} as gene_name, coalesce(label, 'other') as pathway_annotation from part left join {LABELS_SQL} on upper({SYMBOL_SQL}) = gene")
def pathway_annotation(spark, sf_dir):
    return intervals.pathway_annotation(symbols(spark, sf_dir).select("p_partkey", "gene_name"), genesets.pathway_labels(spark))


def enrich_sql(sig: str, background: str, sets: str) -> str:
    cells = "select overlap_count as a, n_sig - overlap_count as b, pathway_size - overlap_count as c, n_all - n_sig - pathway_size + overlap_count as d from k"
    return f"""
        with sig as ({sig}), bg as ({background}), sets as (select distinct pathway, upper(gene) as gene from {sets}),
        k as materialized (
            select pathway, count(*) as pathway_size, count(sig.gene) as overlap_count, coalesce(string_agg(sig.gene, '; ' order by sig.gene), '') as overlap_genes,
                   (select count(*) from sig) as n_sig, (select count(*) from bg) as n_all
            from sets join bg using (gene) left join sig using (gene) group by pathway
        ),
        f as ({fisher_sql(cells, greater=True)}),
        t as (select k.*, a, b, c, d, f.p as pvalue from k join f on a = overlap_count and b = n_sig - overlap_count and c = pathway_size - overlap_count and d = n_all - n_sig - pathway_size + overlap_count),
        r as (select *, rank() over (order by pvalue) + count(*) over (partition by pvalue) - 1 as rk, count(*) over () as n from t),
        e as (select *, least(1.0, min(pvalue * n / rk) over (order by pvalue desc)) as fdr from r)
        select pathway, pathway_size, overlap_count, overlap_genes, round(n_sig * pathway_size / greatest(n_all, 1)::double, 6) as expected,
               round((overlap_count / greatest(n_sig, 1)::double) / (pathway_size / greatest(n_all, 1)::double), 6) as fold_enrichment,
               round({ODDS_SQL}, 6) as odds_ratio, round(pvalue, 6) as pvalue, round(fdr, 6) as fdr, fdr <= 0.05 as significant
        from e
    """


BACKGROUND_SQL = f"select distinct upper({SYMBOL_SQL}) as gene from part"


@query(enrich_sql(f"select distinct upper({SYMBOL_SQL}) as gene from part where p_size > 49", BACKGROUND_SQL, SETS_SQL))
def curated_enrichment(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    return enrichment.enrich(enrichment.significant_genes(rows), enrichment.distinct_genes(rows), genesets.curated_sets(spark))


@query(enrich_sql("select distinct upper(p_name) as gene from part where p_size > 49", "select distinct upper(p_name) as gene from part", "(select p_type as pathway, p_name as gene from part) v"))
def own_set_enrichment(spark, sf_dir):
    """Sets from a table instead of the curated ones."""
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_name").alias("gene_name"), (F.col("p_size") > 49).alias("is_significant"))
    return enrichment.enrich(enrichment.significant_genes(own), enrichment.distinct_genes(own), part.select(F.col("p_type").alias("pathway"), F.col("p_name").alias("gene")))


@query(f"""select 'curated' as library, * from ({ORACLE_SQL["curated_enrichment"]}) union all
    select 'types' as library, * from ({enrich_sql(f"select distinct upper({SYMBOL_SQL}) as gene from part where p_size > 49", BACKGROUND_SQL, f"(select p_type as pathway, {SYMBOL_SQL} as gene from part) v")})""")
def library_enrichment(spark, sf_dir):
    """The curated sets and those of another library, a family of tests each."""
    rows, part = symbols(spark, sf_dir), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    own = rows.join(part, "p_partkey").select(F.col("p_type").alias("pathway"), F.col("gene_name").alias("gene"))
    return enrichment.enrich_libraries(enrichment.significant_genes(rows), enrichment.distinct_genes(rows), {"curated": genesets.curated_sets(spark), "types": own})


@query(f"select distinct upper(g) as gene from (select {SYMBOL_SQL} as g from part order by p_retailprice desc, p_partkey limit 100)")
def fallback_genes(spark, sf_dir):
    return enrichment.top_genes(symbols(spark, sf_dir))


@query(f"""select pathway, concat_ws('/', overlap_count, pathway_size) as overlap, format('{{:,.2f}}', fold_enrichment) as fold, format('{{:,.4f}}', pvalue) as p, format('{{:,.4f}}', fdr) as fdr,
    case when significant then 'YES' else 'no' end as significant from ({ORACLE_SQL["curated_enrichment"]})""")
def pathway_report(spark, sf_dir):
    return report.pathway_table(curated_enrichment(spark, sf_dir))


# --- metatranscript -----------------------------------------------------------------------------

META_SQL = f"""
    with s as ({SITES_SQL}), p as (select p_partkey as k, p_name, concat('chr', p_partkey % 5) as chrom, p_partkey % 2 = 1 as minus from part),
    h as (
        select s.chrom, s.ref_pos, s.strand, k, p_name, case when minus then 59 - (ref_pos - k) else ref_pos - k end as o, minus
        from s join p on s.chrom = p.chrom and (s.strand = '-') = minus and ref_pos >= k and ref_pos < k + 60
    ),
    q as (
        select *, case when o < 10 then o / 10.0::double
                       when not minus and o >= 10 and o < 20 then 1 + (o - 10) / 25.0::double when not minus and o >= 30 and o < 45 then 1 + (o - 20) / 25.0::double
                       when minus and o >= 15 and o < 30 then 1 + (o - 15) / 25.0::double when minus and o >= 40 and o < 50 then 1 + (o - 25) / 25.0::double
                       when o >= 50 then 2 + (o - 50) / 10.0::double end as pos
        from h
    ),
    b as (select *, row_number() over (partition by chrom, ref_pos, strand order by k desc) as rn from q where pos is not null),
    a as (
        select s.chrom, s.ref_pos, s.strand, pos as metatranscript_pos, case when pos is null then 'intergenic' when pos < 1 then '5UTR' when pos < 2 then 'CDS' else '3UTR' end as region,
               coalesce(p_name, '') as gene_name, coalesce('T' || k, '') as transcript_id, case s.ref_pos % 3 when 0 then 'm6A' when 1 then 'inosine' else '2OmeA' end as mod_type,
               s.ref_pos % 5 = 0 as is_significant, case when s.ref_pos % 5 <> 0 then 'unchanged' when s.ref_pos % 2 = 0 then 'increased' else 'decreased' end as direction
        from s left join b on s.chrom = b.chrom and s.ref_pos = b.ref_pos and s.strand = b.strand and rn = 1
    )
"""


def placed(spark, sf_dir) -> DataFrame:
    pos = F.col("ref_pos")
    rows = metatranscript.annotate(proxies.positions(spark, sf_dir), proxies.transcripts(spark, sf_dir), SITE_ID, bin_size=128)
    kind = F.when(pos % 3 == 0, "m6A").when(pos % 3 == 1, "inosine").otherwise("2OmeA")
    direction = F.when(pos % 5 != 0, "unchanged").when(pos % 2 == 0, "increased").otherwise("decreased")
    return rows.withColumns({"mod_type": kind, "is_significant": pos % 5 == 0, "direction": direction})


@query(f"{META_SQL} select chrom, ref_pos, strand, round(metatranscript_pos, 6) as metatranscript_pos, region, gene_name, transcript_id from a")
def metatranscript_positions(spark, sf_dir):
    return placed(spark, sf_dir).select(*SITE_ID, "metatranscript_pos", "region", "gene_name", "transcript_id")


@query(f"""{META_SQL}, d as (select distinct mod_type, r.region from a, (values ('5UTR'), ('CDS'), ('3UTR'), ('intergenic')) as r(region))
    select d.mod_type, d.region, count(a.chrom) as total_sites, count(case when is_significant then 1 end) as significant,
           count(case when is_significant and direction = 'increased' then 1 end) as increased, count(case when is_significant and direction = 'decreased' then 1 end) as decreased
    from d left join a on d.mod_type = a.mod_type and d.region = a.region group by d.mod_type, d.region""")
def metatranscript_summary(spark, sf_dir):
    return metatranscript.summary(placed(spark, sf_dir))


@query(f"{META_SQL} select region, count(case when direction = 'increased' then 1 end) as increased, count(case when direction = 'decreased' then 1 end) as decreased, count(case when direction = 'unchanged' then 1 end) as unchanged from a group by region")
def region_directions(spark, sf_dir):
    return metatranscript.direction_counts(placed(spark, sf_dir))


@query(f"""{META_SQL} select region, count(*) as n_all, count(case when is_significant then 1 end) as n_sig, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct_all,
    round(100.0 * count(case when is_significant then 1 end) / greatest(sum(count(case when is_significant then 1 end)) over (), 1), 6) as pct_sig from a where region <> 'intergenic' group by region""")
def region_shares(spark, sf_dir):
    return metatranscript.region_shares(placed(spark, sf_dir))


@query(f"{META_SQL} select region, mod_type, count(*) as n from a where is_significant and region in ('5UTR', 'CDS', '3UTR') group by region, mod_type")
def significant_regions(spark, sf_dir):
    rows = report.dashboard_filter(placed(spark, sf_dir), only_significant=True, regions=metatranscript.REGIONS[:3])
    return rows.groupBy("region", "mod_type").agg(F.count("*").alias("n"))


@query(f"""{META_SQL}, r as (select *, round((ref_pos % 11) / 10.0::double - 0.5, 6) as delta, round((ref_pos % 50) / 50.0::double, 6) as q from a where is_significant)
    select gene_name as "Gene", chrom as "Chr", ref_pos as "Position", region as "Region", coalesce(format('{{:,.4f}}', metatranscript_pos), '—') as "Meta Pos", format('{{:,.4f}}', delta) as "Δ Stoich", format('{{:,.4f}}', q) as "FDR", direction as "Direction"
    from r order by q, chrom, ref_pos, mod_type, strand limit 30""")
def region_page(spark, sf_dir):
    pos = F.col("ref_pos")
    rows = placed(spark, sf_dir).withColumnRenamed("chrom", "reference_name")
    fdr = F.round(pos % 50 / F.lit(50.0), 6)
    return report.region_page(rows.withColumns({"control": F.lit("c"), "treatment": F.lit("t"), "delta_stoichiometry": F.round(pos % 11 / F.lit(10.0) - 0.5, 6), "fdr": fdr, "pvalue": fdr}))


# --- sequences and tags -------------------------------------------------------------------------

WINDOW_SQL = lambda before, after: f"substr(text, (greatest(n_chars // 2 - {before}, 0) + 1)::bigint, (n_chars // 2 + {after} - greatest(n_chars // 2 - {before}, 0))::bigint)"


CAPS = lambda x: f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"""
    select doc_id, round((length(w) - length(translate({CAPS('w')}, 'GC', '')))::double / nullif(length(w), 0), 6) as gc_content,
           regexp_matches(translate({CAPS(WINDOW_SQL(2, 3))}, 'U', 'T'), '[AGT][AG]AC[ACT]') as drach_motif, {CAPS(WINDOW_SQL(5, 6))} as kmer_context
    from (select *, {WINDOW_SQL(25, 25)} as w from documents)
""")
def sequence_features(spark, sf_dir):
    """Windows of whole texts, which stand in for reference sequences cut to tiles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("n_chars") / 2).alias("ref_pos")).withColumn("reference_name", F.col("doc_id").cast("string"))
    size = 500
    tiles = docs.select("reference_name", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("text") / size))).alias("tile_id"))
    start = F.greatest(F.col("tile_id") * size - 25, F.lit(0))
    tiles = tiles.select("reference_name", "tile_id", start.alias("tile_start"), F.substring(F.col("text"), (start + 1).cast("int"), ((F.col("tile_id") + 1) * size + 26 - start).cast("int")).alias("seq"))
    return features.sequence_features(docs.drop("text"), tiles, size).select("doc_id", "gc_content", "drach_motif", "kmer_context")


PIPED = "concat('ENST', p_partkey, '|', 'ENSG', p_partkey, '|-|-|', p_brand, case when p_partkey % 3 = 0 then '' else concat('|', p_name, '|', p_size) end)"


@query(f"select p_partkey, split_part({PIPED}, '|', 1) as transcript_id, case when p_partkey % 3 = 0 then {PIPED} else p_name end as gene_name from part")
def reference_fields(spark, sf_dir):
    ref = F.expr(PIPED)
    return table(spark, sf_dir, "part").select("p_partkey", sequence.transcript_id(ref).alias("transcript_id"), sequence.gene_of_reference(ref).alias("gene_name"))


@query("""
    select concat('chr', p_partkey % 5) as chrom, p_partkey - 1 as start, p_partkey + p_size as "end", case when p_partkey % 2 = 0 then '+' else '-' end as strand, 'gene' as feature,
           null::varchar as transcript_id, concat('G', p_partkey) as gene_id, p_name as gene_name, p_brand as gene_type, null::varchar as gene_biotype
    from part where p_partkey % 7 <> 0
""")
def gtf_records(spark, sf_dir):
    """Annotation lines derived from parts, a comment in seven of them."""
    line = F.expr("""if(p_partkey % 7 = 0, concat('#', p_name), concat_ws('\t', concat('chr', p_partkey % 5), 'src', 'gene', p_partkey, p_partkey + p_size, '.', if(p_partkey % 2 = 0, '+', '-'), '.',
        concat('gene_id "G', p_partkey, '"; gene_name "old"; gene_type "', p_brand, '"; gene_name "', p_name, '";')))""")
    return annotation.parse_gtf(table(spark, sf_dir, "part").select(line.alias("value")))


@query("""
    select concat('chr', p_partkey % 5) as chrom, p_partkey - 1 as start, p_partkey + p_size as "end", case when p_partkey % 2 = 0 then '+' else '-' end as strand, concat('G', p_partkey) as gene_id, p_name as gene_name, p_brand as gene_biotype
    from part where p_partkey % 7 <> 0
""")
def gtf_genes(spark, sf_dir):
    return annotation.genes(gtf_records(spark, sf_dir))


#: Letter i (from 0) of the sequence of supplier k, of 150 to 209 letters.
LETTER_SQL = "substr('ACGTN', ((k * 7 + i * i + i * k // 3) % 5 + 1)::bigint, 1)"
FASTA_SQL = f"select concat('S', k) as reference_name, string_agg({LETTER_SQL}, '' order by i) as whole from (select s_suppkey as k, unnest(range(150 + s_suppkey % 60)) as i from supplier) group by k"


def fasta_tiles(spark, sf_dir, tile_size, reach):
    """Sequences of the suppliers written as FASTA in lines of 60 and read back by their index."""
    folder = f"{shared_folder(spark).rstrip('/')}/fasta-{uuid.uuid4().hex}"
    whole = F.expr("array_join(transform(sequence(0L, 149L + s_suppkey % 60), i -> substr('ACGTN', int((s_suppkey * 7 + i * i + i * s_suppkey div 3) % 5 + 1), 1)), '')")
    lines = F.concat(F.lit(">S"), F.col("s_suppkey").cast("string"), F.lit(" made from a key\n"), F.regexp_replace(whole, "(.{60})(?=.)", "$1\n"))
    table(spark, sf_dir, "supplier").select(lines).write.text(folder)
    fasta.write_index(spark, folder)
    return fasta.read_fasta(spark, folder, tile_size, reach)


@query(f"""select reference_name, t as tile_id, greatest(t * 40 - 5, 0) as tile_start, substr(whole, greatest(t * 40 - 5, 0) + 1, (t + 1) * 40 + 5 - greatest(t * 40 - 5, 0)) as seq
    from ({FASTA_SQL}), unnest(range(6)) as u(t) where t * 40 < length(whole)""")
def reference_tiles(spark, sf_dir):
    return fasta_tiles(spark, sf_dir, 40, 5)


@query(f"""
    with s as (select distinct concat('S', l_suppkey + l_partkey % 2 * 100000) as reference_name, l_partkey % 150 as ref_pos, case when l_suppkey % 2 = 0 then '+' else '-' end as strand from lineitem),
    w as (select s.*, substr(whole, greatest(ref_pos - 25, 0) + 1, ref_pos + 25 - greatest(ref_pos - 25, 0)) as w, substr(whole, greatest(ref_pos - 2, 0) + 1, ref_pos + 3 - greatest(ref_pos - 2, 0)) as m,
                 substr(whole, greatest(ref_pos - 5, 0) + 1, ref_pos + 6 - greatest(ref_pos - 5, 0)) as k from s left join ({FASTA_SQL}) using (reference_name))
    select reference_name, ref_pos, strand, round((length(w) - length(translate(w, 'GC', '')))::double / nullif(length(w), 0), 6) as gc_content, coalesce(regexp_matches(m, '[AGT][AG]AC[ACT]'), false) as drach_motif, coalesce(k, '') as kmer_context from w""")
def reference_features(spark, sf_dir):
    """Sites on sequences from a FASTA file; every second part's reference is in no file."""
    lines = table(spark, sf_dir, "lineitem")
    at = lines.select(F.concat(F.lit("S"), (F.col("l_suppkey") + F.col("l_partkey") % 2 * 100000).cast("string")).alias("reference_name"), (F.col("l_partkey") % 150).alias("ref_pos"), F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()
    return features.sequence_features(at, fasta_tiles(spark, sf_dir, 40, 25), 40)


@query(f"select chrom as reference_name, ref_pos, strand, null::double as gc_content, false as drach_motif, '' as kmer_context from ({SITES_SQL})")
def features_without_sequence(spark, sf_dir):
    return features.sequence_features(proxies.positions(spark, sf_dir).withColumnRenamed("chrom", "reference_name"), None)


@query("select l_linestatus as sample, l_orderkey as read_id, l_suppkey as reference_name, l_partkey as ref_pos, l_returnflag as mod_type, l_shipdate::varchar as mod_code, l_discount as probability, l_linenumber as strand from lineitem")
def headerless_chunks(spark, sf_dir):
    names = ["l_linestatus", "l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_shipdate", "l_discount", "l_linenumber", "l_tax"]
    lines = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    return sites.normalize_columns(lines.select(*names).toDF(*map(str, range(len(names)))))


@query(f"""select sample, count(*) as calls, null::double as mean_probability from ({CALLS_SQL}) group by sample
    union all select sample, null as calls, round(avg(probability), 6) as mean_probability from ({CALLS_SQL}) group by sample""")
def united_summaries(spark, sf_dir):
    by_sample = proxies.calls(spark, sf_dir).groupBy("sample")
    return results_tables.union_tables([by_sample.agg(F.count("*").alias("calls")), by_sample.agg(F.avg("probability").alias("mean_probability"))])


@query("""
    select l_orderkey, l_linenumber, 'A' as base, case when l_linenumber % 2 = 0 then 'a' else '17596' end as mod_code, [l_linenumber, l_partkey % 3]::varchar as skips, 2::bigint as n_calls,
           case when l_linenumber % 2 = 0 then 'm6A' else 'inosine' end as mod_type
    from lineitem where l_linenumber % 3 <> 0
""")
def mm_entries(spark, sf_dir):
    """MM tags derived from lines; one in three has no mark and gives no entry."""
    tag = F.expr("concat('A+', if(l_linenumber % 2 = 0, 'a', '17596'), if(l_linenumber % 3 = 0, '', '.'), ',', l_linenumber, ',', l_partkey % 3, ';')")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(mm.parse_mm(tag)).alias("e"))
    return rows.select("l_orderkey", F.col("l_linenumber"), "e.base", "e.mod_code", F.concat(F.lit("["), F.array_join(F.col("e.skips").cast("array<string>"), ", "), F.lit("]")).alias("skips"), "e.n_calls", sequence.mod_name(F.col("e.mod_code")).alias("mod_type"))


def sam_lines(spark, sf_dir) -> DataFrame:
    """Alignment lines of ten bases derived from order lines: three calls on four As, every third read on the minus strand, every seventh unmapped."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("""concat_ws('\t', concat('r', l_orderkey, '_', l_linenumber), if(l_orderkey % 7 = 0, 4, if(l_orderkey % 3 = 0, 16, 0)), concat('S', l_suppkey), l_partkey + 1, 60, '2S5M1D3M', '*', 0, 0,
            if(l_orderkey % 3 = 0, 'TTGTCTGCTC', 'AAGACAGCAC'), '*', if(l_linenumber = 7, 'XX:i:1', 'MM:Z:A+a.,1,0,0;'), 'ML:B:C,0,128,255')""").alias("value")
    )


#: As at 0, 1, 3, 5, 8 of the read; calls at the second to fourth, from the other end on the minus strand. Query 1 is clipped, 3 and 5 lie one and three bases into the block.
SAM_SQL = """
    with r as (select concat('r', l_orderkey, '_', l_linenumber) as read_id, concat('S', l_suppkey) as reference_name, l_partkey as p, l_orderkey % 3 = 0 as minus from lineitem where l_orderkey % 7 <> 0 and l_linenumber <> 7),
    c as (select *, unnest(case when minus then [3, 1] else [1, 3] end) as o, unnest(case when minus then [0, 128] else [128, 255] end) as ml from r)
    select read_id, reference_name, p + o as ref_pos, 'm6A' as mod_type, 'a' as mod_code, round(ml / 255.0::double, 6) as probability, case when minus then '-' else '+' end as strand from c
"""


@query()
def decoded_calls(spark, sf_dir):
    return mm.decode_reads(alignments.parse_sam(sam_lines(spark, sf_dir)))


@query("select count(*) as total_reads, count(case when l_orderkey % 7 = 0 then 1 end) as unmapped_reads, count(case when l_orderkey % 7 <> 0 and l_linenumber = 7 then 1 end) as reads_without_tags, count(case when l_orderkey % 7 <> 0 and l_linenumber <> 7 then 1 end) as mapped_with_mods, 0::bigint as reads_without_sequence from lineitem")
def read_counters(spark, sf_dir):
    return alignments.read_counters(alignments.parse_sam(sam_lines(spark, sf_dir)))


@query("""select concat('r', l_orderkey, '_', l_linenumber) as qname, (case when l_orderkey % 7 = 0 then 4 when l_orderkey % 3 = 0 then 16 else 0 end)::bigint as flag, concat('S', l_suppkey) as rname, l_partkey::bigint as pos,
    '2S5M1D3M' as cigar, case when l_orderkey % 3 = 0 then 'TTGTCTGCTC' else 'AAGACAGCAC' end as seq, case when l_linenumber <> 7 then 'A+a.,1,0,0;' end as mm, '0,128,255' as ml from lineitem""")
def bam_reads(spark, sf_dir):
    """Reads written as BAM files and read back by ranges of 64 KB between indexed records."""
    folder = f"{shared_folder(spark).rstrip('/')}/bam-{uuid.uuid4().hex}"
    bam.write_bam(alignments.parse_sam(sam_lines(spark, sf_dir)), folder)
    return bam.read_bam(spark, folder, split_bytes=1 << 16).withColumn("ml", F.array_join("ml", ",")).withColumn("flag", F.col("flag").cast("long"))


# --- features and models ------------------------------------------------------------------------


@query(f"""{diff_sql()} select {KEYS}, round(ln(1 + total_reads_ctrl), 6) as log_coverage_ctrl, round(ln(1 + total_reads_treat), 6) as log_coverage_treat, round(total_reads_treat / greatest(total_reads_ctrl, 1)::double, 6) as coverage_ratio,
    round(stoichiometry_ctrl, 6) as baseline_stoichiometry, round(stoichiometry_treat / greatest(stoichiometry_ctrl, 0.001), 6) as stoichiometry_change_ratio, is_significant::bigint as label from results""")
def coverage_features(spark, sf_dir):
    rows = features.coverage_features(results(spark, sf_dir)).withColumn("label", F.col("is_significant").cast("int"))
    return rows.select(*sites.SITE, "log_coverage_ctrl", "log_coverage_treat", "coverage_ratio", "baseline_stoichiometry", "stoichiometry_change_ratio", "label")


@query("select c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::bigint as \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer")
def one_hot_segments(spark, sf_dir):
    return features.one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]).drop("c_mktsegment")


@query("select c_custkey, round(coalesce(b, (select median(case when c_custkey % 4 <> 0 then c_acctbal end) from customer)), 6) as balance from (select c_custkey, case when c_custkey % 4 <> 0 then c_acctbal end as b from customer)")
def imputed_balances(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"))
    return features.impute_median(rows, ["balance"])


@query("select quality as label, round(count(*) * 0.2)::bigint as n_test, count(*) as n from labels group by quality")
def split_sizes(spark, sf_dir):
    split = features.stratified_split(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "label", ["doc_id"])
    return split.groupBy("label").agg(F.count_if("is_test").alias("n_test"), F.count("*").alias("n"))


@query("select count(case when quality = 0 then 1 end) as n_neg, count(case when quality = 1 then 1 end) as n_pos, count(distinct quality) as n_classes, round(count(case when quality = 0 then 1 end) / greatest(count(case when quality = 1 then 1 end), 1)::double, 6) as scale_pos_weight from labels")
def class_balance(spark, sf_dir):
    return features.class_balance(table(spark, sf_dir, "labels"), "quality")


CURVE_SQL = """
    with s as (select n_chars::double as score, quality as label from documents join labels using (doc_id)),
    g as (select score as threshold, sum(label) as p, sum(1 - label) as n from s group by score),
    c as (select threshold, sum(p) over (order by threshold desc) as tp, sum(n) over (order by threshold desc) as fp, sum(p) over () as pos, sum(n) over () as neg from g),
    r as (select threshold, tp::bigint as tp, fp::bigint as fp, fp / neg::double as fpr, tp / pos::double as tpr, tp / (tp + fp)::double as precision from c)
"""


def length_scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


@query(f"{CURVE_SQL} select threshold, tp, fp, round(fpr, 6) as fpr, round(tpr, 6) as tpr, round(precision, 6) as precision from r")
def curve_points(spark, sf_dir):
    return metrics.curve_points(length_scores(spark, sf_dir))


@query(f"""{CURVE_SQL}, l as (select *, coalesce(lag(fpr) over w, 0) as f0, coalesce(lag(tpr) over w, 0) as t0 from r window w as (order by threshold desc))
    select round(sum((fpr - f0) * (tpr + t0) / 2), 6) as roc_auc, round(sum((tpr - t0) * precision), 6) as avg_precision from l""")
def ranking_metrics(spark, sf_dir):
    return metrics.ranking_metrics(length_scores(spark, sf_dir))


@query("""
    select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy, round(tp / (tp + fp)::double, 6) as precision_1, round(tp / (tp + fn)::double, 6) as recall_1, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1_1
    from (select count(case when n_chars >= 1000 and quality = 1 then 1 end) as tp, count(case when n_chars >= 1000 and quality = 0 then 1 end) as fp, count(case when n_chars < 1000 and quality = 1 then 1 end) as fn, count(case when n_chars < 1000 and quality = 0 then 1 end) as tn
          from documents join labels using (doc_id))
""")
def confusion_counts(spark, sf_dir):
    return metrics.confusion(length_scores(spark, sf_dir), threshold=1000)


FEATURES = [f"f{i}" for i in range(64)]


def vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as feature rows, a small digit as the positive label; every dimension."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])
    return ml.assemble(rows, FEATURES).select("vec_id", "label", "features")


#: Trees and depth of the registered training queries, those of the reference.
TREES, DEPTH = 200, 6
#: Rows of a partition of the model tables: every tree level is a job, and every task that explains rows walks all trees.
TRAIN_ROWS = 50_000
#: Where a session's models and their test rows lie, by kind and tables.
_TRAINED: dict[tuple[str, str, str], tuple[str, DataFrame]] = {}


def trained(spark, sf_dir: str, kind: str):
    """(model, test rows): trained once in a session, saved to the shared folder and read back by every query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _TRAINED:
        split = cut(features.stratified_split(vectors(spark, sf_dir), "label", ["vec_id"]))
        train, test = (cut(half.coalesce(max(1, -(-half.count() // TRAIN_ROWS)))) for half in (split.where("not is_test"), split.where("is_test")))
        fit = {"boosting": ml.train_boosting, "forest": ml.train_forest}[kind]
        path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
        ml.save_model(spark, fit(train, trees=TREES, depth=DEPTH), FEATURES, path)
        _TRAINED[key] = path, test
    path, test = _TRAINED[key]
    return ml.load_model(spark, path)[0], test


@query()
def boosting_metrics(spark, sf_dir):
    return ml.evaluate(*trained(spark, sf_dir, "boosting"))


@query()
def forest_metrics(spark, sf_dir):
    return ml.evaluate(*trained(spark, sf_dir, "forest"))


@query()
def forest_importances(spark, sf_dir):
    return ml.importances(spark, trained(spark, sf_dir, "forest")[0], FEATURES)


@query()
def shap_global(spark, sf_dir):
    model, test = trained(spark, sf_dir, "boosting")
    return ml.global_importance(ml.shap_long(ml.shap_values(model, test, FEATURES, "vec_id"), FEATURES, "vec_id"))


@query()
def shap_local(spark, sf_dir):
    model, test = trained(spark, sf_dir, "boosting")
    return ml.local_explanations(ml.shap_values(model, test, FEATURES, "vec_id"), "vec_id").select("rank", "vec_id", "shap_sum")


#: Embeddings stand for attributions: one value for each row and dimension.
LONG_SQL = "select vec_id, 'f' || (unnest(range(len(embedding)))) as feature, unnest(embedding)::double as shap_value from embeddings"
RANKED_SQL = f"with long as ({LONG_SQL}), g as (select feature, avg(abs(shap_value)) as m from long group by feature), r as (select *, row_number() over (order by m desc, feature) as rank from g)"


def attributions(spark, sf_dir) -> DataFrame:
    value = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", value.alias("shap"), value.alias("feature_values"))


@query(f"{RANKED_SQL} select feature, round(m, 6) as mean_abs_shap, rank from r")
def importance_ranks(spark, sf_dir):
    return ml.global_importance(ml.shap_long(attributions(spark, sf_dir), FEATURES, "vec_id"))


@query(f"{RANKED_SQL} select feature, format('{{:,.4f}}', m) as mean_abs_shap, rank from r where rank <= 20")
def importance_page(spark, sf_dir):
    return ml.importance_table(importance_ranks(spark, sf_dir), n=20)


@query(f"{RANKED_SQL} select vec_id, feature, round(shap_value, 6) as shap_value, round(shap_value, 6) as feature_value, rank from long join r using (feature) where rank <= 5")
def dependence_rows(spark, sf_dir):
    return ml.dependence(ml.shap_long(attributions(spark, sf_dir), FEATURES, "vec_id"))


@query("select vec_id, round(s, 6) as shap_sum, row_number() over (order by s desc, vec_id) as rank from (select vec_id, list_sum(embedding::double[]) as s from embeddings) order by s desc, vec_id limit 20")
def local_rows(spark, sf_dir):
    return ml.local_explanations(attributions(spark, sf_dir), "vec_id").select("vec_id", "shap_sum", "rank")


@query("select vec_id, round(s, 6) as shap_sum, row_number() over (order by s desc, vec_id) as rank, " + ", ".join(f"round(embedding[{i + 1}]::double, 6) as {p}_f{i}" for p in ("shap", "value") for i in range(64)) + " from (select *, list_sum(embedding::double[]) as s from embeddings) order by s desc, vec_id limit 20")
def local_wide(spark, sf_dir):
    rows = ml.local_explanations(attributions(spark, sf_dir), "vec_id")
    return ml.wide_explanations(rows, FEATURES).select("vec_id", "shap_sum", "rank", *[f"{p}_{f}" for p in ("shap", "value") for f in FEATURES])


def node(feature=-1, threshold=0.0, left=-1, right=-1, value=0.0, cover=0.0):
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "value": value, "cover": cover}


#: Two trees: one over features 0 and 1, one that asks feature 2 twice and feature 3 once.
FIXED_TREES = [
    {"weight": 1.0, "nodes": [node(0, 0.0, 1, 2, cover=100.0), node(value=1.0, cover=60.0), node(1, 0.05, 3, 4, cover=40.0), node(value=-2.0, cover=10.0), node(value=4.0, cover=30.0)]},
    {"weight": 0.5, "nodes": [node(2, 0.1, 1, 2, cover=80.0), node(3, -0.02, 3, 4, cover=60.0), node(value=3.0, cover=20.0), node(2, -0.1, 5, 6, cover=45.0), node(value=-1.0, cover=15.0), node(value=2.0, cover=15.0), node(value=0.5, cover=30.0)]},
]
#: Each tree's expectation with none, one or both of its two features known; a feature's share is the mean of what it adds first and last.
FIXED_SHAP_SQL = """
    with x as (select vec_id, embedding[1]::double as x0, embedding[2]::double as x1, embedding[3]::double as x2, embedding[4]::double as x3 from embeddings),
    v as (
        select vec_id, 0.6 * 1 + 0.4 * (0.25 * -2 + 0.75 * 4) as a, case when x0 <= 0.0 then 1 else 0.25 * -2 + 0.75 * 4 end as a0, 0.6 * 1 + 0.4 * case when x1 <= 0.05::double then -2 else 4 end as a1,
               case when x0 <= 0.0 then 1 when x1 <= 0.05::double then -2 else 4 end as a01,
               0.75 * (0.75 * (2 / 3.0::double * 0.5 + 1 / 3.0::double * 2) + 0.25 * -1) + 0.25 * 3 as b,
               case when x2 > 0.1::double then 3 else 0.75 * case when x2 <= -0.1::double then 2 else 0.5 end + 0.25 * -1 end as b2,
               0.75 * case when x3 <= -0.02::double then 2 / 3.0::double * 0.5 + 1 / 3.0::double * 2 else -1 end + 0.25 * 3 as b3,
               case when x2 > 0.1::double then 3 when x3 > -0.02::double then -1 when x2 <= -0.1::double then 2 else 0.5 end as b23
        from x
    ),
    phi as (select vec_id, [(a0 - a + a01 - a1) / 2, (a1 - a + a01 - a0) / 2, (b2 - b + b23 - b3) / 4, (b3 - b + b23 - b2) / 4] as s, a + b / 2 as base from v)
"""


def fixed_shap(spark, sf_dir) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return ml.shap_of_trees(FIXED_TREES, table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")), "vec_id")


@query(f"{FIXED_SHAP_SQL} select vec_id, 'f' || i as feature, round(s[i + 1], 6) + 0.0 as shap_value, round(base, 6) as base from phi, unnest(range(4)) as u(i)")
def fixed_tree_shap(spark, sf_dir):
    """SHAP of every row under two fixed trees."""
    rows = fixed_shap(spark, sf_dir)
    long = ml.shap_long(rows, FEATURES, "vec_id").where(F.col("feature").isin("f0", "f1", "f2", "f3"))
    return long.select("vec_id", "feature", "shap_value").join(rows.select("vec_id", "base"), "vec_id")


@query(f"{FIXED_SHAP_SQL}, l as (select 'f' || i as feature, avg(abs(coalesce(s[i + 1], 0))) as m from phi, unnest(range(64)) as u(i) group by i) select feature, round(m, 6) as mean_abs_shap, row_number() over (order by m desc, feature) as rank from l")
def fixed_tree_importance(spark, sf_dir):
    return ml.global_importance(ml.shap_long(fixed_shap(spark, sf_dir), FEATURES, "vec_id"))


ORACLE_SQL["decoded_calls"] = SAM_SQL

