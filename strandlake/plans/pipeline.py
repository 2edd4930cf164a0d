"""The analysis from reads to enrichment as one lazy plan, written only at named outputs.

``python -m strandlake.plans.pipeline CONFIG [--from-step N] [--to-step N] [--method M]`` runs steps
1 to 8 over the samples and comparisons of a configuration.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import genesets
from strandlake.functions.mm import decode_reads
from strandlake.operators import differential, enrichment, features, intervals, metatranscript, metrics, ml, report, sites
from strandlake.sources import alignments, annotation
from strandlake.sources.results import Config, load_calls, load_combined, load_table, save_table, union_tables

STEPS = ["calls", "stoichiometry", "differential", "feature_matrix", "model", "shap", "pathway_enrichment", "metatranscript_positions"]


@dataclass
class Pipeline:
    """Steps hand DataFrames on; a step outside the chosen range is read from its earlier output.

    ``config.samples`` maps a name to ``{"bam": path}``, ``{"sam": path}`` or ``{"calls": folder}``. Sequence features need
    ``fasta``, annotation ``gtf``; without them the placeholders of the operators stand. Enrichment is
    over the gene sets of ``gmt``, or the curated ones. ``folds`` over 1 adds a cross-validation, and SHAP
    explains ``explained`` test rows.
    """

    spark: SparkSession
    config: Config
    fasta: str | None = None
    gtf: str | None = None
    method: str = "fisher"
    model_kind: str = "boosting"
    trees: int = 200
    folds: int = 0
    explained: int = 1000
    gmt: dict[str, str] | None = None
    mod_types: list[str] | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    seen: dict[str, Observation] = field(default_factory=dict)

    def calls(self) -> DataFrame:
        """Calls of all samples: decoded from reads, whose counters are taken on the way, or loaded from chunks of an earlier extraction."""
        read = {"bam": alignments.read_bam, "sam": alignments.read_sam}
        parts, own = [], self.spark.newSession()
        for name, source in self.config.samples.items():
            for kind in source:
                if kind in read:
                    rows, self.seen[name] = alignments.observed(read[kind](own, source[kind]))
                    parts.append(decode_reads(rows).withColumn("sample", F.lit(name)))
                elif kind == "calls":
                    rows = load_calls(own, source[kind], name)
                    parts.append(rows.withColumn("sample", F.coalesce("sample", F.lit(name))) if "sample" in rows.columns else rows.withColumn("sample", F.lit(name)))
        if not parts:
            raise ValueError("the configuration names no sample with a bam, sam or calls path")
        return union_tables(parts)

    def counters(self) -> DataFrame:
        """The reads of every sample that this run has decoded, as the extraction saw them."""
        rows = [{"cell_line": self.config.cell_line(), "sample": name, **seen.get} for name, seen in self.seen.items()]
        names = ["total_reads", "unmapped_reads", "reads_without_tags", "mapped_with_mods", "reads_without_sequence"]
        return self.spark.createDataFrame(rows, f"cell_line string, sample string, {', '.join(f'{n} long' for n in names)}")

    def stoichiometry(self) -> DataFrame:
        return sites.stoichiometry(self.get("calls"), self.config.modification_probability, self.config.min_coverage, self.mod_types)

    def differential(self) -> DataFrame:
        return differential.differential(self.get("stoichiometry"), self.config.comparisons, self.method, self.config.fdr_threshold, self.config.min_delta_stoichiometry)

    def feature_matrix(self) -> DataFrame:
        rows = self.get("differential").withColumn("chrom", F.col("reference_name"))
        key = ["control", "treatment", *sites.SITE]
        if self.gtf:
            genes = annotation.genes(annotation.read_gtf(self.spark, self.gtf))
            rows = intervals.assign_gene(rows, genes, key)
            rows = rows.withColumn("transcript_region", intervals.region_of_position(F.col("relative_position")))
        else:
            rows = intervals.without_annotation(rows)
        rows = features.sequence_features(rows, annotation.read_fasta(self.spark, self.fasta) if self.fasta else None)
        rows = intervals.pathway_annotation(features.coverage_features(rows), genesets.pathway_labels(self.spark))
        rows = rows.withColumns({"drach_motif": F.col("drach_motif").cast("int"), "label": F.col("is_significant").cast("int")})
        return features.impute_median(features.one_hot(rows, features.CATEGORICAL), [c for c in features.NUMERIC if c in rows.columns])

    def feature_names(self, rows: DataFrame) -> list[str]:
        return [c for c in features.NUMERIC if c in rows.columns] + [c for c in rows.columns if any(c.startswith(f"{p}_") for p in features.CATEGORICAL)]

    def fit(self) -> None:
        """Train on the feature matrix, and write model, feature names and both halves of the split."""
        rows = self.get("feature_matrix")
        names = self.feature_names(rows)
        split = features.stratified_split(rows.withColumn("site", F.concat_ws("|", "control", "treatment", *sites.SITE)), "label", ["site"])
        for half, test in (("train_data", False), ("test_data", True)):
            save_table(split.where(F.col("is_test") == test).drop("is_test"), self.beside("model", half))
        train = load_table(self.spark, self.beside("model", "train_data"))
        trained = (ml.train_boosting if self.model_kind == "boosting" else ml.train_forest)(ml.assemble(train, names), trees=self.trees)
        ml.save_model(self.spark, trained, names, self.beside("model", self.model_kind))

    def fitted(self):
        """(model, test rows, feature names) as they were written, by this run or an earlier one."""
        model, names = ml.load_model(self.spark, self.beside("model", self.model_kind))
        return model, ml.assemble(load_table(self.spark, self.beside("model", "test_data")), names), names

    def run_model(self) -> DataFrame:
        self.fit()
        model, test, _ = self.fitted()
        return ml.evaluate(model, test)

    def attributions(self) -> DataFrame:
        """SHAP of a fixed sample of the test rows, computed once in a run."""
        if "attributions" not in self.tables:
            model, test, names = self.fitted()
            save_table(ml.shap_values(model, ml.explain_sample(test, self.explained, "site"), names, "site"), self.beside("shap", "shap_values"))
            self.tables["attributions"] = load_table(self.spark, self.beside("shap", "shap_values"))
        return self.tables["attributions"]

    def shap(self) -> DataFrame:
        return ml.global_importance(self.shap_rows())

    def shap_rows(self) -> DataFrame:
        return ml.shap_long(self.attributions(), ml.load_model(self.spark, self.beside("model", self.model_kind))[1], "site")

    def extras(self, step: str) -> dict[str, DataFrame]:
        """What a step writes beside its table."""
        if step == "calls":
            return {"read_counters": self.counters()} if self.seen else {}
        if step == "differential":
            found = self.get("differential")
            return {"significant_sites": report.significant_sites(found), "volcano": differential.volcano(found)}
        if step == "model":
            model, test, names = self.fitted()
            score = ml.scored(model, test).select("label", "score")
            out = {"curve_points": metrics.curve_points(score), "importances": ml.importances(self.spark, model, names)}
            if self.folds:
                train = ml.train_boosting if self.model_kind == "boosting" else ml.train_forest
                rows = ml.assemble(self.get("feature_matrix"), names).withColumn("site", F.concat_ws("|", "control", "treatment", *sites.SITE))
                out["cross_validation"] = ml.cross_validate(rows.select("site", "label", "features"), lambda part: train(part, trees=self.trees), ["site"], self.folds)
            return out
        if step == "shap":
            rows = self.shap_rows()
            names = ml.load_model(self.spark, self.beside("model", self.model_kind))[1]
            return {"local_explanations": ml.wide_explanations(ml.local_explanations(self.attributions(), "site"), names), "dependence": ml.dependence(rows), "importance_table": ml.importance_table(self.get("shap"))}
        if step == "pathway_enrichment":
            found = {name: self.get(name) for name in ("differential", "pathway_enrichment")}
            # the shorter rows first: the text is cut
            text = report.chat_context({"pathway_enrichment": report.pathway_table(found["pathway_enrichment"]), "differential": report.table_page(found["differential"])})
            return {"first_page": report.table_page(found["differential"]), "context": self.spark.createDataFrame([(text,)], "context string")}
        return {}

    def pathway_enrichment(self) -> DataFrame:
        rows = self.get("feature_matrix")
        significant = enrichment.significant_genes(rows)
        if significant.isEmpty():
            significant = enrichment.top_genes(rows)
        libraries = {"curated": genesets.curated_sets(self.spark)} | {name: annotation.read_gmt(self.spark, path) for name, path in (self.gmt or {}).items()}
        return enrichment.enrich_libraries(significant, enrichment.distinct_genes(rows), libraries)

    def metatranscript_positions(self) -> DataFrame:
        if not self.gtf:
            raise ValueError("metatranscript coordinates need an annotation")
        rows = self.get("differential").withColumn("chrom", F.col("reference_name"))
        return metatranscript.annotate(rows, annotation.transcript_features(annotation.read_gtf(self.spark, self.gtf)), ["control", "treatment", *sites.SITE])

    def get(self, name: str) -> DataFrame:
        """A step's table: of this run if it is there, else of an earlier one."""
        if name not in self.tables:
            folder = self.path(name).rsplit("/", 1)[0]
            self.tables[name] = load_combined(self.spark, folder, name, f"*_{name}")
        return self.tables[name]

    def path(self, name: str) -> str:
        return f"{self.config.base_dir}/{STEPS.index(name) + 1:02d}_{name}/{name}"

    def beside(self, step: str, name: str) -> str:
        """Where a further output of a step lies."""
        return f"{self.config.base_dir}/{STEPS.index(step) + 1:02d}_{step}/{name}"

    def run(self, from_step: int = 1, to_step: int = 8) -> dict[str, DataFrame]:
        """Write the outputs of the steps in range, one after the other; later steps read what was written."""
        for name in STEPS[max(1, from_step) - 1 : min(8, to_step)]:
            make = {"model": self.run_model}.get(name) or getattr(self, name)
            if name == "metatranscript_positions" and not self.gtf:
                continue
            save_table(make(), self.path(name), by={"calls": ["sample"], "pathway_enrichment": ["library"]}.get(name))
            self.tables[name] = load_table(self.spark, self.path(name))
            for extra, table in self.extras(name).items():
                save_table(table, self.beside(name, extra))
        return {name: table for name, table in self.tables.items() if name in STEPS}


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("config")
    for name, default in (("--from-step", 1), ("--to-step", 8)):
        args.add_argument(name, type=int, default=default)
    args.add_argument("--method", choices=["fisher", "logistic"], default="fisher")
    args.add_argument("--fasta")
    args.add_argument("--gtf")
    args.add_argument("--gmt", action="append", default=[], metavar="NAME=PATH", help="a further gene-set library")
    args.add_argument("--model", choices=["boosting", "forest"], default="boosting")
    args.add_argument("--folds", type=int, default=0)
    given = args.parse_args()
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    done = Pipeline(spark, Config.load(given.config), given.fasta, given.gtf, given.method, given.model, folds=given.folds, gmt=dict(x.split("=", 1) for x in given.gmt)).run(given.from_step, given.to_step)
    print(json.dumps({name: df.count() for name, df in done.items()}))


if __name__ == "__main__":
    main()
