"""The analysis from alignments to enrichment on made-up reads."""

import random

from pyspark.sql import functions as F

from strandlake.operators import ml as models
from strandlake.plans.pipeline import STEPS, Pipeline
from strandlake.sources.results import Config, load_combined


def test_all_steps(spark, tmp_path):
    rng = random.Random(1)
    for sample, low in (("c", 0), ("t", 128)):
        with open(tmp_path / f"{sample}.sam", "w") as out:
            out.write("@HD\tVN:1.6\n")
            for i in range(900):
                gene = i % 3
                ml = ",".join(str(255 if rng.random() < (0.1 if gene == 0 or low == 0 else 0.8) else 10) for _ in range(4))
                out.write("\t".join([f"r{i}", "0", f"chr{gene}", "101", "60", "12M", "*", "0", "0", "AGGACTAACAGA", "*", "MM:Z:A+a.,0,0,1,0;", f"ML:B:C,{ml}"]) + "\n")
    with open(tmp_path / "g.gtf", "w") as out:
        for k, name in enumerate(("TP53", "BAX", "XYZ")):
            tail = f'gene_id "G{k}"; gene_name "{name}"; gene_type "protein_coding"; transcript_id "T{k}";'
            for feature, a, b in (("gene", 95, 120), ("transcript", 95, 120), ("UTR", 95, 104), ("CDS", 105, 110), ("UTR", 111, 120)):
                out.write(f"chr{k}\ts\t{feature}\t{a}\t{b}\t.\t+\t.\t{tail}\n")
    (tmp_path / "g.fa").write_text("".join(f">chr{k}\n{'ACGT' * 25}AGGACTAACAGA{'ACGT' * 5}\n" for k in range(3)))
    config = Config({s: {"sam": str(tmp_path / f"{s}.sam")} for s in "ct"}, [("c", "t")], base_dir=str(tmp_path / "results_x"))
    line = Pipeline(spark, config, str(tmp_path / "g.fa"), str(tmp_path / "g.gtf"), trees=3, folds=2)
    done = line.run()
    assert list(done) == STEPS
    assert done["calls"].count() == 2 * 900 * 4 and done["stoichiometry"].count() == 2 * 12
    found = done["differential"]
    assert found.count() == 12 and found.where("is_significant").count() == 8 and found.where("direction = 'increased'").count() == 8
    matrix = done["feature_matrix"].collect()
    assert {r.pathway_annotation for r in matrix} == {"apoptosis", "other"} and any(r.drach_motif for r in matrix) and all(r.gc_content > 0 for r in matrix)
    assert {r.region for r in done["metatranscript_positions"].collect()} == {"5UTR", "CDS"}
    assert done["model"].count() == 1 and done["shap"].count() > 10
    assert {r.pathway for r in done["pathway_enrichment"].collect()} == {"Apoptosis"}
    beside = lambda step, name: spark.read.parquet(f"{line.beside(step, name)}.parquet")
    assert beside("differential", "significant_sites").count() == 8 and beside("differential", "volcano").count() == 12
    assert beside("model", "curve_points").count() > 0 and beside("model", "cross_validation").count() == 2
    assert beside("model", "train_data").count() + beside("model", "test_data").count() == 12
    model, names = models.load_model(spark, line.beside("model", "boosting"))
    assert beside("model", "importances").count() == len(names) and model.getNumTrees == 3
    assert {r.feature for r in beside("shap", "dependence").select("feature").distinct().collect()} <= set(names)
    assert beside("shap", "local_explanations").count() > 0 and beside("shap", "importance_table").count() == len(names)
    seen = {r["sample"]: r for r in beside("calls", "read_counters").collect()}
    assert set(seen) == {"c", "t"} and seen["c"].total_reads == seen["c"].mapped_with_mods == 900 and seen["t"].cell_line == "x"
    # chunks of calls in place of reads give the same sites
    for k in range(2):
        done["calls"].where("sample = 'c'").where(F.crc32("read_id") % 2 == k).write.parquet(str(tmp_path / f"chunks/c_chunk_{k}.parquet"))
    chunked = Pipeline(spark, Config({"c": {"calls": str(tmp_path / "chunks")}, "t": config.samples["t"]}, [("c", "t")], base_dir=str(tmp_path / "results_y")))
    sites = lambda rows: sorted((r["sample"], r.reference_name, r.ref_pos, r.total_reads, r.modified_reads) for r in rows.collect())
    assert sites(chunked.run(1, 2)["stoichiometry"]) == sites(done["stoichiometry"])
    assert beside("pathway_enrichment", "first_page").count() == 8 and "Apoptosis" in beside("pathway_enrichment", "context").first().context
    (tmp_path / "own.gmt").write_text("Mine\td\tTP53\tXYZ\n")
    both = Pipeline(spark, config, gmt={"own": str(tmp_path / "own.gmt")}).run(7, 7)["pathway_enrichment"]
    assert {(r.library, r.pathway) for r in both.collect()} == {("curated", "Apoptosis"), ("own", "Mine")}
    again = Pipeline(spark, config, method="logistic", trees=3)
    assert list(again.run(3, 3)) == ["stoichiometry", "differential"]
    # step 6 by itself explains the model that is there
    before = sorted(map(tuple, done["shap"].collect()))
    assert sorted(map(tuple, Pipeline(spark, config, trees=99).run(6, 6)["shap"].collect())) == before


def test_combined_or_single_files(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}_differential.csv").write_text(f"site,{name}\n{value},x\n")
    got = load_combined(spark, str(tmp_path), "all_results", "*_differential")
    assert sorted(got.columns) == ["a", "b", "site"] and got.count() == 2
    spark.range(3).write.parquet(str(tmp_path / "all_results.parquet"))
    assert load_combined(spark, str(tmp_path), "all_results", "*_differential").count() == 3


def test_model_queries_train_the_whole_model(spark, monkeypatch):
    from strandlake.plans import queries

    data, seen = "/root/testdata/sf0.001", []

    def fit(train, trees, depth):
        seen.append((trees, depth, train.first().features.size))
        raise StopIteration

    for kind in ("train_boosting", "train_forest"):
        monkeypatch.setattr(queries.ml, kind, fit)
    monkeypatch.setattr(queries, "_TRAINED", {})
    for name in ("boosting_metrics", "forest_metrics", "forest_importances", "shap_global", "shap_local"):
        try:
            queries.QUERIES[name](spark, data)
        except StopIteration:
            pass
    size = len(spark.read.parquet(f"{data}/embeddings.parquet").first().embedding)
    assert seen == [(200, 6, size)] * 5
