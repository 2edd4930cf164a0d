"""Tables of earlier runs: Parquet or CSV by name, absent ones as empty tables, and their sinks."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandlake.operators.sites import normalize_columns
from strandlake.sources.stores import discard, replace_folder, restore, staging_of

CALLS = "sample string, read_id string, reference_name string, ref_pos long, mod_type string, mod_code string, probability double, strand string"


#: Conditions that end a sample's name, and names that are only a condition.
CONDITIONS = ("_normoxia_plasma", "_hypoxia_plasma", "_plasma_normoxia", "_plasma_hypoxia", "_normoxia", "_hypoxia", "_plasma", "_treated", "_untreated")
NOT_NAMES = ("untreated", "plasma", "plasma_treated")


@dataclass
class Config:
    """What a run needs to know, with the defaults of the fixed pipeline."""

    samples: dict = field(default_factory=dict)
    comparisons: list[tuple[str, str]] = field(default_factory=list)
    modification_probability: int = 191
    min_coverage: int = 10
    fdr_threshold: float = 0.05
    min_delta_stoichiometry: float = 0.10
    base_dir: str = "results"

    @classmethod
    def of(cls, raw: dict) -> Config:
        t = raw.get("thresholds", {})
        known = {k: t[k] for k in ("modification_probability", "min_coverage", "fdr_threshold", "min_delta_stoichiometry") if k in t}
        return cls(raw.get("samples", {}), [(c["control"], c["treatment"]) for c in raw.get("comparisons", [])], base_dir=raw.get("output", {}).get("base_dir", "results"), **known)

    @classmethod
    def load(cls, path: str) -> Config:
        """From JSON, or from YAML where that library is installed."""
        text = open(path, encoding="utf-8").read()
        if path.endswith(".json"):
            return cls.of(json.loads(text))
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configurations need the yaml package; JSON works without") from e
        return cls.of(yaml.safe_load(text) or {})

    def cell_line(self) -> str:
        """The name in the results folder, else what the sample names share before their conditions."""
        _, found, rest = self.base_dir.partition("results_")
        if found and rest.strip("/\\") not in ("", "results"):
            return rest.strip("/\\")
        ends = {s: max((len(c) for c in CONDITIONS if s.endswith(c)), default=0) for s in self.samples}
        names = sorted({s[: len(s) - n] for s, n in ends.items()} - set(NOT_NAMES))
        return os.path.commonprefix(names).rstrip("_") or "results"


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet at ``path`` if it is there, else CSV."""
    for name in dict.fromkeys((path if path.endswith(".parquet") else f"{path}.parquet", path)):
        if name.endswith(".parquet"):
            restore(name)
        try:
            return spark.read.parquet(name)
        except AnalysisException:
            continue
    csv = spark.read.option("header", True)
    return (csv.schema(schema) if schema else csv.option("inferSchema", True)).csv(path if path.endswith(".csv") else f"{path}.csv")


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at ``path``, or no rows of ``schema`` where there is none."""
    try:
        return load_table(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_combined(spark: SparkSession, folder: str, combined: str, parts: str) -> DataFrame:
    """The combined table of a folder if there is one, else all tables there that match ``parts``, by column name.

    Files of one pattern differ in columns at most by some that are absent: those are null.
    """
    try:
        return load_table(spark, f"{folder}/{combined}")
    except AnalysisException:
        pass
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{folder}/{parts}.parquet")
    except AnalysisException:
        files = [r["path"] for r in spark.read.format("binaryFile").load(f"{folder}/{parts}.csv").select("path").orderBy("path").collect()]
        if not files:
            raise
        return union_tables([spark.read.option("header", True).option("inferSchema", True).csv(f) for f in files])


def load_json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def load_calls(spark: SparkSession, folder: str, sample: str) -> DataFrame:
    """A sample's calls: its single table if there is one, else its numbered chunks."""
    for name in (f"{sample}_modifications.parquet", f"{sample}_chunk_*.parquet"):
        try:
            return normalize_columns(spark.read.parquet(f"{folder}/{name}"))
        except AnalysisException:
            continue
    return spark.read.schema(CALLS).option("header", True).csv(f"{folder}/{sample}_modifications.csv")


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def save_table(df: DataFrame, path: str, csv: bool = False, rows_per_file: int | None = None, by: list[str] | None = None) -> None:
    """Parquet, replaced whole, with CSV beside it on request. Partition columns prune later reads.

    A table is written to a folder beside its place and takes it only when it is whole: a job that is killed leaves
    the old one readable, even if it is what ``df`` reads.
    """
    for suffix, kept in ((".parquet", by), *([(".csv", None)] if csv else [])):
        restore(f"{path}{suffix}")
        staged = staging_of(f"{path}{suffix}")
        writer = df.write.partitionBy(*kept) if kept else df.write
        if rows_per_file and suffix == ".parquet":
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        try:
            writer.parquet(staged) if suffix == ".parquet" else writer.option("header", True).csv(staged)
        except BaseException:
            discard(staged)
            raise
        replace_folder(staged, f"{path}{suffix}")


def result_folders(root: str) -> list[str]:
    """Folders named results* that hold numbered step folders, under ``root`` on the driver's file system."""
    return sorted(d for d, names, _ in os.walk(root) if os.path.basename(d).startswith("results") and any(n.startswith("0") for n in names))
