"""Tree models on feature rows, their evaluation, and SHAP attributions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import metrics
from strandlake.operators.features import class_balance
from strandlake.session import shared_folder


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    """``features`` as one vector; features that the rows lack are left out."""
    present = [f for f in features if f in rows.columns]
    return VectorAssembler(inputCols=present, outputCol="features").transform(rows)


def weighted(rows: DataFrame, label: str = "label", balanced: bool = False) -> DataFrame:
    """``weight``: positives by the class ratio, or both classes to equal totals."""
    b = class_balance(rows, label).first()
    if b["n_classes"] < 2:
        raise ValueError("training needs rows of both classes")
    n = b["n_pos"] + b["n_neg"]
    pos, neg = (n / (2 * b["n_pos"]), n / (2 * b["n_neg"])) if balanced else (b["scale_pos_weight"], 1.0)
    return rows.withColumn("weight", F.when(F.col(label) == 1, pos).otherwise(neg))


def train_boosting(train: DataFrame, trees: int = 200, depth: int = 6, rate: float = 0.1, seed: int = 42):
    return GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, checkpointInterval=10).fit(weighted(train))


def train_forest(train: DataFrame, trees: int = 200, depth: int = 6, seed: int = 42):
    return RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(weighted(train, balanced=True))


def save_model(spark: SparkSession, model, features: list[str], path: str) -> None:
    """The model in Spark's own format, and the names of its features in their order, under one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(enumerate(features)), "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str):
    """(model, features) of ``save_model``, whichever of the two kinds it is."""
    kind = spark.read.json(f"{path}/model/metadata").first()["class"].rsplit(".", 1)[-1]
    loaders = {"GBTClassificationModel": GBTClassificationModel, "RandomForestClassificationModel": RandomForestClassificationModel}
    features = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    return loaders[kind].load(f"{path}/model"), features


def scored(model, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of class 1 as ``score``."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def evaluate(model, test: DataFrame) -> DataFrame:
    """One row: roc_auc, avg_precision, accuracy, precision, recall and F1 of class 1, and the confusion counts."""
    rows = scored(model, test).select("label", "score")
    return metrics.ranking_metrics(rows).crossJoin(F.broadcast(metrics.confusion(rows)))


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def cross_validate(rows: DataFrame, fit, key: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """ROC AUC of every fold; folds take turns in each label's hash order."""
    order = Window.partitionBy("label", F.pmod(F.xxhash64(*key), F.lit(64))).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    dealt = rows.withColumn("_fold", F.pmod(F.row_number().over(order) + F.xxhash64(*key), F.lit(folds)))
    out = None
    for k in range(folds):
        model = fit(dealt.where(F.col("_fold") != k))
        one = metrics.ranking_metrics(scored(model, dealt.where(F.col("_fold") == k)).select("label", "score")).select(F.lit(k).alias("fold"), "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out


# --- SHAP ---------------------------------------------------------------------------------------


def tree_arrays(spark: SparkSession, model) -> list[dict]:
    """The trees of a Spark tree ensemble as arrays: child indices, features, thresholds, values, cover, weight.

    Read from the node table of the saved model, whose size is the model's.
    """
    boosted = "GBT" in type(model).__name__
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: list[list[dict]] = [[] for _ in model.treeWeights]
    for r in sorted(rows, key=lambda r: (r["treeID"], r["id"])):
        stats, inner = list(r["impurityStats"]), r["leftChild"] >= 0
        trees[r["treeID"]].append(
            {
                "left": r["leftChild"] if inner else -1,
                "right": r["rightChild"] if inner else -1,
                "feature": r["split"]["featureIndex"] if inner else -1,
                "threshold": float(r["split"]["leftCategoriesOrThreshold"][0]) if inner else 0.0,
                "value": float(r["prediction"]) if boosted else stats[1] / max(sum(stats), 1e-300),
                "cover": stats[0] if boosted else sum(stats),
            }
        )
    return [{"nodes": nodes, "weight": float(w) if boosted else float(w) / model.getNumTrees} for nodes, w in zip(trees, model.treeWeights, strict=True)]


@dataclass(frozen=True)
class LeafPaths:
    """The leaves of a tree and the distinct features on their paths, in slots.

    ``feature``, ``low``, ``high`` and ``zero`` are (leaves, slots): a row keeps to a slot's branch if its feature lies
    in (low, high], and ``zero`` is the share of the cover that does. An empty slot keeps every row.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    zero: np.ndarray

    @classmethod
    def of(cls, nodes: list[dict]) -> LeafPaths:
        found: list[tuple[float, dict[int, tuple[float, float, float]]]] = []
        open_nodes: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while open_nodes:
            at, path = open_nodes.pop()
            node = nodes[at]
            if node["left"] < 0:
                found.append((node["value"], path))
                continue
            f, limit = node["feature"], node["threshold"]
            low, high, zero = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["left"], (low, min(high, limit))), (node["right"], (max(low, limit), high))):
                share = nodes[child]["cover"] / max(node["cover"], 1e-300)
                open_nodes.append((child, path | {f: (*bounds, zero * share)}))
        slots = max(1, max(len(path) for _, path in found))
        shape = (len(found), slots)
        feature, low, high, zero = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
        for i, (_, path) in enumerate(found):
            for j, (f, (a, b, z)) in enumerate(path.items()):
                feature[i, j], low[i, j], high[i, j], zero[i, j] = f, a, b, max(z, 1e-200)
        return cls(np.array([v for v, _ in found]), feature, low, high, zero)


def tree_shap(nodes: list[dict], x: np.ndarray, paths: LeafPaths | None = None) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of one tree for the rows of ``x``, and the tree's expectation.

    Every leaf pays its value to the features on its path: to feature f the integral over t from 0 to 1 of (one - zero) of f
    times the product of zero (1 - t) + one t over the other features. The product over all of them is formed once
    at each node of a quadrature that is exact for its degree, and divided by f's own factor: the work is linear
    in the features of a path.
    """
    p = paths or LeafPaths.of(nodes)
    n_leaves, slots = p.feature.shape
    at, weight = np.polynomial.legendre.leggauss((slots + 1) // 2)
    at, weight = (at + 1) / 2, weight / 2
    phi = np.zeros(x.shape)
    for start in range(0, len(x), 256):
        v = x[start : start + 256].T[p.feature]
        # not a number keeps right of every threshold
        low, high = p.low[:, :, None], p.high[:, :, None]
        one = ((low == -np.inf) | ~(v <= low)) & ((high == np.inf) | (v <= high))
        zero = p.zero[:, :, None]
        share = np.zeros(v.shape)
        for t, w in zip(at, weight):
            factor = zero * (1 - t) + one * t
            share += w * factor.prod(axis=1, keepdims=True) / factor
        paid = (p.value[:, None, None] * share * (one - zero)).reshape(n_leaves * slots, -1)
        np.add.at(phi[start : start + 256].T, p.feature.ravel(), paid)
    return phi, float((p.value * p.zero.prod(axis=1)).sum())


def shap_values(model, rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, shap, feature_values, base): SHAP of the raw margin (boosting) or of the probability (forest)."""
    return shap_of_trees(tree_arrays(rows.sparkSession, model), rows.select(key, vector_to_array("features").alias("x")), key)


def shap_of_trees(trees: list[dict], rows: DataFrame, key: str) -> DataFrame:
    """(key, shap, feature_values, base) of rows (key, x) under weighted trees.

    The trees' leaf paths are laid out once and broadcast (their size is the model's); rows are explained batch by batch.
    """
    held = rows.sparkSession.sparkContext.broadcast([(t["weight"], LeafPaths.of(t["nodes"])) for t in trees])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            phi, base = np.zeros(x.shape), 0.0
            for weight, paths in held.value:
                own, expected = tree_shap([], x, paths)
                phi += weight * own
                base += weight * expected
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(phi.tolist(), pa.list_(pa.float64())), batch.column("x"), pa.array([base] * len(x))], names=[key, "shap", "feature_values", "base"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x").mapInArrow(run, f"{key} {kind}, shap array<double>, feature_values array<double>, base double")


def explain_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A fixed sample of n rows: the first by a hash of the key."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def shap_long(shap: DataFrame, features: list[str], key: str) -> DataFrame:
    """(key, feature, shap_value, feature_value)."""
    names = F.array(*map(F.lit, features))
    zipped = F.arrays_zip(names.alias("feature"), F.col("shap").alias("shap_value"), F.col("feature_values").alias("feature_value"))
    return shap.select(key, F.explode(zipped).alias("_z")).select(key, "_z.*")


def global_importance(long: DataFrame) -> DataFrame:
    """Mean absolute SHAP of each feature with its rank."""
    means = long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))


def local_explanations(shap: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n rows of the largest SHAP sum."""
    total = F.aggregate("shap", F.lit(0.0), lambda a, v: a + v)
    top = shap.withColumn("shap_sum", total).orderBy(F.desc("shap_sum"), key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("shap_sum"), key)))


def wide_explanations(explained: DataFrame, features: list[str]) -> DataFrame:
    """The rows of ``local_explanations`` with a column ``shap_{feature}`` and ``value_{feature}`` for each feature in place of the arrays."""
    wide = [F.get(c, F.lit(i)).alias(f"{prefix}_{f}") for prefix, c in (("shap", "shap"), ("value", "feature_values")) for i, f in enumerate(features)]
    return explained.select(*[c for c in explained.columns if c not in ("shap", "feature_values")], *wide)


def importance_table(importance: DataFrame, value: str = "mean_abs_shap", n: int | None = None, digits: int = 4) -> DataFrame:
    """Display form of an importance table, largest first: the first ``n`` features, or all, with formatted values."""
    rows = importance.orderBy(F.desc(value), "feature")
    rows = rows if n is None else rows.limit(n)
    return rows.select("feature", F.format_number(value, digits).alias(value), *[c for c in importance.columns if c not in ("feature", value)])


def dependence(long: DataFrame, n: int = 5) -> DataFrame:
    """The rows of the n most important features."""
    top = global_importance(long).where(F.col("rank") <= n).select("feature", "rank")
    return long.join(F.broadcast(top), "feature")
