"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits unit vectors again and again at random hyperplanes; vectors near a hyperplane go
to both sides, so that a similar pair rarely parts. Splits follow from the tree, the level and the
node alone: no state is fitted, every row is indexed. Within a leaf all pairs are verified by cosine
in double precision, and a pair that shares several leaves counts in the first of them. Leaves that
are too large for a task are compared block against block, which is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import connected_components, join_unique
from strandlake.llm.neardup import mix
from strandlake.session import cut


@dataclass(frozen=True)
class ForestSettings:
    """``spill`` is the half width of a split's overlap as a share of the projected distance of a
    pair at the threshold; ``leaf`` the size at which splitting stops, ``leaf_limit`` that up to
    which a leaf is compared in one go."""

    min_cosine: float = 0.9
    trees: int = 6
    leaf: int = 256
    leaf_limit: int = 1024
    spill: float = 0.35


def leaves(unit: np.ndarray, levels: int, s: ForestSettings) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every vector in every tree; leaves of one tree order before those of the next."""
    n, d = unit.shape
    margin = s.spill * math.sqrt(2 - 2 * s.min_cosine) / math.sqrt(d)
    rows_out, leaves_out = [], []
    for tree in range(s.trees):
        rows, nodes = np.arange(n), np.full(n, d * 1000 + tree, np.uint64)
        for level in range(levels):
            direction = np.random.default_rng([d, tree, level]).standard_normal(d)
            direction /= np.linalg.norm(direction)
            # a node's hyperplane lies off the centre by a part of the spread that its own number gives
            offset = ((mix(nodes ^ np.uint64(level)) >> np.uint64(11)).astype(float) / 2**53 - 0.5) * 0.5 / math.sqrt(d)
            side = (unit @ direction)[rows] - offset
            left, right = side < margin, side > -margin
            with np.errstate(over="ignore"):
                nodes = np.concatenate([mix(nodes[left] * np.uint64(2)), mix(nodes[right] * np.uint64(2) + np.uint64(1))])
            rows = np.concatenate([rows[left], rows[right]])
        rows_out.append(rows)
        leaves_out.append((nodes >> np.uint64(8)).astype(np.int64) | (np.int64(tree) << np.int64(56)))
    return np.concatenate(rows_out), np.concatenate(leaves_out)


def forest(reps: DataFrame, levels: int, s: ForestSettings) -> DataFrame:
    """(leaf, rep, copies, vector, all_leaves): one row for each leaf that holds the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            values = batch.column("embedding").to_pylist()
            for i, v in enumerate(values):
                by_dim.setdefault(len(v), []).append(i)
            reps_in, copies = batch.column("rep").to_pylist(), batch.column("copies").to_pylist()
            for own in by_dim.values():
                raw = np.array([values[i] for i in own], np.float64)
                rows, at = leaves(raw / np.linalg.norm(raw, axis=1, keepdims=True), levels, s)
                order = np.lexsort((at, rows))
                rows, at = rows[order], at[order]
                starts = np.searchsorted(rows, np.arange(len(own) + 1))
                held = [at[a:b].tobytes() for a, b in zip(starts, starts[1:])]
                bodies = [x.astype("<f8").tobytes() for x in raw]
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(at[a : a + 4096]),
                            pa.array([reps_in[own[r]] for r in part], pa.int64()),
                            pa.array([copies[own[r]] for r in part], pa.int64()),
                            pa.array([bodies[r] for r in part], pa.binary()),
                            pa.array([held[r] for r in part], pa.binary()),
                        ],
                        names=["leaf", "rep", "copies", "vector", "all_leaves"],
                    )

    return reps.mapInArrow(run, "leaf long, rep long, copies long, vector binary, all_leaves binary")


def leaf_links(leaf: int, rows: list[tuple], cross: bool, min_cosine: float) -> tuple[list[int], list[int], list[int]]:
    """(a, b, n): link counts as (a, a, n), and links that join the leaf's components as (a, b, 0)."""
    reps = np.array([r[0] for r in rows])
    copies = np.array([r[1] for r in rows])
    part = np.array([r[4] for r in rows])
    unit = np.stack([np.frombuffer(r[2], "<f8") for r in rows])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    held = [np.frombuffer(r[3], "<i8") for r in rows]
    table = np.full((len(rows), max(map(len, held))), -1, np.int64)
    for i, h in enumerate(held):
        table[i, : len(h)] = h
    counts = np.zeros(len(rows), np.int64)
    parent = np.arange(len(rows))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(0, len(rows), 256):
        i, j = np.nonzero(unit[a : a + 256] @ unit.T >= min_cosine)
        i = i + a
        keep = (i < j) & ((part[i] != part[j]) if cross else True)
        i, j = i[keep], j[keep]
        for b in range(0, len(i), 4096):
            x, y = i[b : b + 4096], j[b : b + 4096]
            same = (table[x][:, :, None] == table[y][:, None, :]) & (table[x] >= 0)[:, :, None]
            first = np.where(same.any(axis=2), table[x], np.iinfo(np.int64).max).min(axis=1) == leaf
            x, y = x[first], y[first]
            np.add.at(counts, x, copies[y])
            np.add.at(counts, y, copies[x])
            for p, q in zip(x.tolist(), y.tolist()):
                p, q = root(p), root(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for k in range(len(rows)):
        for values, use in (((reps[k], reps[k], counts[k]), counts[k] > 0), ((reps[k], reps[root(k)], 0), root(k) != k)):
            if use:
                for column, value in zip(out, values):
                    column.append(int(value))
    return out


def near_vectors(vectors: DataFrame, settings: ForestSettings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Null, empty and zero vectors and such with null or non-finite components link with nothing;
    vectors of different lengths are never compared. Equal vectors are one representative with a
    count, and all linked. An empty table gives no rows.
    """
    s = settings or ForestSettings()
    raw = F.col(vector_col)
    base = vectors.select(F.col(id_col).cast("long").alias("vec"), F.transform(raw, lambda x: x.cast("double")).alias("embedding"))
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    base = base.withColumn("valid", F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    reps = cut(base.where("valid").groupBy("embedding").agg(F.min("vec").alias("rep"), F.count("*").alias("copies")))
    levels = max(0, math.ceil(math.log2(max(1, reps.count()) / s.leaf)))
    rows = forest(reps, levels, s)
    large = cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > s.leaf_limit))
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / s.leaf_limit)
    placed = rows.join(large, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("rep", "leaf"), blocks))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    paired = paired.select("leaf", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rep", "copies", "vector", "all_leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                found = leaf_links(key[0], group, key[1] != key[2], s.min_cosine)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "n"])

        for batch in batches:
            for leaf, x, y, *row in zip(*[batch.column(c).to_pylist() for c in ("leaf", "x", "y", "rep", "copies", "vector", "all_leaves", "part")], strict=True):
                if (leaf, x, y) != key:
                    yield from flush()
                    key, group = (leaf, x, y), []
                group.append(tuple(row))
        yield from flush()

    found = cut(paired.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y").mapInArrow(run, "a long, b long, n long"))
    degrees = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    labels = connected_components(found.where("a != b").select("a", "b")).withColumnRenamed("node", "rep")
    classes = reps.join(degrees, "rep", "left").join(labels, "rep", "left").where("copies > 1 or links is not null")
    classes = cut(classes.select("embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    # what can't be linked has no key
    keyed = base.withColumn("embedding", F.when(F.col("valid"), F.col("embedding")))
    joined = join_unique(keyed, classes, "embedding", F.col("vec"), "copies")
    component = F.coalesce("component", "vec")
    return joined.select(F.col("vec").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec") == component).alias("kept"))
