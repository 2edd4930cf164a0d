"""Hard negatives: for each anchor and positive, the best different-label rows within a window of the positive's score.

Rows become integer vectors and are laid along a Hilbert curve within each label, then cut to blocks of
``BLOCK_ROWS`` consecutive rows: one Parquet row each, with the block's least and greatest value in every
dimension beside it (its zone map). For an anchor and a block, interval arithmetic over the zone map
bounds every inner product inside; only blocks whose interval meets one of the anchor's windows are
read. Positives come from the same search with the window that starts at the fifth best score in the anchor's own
block.

Scores are exact integers: products are summed in doubles where every sum stays below 2**53, else in 64-bit
integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import freeing
from strandlake.session import Scratch

BLOCK_ROWS = 256
#: Anchors travel in groups of so many, zone maps in pages of so many blocks.
GROUP, PAGE = 64, 512
#: The curve runs through so many dimensions, those of largest variance, with so many bits each.
CURVE_DIMS, CURVE_BITS = 8, 6
#: Components beyond this are taken as this: the sum of products of up to 2**15 such components fits 64 bits.
LARGEST = 1 << 23
NO_ID = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of every component, in doubles first."""
    bound = float(LARGEST)
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256.0, F.lit(-bound)), F.lit(bound))).cast("int"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points whose coordinates have ``bits`` bits; rows are points (Skilling's transform)."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return place.astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows of ``a`` and ``b``, exactly."""
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def intervals(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product that each anchor can have with a vector between each pair of bounds."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` highest scores stand, equal ones by ascending id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


@dataclass(frozen=True)
class Blocks:
    """``rows``: block, label, n, low, high, ids, vectors (int32, packed). ``anchors``: anchor (its own key), anchor_id, label, vector, least."""

    rows: DataFrame
    anchors: DataFrame
    dims: int


def build(vectors: DataFrame, anchor: Column, scratch: Scratch, k: int = 5) -> Blocks:
    """Blocks of all rows (vec_id, label, vector of integers), and the anchors among them.

    ``least`` is the ``k``-th best score of an anchor with the other rows of its block, null if it has fewer: no
    row under it can be among its first ``k`` positives. Rows of the anchor's own id are not its positives.
    """
    stats = vectors.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("spread"))
    found = sorted((r["pos"], r["mean"], r["spread"] or 0.0) for r in stats.orderBy(F.desc("spread"), "pos").limit(CURVE_DIMS).collect())
    dims = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    axes = [p for p, _, _ in found]
    middle, spread = np.array([m for _, m, _ in found]), np.array([max(s, 1e-9) for _, _, s in found])

    def places(column: pa.Array) -> pa.Array:
        if not axes:
            return pa.array(np.zeros(len(column)), pa.int64())
        x = (matrix(column, dims)[:, axes] - middle) / spread
        cells = np.clip((x + 2.5) / 5 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
        return pa.array(hilbert(cells.astype(np.int64), CURVE_BITS))

    places.__annotations__ = {"column": pa.Array, "return": pa.Array}
    placed = scratch.cut(vectors.withColumn("is_anchor", F.coalesce(anchor, F.lit(False))).withColumn("place", F.arrow_udf(places, "long")("vector")))
    rows = placed.count()
    tasks = max(1, math.ceil(rows / (64 * BLOCK_ROWS)))
    # equal rows of a hot place are dealt by their ids: a range ends anywhere
    ordered = placed.repartitionByRange(tasks, "label", "place", F.xxhash64("vec_id")).sortWithinPartitions("label", "place", "vec_id")
    kinds = "label int, n int, low binary, high binary, ids binary, vectors binary, anchors array<struct<anchor_id: long, vector: binary, least: long>>"
    anchor_type = pa.list_(pa.struct([("anchor_id", pa.int64()), ("vector", pa.binary()), ("least", pa.int64())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(all_of_them: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            label = table["label"].to_numpy()
            v = matrix(pa.concat_arrays([c for c in table["vector"].chunks]), dims)
            ids = table["vec_id"].fill_null(NO_ID).to_numpy()
            anchors = table["is_anchor"].to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.diff(label)) + 1
            done = 0
            for a, b in zip([0, *cuts], [*cuts, len(label)]):
                for at in range(a, b, BLOCK_ROWS):
                    end = min(b, at + BLOCK_ROWS)
                    if end == len(label) and end - at < BLOCK_ROWS and not all_of_them:
                        break
                    yield block(int(label[at]), v[at:end], ids[at:end], np.flatnonzero(anchors[at:end]))
                    done = end
            held[:] = table.slice(done).combine_chunks().to_batches() if done < len(label) else []

        def block(label: int, v: np.ndarray, ids: np.ndarray, anchors: np.ndarray) -> pa.RecordBatch:
            score = products(v[anchors], v)
            own = []
            for i, s in zip(anchors.tolist(), score):
                others = s[ids != ids[i]]
                least = int(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else None
                own.append({"anchor_id": int(ids[i]), "vector": v[i].astype("<i4").tobytes(), "least": least})
            cells = [[label], [len(v)], [v.min(axis=0).astype("<i4").tobytes()], [v.max(axis=0).astype("<i4").tobytes()], [ids.astype("<i8").tobytes()], [v.astype("<i4").tobytes()]]
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cells, types)], pa.array([own], anchor_type)], names=["label", "n", "low", "high", "ids", "vectors", "anchors"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 16 * BLOCK_ROWS:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    packed = ordered.mapInArrow(freeing(pack), kinds)
    # a block's number: its task and its place there, fixed by writing it
    packed = scratch.cut(packed.withColumn("block", F.monotonically_increasing_id()))
    anchors = packed.select("block", "label", F.posexplode("anchors").alias("i", "a")).select(F.concat_ws(":", "block", "i").alias("anchor"), "a.anchor_id", "label", "a.vector", "a.least")
    return Blocks(packed.drop("anchors"), scratch.cut(anchors), dims)


def in_windows(blocks: Blocks, wanted: DataFrame, same_label: bool, k: int, scratch: Scratch) -> DataFrame:
    """(anchor, window, id, score): the ``k`` best rows in each window of each anchor, and no row of the anchor's own id if ``same_label``.

    ``wanted`` has anchor, anchor_id, label, vector and windows, an array of (window, low, high), bounds included.
    """
    dims = blocks.dims
    zones = blocks.rows.select("block", "label", "low", "high")
    n_zones, n_anchors = zones.count(), wanted.count()
    pages, groups = max(1, math.ceil(n_zones / PAGE)), max(1, math.ceil(n_anchors / GROUP))
    paged = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page")).agg(F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))
    grouped = wanted.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("grp")).agg(F.collect_list(F.struct("anchor", "anchor_id", "label", "vector", "windows")).alias("anchors"))
    asked = grouped.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))).join(paged, "page")
    anchor_type = pa.struct([("anchor", pa.string()), ("anchor_id", pa.int64()), ("label", pa.int32()), ("vector", pa.binary()), ("windows", pa.list_(pa.struct([("window", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])))])
    anchor_ddl = "struct<anchor: string, anchor_id: long, label: int, vector: binary, windows: array<struct<window: long, low: long, high: long>>>"

    def numbers(packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), dims).astype(np.int64)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, held = row["anchors"], row["zones"]
                least, most = intervals(numbers([a["vector"] for a in anchors]), numbers([z["low"] for z in held]), numbers([z["high"] for z in held]))
                labels = np.array([z["label"] for z in held])
                need = np.zeros(least.shape, bool)
                for i, a in enumerate(anchors):
                    for w in a["windows"]:
                        need[i] |= (most[i] >= w["low"]) & (least[i] <= w["high"])
                    need[i] &= (labels == a["label"]) == same_label
                for j in np.flatnonzero(need.any(axis=0)).tolist():
                    some = [anchors[i] for i in np.flatnonzero(need[:, j]).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([held[j]["block"]], pa.int64()), pa.array([some], pa.list_(anchor_type))], names=["block", "anchors"])

    chosen = asked.mapInArrow(freeing(choose), f"block long, anchors array<{anchor_ddl}>")
    reads = chosen.join(blocks.rows.select("block", "ids", "vectors"), "block")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], "<i8")
                scores = products(numbers([a["vector"] for a in row["anchors"]]), np.frombuffer(row["vectors"], "<i4").reshape(len(ids), dims).astype(np.int64))
                for a, s in zip(row["anchors"], scores):
                    for w in a["windows"]:
                        good = (s >= w["low"]) & (s <= w["high"])
                        if same_label:
                            good &= ids != a["anchor_id"]
                        if good.any():
                            key = (a["anchor"], w["window"])
                            old = held.get(key, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                            x, y = np.concatenate([old[0], s[good]]), np.concatenate([old[1], ids[good]])
                            top = best(x, y, k)
                            held[key] = (x[top], y[top])
                if len(held) > 50_000:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        flat = [(anchor, window, s, d) for (anchor, window), (scores, ids) in held.items() for s, d in zip(scores.tolist(), ids.tolist())]
        anchor, window, s, d = zip(*flat)
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.string()), pa.array(window, pa.int64()), pa.array([None if x == NO_ID else x for x in d], pa.int64()), pa.array(s, pa.int64())], names=["anchor", "window", "id", "score"])

    found = reads.mapInArrow(freeing(read), "anchor string, window long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label, a null vector or one with a null or non-finite component take no part.
    Shorter vectors count as ended by zeros; components of more than 2**15 in magnitude as 2**15. Null ids are never anchors and come last among
    equal scores. Rows of the anchor's own id are no positives of it; anchors of one id are anchors each. A pair
    without a negative in its window gives no row, and a positive of negative score has none.
    """
    scratch = Scratch()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & usable(F.col("vector"))).withColumn("vector", whole_numbers(F.col("vector")))
    blocks = build(rows, anchor, scratch, positives)
    everything = F.struct(F.lit(0).cast("long").alias("window"), F.coalesce("least", F.lit(-(2**63))).alias("low"), F.lit(2**63 - 1).alias("high"))
    found = in_windows(blocks, blocks.anchors.select("anchor", "anchor_id", "label", "vector", F.array(everything).alias("windows")), True, positives, scratch)
    found = scratch.cut(found.select("anchor", F.col("rank").cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 80 * p <= 100 * s <= 100 * p in whole numbers
    low = F.ceil(F.lit(percent) * F.col("positive_score") / F.lit(100.0))
    low = F.when(F.lit(100) * (low - 1) >= F.lit(percent) * F.col("positive_score"), low - 1).when(F.lit(100) * low < F.lit(percent) * F.col("positive_score"), low + 1).otherwise(low)
    windows = found.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high"))).alias("windows"))
    wanted = scratch.cut(blocks.anchors.join(windows, "anchor").select("anchor", "anchor_id", "label", "vector", "windows"))
    below = in_windows(blocks, wanted, False, negatives, scratch)
    named = below.join(found, ["anchor", "window"]).join(blocks.anchors.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
