"""What the corpus operators share: Arrow mapping over texts, joins that survive a hot key,
and connected components of a link table."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.session import cut

#: Rows of a batch are handed to Python code in slices of about so many bytes.
SLICE_BYTES = 4_000_000
#: A key is hot with more than one row in so many of a table, and with more rows than the least figure.
HOT_SHARE, LEAST_HOT = 20_000, 2000
#: A key with more rows than this is dealt to several tasks, each of about so many of its rows.
HOT_ROWS = 100_000
#: A table of numbers is broadcast only when counted to have no more rows than this (a few MB).
BROADCAST_ROWS = 100_000

_ARROW = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
    "array<bigint>": pa.list_(pa.int64()),
}


def fields(ddl: str) -> list[T.StructField]:
    return T._parse_datatype_string(ddl).fields if isinstance(ddl, str) else list(ddl)


def release() -> None:
    """Hand the memory that a task has freed back to the system: Python workers live on for tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with ``release`` at its end."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column in runs of about ``SLICE_BYTES``, each with its first row; null is the empty text.

    Runs are cut by the column's own offsets: only one of them at a time exists as Python strings.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def batch_slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows of a batch in such runs, with their texts."""
    for start, texts in slices(batch.column(text_col)):
        yield batch.slice(start, len(texts)), texts


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_struct_by_text(df: DataFrame, text_col: str, ddl: str, make: Callable[[], Callable[[list[str]], Sequence[list]]]) -> tuple[DataFrame, str]:
    """``df`` with one more column, a struct of ``ddl`` computed from whole texts, and that column's name.

    ``make`` runs once in each task and returns a function from a list of texts to one list of
    values for each field of ``ddl``; what it holds goes with the task. Rows, their order and the
    other columns stay in the JVM: Python gets texts and returns the new fields alone.
    """
    new = fields(ddl)
    kinds = [_ARROW[f.dataType.simpleString()] for f in new]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for column in columns:
            for _, texts in slices(column):
                yield pa.StructArray.from_arrays([pa.array(v, type=k) for v, k in zip(apply(texts), kinds, strict=True)], names=[f.name for f in new])
            if not len(column):
                yield pa.StructArray.from_arrays([pa.array([], type=k) for k in kinds], names=[f.name for f in new])

    run = freeing(run)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # marked as not deterministic, a filter on its result can't move below and run it twice
    found = F.arrow_udf(run, T.StructType(new)).asNondeterministic()
    held = free_name(df, "_found")
    return df.withColumn(held, found(F.col(text_col))), held


def append_by_text(df: DataFrame, text_col: str, ddl: str, make: Callable[[], Callable[[list[str]], Sequence[list]]]) -> DataFrame:
    """``df`` with columns computed from whole texts; a column of the same name gives way."""
    new = fields(ddl)
    names = {f.name.lower() for f in new}
    found, held = with_struct_by_text(df, text_col, ddl, make)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return found.select(*kept, *[F.col(held)[f.name].alias(f.name) for f in new])


def filter_by_text(df: DataFrame, text_col: str, ddl: str, make: Callable[[], Callable[[list[str]], Sequence[list]]], test: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose computed fields pass ``test``."""
    found, held = with_struct_by_text(df, text_col, ddl, make)
    return found.where(test(F.col(held))).select(*[F.col(f"`{c}`") for c in df.columns])


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """``small``, to be broadcast if its proven bound of rows is within ``BROADCAST_ROWS``."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def join_unique(big: DataFrame, small: DataFrame, key: str, spread: Column, held: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join to ``small``, which has each key once; its column ``held`` counts the rows of ``big`` under a key.

    ``rows``, if given, is a proven bound of its rows: up to ``BROADCAST_ROWS`` it is broadcast.
    Otherwise a key with more than one row in ``HOT_SHARE`` of all is dealt to as many tasks as it has
    such shares, so at most ``HOT_SHARE`` keys are, and their list is broadcast. ``spread`` decides a
    row's task among them and must be deterministic; rows without a key go by it as well. ``small``
    is read twice and should be a written table.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    total, most = small.agg(F.coalesce(F.sum(held), F.lit(0)), F.coalesce(F.max(held), F.lit(0))).first()
    share = max(LEAST_HOT, total // HOT_SHARE)
    left, right = big.withColumn("_parts", F.lit(1)), small.withColumn("_salt", F.lit(0).cast("long"))
    if most > share:
        parts = F.ceil(F.col(held) / share)
        left = big.join(F.broadcast(small.where(F.col(held) > share).select(key, parts.alias("_parts"))), key, "left")
        right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)))
    place = F.xxhash64(spread)
    salt = F.when(F.col(key).isNull(), place).otherwise(F.pmod(place, F.coalesce("_parts", F.lit(1))))
    return left.withColumn("_salt", salt).drop("_parts").join(right, [key, "_salt"], how).drop("_salt")


def join_counted(big: DataFrame, small: DataFrame, key: str, spread: Column, counts: DataFrame, how: str = "left") -> DataFrame:
    """Join to ``small``, which has each key once, with hot keys dealt to as many tasks as their rows need.

    ``counts`` has the rows of ``big`` under each key. Only keys of more than ``HOT_ROWS`` rows are
    dealt, by ``spread``, which must be deterministic; there is at most one such key for each ``HOT_ROWS``
    rows of ``big``, so their list is broadcast.
    """
    hot = F.broadcast(counts.where(F.col("rows") > HOT_ROWS).select(key, F.ceil(F.col("rows") / HOT_ROWS).alias("_parts")))
    left = big.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0)).cast("long")).drop("_parts")
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) in, (node, component) of all of them out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["node", "component"])


def component_table(links: DataFrame, max_rounds: int = 40) -> tuple[DataFrame, int]:
    """(node, component) for every node of ``links`` (a, b), the smallest node reachable, and a bound of its rows.

    Up to ``BROADCAST_ROWS`` different links are joined by one task. More go through alternating
    large-star and small-star steps, one written table a round; the links stay distributed, and hubs
    are salted while there are more nodes than may be broadcast. An empty link table gives an empty
    result.
    """

    def smaller_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")

    def with_least(e: DataFrame, nodes: int) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_held"))
        return join_unique(e, least if nodes <= BROADCAST_ROWS else cut(least), "u", F.col("v"), "_held", "inner", nodes)

    def measured(e: DataFrame) -> tuple[int, int]:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = cut(smaller_first(links).distinct())
    state = measured(edges)
    if state[0] <= BROADCAST_ROWS:
        found = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).repartition(1).mapInArrow(joined_in_task, "node long, component long")
        return cut(found), 2 * state[0]
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * state[0]).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        star = with_least(cut(smaller_first(large)), 2 * state[0])
        small = star.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(star.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(smaller_first(small).distinct())
        before, state = state, measured(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
    return found, 2 * state[0]


def connected_components(links: DataFrame) -> DataFrame:
    return component_table(links)[0]
