"""Ranked lexical search through K2-treaps over the grid of terms and documents.

Each run of documents is a grid: a row for each of its terms in order, a column for each document.
A quadtree halves the grid in both directions down to cells of ``LEAF`` by ``LEAF``; each cell that is not empty
stores which quarters hold something and the highest impact inside, cells of a level in Morton
order. A query item follows the paths of all its rows at once: an entry is a range of documents
with the cells that the item's rows have there, and the sum of their maxima, weighted, bounds the score of
any document in it. Entries are opened best first until no bound reaches the item's twentieth score.

Scores are integers: ``weight * (10**9 * tf // (1000 * tf + 12 * m))`` summed over the item's terms, with ``m`` the
document's length norm. The second factor is the impact; the weight needs the whole table's counts and
comes in when an item is asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import BROADCAST_ROWS, freeing, slices
from strandlake.session import Scratch, seen_by, session_with

#: Every byte but ASCII letters and digits and those of other characters separates terms; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Side of the smallest cells, a power of two; their entries are listed.
LEAF_BITS = 3
LEAF = 1 << LEAF_BITS
#: A run of documents is closed at so many bytes of text; a longer text is a run by itself.
RUN_BYTES = 2_000_000
#: A run's treap is some 7 MB: Spark reads a row group whole, and hands tasks all rows of a batch at once.
ONE_A_GROUP, ONE_A_BATCH = {"parquet.block.row.count.limit": "1"}, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: So many entries of an item are opened at a time.
BEAM = 48
#: Stands for a null id: after all others.
NO_ID = np.iinfo(np.int64).max
INDEX = "n_docs long, bits int, terms binary, term_ends binary, term_df binary, ids binary, masks array<binary>, tops array<binary>, leaf_starts binary, leaf_at binary, leaf_tf binary, norms binary"


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the text that each stands in."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw).translate(_FOLD) + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])[:-1]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    return words, np.searchsorted(begins, starts, "right") - 1


def spread_bits(x: np.ndarray) -> np.ndarray:
    """The bits of ``x`` (below 2**31) at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def norms_of(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The length norm m of each document."""
    return 75 + np.array([25 * int(x) * n // total for x in lengths], np.int64) if len(lengths) else np.zeros(0, np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def build(words: pa.Array, doc_of: np.ndarray, ids: np.ndarray, n: int, total: int) -> dict | None:
    """The treap of a run of documents; None if it has no term.

    Columns are ordered by a document's most frequent term, then its length: neighbours share a language
    and a length, which makes the maxima of a range say more.
    """
    if not len(words):
        return None
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row_of = rank[coded.indices.to_numpy()]
    lengths = np.bincount(doc_of, minlength=len(ids))
    pairs, tf = np.unique(doc_of * len(order) + row_of, return_counts=True)
    doc, row = np.divmod(pairs, len(order))
    by_tf = np.lexsort((row, -tf, doc))
    first = by_tf[np.concatenate([[True], doc[by_tf][1:] != doc[by_tf][:-1]])]
    lead = np.full(len(ids), -1)
    lead[doc[first]] = row[first]
    columns = np.lexsort((ids, lengths, lead))
    place = np.empty(len(ids), np.int64)
    place[columns] = np.arange(len(ids))
    col = place[doc]
    norms = norms_of(lengths[columns], n, total)
    bits = max(LEAF_BITS, int(max(len(order), len(ids)) - 1).bit_length())
    code = (spread_bits(row) << np.uint64(1)) | spread_bits(col)
    by_code = np.argsort(code, kind="stable")
    code, row, col, tf = code[by_code], row[by_code], col[by_code], tf[by_code]
    cell = code >> np.uint64(2 * LEAF_BITS)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    keys, top = cell[starts], np.maximum.reduceat(impacts(tf, norms[col]), starts)
    masks, tops = [], [top.astype("<i4").tobytes()]
    for _ in range(bits - LEAF_BITS):
        cell = keys >> np.uint64(2)
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (keys & np.uint64(3)).astype(np.uint8), begin).tobytes())
        keys, top = cell[begin], np.maximum.reduceat(top, begin)
        tops.append(top.astype("<i4").tobytes())
    names = coded.dictionary.take(pa.array(order))
    return {
        "n_docs": len(ids),
        "bits": bits,
        "terms": b"".join(names.to_pylist()),
        "term_ends": np.cumsum(pc.binary_length(names).to_numpy()).astype("<i8").tobytes(),
        "term_df": np.bincount(row, minlength=len(order)).astype("<i8").tobytes(),
        "ids": ids[columns].astype("<i8").tobytes(),
        # from the root down
        "masks": masks[::-1],
        "tops": tops[::-1],
        "leaf_starts": np.append(starts, len(tf)).astype("<i4").tobytes(),
        "leaf_at": (((row & (LEAF - 1)) << LEAF_BITS) | (col & (LEAF - 1))).astype(np.uint8).tobytes(),
        "leaf_tf": tf.astype("<i4").tobytes(),
        "norms": norms.astype("<i8").tobytes(),
    }


def term_names(row: dict) -> list[bytes]:
    ends = np.frombuffer(row["term_ends"], "<i8").tolist()
    return [row["terms"][a:b] for a, b in zip([0, *ends], ends)]


_SET_BITS = np.array([x.bit_count() for x in range(16)], np.int64)


class Treap:
    """One run's treap, read back."""

    def __init__(self, row: dict):
        self.bits, self.n_docs = row["bits"], row["n_docs"]
        self.rows = {t: i for i, t in enumerate(term_names(row))}
        self.masks = [np.frombuffer(b, np.uint8) for b in row["masks"]]
        self.tops = [np.frombuffer(b, "<i4").astype(np.int64) for b in row["tops"]]
        self.below = [np.concatenate([[0], np.cumsum(_SET_BITS[m])]) for m in self.masks]
        self.starts = np.frombuffer(row["leaf_starts"], "<i4").astype(np.int64)
        self.at, self.tf = np.frombuffer(row["leaf_at"], np.uint8), np.frombuffer(row["leaf_tf"], "<i4")
        self.norms, self.ids = np.frombuffer(row["norms"], "<i8"), np.frombuffer(row["ids"], "<i8")

    def search(self, wanted: list[tuple[bytes, int]], top: Top) -> None:
        """Offer every document whose score may belong to the best. ``wanted`` has each term's weight times its count in the item."""
        known = [(self.rows[t], w) for t, w in wanted if t in self.rows and w]
        if not known:
            return
        rows, weight = (np.array(x, np.int64) for x in zip(*known))
        q, depth = len(rows), self.bits - LEAF_BITS
        # the open entries of each level: bound, first document in cells of the level, and each row's cell or -1
        waiting = [[np.zeros((0,), np.int64), np.zeros((0,), np.int64), np.zeros((0, q), np.int64)] for _ in range(depth + 1)]
        waiting[0] = [np.array([int((self.tops[0][0] * weight).sum())]), np.zeros(1, np.int64), np.zeros((1, q), np.int64)]
        while True:
            best = [int(x[0].max()) if len(x[0]) else -1 for x in waiting]
            level = max(range(depth + 1), key=lambda i: (best[i], i))
            if best[level] < max(1, top.least):
                return
            bound, place, cells = waiting[level]
            live = bound >= max(1, top.least)
            if not live.all():
                bound, place, cells = bound[live], place[live], cells[live]
            if len(bound) > BEAM:
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(-bound, BEAM)[:BEAM]] = True
                waiting[level] = [bound[~chosen], place[~chosen], cells[~chosen]]
                place, cells = place[chosen], cells[chosen]
            else:
                waiting[level] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, q), np.int64)]
            if level == depth:
                self.offer(rows, weight, place, cells, top)
                continue
            half = (rows >> (self.bits - level - 1)) & 1
            for side in (0, 1):
                quarter = (half << 1) | side
                # a missing cell reads the last one's mask: it is masked out again
                mask = self.masks[level][cells]
                here = (cells >= 0) & ((mask >> quarter) & 1).astype(bool)
                child = np.where(here, self.below[level][cells] + _SET_BITS[mask & ((1 << quarter) - 1)], -1)
                limit = (np.where(here, self.tops[level + 1][child], 0) * weight).sum(axis=1)
                good = limit >= max(1, top.least)
                if good.any():
                    old = waiting[level + 1]
                    waiting[level + 1] = [np.concatenate([old[0], limit[good]]), np.concatenate([old[1], 2 * place[good] + side]), np.concatenate([old[2], child[good]])]

    def offer(self, rows: np.ndarray, weight: np.ndarray, place: np.ndarray, cells: np.ndarray, top: Top) -> None:
        """The exact scores of the documents of some smallest ranges."""
        entry, term = np.nonzero(cells >= 0)
        cell = cells[entry, term]
        first, size = self.starts[cell], self.starts[cell + 1] - self.starts[cell]
        which = np.repeat(np.arange(len(cell)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        own = (self.at[at] >> LEAF_BITS) == (rows[term[which]] & (LEAF - 1))
        which, at = which[own], at[own]
        slot = entry[which] * LEAF + (self.at[at] & (LEAF - 1))
        doc = place[entry[which]] * LEAF + (self.at[at] & (LEAF - 1))
        score = np.zeros(len(place) * LEAF, np.int64)
        np.add.at(score, slot, weight[term[which]] * impacts(self.tf[at].astype(np.int64), self.norms[doc]))
        hit = np.flatnonzero(score)
        top.add(score[hit], self.ids[(place[:, None] * LEAF + np.arange(LEAF)).ravel()[hit]])


class Top:
    """The best ``k`` scores so far; equal ones by ascending id. ``least`` is what a document needs to come in."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.least = int(self.scores[-1])


@dataclass(frozen=True)
class Index:
    """The treaps (one row a run of documents), the number of documents with a term, and of all terms."""

    runs: DataFrame
    n: int
    total: int


def counts(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """N and L of the whole table: one row of two numbers for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                words, doc_of = terms_of(texts)
                n, total = n + len(np.unique(doc_of)), total + len(words)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    found = docs.select(text_col).mapInArrow(freeing(run), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return found["n"] or 0, found["total"] or 0


def index(docs: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> Index:
    """Index every document. Null and empty texts have no term and no entry; equal ids are documents of their own, null ids come last."""
    n, total = counts(docs, text_col)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        ids: list[np.ndarray] = []
        size = docs_so_far = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal size, docs_so_far
            if held:
                row = build(pa.concat_arrays([w for w, _ in held]), np.concatenate([d for _, d in held]), np.concatenate(ids), n, total)
                held.clear(), ids.clear()
                size = docs_so_far = 0
                if row:
                    yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for start, texts in slices(batch.column(0)):
                words, doc_of = terms_of(texts)
                held.append((words, doc_of + docs_so_far))
                ids.append(pc.fill_null(batch.column(1).slice(start, len(texts)).cast(pa.int64()), NO_ID).to_numpy())
                docs_so_far += len(texts)
                size += len(words.buffers()[2] or b"")
                if size >= RUN_BYTES:
                    yield from closed()
        yield from closed()

    return Index(scratch.cut(docs.select(text_col, id_col).mapInArrow(freeing(run), INDEX), **ONE_A_GROUP), n, total)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, n): each item's different terms with their counts; items without a term are not there.

    ``item`` numbers nothing: it is a hash of id and text, so equal rows are one item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                words, doc_of = terms_of(texts)
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(start, len(texts)).take(pa.array(doc_of)), words.cast(pa.binary())], names=["item", "term"])

    keyed = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    keyed = keyed.select(F.sha2(F.concat_ws("\0", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256).alias("item"), "item_id", "text")
    split = keyed.select("item", "text").mapInArrow(run, "item string, term binary").groupBy("item", "term").agg(F.count("*").alias("n"))
    return split.join(keyed.select("item", "item_id").distinct(), "item")


def search(items: DataFrame, docs: Index, scratch: Scratch, item_col: str = "item_id", text_col: str = "text", k: int = 20, chunk: int = 512) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Equal scores go by ascending doc_id, null last; ranks of rows with equal score and id are theirs in any
    order. Items travel in chunks of ``chunk``, each asked of every run; the best of all runs that a task
    reads go on. Items without a term, and an empty table, give no row.
    """
    found = scratch.cut(item_terms(items, item_col, text_col))
    n_terms = found.select("term").distinct().count()
    wanted = found.select("term").distinct()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(term_names(row), pa.binary()), pa.array(np.frombuffer(row["term_df"], "<i8"))], names=["term", "df"])

    every = docs.runs.select("terms", "term_ends", "term_df").mapInArrow(frequencies, "term binary, df long")
    asked = every.join(F.broadcast(wanted) if n_terms <= BROADCAST_ROWS else wanted, "term", "left_semi")
    df = asked.groupBy("term").agg(F.sum("df").alias("df"))

    weigh = F.floor(1000 * F.log(F.lit(2.0 * docs.n + 2) / (2 * F.col("df") + 1)))
    weighed = found.join(df, "term").select("item", "item_id", F.struct("term", (weigh * F.col("n")).alias("w")).alias("t"))
    grouped = weighed.groupBy("item", "item_id").agg(F.collect_list("t").alias("ts"))
    n_items = found.select("item").distinct().count()
    n_chunks = max(1, math.ceil(n_items / chunk))
    packed = grouped.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(n_chunks))).groupBy("chunk").agg(F.collect_list(F.struct("item", "item_id", "ts")).alias("items"))
    own = session_with(found.sparkSession, **ONE_A_BATCH)
    packed = seen_by(own, scratch.cut(packed))
    asked_runs = seen_by(own, docs.runs).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))))
    joined = asked_runs.join(F.broadcast(packed) if n_terms <= BROADCAST_ROWS and n_items <= 10 * chunk else packed, "chunk")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[str, tuple[int | None, Top]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                treap = Treap(row)
                for item in row["items"]:
                    top = tops.setdefault(item["item"], (item["item_id"], Top(k)))[1]
                    treap.search([(t["term"], t["w"]) for t in item["ts"]], top)
                if len(tops) > BROADCAST_ROWS:
                    yield from rows(tops)
                    tops = {}
        yield from rows(tops)

    def rows(tops: dict[str, tuple[int | None, Top]]) -> Iterator[pa.RecordBatch]:
        held = [(item, item_id, d, s) for item, (item_id, top) in tops.items() for d, s in zip(top.ids.tolist(), top.scores.tolist())]
        if held:
            item, item_id, d, s = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(item_id, pa.int64()), pa.array([None if x == NO_ID else x for x in d], pa.int64()), pa.array(s, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    best = seen_by(found.sparkSession, scratch.cut(joined.mapInArrow(freeing(descend), "item string, item_id long, doc_id long, score long")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
