"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with equal sets are one representative. Trees
branch representatives recursively: a node picks a few minwise functions by its own seed (one over
the threshold on average) and deals its members to children by those minima, so a similar pair is
expected to stay together in about one child. Small nodes are compared exhaustively on full sets.
Independent trees are repeated until a pair at the threshold is missed with negligible chance.

Links join components, and from then on only members of different components are compared: a node
within one component is done. The first tree is finished before the others begin, so that groups of
copies are one component each by the time the other trees meet them. What a node costs is the number
of its pairs outside its largest component. One that costs too much for a single group is compared
block against block, which is exact, up to ``reach`` times that cost: members just short of the
threshold stay together however far a node branches. A node beyond is compared in blocks, which
links most of its members, and by the heads of the components that meet in it; if it still costs as
much it branches on, and at the depth limit is finished block against block as well.

Before texts are fetched, sketches leave out pairs whose likeness is four standard deviations under
the threshold; those that stay are confirmed on full sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import BROADCAST_ROWS, batch_slices, bounded, component_table, free_name, freeing, join_unique
from strandlake.session import Scratch, cut

#: A worker's table of shingle sets is emptied beyond so many entries: a bound on memory alone.
SET_MEMO = 2_000_000
#: Words are hashed in pieces of about so many bytes, and minima taken of so many shingles at a time: both fit a core's cache.
PIECE, SKETCH_ROWS = 200_000, 1024
#: ASCII white space; which bytes belong to words; a random number for each byte, the same for A-Z and a-z.
BLANK = re.compile(rb"[\t-\r ]")
WORD_BYTE = np.array([not BLANK.match(bytes([b])) for b in range(256)])
BYTE_NUMBERS = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)[list(bytes(range(256)).lower())]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class JoinSettings:
    """``width`` words a shingle; linked with ``100 * intersection >= percent * union``.

    ``trees`` and ``functions`` set recall. ``pair_limit`` is the cost and ``row_limit`` the size up to
    which a node is one group; up to ``reach`` times that cost its blocks of about ``finish_block`` meet
    each other. A larger one is cut to blocks of about ``block`` and branches by ``levels`` more,
    ``rounds`` times at most.
    """

    width: int = 5
    percent: int = 80
    trees: int = 10
    functions: int = 64
    levels: int = 2
    pair_limit: int = 1_000_000
    reach: int = 16
    row_limit: int = 1024
    block: int = 64
    finish_block: int = 512
    rounds: int = 6

    @property
    def least(self) -> int:
        """The matches of two sketches below which no pair is at the threshold, but for one in tens of thousands."""
        p = self.percent / 100
        return max(1, math.floor(self.functions * p - 4 * math.sqrt(self.functions * p * (1 - p))))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    with np.errstate(over="ignore"):
        x = x + _MIX[2]
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of a text in UTF-8, A-Z as a-z.

    A word's hash is the mixed sum of its bytes' numbers, each times a number of its place in the word.
    Texts are taken in pieces that end between words, so that what is held is a few times a piece.
    """
    found, at = [], 0
    while at < len(data):
        end = BLANK.search(data, at + PIECE)
        stop = end.end() if end else len(data)
        piece = np.frombuffer(data, np.uint8, stop - at, at)
        edge = np.diff(np.concatenate([[False], WORD_BYTE[piece], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(starts):
            sizes = ends - starts
            first = np.cumsum(sizes) - sizes
            letters = piece[WORD_BYTE[piece]]
            place = np.arange(len(letters)) - np.repeat(first, sizes)
            with np.errstate(over="ignore"):
                found.append((mix(np.add.reduceat(BYTE_NUMBERS[letters] * (mix(np.arange(sizes.max(), dtype=np.uint64)) | np.uint64(1))[place], first)), starts + at))
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; words are runs without ASCII white space."""

    def __init__(self, width: int):
        self.width = width

    def runs(self, h: np.ndarray, size: int) -> np.ndarray:
        """The hashes of all runs of ``size`` of the words ``h``."""
        n = max(0, len(h) - size + 1)
        out = np.full(n, size, np.uint64)
        for k in range(size if n else 0):
            out = mix(out ^ h[k : k + n])
        return out

    def many(self, texts: list[str]) -> list[np.ndarray]:
        bodies = [t.encode("utf-8", "surrogatepass") for t in texts]
        h, at = word_hashes(b"\n".join(bodies))
        ends = np.searchsorted(at, np.cumsum([len(b) + 1 for b in bodies])).tolist()
        every, out = self.runs(h, self.width), []
        for a, b in zip([0, *ends], ends):
            own = np.sort(every[a : b - self.width + 1] if b - a >= self.width else self.runs(h[a:b], b - a))
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else np.zeros(0, np.uint64))
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@cache
def multipliers(functions: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray, functions: int) -> bytes:
    """The minimum of each function over the set, 32 bits each."""
    a = multipliers(functions)
    best = np.full(functions, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), SKETCH_ROWS):
            best = np.minimum(best, (hashes[at : at + SKETCH_ROWS, None] * a[None, :]).min(axis=0))
    return (best >> np.uint64(32)).astype("<u4").tobytes()


def fingerprints(docs: DataFrame, s: JoinSettings) -> DataFrame:
    """(doc, mark, n_shingles, sig, sketch) of (doc, mark, text): equal sets have equal sig; no sketch for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(s.width)
        for batch in batches:
            for part, texts in batch_slices(batch, "text"):
                out: tuple[list, ...] = ([], [], [])
                for x in shingle.many(texts):
                    for column, value in zip(out, (len(x), xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None, sketch(x, s.functions) if len(x) else None)):
                        column.append(value)
                found = [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("mark"), *found], names=["doc", "mark", "n_shingles", "sig", "sketch"])

    return docs.mapInArrow(freeing(run), "doc long, mark long, n_shingles long, sig string, sketch binary")


def descend(nodes: np.ndarray, sketches: np.ndarray, s: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, member): the member's row and the child. Every node picks one function, and a second one with the chance that makes 1/threshold of them."""
    rows, n = np.arange(len(nodes)), np.uint64(s.functions)
    first, more = mix(nodes), mix(nodes ^ _MIX[0])
    second = (more >> np.uint64(11)).astype(float) / 2**53 < 100 / s.percent - 1
    picks = np.concatenate([first % n, (mix(more) % n)[second]]).astype(np.int64)
    who = np.concatenate([rows, rows[second]])
    with np.errstate(over="ignore"):
        child = mix(mix(nodes[who] ^ (picks.astype(np.uint64) + np.uint64(1)) * _MIX[1]) + sketches[who, picks].astype(np.uint64))
    return who, child


def branched(rows: DataFrame, s: JoinSettings, trees: Sequence[int] = ()) -> DataFrame:
    """(node, rep, label) some levels down, from (rep, label, sketch) at the roots of ``trees``, or else (node, rep, label, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "label"))
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(len(reps), s.functions)
            if trees:
                at = np.repeat(np.arange(len(reps)), len(trees))
                nodes = mix(np.tile(np.array(trees, np.uint64) + np.uint64(1), len(reps)))
            else:
                at, nodes = np.arange(len(reps)), batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
            for _ in range(s.levels):
                who, nodes = descend(nodes, sketches[at], s)
                at = at[who]
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(reps[at]), pa.array(labels[at])], names=["node", "rep", "label"])

    return rows.mapInArrow(run, "node long, rep long, label long")


def by_group(batches: Iterator[pa.RecordBatch], columns: Sequence[str], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of each run of rows with one key."""
    held, group = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for k, *row in zip(*[part.column(c).to_pylist() for c in (key, *columns)], strict=True):
                if k != held:
                    if group:
                        yield held, group
                    held, group = k, []
                group.append(tuple(row))
    if group:
        yield held, group


def candidate_pairs(labels: np.ndarray, sketches: np.ndarray, s: JoinSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, matches), in parts, of the pairs with different labels whose sketches allow a link; each pair once.

    Members of the commonest label are compared with the others only.
    """
    values, counts = np.unique(labels, return_counts=True)
    others = np.flatnonzero(labels != values[counts.argmax()])
    rank = np.full(len(labels), -1)
    rank[others] = np.arange(len(others))
    step = max(1, 500_000 // len(labels))
    columns = np.ascontiguousarray(sketches.T)
    for at in range(0, len(others), step):
        own = others[at : at + step]
        matches = np.zeros((len(own), len(labels)), np.uint8)
        for f in range(s.functions):
            matches += columns[f, own, None] == columns[f]
        # a pair of two others counts at the later one
        allowed = (matches >= s.least) & (labels[own, None] != labels[None, :]) & (rank[None, :] < rank[own, None])
        i, j = np.nonzero(allowed)
        yield own[i], j, matches[i, j]


def candidates(groups: DataFrame, s: JoinSettings) -> DataFrame:
    """The rows of groups (cid, rep, label, sketch) that have a partner among the others of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, group in by_group(batches, ("rep", "label", "sketch"), "cid"):
            if len(group) < 2:
                continue
            sketches = np.frombuffer(b"".join([g[2] for g in group]), "<u4").reshape(len(group), s.functions)
            keep = np.zeros(len(group), bool)
            for i, j, _ in candidate_pairs(np.array([g[1] for g in group]), sketches, s):
                keep[i] = keep[j] = True
            kept = [group[k] for k in np.flatnonzero(keep)]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([cid] * len(kept), pa.int64()), *[pa.array(v, t) for v, t in zip(zip(*kept), (pa.int64(), pa.int64(), pa.binary()))]], names=["cid", "rep", "label", "sketch"])

    return groups.repartition("cid").sortWithinPartitions("cid").mapInArrow(freeing(run), "cid long, rep long, label long, sketch binary")


def linked(group: list[tuple[int, bytes, str]], shingle: Shingler, s: JoinSettings) -> list[tuple[int, int]]:
    """Links that join the group's components as all its candidate pairs would: (label, sketch, text) in, (label, label) out."""
    labels = np.array([g[0] for g in group])
    sketches = np.frombuffer(b"".join([g[1] for g in group]), "<u4").reshape(len(group), s.functions)
    component = labels.copy()
    sets: dict[int, np.ndarray] = {}
    held = 0

    def members(which: list[int]) -> list[np.ndarray]:
        nonlocal held
        if held > SET_MEMO:
            sets.clear()
            held = 0
        new = [i for i in which if i not in sets]
        for i, x in zip(new, shingle.many([group[i][2] for i in new])):
            sets[i] = x
            held += len(x)
        return [sets[i] for i in which]

    def near(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(y) for y in others])
        flat = np.concatenate(others)
        starts = np.cumsum(sizes) - sizes

        def enough(found: np.ndarray) -> np.ndarray:
            both = np.add.reduceat(found, starts, dtype=np.int64)
            return 100 * both >= s.percent * (len(x) + sizes - both)

        # low bits in common bound the intersection from above; few pairs are left to be confirmed
        low = np.uint64((1 << min(22, len(x).bit_length() + 6)) - 1)
        taken = np.zeros(int(low) + 1, bool)
        taken[x & low] = True
        allowed = enough(taken[flat & low])
        if allowed.any():
            allowed = enough(np.repeat(allowed, sizes) & (x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat))
        return allowed

    out = []
    for left, right, matches in candidate_pairs(labels, sketches, s):
        starts = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else []
        for a, b in zip(starts, [*starts[1:], len(left)]):
            i = left[a]
            # the likeliest partners first: those of a component that has been joined need no look
            todo, take = right[a:b][np.argsort(-matches[a:b].astype(np.int64), kind="stable")], 4
            while len(todo := todo[component[todo] != component[i]]):
                now, todo = todo[:take], todo[take:]
                x, *others = members([i, *now.tolist()])
                for j in now[near(x, others)].tolist():
                    one, two = component[i], component[j]
                    if one != two:
                        component[component == max(one, two)] = min(one, two)
                        out.append((int(labels[i]), int(labels[j])))
                take = min(4 * take, 256)
    return out


def compared(kept: DataFrame, texts: DataFrame, s: JoinSettings) -> DataFrame:
    """(a, b) links between labels, of candidates (cid, rep, label, sketch) whose texts are in ``texts`` (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(s.width)
        for _, group in by_group(batches, ("label", "sketch", "text"), "cid"):
            if found := linked(group, shingle, s):
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], names=["a", "b"])

    whole = kept.join(texts, "rep").select("cid", "label", "sketch", "text")
    return whole.repartition("cid").sortWithinPartitions("cid").mapInArrow(freeing(run), "a long, b long")


def blocks(members: DataFrame, s: JoinSettings) -> DataFrame:
    """The members of nodes (node, rep, n, label), each node cut to blocks of about ``s.block``."""
    place = F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("n") / s.block))
    return members.select(F.xxhash64("node", place).alias("cid"), "rep", "label")


def block_pairs(members: DataFrame, s: JoinSettings) -> DataFrame:
    """Groups in which every two members of a node with different labels meet, of (node, rep, label, n, most, main).

    The ``most`` members with a node's commonest label ``main`` are linked already: their blocks meet
    those of the others, not each other. The others' blocks also meet among themselves.
    """
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    a, b = F.ceil(F.col("most") / s.finish_block), F.ceil((F.col("n") - F.col("most")) / s.finish_block)
    main, place = F.col("label") == F.col("main"), F.xxhash64("rep", "node")
    x, y = F.pmod(place, a), F.pmod(place, b)
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("x"), b.alias("y"))
    across = F.when(main, F.transform(upto(b), lambda j: key("across", x, j))).otherwise(F.transform(upto(a), lambda i: key("across", i, y)))
    among = F.when(main, F.expr("cast(array() as array<struct<kind:string,x:bigint,y:bigint>>)")).otherwise(F.transform(upto(b), lambda j: key("among", F.least(y, j), F.greatest(y, j))))
    spread = members.select("node", "rep", "label", F.explode(F.concat(across, among)).alias("_k"))
    return spread.select(F.xxhash64("node", "_k.kind", "_k.x", "_k.y").alias("cid"), "rep", "label")


class Labels:
    """The component of each representative, as links come in: a table of those that are not their own."""

    def __init__(self, scratch: Scratch):
        self.table, self.rows, self.cut = None, 0, scratch.cut

    def add(self, links: DataFrame) -> bool:
        """Join the components that ``links`` (a, b) name; false if there are none."""
        if links.isEmpty():
            return False
        joined, n = component_table(links)
        moved = joined.where("node != component").select(F.col("node").alias("rep"), F.col("component").alias("label"))
        if self.table is not None:
            known = self.table.withColumnRenamed("label", "node")
            if n > BROADCAST_ROWS:
                joined = self.cut(joined.join(known.groupBy("node").agg(F.count("*").alias("_held")), "node"))
            held = join_unique(known, joined, "node", F.col("rep"), "_held", rows=n)
            moved = moved.unionByName(held.select("rep", F.coalesce("component", "node").alias("label")))
        self.table = self.cut(moved)
        self.rows = self.table.count()
        return True

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the label of their rep as it is now; a rep has few rows, one for each node it is in."""
        rows = rows.drop("label")
        if self.table is None:
            return rows.withColumn("label", F.col("rep"))
        return rows.join(bounded(self.table, self.rows), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def classes(docs: DataFrame, s: JoinSettings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc, mark, n_shingles, sig) of every row, and (sig, first, rows) of the classes of more than one row with a bound of their number.

    ``mark`` is a hash of the text, which with the id names a row; ``first`` is the struct of the
    smallest id of a class (null ids last) and its mark, ``rows`` counts the class.
    """
    scratch = Scratch()
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    base = cut(fingerprints(keyed, s))
    row = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")
    reps = base.where("sig is not null").groupBy("sig").agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    reps = scratch.cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    labels = Labels(scratch)
    texts: list[DataFrame] = []

    def compare(groups: DataFrame) -> None:
        """Link what the groups (cid, rep, label) hold; only candidates have their texts fetched, once for each."""
        kept = scratch.cut(candidates(groups.join(reps.select("rep", "sketch"), "rep").select("cid", "rep", "label", "sketch"), s))
        if kept.isEmpty():
            return
        needed = kept.select("rep").distinct()
        if texts:
            needed = needed.join(reduce(DataFrame.unionByName, texts).select("rep"), "rep", "left_anti")
        wanted = scratch.cut(reps.join(needed, "rep").select("rep", F.col("first.doc").alias("_doc"), F.col("first.mark").alias("_mark")))
        same = (F.col("mark") == F.col("_mark")) & F.col("doc").eqNullSafe(F.col("_doc"))
        texts.append(scratch.cut(keyed.join(bounded(wanted, wanted.count()), same).dropDuplicates(["rep"]).select("rep", "text")))
        labels.add(scratch.cut(compared(kept, reduce(DataFrame.unionByName, texts), s)))

    def mixed(rows: DataFrame) -> DataFrame:
        """(node, rep, label, n, most, main) of the nodes that hold members of different components: their members and those of the commonest label."""
        counts = rows.groupBy("node", "label").agg(F.count("*").alias("c")).groupBy("node")
        top = F.max(F.struct("c", "label"))
        sizes = scratch.cut(counts.agg(F.sum("c").alias("n"), top.getField("c").alias("most"), top.getField("label").alias("main"), F.count("*").alias("_labels")).where("_labels > 1").drop("_labels"))
        return scratch.cut(join_unique(rows.select("node", "rep", "label"), sizes, "node", F.col("rep"), "n", "inner", sizes.count()))

    def search(rows: DataFrame) -> None:
        """Resolve the nodes of ``rows`` (node, rep, label)."""
        cost = (F.col("n") - F.col("most")) * F.col("n")
        small, wide = (cost <= s.pair_limit) & (F.col("n") <= s.row_limit), cost > s.reach * s.pair_limit

        def whole(members: DataFrame) -> DataFrame:
            """Groups of the nodes that are compared as a whole."""
            return members.where(small).select(F.col("node").alias("cid"), "rep", "label").unionByName(block_pairs(members.where(~small & ~wide), s))

        for turn in range(s.rounds + 1):
            members = mixed(scratch.cut(rows))
            left = members.where(wide)
            compare(whole(members).unionByName(blocks(left, s)))
            if left.isEmpty():
                return
            # the heads of the components that meet in a node, compared in blocks of their own
            named = scratch.cut(labels.of(left.select("node", "rep")))
            heads = named.select(F.xxhash64("node", F.lit("heads")).alias("node"), F.col("label").alias("rep"), "label").distinct()
            compare(blocks(heads.join(heads.groupBy("node").agg(F.count("*").alias("n")), "node"), replace(s, block=s.row_limit)))
            left = mixed(labels.of(named.select("node", "rep")))
            if left.isEmpty():
                return
            compare(whole(left))
            left = left.where(wide)
            if left.isEmpty():
                return
            if turn == s.rounds:
                return compare(block_pairs(left, s))
            rows = branched(left.join(reps.select("rep", "sketch"), "rep").select("node", "rep", "label", "sketch"), s)

    for trees in ([0], [*range(1, s.trees)]):
        if trees:
            search(branched(labels.of(reps.select("rep", "sketch")).select("rep", "label", "sketch"), s, trees))

    named = scratch.cut(labels.of(reps.select("sig", "rep", "first", "copies")))
    joined = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("rows"), F.count("*").alias("_held")).where("rows > 1")
    found = cut(join_unique(named.select("sig", "label", "copies"), scratch.cut(joined), "label", F.col("sig"), "_held", "inner").select("sig", "first", "rows", "copies"))
    n = found.count()
    scratch.clear()
    return base.select("doc", "mark", "n_shingles", "sig"), found, n


def near_duplicates(docs: DataFrame, settings: JoinSettings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Null and empty texts, and texts of white space, have the empty set and link with nothing. Equal
    sets are always linked. Rows that repeat an id are rows of their own, with texts and components of
    their own. A null id links like any other, but names a component (null) only where all its
    members have none; kept is null-safe equality of id and component. An empty table gives no rows.
    """
    base, found, n = classes(docs, settings or JoinSettings(), id_col, text_col)
    joined = join_unique(base, found, "sig", F.col("mark"), "copies", rows=n)
    component = F.when(F.col("first").isNull(), F.col("doc")).otherwise(F.col("first.doc"))
    return joined.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, settings: JoinSettings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that with the smallest id, null ids last.

    Of rows that repeat this id, that with the smallest hash of its text stays, and one of those equal
    in id and text. Rows with an empty set all stay.
    """
    base, found, n = classes(docs, settings or JoinSettings(), id_col, text_col)
    own = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")
    inside = join_unique(base, found, "sig", F.col("mark"), "copies", "inner", n).groupBy("doc", "mark", (own == F.col("first")).alias("first")).agg(F.count("*").alias("_rows"))
    # a row goes if it isn't its class's first, or if rows equal to that one repeat it: of those, one comes back
    goes = cut(inside.where(~F.col("first") | (F.col("_rows") > 1)))
    key, mark = free_name(docs, "_doc"), free_name(docs, "_mark")
    marked = docs.withColumns({key: F.col(id_col).cast("long"), mark: F.xxhash64(text_col)})
    same = F.col(key).eqNullSafe(F.col("doc")) & (F.col(mark) == F.col("mark"))
    stay = marked.join(bounded(goes.select("doc", "mark"), goes.count()), same, "left_anti")
    again = goes.where("first").select("doc", "mark")
    if not again.isEmpty():
        stay = stay.unionByName(marked.join(bounded(again, again.count()), same, "left_semi").dropDuplicates([key, mark]))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
