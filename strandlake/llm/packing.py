"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents become token ids with an end mark and are cut to pieces of at most one sequence. Only the
histogram (one count for each length) reaches the driver. There the longest lengths are placed
first, each into the packs with most room left, and packs of one make are counted together as a
pattern. Patterns go back to the pieces by their rank among the pieces of one length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.bpe import tokenizer
from strandlake.llm.common import batch_slices, bounded, freeing
from strandlake.session import cut

#: Ranks within one length are counted in parts of about so many pieces, so that a hot length takes as many tasks as it needs.
RANK_ROWS = 20_000


#: Fixed value: the byte-level tokenizer's split of a text into pieces, in a form that never backtracks.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Within these characters both libraries agree what a letter, a digit and a space are.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")
#: A run without a space, or of spaces, from which the merging of one piece grows with its square.
LONG_RUN = 2000
LONG_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(own))
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a byte-level BPE as little-endian bytes.

    Texts of common characters go to a merger by ranks, which is several times faster than the
    tokenizer's own library and gives the same ids; texts with other characters, special tokens or
    very long runs go to that library.
    """

    def __init__(self, path: str):
        self.t = tokenizer(path)
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.fast = self.by_ranks(json.load(open(path, encoding="utf-8")))

    def by_ranks(self, spec: dict):
        """The merger by ranks, or None where ids don't follow the order of the merges."""
        model, split, bytes_of = spec["model"], spec.get("pre_tokenizer") or {}, byte_of()
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        special = set(self.special)
        names = [t for t in model["vocab"] if t not in special]
        if not plain or [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))) or len(names) != 256 + len(merged):
            return None
        import tiktoken

        ranks = {bytes(bytes_of[c] for c in t): model["vocab"][t] for t in names}
        return tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def simple(self, text: str) -> bool:
        return bool(COMMON.fullmatch(text)) and not any(s in text for s in self.special) and max(map(len, text.split()), default=0) < LONG_RUN and not LONG_SPACE.search(text)

    def ids(self, text: str) -> bytes:
        if self.fast and self.simple(text):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes() if text else b""


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces(docs: DataFrame, path: str, end_id: int = 1, room: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document with its end mark, cut every ``room`` ids.

    Null and empty texts are the end mark alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part, texts in batch_slices(batch, text_col):
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, t in zip(part.column(id_col).to_pylist(), texts):
                    ids = encoder.ids(t) + end
                    for at in range(0, len(ids), 4 * room):
                        own = ids[at : at + 4 * room]
                        for column, value in zip(out, (i, at // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        # the vocabulary is read again in a second; kept, it would stay in every worker
        byte_encoder.cache_clear()
        tokenizer.cache_clear()

    return docs.select(id_col, text_col).mapInArrow(freeing(task), f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], room: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with their counts: every piece of the histogram in exactly one slot."""
    by_space: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    spaces: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        space = room - sum(pattern)
        if not by_space[space]:
            heappush(spaces, -space)
        by_space[space][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while spaces and not by_space[-spaces[0]]:
                heappop(spaces)
            if not spaces or -spaces[0] < length:
                # as many new packs as the rest of this length fills; the loop puts the rest into them
                new = -(-left // (room // length))
                put((length,), new)
                left -= new
                continue
            most = by_space[-spaces[0]]
            pattern, n = next(iter(most.items()))
            took = min(n, left)
            if took == n:
                del most[pattern]
            else:
                most[pattern] -= took
            put((*pattern, length), took)
            left -= took
    return [(p, n) for space in sorted(by_space) for p, n in sorted(by_space[space].items())]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): which ranks of a length a slot takes."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return out


def runs(table: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Slots with their number of sequences; neighbouring slots of one length in the same sequences are one row."""
    out: list[tuple[int, int, int, int, int, int]] = []
    for length, a, b, sequence, offset in table:
        last = out[-1] if out else None
        if last and (last[0], last[2], last[3], last[4] + length * ((last[2] - last[1]) // last[5])) == (length, a, sequence, offset):
            out[-1] = (length, last[1], b, sequence, last[4], last[5])
        else:
            out.append((length, a, b, sequence, offset, b - a))
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, room: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset. Sequences number from 0; an empty table gives no rows.

    Null ids and repeated rows are packed like any other. Three small tables meet the pieces: the parts of each
    length (at most ``room`` rows), the counts by length and part, and the counted slots; each is broadcast
    only within ``BROADCAST_ROWS``.
    """
    spark = docs.sparkSession
    whole = cut(pieces(docs, path, end_id, room, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in whole.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = {length: -(-n // RANK_ROWS) for length, n in histogram.items()}
    parted = spark.createDataFrame(sorted(parts.items()), "length long, _parts long")
    cuts = whole.join(bounded(parted, len(parts)), "length").withColumn("_part", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("_parts"))).drop("_parts")
    by_part = cuts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    found = runs(slots(pack_histogram(histogram, room)))
    table = spark.createDataFrame(found, "length long, _from long, _to long, _sequence long, _offset long, _n long")
    before = by_part.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = cuts.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_part").orderBy(id_col, "start", "ids_crc32")))
    ranked = ranked.join(bounded(before, sum(parts.values())), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    placed = ranked.join(bounded(table, len(found)), "length").where("_rank >= _from and _rank < _to")
    at = F.col("_rank") - F.col("_from")
    # ranks go through the sequences once for each piece of this length in a sequence
    placed = placed.withColumns({"sequence_id": F.col("_sequence") + at % F.col("_n"), "offset": F.col("_offset") + F.col("length") * ((at - at % F.col("_n")) / F.col("_n")).cast("long")})
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
