"""FASTA as overlapping tiles, read by byte ranges that an index names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.stores import exists, files_at, store_of

INDEX = "file string, reference_name string, length long, offset long, line_bases long, line_width long"
#: Files are fetched in pieces of so many bytes; a task reads tiles of about so many bases.
PIECE, TASK_BASES = 1 << 22, 64_000_000


def lines(file) -> Iterator[tuple[int, bytes]]:
    """Every line with the byte it begins at, line end included, in constant memory but for one line."""
    at, rest = 0, b""
    while piece := file.read(PIECE):
        whole = (rest + piece).split(b"\n")
        rest = whole.pop()
        for line in whole:
            yield at, line + b"\n"
            at += len(line) + 1
    if rest:
        yield at, rest


def records(file) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, length, offset, line_bases, line_width) of every record, as an index has them.

    A record whose lines differ in length otherwise than by a shorter last one has no line width: 0.
    """
    name, length, offset, bases, width, closed, even = None, 0, 0, 0, 0, False, True
    for at, line in lines(file):
        if line.startswith(b">"):
            if name is not None:
                yield name, length, offset, bases, width if even else 0
            words = line[1:].split(None, 1)
            name, length, offset, bases, width, closed, even = words[0].decode() if words and not line[1:2].isspace() else "", 0, at + len(line), 0, 0, False, True
        elif name is not None:
            n = len(line.rstrip())
            plain = not n or line[:n].isalpha() or line[:n].translate(None, b"*-").isalpha()
            if not bases:
                bases, width = n, len(line)
            even &= plain and n <= bases and not (closed and n)
            closed |= n < bases or len(line) != width
            length += n if plain else len(b"".join(line.split()))
    if name is not None:
        yield name, length, offset, bases, width if even else 0


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The index of all files at ``path``: their ``.fai`` where there is one, else found by one task a file."""
    files = files_at(path, but=(".fai", ".gzi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                if exists(f"{path}.fai"):
                    store, inner = store_of(f"{path}.fai")
                    with store.open_input_stream(inner) as held:
                        rows = [(f[0].decode(), *map(int, f[1:5])) for _, line in lines(held) if len(f := line.rstrip(b"\r\n").split(b"\t")) >= 5]
                else:
                    store, inner = store_of(path)
                    with store.open_input_stream(inner) as held:
                        rows = list(records(held))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), *[pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*part))]], names=["file", "reference_name", "length", "offset", "line_bases", "line_width"])

    rows = spark.createDataFrame([(f,) for f in files], "file string")
    return rows.repartition(max(1, len(files)), "file").mapInArrow(run, INDEX)


def write_index(spark: SparkSession, path: str) -> int:
    """Write the ``.fai`` of every file that has none and whose lines allow one; how many were written."""
    files = [f for f in files_at(path, but=(".fai", ".gzi")) if not exists(f"{f}.fai")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for path in batch.column("file").to_pylist():
                store, inner = store_of(path)
                with store.open_input_stream(inner) as held:
                    rows = list(records(held))
                if all(width or not length for _, length, _, _, width in rows):
                    with store.open_output_stream(f"{inner}.fai") as out:
                        out.write("".join("\t".join(map(str, r)) + "\n" for r in rows).encode())
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    if not files:
        return 0
    rows = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def span(file, row: dict, start: int, end: int) -> str:
    """The bases [start, end) of a record with even lines: one read of the bytes that hold them."""
    bases, width = row["line_bases"], row["line_width"]
    place = lambda p: row["offset"] + p // bases * width + p % bases
    file.seek(place(start))
    return b"".join(file.read(place(end - 1) + 1 - place(start)).split()).decode()


def tiles_in_order(file, row: dict, tile_size: int, reach: int) -> Iterator[tuple[int, int, str]]:
    """The tiles of a record with uneven lines, from its first line on; no more than a tile and a piece are held."""
    file.seek(row["offset"])
    tile, start, held, got = 0, 0, b"", 0

    def bases() -> Iterator[bytes]:
        while piece := file.read(PIECE):
            stop = piece.find(b">")
            yield b"".join((piece if stop < 0 else piece[:stop]).split())
            if stop >= 0:
                return

    source = bases()
    while tile == 0 or tile * tile_size < row["length"]:
        end = min((tile + 1) * tile_size + reach, row["length"])
        while got < end and (more := next(source, None)) is not None:
            held, got = held + more, got + len(more)
        first = max(tile * tile_size - reach, 0)
        held, start = held[first - start :], first
        yield tile, first, held[: end - first].decode()
        tile += 1


def read_fasta(spark: SparkSession, path: str, tile_size: int = 1_000_000, reach: int = 25) -> DataFrame:
    """(reference_name, tile_id, tile_start, seq): tiles that reach ``reach`` bases over both ends.

    Tiles come from byte ranges by the index, many tasks a chromosome, and no row is longer than a
    tile. Records whose lines are uneven are read in order by one task. Names end at the first blank; of records of one
    name the first counts. A record without bases is one empty tile. Files must lie where Arrow's file
    systems reach them, uncompressed.
    """
    step = max(1, TASK_BASES // tile_size)
    index = index_of(spark, path)
    first = index.groupBy("reference_name").agg(F.min(F.struct("file", "offset", "length", "line_bases", "line_width")).alias("r")).select("reference_name", "r.*")
    n_tiles = F.greatest(F.ceil(F.col("length") / F.lit(tile_size)), F.lit(1))
    whole = (F.col("line_width") == 0) & (F.col("length") > 0)
    cut_up = first.withColumn("first", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n_tiles - 1, F.lit(step).cast("long")))))
    cut_up = cut_up.withColumn("last", F.when(whole, n_tiles).otherwise(F.least(F.col("first") + step, n_tiles)))
    total = first.agg(F.sum("length"), F.count("*")).first()
    tasks = max(1, math.ceil((total[0] or 0) / TASK_BASES), math.ceil(total[1] / 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
            tile, start, seq = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(tile)), pa.array(tile, pa.int64()), pa.array(start, pa.int64()), pa.array(seq, pa.string())], names=["reference_name", "tile_id", "tile_start", "seq"])

        for batch in batches:
            opened = None, None
            for row in batch.to_pylist():
                if opened[0] != row["file"]:
                    store, inner = store_of(row["file"])
                    opened = row["file"], store.open_input_file(inner)
                file = opened[1]
                if not row["length"]:
                    yield out(row["reference_name"], [(0, 0, "")])
                elif not row["line_width"]:
                    for tile in tiles_in_order(file, row, tile_size, reach):
                        yield out(row["reference_name"], [tile])
                else:
                    found = []
                    for tile in range(row["first"], row["last"]):
                        start, end = max(tile * tile_size - reach, 0), min((tile + 1) * tile_size + reach, row["length"])
                        found.append((tile, start, span(file, row, start, end)))
                        if sum(len(s) for _, _, s in found) > PIECE:
                            yield out(row["reference_name"], found)
                            found = []
                    if found:
                        yield out(row["reference_name"], found)

    return cut_up.repartition(tasks, "reference_name", "first").sortWithinPartitions("file", "offset", "first").mapInArrow(run, "reference_name string, tile_id long, tile_start long, seq string")
