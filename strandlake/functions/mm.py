"""Modification tags of aligned reads: MM positions, ML probabilities, reference coordinates.

Tags parse as column expressions; calls are decoded from whole Arrow batches. The layout follows the SAM tags
specification: probabilities go by the ordinal of the call, entry by entry, and several codes of
one entry take turns. Entries without ``.`` or ``?`` are read, and entries on the opposite strand
are skipped together with their probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import mod_name

ENTRY = r"^([ACGTUN])([+-])([a-z]+|[0-9]+)[.?]?((?:,[0-9]+)*)$"


def parse_mm(mm: Column, legacy: bool = True) -> Column:
    """array<struct<base, mod_code, skips, n_calls>>.

    ``legacy`` keeps only plus-strand entries that state ``.`` or ``?``, with everything between the
    sign and that mark as the code; a skip that is no number drops the entry. Otherwise every entry
    of the specification is kept, with its strand.
    """
    parts = F.filter(F.transform(F.split(F.rtrim(mm, F.lit(";")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    if legacy:
        header, rest = (lambda x: F.regexp_extract(x, r"^([^.?]*)[.?](.*)$", 1)), (lambda x: F.regexp_extract(x, r"^([^.?]*)[.?],?(.*)$", 2))
        fields = lambda x: F.filter(F.split(rest(x), ","), lambda s: s != "")
        good = F.filter(parts, lambda x: x.rlike("[.?]") & header(x).contains("+") & F.forall(fields(x), lambda s: F.try_to_number(F.trim(s), F.lit("S9999999999")).isNotNull()))
        return F.transform(
            good,
            lambda x: F.struct(
                F.substring(x, 1, 1).alias("base"), F.regexp_extract(header(x), r"^..(.*)$", 1).alias("mod_code"), F.transform(fields(x), lambda s: F.trim(s).cast("int")).alias("skips"), F.size(fields(x)).alias("n_calls")
            ),
        )
    good = F.filter(parts, lambda x: x.rlike(ENTRY))
    skips = lambda x: F.transform(F.filter(F.split(F.regexp_extract(x, ENTRY, 4), ","), lambda s: s != ""), lambda s: s.cast("int"))
    return F.transform(
        good,
        lambda x: F.struct(
            F.regexp_extract(x, ENTRY, 1).alias("base"),
            F.regexp_extract(x, ENTRY, 2).alias("sign"),
            F.when(F.regexp_extract(x, ENTRY, 3).rlike("^[0-9]"), F.array(F.regexp_extract(x, ENTRY, 3))).otherwise(F.filter(F.split(F.regexp_extract(x, ENTRY, 3), ""), lambda c: c != "")).alias("codes"),
            skips(x).alias("skips"),
        ),
    )


#: Which letter of the stored sequence a base of MM names, by strand of the read; N names all.
_ON_PLUS, _ON_MINUS = str.maketrans("U", "T"), str.maketrans("ACGTU", "TGCAA")
#: Reads are decoded in runs of about so many bases.
RUN_BASES = 4_000_000
#: A skip of more digits than this leads beyond any read.
LONGEST_SKIP = 9
ENTRY_PARTS = r"^(?P<base>[ACGTUN])(?P<sign>[+-])(?P<code>[a-z]+|[0-9]+)[.?]?(?P<skips>(?:,[0-9]+)*)$"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string column in a row, and where each begins, with the end behind the last; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def sums_before(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each value the sum of those before it in its group; ``group`` is in order."""
    if not len(values):
        return values
    before = np.cumsum(values) - values
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return before - np.repeat(before[first], np.diff(np.append(first, len(group))))


def aligned_blocks(cigar: pa.Array, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Read, query start, reference start and length of every run of query bases that stand on reference bases, in order."""
    data, begins = flat(cigar)
    digit = (data >= 48) & (data <= 57)
    at = np.flatnonzero(~digit)
    before = np.concatenate([[-1], at[:-1]])
    read = np.searchsorted(begins, at, "right") - 1
    # a length's digits reach back to the last other character or the value's begin
    first = np.maximum(before + 1, begins[read])
    # running values: each digit adds its place value, counted from its operation
    where = np.flatnonzero(digit)
    op_of = np.searchsorted(at, where)
    own = op_of < len(at)
    where, op_of = where[own], op_of[own]
    kept = where >= first[op_of]
    where, op_of = where[kept], op_of[kept]
    n = np.bincount(op_of, weights=(data[where] - 48) * 10.0 ** (at[op_of] - 1 - where), minlength=len(at)).astype(np.int64)
    real = np.isin(data[at], np.frombuffer(b"MIDNSHP=X", np.uint8)) & (at > first)
    n, op, read = n[real], data[at][real], read[real]
    on = lambda letters: np.isin(op, np.frombuffer(letters, np.uint8))
    q = sums_before(np.where(on(b"MIS=X"), n, 0), read)
    r = sums_before(np.where(on(b"MDN=X"), n, 0), read) + pos[read]
    both = on(b"M=X")
    return read[both], q[both], r[both], n[both]


def entry_table(mm: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The read and the parts (base, sign, code, skips) of every well-formed entry."""
    split = pc.split_pattern(pc.fill_null(mm, ""), ";")
    parts = pc.extract_regex(pc.utf8_trim_whitespace(pc.list_flatten(split)), ENTRY_PARTS)
    good = pc.is_valid(parts)
    return pc.list_parent_indices(split).filter(good).to_numpy(), parts.filter(good)


def skip_table(skips: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entry and the value of every skip, in order."""
    split = pc.split_pattern(skips, ",")
    values, entry = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.not_equal(values, "")
    values, entry = values.filter(there), entry.filter(there).to_numpy()
    values = pc.if_else(pc.greater(pc.utf8_length(values), LONGEST_SKIP), "9" * LONGEST_SKIP, values)
    return entry, pc.cast(values, pa.int64()).to_numpy(zero_copy_only=False)


def decode_batch(minus: np.ndarray, pos: np.ndarray, cigar: pa.Array, seq: pa.Array, mm: pa.Array, ml: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Read, reference position, code and probability of every call of a batch of reads, without a loop over reads or calls.

    Flat arrays throughout: base positions of all reads by letter, running sums of skips that start anew with each
    entry, and one search for all calls among all aligned blocks.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0)
    read_of_entry, parts = entry_table(mm)
    if not len(parts):
        return nothing
    base, sign, code, skips = (parts.field(x) for x in ("base", "sign", "code", "skips"))
    entry, skip = skip_table(skips)
    numeric = pc.match_substring_regex(code, "^[0-9]").to_numpy(zero_copy_only=False)
    width = np.where(numeric, 1, pc.utf8_length(code).to_numpy(zero_copy_only=False)).astype(np.int64)
    n_skips = np.bincount(entry, minlength=len(parts)).astype(np.int64)
    # probabilities go by the ordinal of the call within the read, opposite entries included
    first = sums_before(n_skips * width, read_of_entry)
    ordinal = sums_before(skip + 1, entry) + skip
    place = first[entry] + sums_before(np.ones(len(entry), np.int64), entry) * width[entry]

    same = pc.equal(sign, "+").to_numpy(zero_copy_only=False)[entry]
    entry, ordinal, place = entry[same], ordinal[same], place[same]
    read = read_of_entry[entry]
    letters, begins = flat(pc.utf8_upper(pc.fill_null(seq, "")))
    wanted = np.frombuffer("".join(base.to_pylist()).encode(), np.uint8)[entry]
    table = np.stack([np.arange(256), np.arange(256)]).astype(np.uint8)
    for row, names in zip(table, (_ON_PLUS, _ON_MINUS)):
        row[list(names)] = list(names.values())
    wanted = table[minus[read].astype(int), wanted]
    at = np.full(len(read), -1)
    for letter in np.unique(wanted).tolist():
        found = np.arange(len(letters)) if letter == ord("N") else np.flatnonzero(letters == letter)
        edge = np.searchsorted(found, begins)
        own = np.flatnonzero(wanted == letter)
        r = read[own]
        # on the minus strand the stored sequence is the complement, read backwards
        k = np.where(minus[r], edge[r + 1] - 1 - ordinal[own], edge[r] + ordinal[own])
        inside = (k >= edge[r]) & (k < edge[r + 1])
        at[own[inside]] = found[k[inside]] - begins[r[inside]]

    block_read, q, ref, n = aligned_blocks(cigar, pos)
    there = at >= 0
    entry, place, read, at = entry[there], place[there], read[there], at[there]
    if not len(q) or not len(at):
        return nothing
    stride = int(max(q.max(), at.max())) + 2
    block = np.searchsorted(block_read * stride + q, read * stride + at, "right") - 1
    on = (block >= 0) & (block_read[block] == read) & (at < q[block] + n[block])
    entry, place, read = entry[on], place[on], read[on]
    where = ref[block[on]] + at[on] - q[block[on]]

    # several codes of one entry take turns
    times = width[entry]
    turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    entry, place, read, where = (np.repeat(x, times) for x in (entry, place, read, where))
    coded = pc.dictionary_encode(code)
    spelled = [[c] if c[0].isdigit() else list(c) for c in coded.dictionary.to_pylist()]
    starts = np.cumsum([0, *map(len, spelled)])[:-1]
    names = pa.array([x for c in spelled for x in c], pa.string()).take(pa.array(starts[coded.indices.to_numpy()[entry]] + turn))
    place = place + turn
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ml), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    scores = np.append(pc.fill_null(pc.list_flatten(ml), 0).to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
    scored = place < sizes[read + 1] - sizes[read]
    p = np.where(scored, np.maximum(scores[np.where(scored, sizes[read] + place, -1)], 0), 0) / 255
    return read, where, names, p


def decode_reads(reads: DataFrame) -> DataFrame:
    """One row a modification call: read_id, reference_name, ref_pos, mod_type, mod_code, probability, strand.

    ``reads`` has qname, flag, rname, pos (0-based), cigar, seq, mm and ml (array of 0-255).
    Unmapped reads, and reads without sequence or tags, give none. Calls beyond the sequence or on
    inserted or clipped bases are dropped; a missing probability is 0. Arrow batches are decoded whole, in
    runs of about ``RUN_BASES`` bases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + RUN_BASES, "right")))
                part = batch.slice(start, stop - start)
                column = dict(zip(part.schema.names, part.columns))
                minus = column["minus"].to_numpy(zero_copy_only=False).astype(bool)
                pos = pc.fill_null(column["pos"], 0).to_numpy(zero_copy_only=False)
                read, where, names, p = decode_batch(minus, pos, column["cigar"], column["seq"], column["mm"], column["ml"])
                rows = pa.array(read)
                yield pa.RecordBatch.from_arrays([column["read_id"].take(rows), column["reference_name"].take(rows), column["strand"].take(rows), pa.array(where), names, pa.array(p)], names=["read_id", "reference_name", "strand", "ref_pos", "mod_code", "probability"])
                start = stop

    minus = F.col("flag").bitwiseAND(16) != 0
    usable = reads.where((F.col("flag").bitwiseAND(4) == 0) & F.col("mm").isNotNull() & F.col("seq").isNotNull() & (F.col("seq") != "*"))
    given = usable.select(F.col("qname").alias("read_id"), F.col("rname").alias("reference_name"), F.when(minus, "-").otherwise("+").alias("strand"), minus.alias("minus"), F.col("pos").cast("long").alias("pos"), F.col("cigar").cast("string").alias("cigar"), "seq", "mm", F.col("ml").cast("array<int>").alias("ml"))
    calls = given.mapInArrow(run, "read_id string, reference_name string, strand string, ref_pos long, mod_code string, probability double")
    return calls.select("read_id", "reference_name", "ref_pos", mod_name(F.col("mod_code")).alias("mod_type"), "mod_code", "probability", "strand")
