"""Hand-computed cases and properties of functions and sources."""

import gzip
import math
import random
import re
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import mm, sequence, stats
from strandlake.operators import differential, features, intervals, metatranscript, metrics, ml, selection, sites
from strandlake.sources import alignments, annotation, bam, fasta, results, stores
from strandlake.streaming import sites as streaming


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def exact(a, b, c, d, greater=False):
    """Fisher's p in integers."""
    ways = {k: math.comb(a + b, k) * math.comb(c + d, a + c - k) for k in range(max(0, a - d), min(a + b, a + c) + 1)}
    kept = [w for k, w in ways.items() if (k >= a if greater else w <= ways[a])]
    return sum(kept) / sum(ways.values())


def test_fisher_literals(spark):
    cell = [F.lit(x) for x in (8, 2, 1, 5)]
    r = one(spark, two=stats.fisher_two_sided(*cell), up=stats.fisher_greater(*cell), odds=stats.odds_ratio(*cell))
    assert r.two == pytest.approx(400 / 11440) and r.up == pytest.approx(280 / 11440) and r.odds == 20


def test_fisher_equals_integers(spark):
    tables = [(a, b, c, d) for a in (0, 3, 40, 300) for b in (0, 5, 61) for c in (0, 2, 33) for d in (1, 7, 500)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    cells = [F.col(x) for x in "abcd"]
    for r in df.select("*", stats.fisher_two_sided(*cells).alias("two"), stats.fisher_greater(*cells).alias("up")).collect():
        assert r.two == pytest.approx(exact(r.a, r.b, r.c, r.d), rel=1e-8)
        assert r.up == pytest.approx(exact(r.a, r.b, r.c, r.d, True), rel=1e-8)


def test_erfc_to_many_places(spark):
    values = [0.0, 1e-6, 0.1, 0.5, 1.0, 2.0, 2.999, 3.0, 3.5, 5.0, 10.0, 20.0]
    got = spark.createDataFrame([(v,) for v in values], "z double").select("z", stats.erfc(F.col("z")).alias("e")).collect()
    assert all(r.e == pytest.approx(math.erfc(r.z), rel=1e-8) for r in got)


def test_logit_and_erfc(spark):
    coef, p = stats.logit_coefficient(*[F.lit(x) for x in (7, 33, 15, 25)])
    none, sure = stats.logit_coefficient(*[F.lit(x) for x in (0, 33, 15, 25)])
    r = one(spark, coef=coef, p=p, none=none, sure=sure)
    assert r.coef == pytest.approx(1.039772, abs=1e-6)
    assert r.p == pytest.approx(math.erfc(1.039772 / 0.528987 / math.sqrt(2)), abs=1e-6)
    assert r.none is None and r.sure == 1.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.001, 0.01, 0.02, 0.2, 0.5, 1.0])), min_size=1, max_size=12))
def test_bh_is_the_step_up(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i long, pvalue double").withColumn("f", F.lit("x"))
    got = {r.i: r.fdr for r in stats.bh_fdr(df, ["f"]).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    low = 1.0
    for rank in range(len(known), 0, -1):
        low = min(low, known[rank - 1][0] * len(known) / rank)
        assert got[known[rank - 1][1]] == pytest.approx(low)
    assert all(got[i] == 1.0 for i, p in enumerate(ps) if p is None)


def test_site_literal(spark):
    rows = [("s", "r1", "T", 5, "m6A", "+", p) for p in (1.0, 0.8, 0.2)] + [("s", "r2", None, 5, "m6A", "+", 1.0)]
    calls = spark.createDataFrame(rows, "sample string, read_id string, reference_name string, ref_pos long, mod_type string, strand string, probability double")
    r = sites.stoichiometry(calls, min_coverage=1).collect()
    assert len(r) == 1 and (r[0].total_reads, r[0].modified_reads) == (3, 2)
    assert r[0].mean_probability == pytest.approx(2 / 3) and r[0].std_probability == pytest.approx(0.339935, abs=1e-6)
    edge = calls.limit(1).withColumn("probability", F.lit(191 / 255.0))
    assert sites.site_counts(edge).first().modified_count == 1
    assert sites.stoichiometry(calls.limit(0)).count() == 0


def test_differential_of_nothing(spark):
    empty = spark.createDataFrame([], "sample string, reference_name string, ref_pos long, mod_type string, strand string, total_reads long, modified_reads long, stoichiometry double, mean_probability double, median_probability double, std_probability double")
    assert differential.differential(empty, [("a", "b")]).count() == 0


def test_mm_legacy(spark):
    def parsed(tag):
        return [(e.base, e.mod_code, e.skips, e.n_calls) for e in one(spark, x=mm.parse_mm(F.lit(tag))).x]

    assert parsed("A+a.,0,1;A+17596?,2;") == [("A", "a", [0, 1], 2), ("A", "17596", [2], 1)]
    assert parsed("A+a,0,1;") == [] and parsed("A-a.,0") == [] and parsed("C+mh?,1") == [("C", "mh", [1], 1)]
    assert parsed("A+a.,x;A+a.") == [("A", "a", [], 0)]


def reads(spark, *rows):
    return spark.createDataFrame(rows, alignments.READ_FIELDS)


def calls_of(df):
    return sorted((r.ref_pos, r.mod_code, round(r.probability * 255)) for r in mm.decode_reads(df).collect())


def test_decode_strands_clips_and_codes(spark):
    assert calls_of(reads(spark, ("q", 0, "T", 100, "6M", "ACAAGA", "A+a.,0,1;", [10, 20]))) == [(100, "a", 10), (103, "a", 20)]
    assert calls_of(reads(spark, ("q", 16, "T", 100, "6M", "TCTTGT", "A+a.,0,1;", [10, 20]))) == [(102, "a", 20), (105, "a", 10)]
    assert calls_of(reads(spark, ("q", 0, "T", 100, "1S5M", "ACAAGA", "A+a.,0,1;", [255, 0]))) == [(102, "a", 0)]
    both = reads(spark, ("q", 0, "T", 0, "4M", "CACC", "C+mh?,0,1;A+a.,0;", [1, 2, 3, 4, 5]))
    assert calls_of(both) == [(0, "h", 2), (0, "m", 1), (1, "a", 5), (3, "h", 4), (3, "m", 3)]
    skipped = reads(spark, ("q", 0, "T", 0, "4M", "CACG", "G-m,0;A+a,0;", [9, 8]), ("u", 4, None, -1, "*", "ACGT", "A+a,0;", [1]), ("n", 0, "T", 0, "1M", "A", None, None))
    assert calls_of(skipped) == [(1, "a", 8)]


def plain_calls(read):
    """The calls of one read, one after another."""
    name, flag, ref, pos, cigar, seq, tags, ml = read
    if flag & 4 or tags is None or seq in (None, "*"):
        return
    on, q, r = {}, 0, pos or 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        for _ in range(int(n)):
            if op in "M=X":
                on[q] = r
            q, r = q + (op in "MIS=X"), r + (op in "MDN=X")
    minus, taken = bool(flag & 16), 0
    for part in tags.split(";"):
        m = re.fullmatch(r"([ACGTUN])([+-])([a-z]+|[0-9]+)[.?]?((?:,[0-9]+)*)", part.strip())
        if not m:
            continue
        codes = [m[3]] if m[3][0].isdigit() else list(m[3])
        target = m[1].translate(str.maketrans("ACGTU", "TGCAA") if minus else str.maketrans("U", "T"))
        places = [i for i, c in enumerate(seq.upper()) if target in ("N", c)]
        places, k = places[::-1] if minus else places, -1
        for x in m[4].split(",")[1:]:
            k += int(x) + 1
            for code in codes:
                p = max(0, ml[taken] or 0) if taken < len(ml or ()) else 0
                taken += 1
                if m[2] == "+" and k < len(places) and places[k] in on:
                    yield name, ref, on[places[k]], code, p, "-" if minus else "+"


@pytest.mark.parametrize("run_bases", [50, 10**9])
def test_decoding_equals_reads_one_by_one(spark, monkeypatch, run_bases):
    monkeypatch.setattr(mm, "RUN_BASES", run_bases)
    rng = random.Random(run_bases)
    rows = []
    for i in range(600):
        n = rng.randint(0, 60)
        seq = "".join(rng.choice("ACGTNacgtU") for _ in range(n))
        ops = "".join(f"{rng.randint(0, 30)}{rng.choice('MMMMIDNSHP=XQ')}" for _ in range(rng.randint(0, 8)))
        entries = [f"{rng.choice('ACGTUN')}{rng.choice('+++-')}{rng.choice(['a', 'm', 'mh', '17596', 'A', ''])}{rng.choice(['', '.', '?'])}{''.join(',' + str(rng.randint(0, 4)) for _ in range(rng.randint(0, 6)))}" for _ in range(rng.randint(0, 4))]
        tags = rng.choice([None, "", ";;", "A+a,99999999999999999999,0", " A+a.,0 ; C+m,x,1;"]) if i % 20 == 0 else ";".join(entries) + ";"
        ml = rng.choice([None, [], [rng.choice([None, -3, 7]) for _ in range(3)]]) if i % 7 == 0 else [rng.randint(0, 255) for _ in range(rng.randint(0, 40))]
        rows.append((f"q{i}", rng.choice([0, 0, 16, 4, 20]), rng.choice(["T", None]), rng.choice([None, 0, 1000]), rng.choice([None, "*"]) if i % 15 == 0 else ops, None if i % 40 == 0 else seq, tags, ml))
    got = mm.decode_reads(spark.createDataFrame(rows, alignments.READ_FIELDS).repartition(3)).collect()
    want = [c for row in rows for c in plain_calls(row)]
    assert len(want) > 300
    assert sorted((r.read_id, r.reference_name or "", r.ref_pos, r.mod_code, round(r.probability * 255), r.strand) for r in got) == sorted((a, b or "", *c) for a, b, *c in want)
    assert mm.decode_reads(spark.createDataFrame([], alignments.READ_FIELDS)).collect() == []


def test_bam_file(spark, tmp_path):
    name, seq = b"q1\0", "ACAAGA"
    nibbles = ["=ACMGRSVTWYHKDBN".index(c) for c in seq]
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))
    tags = b"MMZA+a.,0,1;\0" + b"MLBC" + struct.pack("<i", 2) + bytes([10, 20]) + b"NMC\1"
    body = struct.pack("<iiBBHHHiiii", 0, 100, len(name), 60, 0, 1, 0, 6, -1, -1, 0) + name + struct.pack("<I", 6 << 4) + packed + b"\xff" * 6 + tags
    header = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"T\0" + struct.pack("<i", 1000)
    whole = header + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(whole[:20]) + gzip.compress(whole[20:]))
    df = alignments.read_bam(spark, str(tmp_path / "a.bam"))
    assert calls_of(df) == [(100, "a", 10), (103, "a", 20)]
    assert alignments.alignment_head(df).first().asDict() == {"reads": 1, "mapped": 1}
    (tmp_path / "b.bam").write_bytes(gzip.compress(whole[:-5]))
    with pytest.raises(Exception, match="cut short"):
        alignments.read_bam(spark, str(tmp_path / "b.bam")).count()
    assert alignments.read_bam(spark, str(tmp_path / "b.bam"), "PERMISSIVE").count() == 0


def some_reads(n, rng):
    sizes = [0, 1, 40, 900]
    return [(f"read{i}", rng.choice([0, 4, 16]), rng.choice([f"T{i % 3}", None]), i if i % 5 else -1, rng.choice(["*", "3S40M2I7D1M"]), "".join(rng.choice("ACGTN") for _ in range(rng.choice(sizes))) or None, rng.choice([None, "A+a.,0;"]), rng.choice([None, [], [i % 256, 0]])) for i in range(n)]


@pytest.mark.parametrize(("block", "split", "parts"), [(300, 1_000, 10), (5_000, 7_000, 3), (60_000, 20_000, 2), (60_000, 10**9, 1)])
def test_ranges_of_a_bam_file_equal_the_whole(spark, tmp_path, monkeypatch, block, split, parts):
    rows = some_reads(2_000, random.Random(5))
    monkeypatch.setattr(bam, "GRANULARITY", 16)
    names = [f"T{k}" for k in range(3)]
    head = b"BAM\1" + struct.pack("<ii", 0, 3) + b"".join(struct.pack("<i", 3) + f"{k}\0".encode() + struct.pack("<i", 1000) for k in names)
    ids = {k: i for i, k in enumerate(names)}
    # blocks that end within records, as other writers may leave them, one of them empty
    whole = head + b"".join(bam.encode(r, ids) for r in rows)
    file = tmp_path / "a.bam"
    file.write_bytes(b"".join(bam.block_of(whole[a : a + block]) + (bam.LAST_BLOCK if a == 3 * block else b"") for a in range(0, len(whole), block)) + bam.LAST_BLOCK)
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    read = lambda path=file: bam.read_bam(spark, str(path), split_bytes=split)
    assert read().rdd.getNumPartitions() == 1 and key(read().collect()) == key(rows)
    with pytest.MonkeyPatch.context() as patch:
        # a coordinate index of the same places: one chunk each thousandth record, and a bin of counts that names no place
        with open(file, "rb") as held:
            places = [p for p, _ in bam.records(bam.header_of(held)[1])]
        chunks = [b << 16 | u for b, u in places[::100]]
        bai = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 2) + struct.pack("<Ii", 4681, len(chunks)) + b"".join(struct.pack("<QQ", c, c + 1) for c in chunks) + struct.pack("<Ii", 37450, 2) + struct.pack("<QQQQ", 1, 2, 3, 4) + struct.pack("<i", 2) + struct.pack("<QQ", 0, chunks[5])
        (tmp_path / "a.bai").write_bytes(bai)
        patch.setattr(bam, "GRANULARITY", 16)
        assert read().rdd.getNumPartitions() >= min(parts, 2) and key(read().collect()) == key(rows)
        (tmp_path / "a.bai").unlink()
    assert bam.index_bam(spark, str(tmp_path)) == 1 and bam.index_bam(spark, str(tmp_path)) == 0
    assert read().rdd.getNumPartitions() >= parts and key(read().collect()) == key(rows)


def test_bam_files_written_by_partitions(spark, tmp_path, monkeypatch):
    rows = some_reads(3_000, random.Random(9)) + [("long", 0, "T1", 7, "70000M", "ACGT" * 50_000, "A+a.,0;", [3])]
    df = spark.createDataFrame(rows, bam.READ_FIELDS).repartition(3)
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    out = tmp_path / "out"
    bam.write_bam(df, str(out))
    assert len(list(out.glob("*.bam"))) == 3 == len(list(out.glob("*.sbi"))) and not list(out.glob("_*"))
    back = bam.read_bam(spark, str(out), split_bytes=20_000)
    assert back.rdd.getNumPartitions() > 3 and key(back.collect()) == key(rows)
    # a job that dies leaves what was there
    broken = spark.createDataFrame([("x" * 300, 0, "T1", 1, "1M", "A", None, None)], bam.READ_FIELDS)
    with pytest.raises(Exception, match="254"):
        bam.write_bam(broken, str(out), mode="overwrite")
    assert key(bam.read_bam(spark, str(out)).collect()) == key(rows) and not list(out.glob("_*"))
    bam.write_bam(df.limit(5), str(out), mode="overwrite")
    assert bam.read_bam(spark, str(out)).count() == 5
    bam.write_bam(df.where("false"), str(tmp_path / "none"))
    assert bam.read_bam(spark, str(tmp_path / "none")).collect() == []


def test_counters_are_taken_on_the_way(spark, tmp_path):
    rows = spark.newSession().createDataFrame(some_reads(500, random.Random(2)), bam.READ_FIELDS)
    watched, seen = alignments.observed(rows)
    mm.decode_reads(watched).write.parquet(str(tmp_path / "calls"))
    assert seen.get == alignments.read_counters(rows).first().asDict()


def test_sequence_functions(spark):
    at = lambda s, p, f: one(spark, x=f(F.lit(s), F.lit(p))).x
    assert at("ACGT", 0, sequence.gc_content) == 0.5 and at("", 0, sequence.gc_content) is None
    assert at("GGACT", 2, sequence.is_drach) and not at("GGACG", 2, sequence.is_drach) and at("UGACU", 2, sequence.is_drach)
    assert at("aaccggtt", 2, sequence.kmer) == "AACCGGTT"


def exact_fisher(a, b, c, d):
    """(two-sided, greater) in whole numbers."""
    n1, n2, m = a + b, c + d, a + c
    weight = {k: math.comb(n1, k) * math.comb(n2, m - k) for k in range(max(0, m - n2), min(n1, m) + 1)}
    total = sum(weight.values())
    return sum(w for w in weight.values() if w * 10**9 <= weight[a] * (10**9 + 100)) / total, sum(w for k, w in weight.items() if k >= a) / total


def test_fisher_by_ratios_equals_whole_numbers():
    rng = random.Random(1)
    tables = [(0, 0, 0, 0), (5, 0, 0, 0), (0, 3, 0, 9), (1, 0, 0, 1), (3, 3, 3, 3), (300, 0, 0, 300), (0, 900, 900, 0)]
    tables += [tuple(rng.randint(0, top) for _ in range(4)) for top in (3, 20, 150, 700) for _ in range(60)]
    import numpy as np

    cells = [np.array(x) for x in zip(*tables)]
    two, up = stats.fisher_p(*cells, False), stats.fisher_p(*cells, True)
    for i, t in enumerate(tables):
        want = exact_fisher(*t)
        assert two[i] == pytest.approx(want[0], rel=1e-9, abs=1e-300) and up[i] == pytest.approx(want[1], rel=1e-9, abs=1e-300), t


def exact_weights(n, m, n2):
    """The first k of the support, and the weight of every k as a multiple of its, in 40 digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    w, out = Decimal(1), []
    k0 = max(0, m - n2)
    for k in range(k0, min(n, m) + 1):
        out.append(w)
        w = w * (n - k) * (m - k) / ((k + 1) * (n2 - m + k + 1))
    return k0, out


@pytest.mark.parametrize("table", [(50_000, 50_000, 49_000, 51_000), (50_000, 50_000, 50_001, 49_999), (300, 99_700, 420, 99_580), (10_000, 90_000, 30_000, 70_000)])
def test_fisher_of_deep_sites(table):
    import numpy as np

    a, b, c, d = table
    k0, w = exact_weights(a + b, a + c, c + d)
    total = sum(w)
    two = sum(x for x in w if float(x / w[a - k0]) <= 1 + 1e-7) / total
    up = sum(w[a - k0 :]) / total
    cells = [np.array([x]) for x in table]
    assert stats.fisher_p(*cells, False)[0] == pytest.approx(float(two), rel=1e-9, abs=1e-300)
    assert stats.fisher_p(*cells, True)[0] == pytest.approx(float(up), rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("rows", [4, 37, 10**9])
def test_step_up_by_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "RANGE_ROWS", rows)
    rng = random.Random(rows)
    data = [(rng.choice("abc"), rng.choice([None, 0.0, 1.0, 0.5, rng.random(), rng.random() ** 9])) for _ in range(300)] + [("one", 0.3)]
    for least in (1, 2):
        got = stats.bh_fdr(spark.createDataFrame(data, "f string, pvalue double"), ["f"], least=least).collect()
        want = []
        for f in sorted({f for f, _ in data}):
            ps = sorted(p for g, p in data if g == f and p is not None)
            if len(ps) >= least:
                q = [min(1.0, min(x * len(ps) / (j + 1) for j, x in enumerate(ps) if x >= p)) for p in ps]
                want += [(f, p, round(x, 12)) for p, x in zip(ps, q)]
            if least == 1:
                want += [(f, None, 1.0) for g, p in data if g == f and p is None]
        # of equal p the last rank counts
        assert sorted(((r.f, r.pvalue, round(r.fdr, 12)) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("slots", "held"), [(2, 3), (7, 10), (4096, 10_000)])
def test_medians_by_narrowing(spark, monkeypatch, slots, held):
    monkeypatch.setattr(selection, "SLOTS", slots)
    monkeypatch.setattr(selection, "HELD", held)
    rng = random.Random(slots)
    groups = {
        "few": [1.0, 5.0], "one": [2.5], "same": [3.0] * 50, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(61)], "even": [float(x) for x in range(100)],
        "ties": [0.0] * 30 + [1.0] * 30, "ends": [float("-inf"), float("inf"), 0.0, 1e-320, -0.0, float("inf")], "near": [1 + k * 2**-52 for k in range(41)], None: [rng.random() for _ in range(80)],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("nothing", None), ("nothing", float("nan")), ("few", None), ("few", float("nan"))]
    rng.shuffle(data)
    got = {r.g: r.median for r in selection.exact_medians(spark.createDataFrame(data, "g string, v double"), ["g"], F.col("v")).collect()}
    middle = lambda vs: (sorted(vs)[(len(vs) - 1) // 2] + sorted(vs)[len(vs) // 2]) / 2
    assert got == {g: middle(vs) for g, vs in groups.items()}
    rows = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (9.0, None)], "a double, b double")
    assert sorted(map(tuple, features.impute_median(rows, ["a", "b"]).collect())) == [(1.0, 0.0), (4.0, 0.0), (4.0, 0.0), (9.0, 0.0)]


def call_rows(n, rng):
    return [(rng.choice("ab"), f"r{rng.randint(0, n)}", "T", rng.randint(0, 20), rng.choice("xy"), "+", rng.random()) for _ in range(n)]


CALL = "sample string, read_id string, reference_name string, ref_pos long, mod_type string, strand string, probability double"


def test_states_of_a_stream_that_stops_and_resumes(spark, tmp_path):
    rng = random.Random(4)
    rows, log = [], streaming.counts_log(spark, str(tmp_path / "log"), fan=3)
    source, progress = tmp_path / "calls", str(tmp_path / "progress")
    key = lambda df: sorted((*r[:5], r.total_count, r.modified_count, round(r.prob_sum, 9), round(r.prob_sq_sum, 9)) for r in df.collect())
    sizes = []
    for run in range(3):
        for k in range(6):
            part = call_rows(40, rng)
            rows += part
            spark.createDataFrame(part, CALL).coalesce(1).write.mode("append").parquet(str(source))
        calls = spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).parquet(str(source))
        streaming.stream_states(calls, log, sites.site_counts, progress).awaitTermination()
        assert key(log.read()) == key(sites.site_counts(spark.createDataFrame(rows, CALL)))
        sizes.append(len(log.manifest().folders))
        # no more on disk than this version and what the one before held
        assert len(list((tmp_path / "log").glob("states-*"))) == sizes[-1] + len(log.manifest().before)
    assert log.manifest().last_batch == 17 and max(sizes) <= 2 * 3
    # a batch that runs again does not count twice; one that died before its manifest leaves nothing that is read
    want = key(log.read())
    log.add(sites.site_counts(spark.createDataFrame(rows[:5], CALL)), 17)
    log._write(sites.site_counts(spark.createDataFrame(rows[:5], CALL)))
    assert key(log.read()) == want and log.manifest().last_batch == 17
    with pytest.raises(ValueError, match="no state"):
        streaming.counts_log(spark, str(tmp_path / "none")).read()


def test_stored_sketches_keep_their_bounds(spark, tmp_path):
    rng = random.Random(6)
    log, rows = streaming.summary_log(spark, str(tmp_path / "log"), fan=2), []
    for batch in range(5):
        part = [("a", f"r{rng.randint(0, 30_000)}", "T", rng.randint(0, 10**6), "x", "+", rng.random() ** 2) for _ in range(8_000)]
        rows += part
        log.add(sites.summary_states(spark.createDataFrame(part, CALL)), batch)
    got = sites.finalize_summary(log.read()).first()
    ps = sorted(r[-1] for r in rows)
    assert got.calls == 40_000 and got.mean_prob == pytest.approx(sum(ps) / len(ps))
    assert got.unique_reads == pytest.approx(len({r[1] for r in rows}), rel=0.03) and got.unique_sites == pytest.approx(len({r[3] for r in rows}), rel=0.03)
    for q, x in ((0.25, got.q1_prob), (0.5, got.median_prob), (0.75, got.q3_prob)):
        assert sum(p <= x for p in ps) / len(ps) == pytest.approx(q, abs=0.015)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(8)
    spans = [(i, rng.choice("ab"), a := rng.randint(-50, 3_000_000), a + rng.choice([0, 1, 3, 64, 65, 513, 40_000, 2_000_000, 9_000_000])) for i in range(150)] + [(900, "a", None, 5), (901, None, 1, 5)]
    points = [(k, rng.choice("ab"), rng.randint(-60, 4_000_000)) for k in range(400)] + [(k, c, s) for k, c, s, _ in spans] + [(990, "a", None)]
    got = intervals.overlap_join(spark.createDataFrame(points, "k long, chrom string, ref_pos long"), spark.createDataFrame(spans, "id long, chrom string, start long, end long"), ["chrom"], bin_size=64)
    want = [(k, i) for k, c, p in points for i, d, s, e in spans if None not in (p, s, c, d) and c == d and s <= p < e]
    assert sorted((r.k, r.id) for r in got.collect()) == sorted(want) and want
    none = spark.createDataFrame([], "id long, chrom string, start long, end long")
    assert intervals.overlap_join(spark.createDataFrame(points, "k long, chrom string, ref_pos long"), none, ["chrom"]).collect() == []


@pytest.mark.parametrize("rows", [3, 10**9])
def test_curve_by_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(metrics, "RANGE_ROWS", rows)
    rng = random.Random(9)
    data = [(rng.randint(0, 1), rng.choice([None, 0.5, round(rng.random(), 2)])) for _ in range(200)]
    got = metrics.curve_points(spark.createDataFrame(data, "label int, score double")).collect()
    at = lambda x, y: sum(s is not None and s >= x and k == y for k, s in data)
    assert sorted((r.threshold, r.tp, r.fp) for r in got) == [(x, at(x, 1), at(x, 0)) for x in sorted({s for _, s in data if s is not None})]


FASTA = ">T1 first\nACGTACGTAC\nGTACGTACGT\nAC\n>T2\n\n>T1 again\nTTTT\n>T3\r\nACG\r\nTTA\r\nC\r\n>T4 uneven\nAC\nGTACG\nT A\n\nCC\n>T5 blank at the end\nACGT\nAC\n\n>  \nGG\n>T6\nAC-*\nGT\n>T7\nACGTACG"


@pytest.mark.parametrize(("piece", "tile", "reach"), [(7, 4, 2), (1 << 22, 5, 0), (3, 100, 25), (1 << 22, 1, 3)])
def test_fasta_by_byte_ranges(spark, tmp_path, monkeypatch, piece, tile, reach):
    monkeypatch.setattr(fasta, "PIECE", piece)
    monkeypatch.setattr(fasta, "TASK_BASES", 8)
    (tmp_path / "x.fa").write_bytes(FASTA.encode())
    (tmp_path / "y.fa").write_text(">T1\nGGGGGGG\n>T8\n" + "ACGTN\n" * 30)
    want, seen = set(), set()
    for record in (FASTA[1:].split(">") + (tmp_path / "y.fa").read_text()[1:].split(">")):
        head, _, body = record.partition("\n")
        name, seq = head.split()[0] if head[:1].strip() and head.split() else "", "".join(body.split())
        if name not in seen:
            seen.add(name)
            for t in range(max(1, math.ceil(len(seq) / tile))):
                first = max(t * tile - reach, 0)
                want.add((name, t, first, seq[first : (t + 1) * tile + reach]))
    read = lambda: [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path), tile, reach).collect()]
    assert sorted(read()) == sorted(want)
    # one of the two files has uneven lines: no index can state it
    assert fasta.write_index(spark, str(tmp_path)) == 1
    assert (tmp_path / "y.fa.fai").read_text() == "T1\t7\t4\t7\t8\nT8\t150\t16\t5\t6\n"
    assert sorted(read()) == sorted(want)


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1,), (2,)], "x int")
    results.save_table(one, path, csv=True)
    rows = lambda: sorted(r.x for r in results.load_table(spark, path).collect())
    broken = one.select(F.when(F.col("x") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("x")).cast("int").alias("x"))
    with pytest.raises(Exception, match="killed"):
        results.save_table(broken, path)
    assert rows() == [1, 2] and sorted(p.name for p in tmp_path.iterdir()) == ["t.csv", "t.parquet"]
    # a table may be made of itself
    results.save_table(results.load_table(spark, path).select((F.col("x") + 1).alias("x")), path)
    assert rows() == [2, 3]
    # killed between the two renames: the old one comes back; after them: it goes
    (tmp_path / "t.parquet").rename(stores.set_aside(f"{path}.parquet"))
    assert rows() == [2, 3]
    one.write.parquet(stores.set_aside(f"{path}.parquet"))
    assert rows() == [2, 3] and not stores.exists(stores.set_aside(f"{path}.parquet"))


def test_fasta_tiles_and_gtf(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">T1 first\nACGTACGTAC\nGTACGTACGT\n>T2\nGG\n")
    tiles = {(r.reference_name, r.tile_id): (r.tile_start, r.seq) for r in annotation.read_fasta(spark, str(tmp_path / "x.fa"), 8, 2).collect()}
    assert tiles[("T1", 1)] == (6, "GTACGTACGTAC") and tiles[("T2", 0)] == (0, "GG") and len(tiles) == 4
    where = spark.createDataFrame([("T1", 15), ("T3", 1)], "reference_name string, ref_pos long")
    rows = {r.reference_name: r for r in features.sequence_features(where, annotation.read_fasta(spark, str(tmp_path / "x.fa"), 8, 25), 8).collect()}
    assert rows["T1"].kmer_context == "GTACGTACGT" and rows["T3"].gc_content is None and not rows["T3"].drach_motif
    (tmp_path / "x.gtf").write_text('#c\nshort\n1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G"; gene_name "N";\n')
    g = annotation.genes(annotation.read_gtf(spark, str(tmp_path / "x.gtf"))).collect()
    assert [(r.start, r.end, r.gene_id, r.gene_biotype) for r in g] == [(10, 20, "G", "unknown")]
    (tmp_path / "x.gmt").write_text("P\td\tA\tB\n")
    assert annotation.read_gmt(spark, str(tmp_path / "x.gmt")).count() == 2


@pytest.mark.parametrize(
    ("strand", "parts", "pos", "want"),
    [
        ("+", [("five_prime_utr", 100, 110), ("CDS", 110, 120), ("CDS", 200, 210), ("three_prime_utr", 210, 220)], 105, (0.5, "5UTR")),
        ("+", [("five_prime_utr", 100, 110), ("CDS", 110, 120), ("CDS", 200, 210), ("three_prime_utr", 210, 220)], 205, (1.75, "CDS")),
        ("+", [("UTR", 100, 110), ("CDS", 110, 120), ("CDS", 200, 210), ("UTR", 210, 220)], 150, (None, "intergenic")),
        ("-", [("UTR", 210, 220), ("CDS", 200, 210), ("CDS", 110, 120), ("UTR", 100, 110)], 219, (0.0, "5UTR")),
        ("-", [("UTR", 210, 220), ("CDS", 200, 210), ("CDS", 110, 120), ("UTR", 100, 110)], 115, (1.7, "CDS")),
        ("-", [("UTR", 210, 220), ("CDS", 200, 210), ("CDS", 110, 120), ("UTR", 100, 110)], 100, (2.9, "3UTR")),
    ],
)
def test_metatranscript_literals(spark, strand, parts, pos, want):
    rows = [("1", 100, 220, strand, "transcript", "t", "g")] + [("1", a, b, strand, f, "t", "g") for f, a, b in parts]
    gtf = spark.createDataFrame(rows, "chrom string, start long, end long, strand string, feature string, transcript_id string, gene_name string")
    site = spark.createDataFrame([("1", pos, strand)], "chrom string, ref_pos long, strand string")
    r = metatranscript.annotate(site, gtf, ["chrom", "ref_pos", "strand"]).first()
    assert r.region == want[1] and (r.metatranscript_pos == pytest.approx(want[0]) if want[0] is not None else r.metatranscript_pos is None)


def test_overlap_meets_each_pair_once(spark):
    spans = spark.createDataFrame([(i, "c", i * 3, i * 3 + i % 7) for i in range(60)], "id long, chrom string, start long, end long")
    points = spark.range(200).select(F.lit("c").alias("chrom"), F.col("id").alias("ref_pos"))
    got = sorted((r.id, r.ref_pos) for r in intervals.overlap_join(points, spans, ["chrom"], bin_size=4).collect())
    assert got == sorted((i, p) for i in range(60) for p in range(200) if i * 3 <= p < i * 3 + i % 7)


def test_shap_adds_up(spark):
    rows = [(i, float(i % 7), float(i % 5), float((i * 7) % 11), int((i % 7 > 3) ^ (i % 5 > 2))) for i in range(300)]
    names = ["a", "b", "c"]
    df = ml.assemble(spark.createDataFrame(rows, "id long, a double, b double, c double, label int"), names)
    model = ml.train_boosting(df, trees=4, depth=3)
    got = ml.shap_values(model, df.limit(40), names, "id").join(model.transform(df).select("id", "rawPrediction"), "id").collect()
    for r in got:
        assert sum(r.shap) + r.base == pytest.approx(float(r.rawPrediction[1]), abs=1e-9)
    forest = ml.train_forest(df, trees=4, depth=3)
    got = ml.shap_values(forest, df.limit(40), names, "id").join(ml.scored(forest, df).select("id", "score"), "id").collect()
    assert all(sum(r.shap) + r.base == pytest.approx(r.score, abs=1e-9) for r in got)
    with pytest.raises(ValueError, match="both classes"):
        ml.train_forest(df.where("label = 1"))


def grown(rng, depth, n_features):
    """A random tree, features repeating on paths."""
    nodes = []

    def add(depth, cover):
        at = len(nodes)
        nodes.append({"left": -1, "right": -1, "feature": -1, "threshold": 0.0, "value": rng.uniform(-2, 2), "cover": cover})
        if depth and rng.random() < 0.9:
            share = rng.uniform(0.05, 0.95)
            nodes[at] |= {"feature": rng.randrange(n_features), "threshold": rng.choice([-1.0, 0.0, 0.5, 2.0])}
            nodes[at]["left"] = add(depth - 1, cover * share)
            nodes[at]["right"] = add(depth - 1, cover * (1 - share))
        return at

    add(depth, 1000.0)
    return nodes


def plain_shapley(nodes, x):
    """By the definition, over all subsets of features."""
    from itertools import combinations

    def expected(known, at=0):
        n = nodes[at]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return expected(known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        return sum(nodes[c]["cover"] / n["cover"] * expected(known, c) for c in (n["left"], n["right"]))

    m = len(x)
    return [sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (expected({*s, f}) - expected(set(s))) for k in range(m) for s in combinations([g for g in range(m) if g != f], k)) for f in range(m)], expected(set())


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 6, 8])
def test_tree_shap_equals_the_definition(depth):
    import numpy as np

    rng = random.Random(depth)
    for _ in range(4):
        nodes = grown(rng, depth, 5)
        x = np.array([[rng.choice([rng.uniform(-3, 3), 0.0, math.nan, math.inf, -math.inf]) for _ in range(5)] for _ in range(7)])
        phi, base = ml.tree_shap(nodes, x)
        for row, got in zip(x.tolist(), phi.tolist()):
            want, mean = plain_shapley(nodes, row)
            assert got == pytest.approx(want, abs=1e-9) and base == pytest.approx(mean)


def test_results_and_config(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    results.save_table(df, str(tmp_path / "t"), csv=True)
    assert results.load_table(spark, str(tmp_path / "t")).collect() == df.collect()
    assert results.load_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert results.load_json(str(tmp_path / "none.json")) == {}
    raw = {"samples": {"A2058_normoxia": {}, "A2058_hypoxia_plasma": {}}, "comparisons": [{"control": "a", "treatment": "b"}], "thresholds": {"min_coverage": 5}}
    c = results.Config.of(raw)
    assert (c.cell_line(), c.comparisons, c.min_coverage, c.fdr_threshold) == ("A2058", [("a", "b")], 5, 0.05)
    assert results.Config.of({"output": {"base_dir": "./results_X1"}}).cell_line() == "X1"
    (tmp_path / "results_a" / "01_x").mkdir(parents=True)
    assert results.result_folders(str(tmp_path)) == [str(tmp_path / "results_a")]
