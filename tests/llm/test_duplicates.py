"""Near-duplicates of texts and vectors, and SpotSigs, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, neardup, spotsigs, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_texts(n=160):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n // 8):
        base = rng.choices(words, k=rng.randint(40, 90))
        for k in range(8):
            t = list(base)
            for _ in range(k // 2):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t) if k else " ".join(t).upper())
    return texts


@pytest.mark.parametrize(("width", "percent", "limit", "rounds"), [(3, 85, 64, 6), (5, 80, 4, 6), (3, 85, 4, 0)])
def test_near_duplicates_equal_all_pairs(make_docs, odd_texts, width, percent, limit, rounds):
    texts = near_texts() + odd_texts
    sets = [shingles(t, width) for t in texts]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(sets[i] and sets[j]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

    want = components(range(len(texts)), linked)
    got = {r.doc_id: r for r in neardup.near_duplicates(make_docs(texts), neardup.JoinSettings(width, percent, pair_limit=limit * limit, block=limit, finish_block=limit, rounds=rounds)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_one_large_group(make_docs):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(t))
    got = neardup.near_duplicates(make_docs(texts), neardup.JoinSettings(3, 85, pair_limit=256, block=16)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert neardup.near_duplicates(make_docs([])).count() == 0
    assert neardup.near_duplicates(make_docs([None, ""])).where("kept").count() == 2


@pytest.mark.parametrize("more", [{}, {"reach": 1, "rounds": 1}])
def test_texts_just_short_of_the_threshold_are_settled_without_branching_on(make_docs, monkeypatch, more):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(120):
        t = list(base)
        for k, at in enumerate(rng.sample(range(200), 2 + i % 5)):
            t[at] = f"x{i}_{k}"
        texts.append(" ".join(t))
    sets = [shingles(t, 3) for t in texts]
    want = components(range(len(texts)), lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    assert len(set(want.values())) > 30
    turns, branched = [], neardup.branched
    monkeypatch.setattr(neardup, "branched", lambda rows, s, trees=(): turns.append(trees) or branched(rows, s, trees))
    got = neardup.near_duplicates(make_docs(texts), neardup.JoinSettings(3, 85, pair_limit=1000, finish_block=16, **more)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert (len(turns) > 2) if more else turns == [[0], [*range(1, 10)]]


@pytest.mark.parametrize("in_task", [0, 100_000])
def test_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(common, "BROADCAST_ROWS", in_task)
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {frozenset(p) for p in links}
    want = components(sorted({x for p in links for x in p}), lambda i, j: frozenset((i, j)) in pairs)
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in links)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_dealt_by_their_counts(spark, monkeypatch):
    """The same rows as a plain join; no task holds more of a key than its share, nor all rows without a key."""
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    keys = [1] * 300 + [None] * 200 + [2] * 10 + [*range(3, 60)]
    big = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    counts = [(k, sum(x == k for x in keys), f"v{k}") for k in {*keys} - {None, 4, 5}] + [(1000, 0, "none")]
    small = spark.createDataFrame(counts, "k long, held long, v string")
    for how in ("left", "inner"):
        got = sorted((r.id, r.v) for r in common.join_unique(big, small, "k", F.col("id"), "held", how, 1).collect())
        assert got == sorted((r.id, r.v) for r in big.join(small, "k", how).collect())
        assert [r.v for r in common.join_unique(big.where("false"), small, "k", F.col("id"), "held", how).collect()] == []
        assert common.join_unique(big, small.where("false"), "k", F.col("id"), "held", how).count() == (len(keys) if how == "left" else 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        joined = common.join_unique(big, small, "k", F.col("id"), "held")
        held = joined.groupBy(F.spark_partition_id().alias("task"), "k").count().groupBy("k").agg(F.max("count").alias("n"), F.count("*").alias("tasks")).collect()
    finally:
        for name, value in (("spark.sql.shuffle.partitions", "4"), ("spark.sql.adaptive.enabled", "true")):
            spark.conf.set(name, value)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_key = {r.k: r for r in held}
    assert by_key[1].tasks > 16 and by_key[None].tasks > 16 and by_key[2].tasks == 1
    assert by_key[1].n <= 60 and by_key[None].n <= 30


@pytest.mark.parametrize(("limit", "hot"), [(1024, 2000), (16, 1)])
def test_vectors_equal_all_pairs(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(common, "LEAST_HOT", hot)
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((40, 16))
    rows = [c + 0.12 * rng.standard_normal(16) for c in centers for _ in range(12)]
    rows += [rows[0], rows[0], rows[0] * 2]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0]]
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], 7) for i, v in enumerate([*rows, *odd])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int")
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = components(range(len(rows)), lambda i, j: near[i, j])
    got = {r.vec_id: r for r in vectors.near_vectors(df, vectors.ForestSettings(leaf=32, leaf_limit=limit, trees=8)).collect()}
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found >= 0.98 * (near.sum() - len(rows)) and all(got[i].n_links <= near[i].sum() - 1 for i in range(len(rows)))
    assert sum(got[i].component_id == want[i] for i in range(len(rows))) >= 0.98 * len(rows)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(len(rows), len(data)))
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_spotsigs(make_docs, odd_texts):
    texts = near_texts(24) + odd_texts + ["the cat sat on the mat and the dog ran", "the " * 30_000 + "end", "Was Was was to to " * 9_000]
    ids = [i * 37 for i in range(len(texts))]
    docs = make_docs(texts).withColumn("doc_id", F.col("doc_id") * 37)
    got = {r.doc_id: r for r in spotsigs.edited_pairs(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(t) // 3
        r = got[ids[i]]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for i, t in zip(ids, texts):
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert spotsigs.edited_pairs(docs.where("false")).count() == 0
    assert spotsigs.edited_pairs(make_docs(["only one document here"])).first().near_next == 1.0


def test_signatures_chain_over_common_words(spark):
    text = F.lit("Over the big and small house of cards in every town that people built by hand")
    words = spotsigs.marked(text)
    r = spark.range(1).select(words.alias("w"), spotsigs.signature_set(words).alias("s")).first()
    m = spotsigs.MARK
    assert r.w == f" over {m}the big {m}and small house {m}of cards {m}in every town {m}that people built {m}by hand "
    chains = [f"{m}the big small", f"{m}and small house", f"{m}of cards every", f"{m}in every town", f"{m}that people built", f"{m}by hand"]
    assert set(r.s) == {spark.range(1).select(F.hash(F.lit(c)).alias("h")).first().h for c in chains[:-1]}
    a, b = F.array(*map(F.lit, [1, 2, 3, 4])), F.array(*map(F.lit, [3, 4, 5, 6]))
    r = spark.range(1).select(spotsigs.likeness(a, b).alias("x"), spotsigs.likeness(a, F.array(F.lit(1)), 0.5).alias("y")).first()
    assert r.x == pytest.approx(1 / 3) and r.y == 0.0


def test_buckets_are_even_however_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 10)
    for ids in ([*range(99), 2**62], [k << 32 | n for k in range(10) for n in range(10)], [-(2**63), *range(98), 2**63 - 1]):
        edges = ids[9:-1:10]
        docs = spark.createDataFrame([(i, f"text {k} of the words") for k, i in enumerate(ids)], "doc_id long, text string")
        held = docs.groupBy(spotsigs.bucket_of(F.col("doc_id"), sorted(edges)).alias("b")).count().collect()
        assert len(held) == 10 and max(r["count"] for r in held) == 10


@pytest.mark.parametrize("ids", [[*range(39), 2**62], [k << 32 | n for k in range(4) for n in range(10)], [None, None, *range(20), *[7] * 18]])
def test_next_document_across_buckets(spark, monkeypatch, ids):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 5)
    rows = [(i, f"number {k:03d} of the long list with words") for k, i in enumerate(ids)]
    got = sorted((r.doc_id is None, -(r.doc_id or 0), r.edited_sha256) for r in spotsigs.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        want.append((i is None, -(i or 0), hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()))
    assert got == sorted(want)
