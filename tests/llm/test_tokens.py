"""Token counts, encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strandlake.llm import bpe, packing
from strandlake.llm.queries import tokenizer_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
MORE = ["It's don't WE'LL  I'm", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ſ K", "é café", "x y z \x1c w", "1234 ½ ²", "tabs\t\tand\n\nlines \n", "Ünïcode*** %%% a,b.c", "ok \n end", "line\nline two\nthree"]


@pytest.fixture
def docs(make_docs, odd_texts):
    return make_docs(odd_texts + MORE, first=-3)


def plain(path, texts):
    return [e.ids for e in bpe.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts(docs, odd_texts):
    texts = odd_texts + MORE
    got = sorted(bpe.count_tokens(docs, WORDS, limit=4).collect(), key=lambda r: r.doc_id)
    want = plain(WORDS, texts)
    assert [r.n_tokens for r in got] == [len(x) for x in want]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [len(x) > 4 for x in want]
    assert got[0].source == "src" and got[0].score == -1.0


def test_round_trip(docs, odd_texts):
    texts = odd_texts + MORE
    got = sorted(bpe.encode_decode(docs, WORDS, bucket_bytes=300).collect(), key=lambda r: r.doc_id)
    for r, ids in zip(got, plain(WORDS, texts), strict=True):
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bpe.tokenizer(WORDS).decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_long_words_and_nul(make_docs):
    texts = ["x" * 200_000 + " end", "ab" * 100_000, "one a\0b two\0 \0 three", "after"]
    got = sorted(bpe.encode_decode(make_docs(texts), WORDS).collect(), key=lambda r: r.doc_id)
    for r, ids in zip(got, plain(WORDS, texts), strict=True):
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bpe.tokenizer(WORDS).decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert max(r.n_tokens for r in got) > 0


def test_packed_parts():
    parts = [b"", b"a\0b", b"x" * 70_000]
    assert bpe.unpacked(bpe.packed(*parts)) == parts
    values = np.array([0, 1, 65_536, 2**32 - 1])
    assert bpe.numbers(bpe.planes(values)).tolist() == values.tolist()


def test_words_are_encoded_as_the_library_does():
    rng = random.Random(11)
    parts = ["it's", "DON'T", "<|endoftext|>", "x<|startoftext|>y", "a\tb", "caf\u00e9", "\u0130I", "3.14", "--", "'ll", "\U0001f600", "a\u00a0b", "\x1f", "Wor", "ld", "!?", ""]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(3000)]
    assert bpe.WordEncoder(WORDS).encode(words) == plain(WORDS, words)


def test_batches_of_one_row_share_the_word_table(spark, docs, odd_texts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        test_round_trip(docs, odd_texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_equal_rows_stay(spark):
    rows = [(None, "some text")] * 30 + [(7, "other text")] * 20 + [(7, f"text {k}") for k in range(30)] + [(None, None)] * 5 + [(2**62, "far away")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_decode(docs, WORDS, bucket_bytes=300).collect()), key=str)
    want = sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for (i, _), x in zip(rows, plain(WORDS, [t for _, t in rows]))), key=str)
    assert got == want


def test_empty_tables(docs):
    none = docs.where("false")
    assert bpe.encode_decode(none, WORDS).count() == 0 and bpe.count_tokens(none, WORDS).count() == 0 and packing.pack(none, BYTES).count() == 0


def test_packing_covers_every_id_once(docs, odd_texts):
    texts = odd_texts + MORE
    rows = packing.pack(docs, BYTES, room=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in enumerate(plain(BYTES, texts)):
        whole, at = np.array([*ids, 1], "<u4"), 0
        for r in sorted(by_doc[i - 3], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_histogram_packing_places_every_piece():
    counts = {2048: 3, 1500: 2, 700: 5, 500: 4, 40: 100, 1: 7}
    patterns = packing.pack_histogram(counts)
    assert all(sum(p) <= 2048 for p, _ in patterns)
    assert {n: sum(p.count(n) * c for p, c in patterns) for n in counts} == counts
    for n in counts:
        ranks = sorted((a, b) for length, a, b, _, _ in packing.slots(patterns) if length == n)
        assert ranks[0][0] == 0 and ranks[-1][1] == counts[n] and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    assert packing.pack_histogram({}) == []


@pytest.mark.parametrize("counts", [{300: 1_000_000}, {300: 7}, {2048: 5}, {1025: 9, 1023: 4}, {1: 2049}, {900: 50_000, 300: 1_000_001, 17: 3}])
def test_one_hot_length_is_packed_with_itself(counts):
    patterns = packing.pack_histogram(counts)
    assert all(sum(p) <= 2048 for p, _ in patterns)
    assert {n: sum(p.count(n) * c for p, c in patterns) for n in counts} == counts
    tokens, sequences = sum(n * c for n, c in counts.items()), sum(c for _, c in patterns)
    if len(counts) == 1:
        (n, c), = counts.items()
        assert sequences == -(-c // (2048 // n))
    assert sequences <= max(-(-tokens // 1500), sum(c for n, c in counts.items() if n > 1024))


def test_hot_length_fills_its_sequences(make_docs):
    rows = packing.pack(make_docs(["same text here"] * 50 + [""] * 30), BYTES, room=16).collect()
    length = max(r.length for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 16
    assert len(rows) == 80 and sorted(by_sequence) == list(range(len(by_sequence)))
    assert length > 1 and len(by_sequence) == -(-sum(r.length for r in rows) // 16)


def test_one_length_in_many_parts(spark, monkeypatch):
    """A length that all pieces have is ranked in as many parts as it needs, and every piece keeps its place."""
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    docs = spark.createDataFrame([(i, "a" if i % 3 else "the same words again") for i in range(300)] + [(None, "a")] * 20, "doc_id long, text string")
    rows = packing.pack(docs, BYTES).collect()
    assert len(rows) == 320
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = {}
    for sequence, offset, length in taken:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= 2048 and sorted(at) == list(range(len(at)))
