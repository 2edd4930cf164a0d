"""Byte-pair encoding over Spark: token counts by merging, distinct-word encoding and decoding.

Both tokenizers split words at plain spaces and line ends, and no token crosses such a split, so a
chunk between two of them has the same tokens alone as in its text. That makes the distinct chunk
the unit of work.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_by_text, freeing
from strandlake.session import cut

#: A worker's table of chunks is emptied beyond so many entries: a bound on memory, not on what is counted.
MEMO_ENTRIES = 600_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once in each Python worker, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def chunks(text: str) -> list[str]:
    return [c for c in text.replace("\n", " ").split(" ") if c]


# --- token counts -------------------------------------------------------------------------------


class MergeCounter:
    """Tokens of a word-level BPE without making ids: initial symbols minus merges."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        t = tokenizer(path)
        self.normalize, self.pieces = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str
        self.by_piece: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Pop the lowest-ranked adjacent pair from the heap until none is left; equal ranks go leftmost first."""
        symbols: list[str | None] = [*piece[:-1], piece[-1] + self.suffix]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
        heapify(heap)
        left = n
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            whole = symbols[i] = a + b
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((whole, symbols[k]))) is not None:
                    heappush(heap, (r, i, whole, symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], whole))) is not None:
                heappush(heap, (r, h, symbols[h], whole))
        return left

    def plain(self, text: str) -> int:
        total = 0
        for piece, _ in self.pieces(self.normalize(text)):
            n = self.by_piece.get(piece)
            if n is None:
                n = self.by_piece[piece] = self.merged(piece)
            total += n
        return total

    def chunk(self, text: str) -> int:
        if "<" not in text:
            return self.plain(text)
        marks = len(self.splitter.findall(text))
        return marks + sum(self.plain(part) for part in self.splitter.split(text) if part)

    def count(self, text: str) -> int:
        parts, memo = chunks(text), self.by_chunk
        for c in set(parts).difference(memo):
            memo[c] = self.chunk(c)
        total = sum(map(memo.__getitem__, parts))
        for held in (memo, self.by_piece):
            if len(held) > MEMO_ENTRIES:
                held.clear()
        return total


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of whole texts; null text is empty (0, 0, false)."""

    def make() -> Callable:
        counter = merge_counter(path)

        def apply(texts: list[str]) -> list[list]:
            n = [counter.count(t) for t in texts]
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return apply

    return append_by_text(docs, text_col, "n_bytes long, n_tokens long, over_limit boolean", make)


# --- distinct-word encoding and decoding ----------------------------------------------------------

#: Words of a batch are numbered by how often it holds them, in classes of so many, so that most numbers are small.
CLASSES = (256, 65_536)
#: The most buckets of words. A row of the word table is the part of a batch in one bucket, so their number grows with the input alone.
MOST_BUCKETS = 4096


def planes(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte by byte, low bytes first: the high ones, nearly all 0, compress to nothing."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def numbers(data: bytes, width: int = 4) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel()


def packed(*parts: bytes) -> bytes:
    """Byte strings in one compressed body, with their sizes before them."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)), *parts]))


def unpacked(body: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(body)
    (n,) = struct.unpack_from("<Q", data)
    sizes = struct.unpack_from(f"<{n}Q", data, 8)
    ends = np.cumsum([8 + 8 * n, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def numbered(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(batch, bucket, body): for each Arrow batch its documents as word numbers (bucket -1), and the words so numbered by bucket.

    Spark splits the texts. A batch numbers its distinct words by class of frequency, bucket and
    alphabet, so that the bucket's words alone tell their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            lists = batch.column("words")
            found = lists.flatten().dictionary_encode()
            at, words = found.indices.to_numpy(), found.dictionary
            often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            kind = np.searchsorted(np.array(CLASSES), rank, "right")
            alphabet = np.empty(len(words), np.int64)
            alphabet[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            spelled = np.array(words.to_pylist(), object)
            bucket = (hash_array(spelled, categorize=False) % np.uint64(buckets)).astype(np.int64) if len(words) else alphabet
            order = np.lexsort((alphabet, bucket, kind))
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            ids = batch.column("id")
            body = packed(ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), planes(np.diff(lists.offsets.to_numpy())), planes(number[at]))
            rows = [(-1, body)]
            own = order[np.argsort(bucket[order], kind="stable")]
            starts = np.searchsorted(bucket[own], np.arange(buckets + 1))
            spelled = spelled[own]
            # the batch is done with: the most of it goes before the words are packed
            del found, at, words, lists, batch
            for b, (x, y) in enumerate(zip(starts, starts[1:])):
                if y > x:
                    rows.append((b, packed(planes(np.bincount(kind[own[x:y]], minlength=len(CLASSES) + 1)), "\n".join(spelled[x:y]).encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k] * len(rows), pa.int64()), *[pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.binary()))]], names=["batch", "bucket", "body"])

    # no word holds a space or a line end, so words can stand between line ends
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \n]+")
    return docs.select(F.col(id_col).cast("long").alias("id"), split.alias("words")).mapInArrow(freeing(run), "batch long, bucket long, body binary")


class WordEncoder:
    """Ids of words: plain ones by the tokenizer's own normalizer, splitter and model, a thousand at a time; others one by one."""

    def __init__(self, path: str):
        self.t = tokenizer(path)
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.pieces: dict[str, list[int]] = {}

    def plain(self, word: str) -> bool:
        return word.isascii() and word.isprintable() and not any(s in word for s in self.special)

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        easy = [i for i, w in enumerate(words) if w and self.plain(w)]
        model, memo = self.t.model, self.pieces
        for at in range(0, len(easy), 1000):
            own = easy[at : at + 1000]
            line = self.t.normalizer.normalize_str(" ".join([words[i] for i in own]))
            ends = np.cumsum([len(w) + 1 for w in line.split(" ")])
            if len(ends) != len(own):
                raise ValueError("the normalizer doesn't keep words apart")
            found = self.t.pre_tokenizer.pre_tokenize_str(line)
            which = np.searchsorted(ends, [a for _, (a, _) in found], "right").tolist()
            for k, (piece, _) in zip(which, found):
                ids = memo.get(piece)
                if ids is None:
                    if len(memo) > MEMO_ENTRIES // 3:
                        memo.clear()
                    ids = memo[piece] = [x.id for x in model.tokenize(piece)]
                out[own[k]] += ids
        hard = [i for i, w in enumerate(words) if w and not self.plain(w)]
        for i, e in zip(hard, self.t.encode_batch([words[i] for i in hard], add_special_tokens=False)):
            out[i] = e.ids
        return out


def encode_words(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """(batch, bucket, body): for the words of each row their ids, in their order.

    All rows of a bucket meet in one task, whose table of distinct words encodes a word once and
    serves every row that holds it. A word has one row a batch, so no word is hot, however often texts
    repeat it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, held = WordEncoder(path), {}, None
        for batch in batches:
            for key, bucket, body in zip(*[batch.column(c).to_pylist() for c in ("batch", "bucket", "body")]):
                if bucket != held:
                    held, table = bucket, {}
                kinds, text = unpacked(body)
                own = text.decode("utf-8", "surrogatepass").split("\n")
                new = [w for w in own if w not in table]
                for w, ids in zip(new, encoder.encode(new)):
                    table[w] = array("I", ids).tobytes()
                found = [table[w] for w in own]
                sizes = np.array([len(x) // 4 for x in found], np.int64)
                done = packed(kinds, planes(sizes), planes(np.frombuffer(b"".join(found), "<u4")))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([bucket], pa.int64()), pa.array([done], pa.binary())], names=["batch", "bucket", "body"])

    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(freeing(run), "batch long, bucket long, body binary")


def word_ids(bodies: list[bytes]) -> pa.ListArray:
    """The ids of a batch's words by number, from its buckets in order: class by class, bucket by bucket."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(CLASSES) + 1)]
    for body in bodies:
        kinds, sizes, ids = map(numbers, unpacked(body))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        last = 0
        for own, n in zip(parts, kinds.astype(np.int64).tolist()):
            own.append((sizes[last : last + n], ids[ends[last] : ends[last + n]]))
            last += n
    flat = [x for own in parts for x in own]
    sizes = np.concatenate([x for x, _ in flat]) if flat else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), pa.array(np.concatenate([x for _, x in flat]) if flat else np.zeros(0, np.uint32), pa.uint32()))


def digests(values: np.ndarray | memoryview, ends: list[int]) -> list[str]:
    return [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32_000_000) -> DataFrame:
    """One row a document: id, n_tokens and the SHA-256 of its ids (little-endian unsigned 32-bit) and of its decoded text.

    Spark splits texts to words. Arrow batches number their distinct words; the words of all batches
    meet by bucket in the word table, where each is encoded once, and their ids come back to the
    batch, which joins them to its documents by position. Decoding joins ids to the id-to-piece table
    of the vocabulary, of fixed size, once a distinct word of a batch. What belongs together travels
    as one row: a row for each word and position would be several times the input.

    Null text is empty. Null and repeated ids are rows of their own, and an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-size // bucket_bytes)))

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t = tokenizer(path)
        lists = word_ids(right.sort_by("bucket").column("body").to_pylist())
        ids, valid, words, at = unpacked(left.column("body")[0].as_py())
        at, ends = pa.array(numbers(at)), np.concatenate([[0], np.cumsum(numbers(words), dtype=np.int64)])
        # join the ids by position
        found = lists.take(at)
        places = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)])
        tokens = np.ascontiguousarray(found.flatten().to_numpy(), "<u4")
        token_ends = places[ends]
        # join the pieces by id, then the words by position; a word without ids leaves no space
        piece = pa.array([t.id_to_token(i) for i in range(t.get_vocab_size())])
        said = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, piece.take(lists.flatten())), " ")
        some = np.diff(places) > 0
        kept = at.filter(pa.array(some))
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)])[ends], pa.int64()), said.take(kept)), " ").cast(pa.large_binary())
        data = memoryview(text.buffers()[2] or b"")
        text_ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1].tolist()
        return pa.table(
            [
                pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=~np.frombuffer(valid, bool)),
                pa.array(np.diff(token_ends), pa.int64()),
                pa.array(digests(memoryview(tokens).cast("B"), (4 * token_ends).tolist()) if len(tokens) else digests(b"", token_ends.tolist()), pa.string()),
                pa.array(digests(data, text_ends), pa.string()),
            ],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    # written once: both parts of a batch must come from the same pass over the documents
    table = cut(numbered(docs, id_col, text_col, buckets))
    words = encode_words(table.where("bucket >= 0"), path, buckets)
    return table.where("bucket < 0").groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(assemble, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
