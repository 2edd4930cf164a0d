"""Secret scan: fixed rules, and character Markov models that add what the rules do not know.

Three rules find assignments, access keys and hexadecimal runs. Beside them two first-order
character models, one of random strings and one of ordinary identifiers, judge every token of
``MIN_TOKEN`` characters or more that holds a letter by its log-likelihood ratio; of a token that a rule's span
covers in part, what is left. Both are trained on labelled samples of the corpus: in the rows that a
rule may speak of, what the rules find is random, and every token beside it is ordinary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_by_text, free_name, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: A run shorter than this fails as a whole, and so does every part of it: asking for the length at once gives the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The shortest token that the models judge: shorter ones say too little either way.
MIN_TOKEN = 10
#: What the models judge: whole runs of these characters, whatever their length. Letters beyond ASCII end a run: keys hold none.
TOKEN = re.compile(rf"[A-Za-z0-9_+/=-]{{{MIN_TOKEN},}}")
#: What stands between the parts of a token.
JOINERS = re.compile(r"[_/=-]+")
#: What they learn as ordinary: shorter runs too.
WORD = re.compile(r"[A-Za-z0-9_+/=-]{4,}")
#: Without a letter a run is a number or a rule of signs, not a word-like token.
TELLING = re.compile(r"[A-Za-z]")
ALPHABET = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")}
OTHER = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the rules' matches in order; code points, end exclusive."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: The code of each byte; a line end, which no token holds, stands between tokens.
_CODE = np.full(256, OTHER, np.int64)
for _c, _i in ALPHABET.items():
    _CODE[ord(_c)] = _i
SIZE = OTHER + 1
#: A character's own followers outweigh the common ones from so many sightings on.
BACKOFF = 3.0


def pairs(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pair code of each two neighbouring characters of ASCII tokens, and where each token's pairs begin; pairs across tokens are -1.

    A word shouted in capitals is the word.
    """
    data = np.frombuffer("\n".join([t.lower() if t.isupper() else t for t in tokens]).encode("ascii") + b"\n", np.uint8)
    code = _CODE[data]
    found = np.append(code[:-1] * SIZE + code[1:], -1)
    ends = np.flatnonzero(data == 10)
    found[ends], found[ends - 1] = -1, -1
    return found, np.concatenate([[0], ends[:-1] + 1])


def outside(tokens: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The tokens that touch no span of the rules; both lists in order."""
    out, ends, at = [], 0, 0
    for a, b in tokens:
        while at < len(base) and base[at][0] < b:
            ends = max(ends, base[at][2])
            at += 1
        if a >= ends:
            out.append((a, b))
    return out


def words_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What counts as ordinary: the runs that touch no span of the rules."""
    return outside([m.span() for m in WORD.finditer(text)], base)


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the models judge: every token, and where the rules' spans cover some of it what is left on each side."""
    out, first = [], 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while first < len(base) and base[first][2] <= at:
            first += 1
        for a, _, b in base[first:]:
            if a >= end:
                break
            if b > at:
                out.append((at, a))
                at = b
        out.append((at, end))
    return [(a, b) for a, b in out if b - a >= MIN_TOKEN]


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio table of random strings against ordinary identifiers.

    A part is random if its ratio is at least ``total`` nats, the odds that a token must overcome, and
    ``threshold`` nats a pair of characters. Half the weight of the random model lies on strings
    over all characters, since keys come in more alphabets than a sample holds. An empty sample
    leaves its model uniform.
    """

    ratio: np.ndarray = field(repr=False)
    threshold: float = 0.8
    total: float = 20.0

    @classmethod
    def of_counts(cls, random: np.ndarray, ordinary: np.ndarray, threshold: float = 0.8, total: float = 20.0) -> MarkovPair:
        chance = []
        for counts in (random.reshape(SIZE, SIZE), ordinary.reshape(SIZE, SIZE)):
            # a character that was seldom seen is followed by what follows any
            alone = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * SIZE)
            chance.append((counts + BACKOFF * alone) / (counts.sum(axis=1, keepdims=True) + BACKOFF))
        ratio = np.log((chance[0] + 1 / SIZE) / 2) - np.log(chance[1])
        return cls(np.append(ratio.ravel() if random.any() else np.zeros(SIZE * SIZE), 0.0), threshold, total)

    def random(self, tokens: list[str]) -> np.ndarray:
        """Which of the tokens are random: those with a random part, since identifiers are words put together."""
        split = [[p for p in JOINERS.split(t) if p] for t in tokens]
        parts = [p for own in split for p in own]
        if not parts:
            return np.zeros(len(tokens), bool)
        code, starts = pairs(parts)
        sums = np.add.reduceat(self.ratio[code], starts)
        n = np.array([max(1, len(p) - 1) for p in parts])
        out = np.zeros(len(tokens), bool)
        out[np.repeat(np.arange(len(tokens)), [len(own) for own in split])[(sums >= self.total) & (sums >= self.threshold * n)]] = True
        return out

    def spans(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """For each text the tokens that the ratio calls random."""
        where = [tokens_of(t, x) for t, x in zip(texts, base)]
        said = iter(self.random([t[a:b] for t, own in zip(texts, where) for a, b in own]).tolist())
        # each token has its verdict, whether or not it is kept
        return [[(a, 3, b) for (a, b), yes in [(x, next(said)) for x in own] if yes and TELLING.search(t, a, b)] for t, own in zip(texts, where)]


def train(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, total: float = 20.0) -> MarkovPair:
    """Fit on every row that names a secret: pair counts are summed in Spark, the driver gets two tables of fixed size.

    Null texts and rows without such a name teach nothing; with no labelled row the models are equal
    and add nothing. Sums know no order, so ties and repeats need no rule.
    """
    marks = [F.col(text_col).contains(m) for m in ("token", "secret", "passw", "api_key", "apikey", "AKIA")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                values, words = [], []
                for t in texts:
                    base = base_spans(t)
                    values += [t[a:b] if k else ASSIGN.match(t, a)[2] for a, k, b in base]
                    words += [t[a:b] for a, b in words_of(t, base)]
                for own, found in zip(counts, (values, words)):
                    if found:
                        code = pairs(found)[0]
                        own += np.bincount(code[code >= 0], minlength=SIZE * SIZE)
        kind, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(pair, pa.int64()), pa.array(counts[kind, pair], pa.int64())], names=["kind", "pair", "n"])

    rows = docs.where(reduce(or_, marks)).select(text_col).mapInArrow(run, "kind long, pair long, n long")
    counts = np.zeros((2, SIZE * SIZE))
    for r in rows.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"], r["pair"]] = r["n"]
    return MarkovPair.of_counts(counts[0], counts[1], threshold, total)


def scan(docs: DataFrame, model: MarkovPair, text_col: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_random, base_sha256 and spans.

    Null text counts as empty: no span. Overlapping spans of different kinds all stay. Letters beyond ASCII end a
    token and are in none. Rows are independent, so ties, repeats and skew change nothing.
    """

    def make() -> Callable:
        def apply(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], [], [], [], []]
            bases = [base_spans(t) for t in texts]
            for base, added in zip(bases, model.spans(texts, bases)):
                kinds = [k for _, k, _ in base]
                for column, value in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added))), strict=True):
                    column.append(value)
            return out

        return apply

    return append_by_text(docs, text_col, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", make)


def redact(docs: DataFrame, model: MarkovPair, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the scan replaced by ``[REDACTED]``; clean rows stay as they are."""

    def make() -> Callable:
        def apply(texts: list[str]) -> list[list]:
            out = []
            bases = [base_spans(t) for t in texts]
            for t, base, added in zip(texts, bases, model.spans(texts, bases)):
                parts, at = [], 0
                for a, _, b in sorted(base + added):
                    if b <= at:
                        continue
                    parts += [t[at:a], "[REDACTED]"] if a >= at else []
                    at = b
                out.append("".join([*parts, t[at:]]))
            return [out]

        return apply

    clean = free_name(docs, "_clean")
    plain = append_by_text(docs, text_col, f"{clean} string", make)
    return plain.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(clean))).drop(clean)
