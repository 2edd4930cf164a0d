"""Toxicity by the nearest labelled examples.

A bounded sample of labelled rows is the example set. Words and word beginnings that stand with
toxic labels far beyond chance span the vector space; examples and texts are TF-IDF vectors in it.
The nearest examples are found exactly through an inverted index with block maxima: blocks of
examples whose bound can't reach the k-th best cosine are never scored. Votes weighted by cosine
are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_by_text, filter_by_text
from strandlake.session import cut

WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are features beside the whole word.
BEGINNINGS = range(3, 10)
BLOCK = 32
MEMO_WORDS = 100_000
MEMO_VECTORS = 20_000


def word_features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


@dataclass
class BlockMaxIndex:
    """Postings by feature over examples in blocks; ``search`` is exact top-k by cosine."""

    ids: list[int]
    labels: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]] = field(repr=False)
    bounds: list[tuple[np.ndarray, np.ndarray]] = field(repr=False)

    @classmethod
    def build(cls, ids: list[int], labels: list[int], vectors: list[dict[int, float]], n_features: int) -> BlockMaxIndex:
        # examples with the same strongest feature stand together, which makes the block bounds tight
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=lambda f: (vectors[i][f], -f)), ids[i]))
        columns: list[tuple[list, list]] = [([], []) for _ in range(n_features)]
        for place, i in enumerate(order):
            for f, w in vectors[i].items():
                columns[f][0].append(place)
                columns[f][1].append(w)
        postings = [(np.array(a, np.int64), np.array(w)) for a, w in columns]
        bounds = []
        for a, w in postings:
            blocks, first = np.unique(a // BLOCK, return_index=True)
            bounds.append((blocks, np.maximum.reduceat(w, first) if len(w) else w))
        return cls([ids[i] for i in order], np.array([labels[i] for i in order], float), postings, bounds)

    def search(self, query: dict[int, float], k: int, leave_out: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine; ties go to the smaller place."""
        n = len(self.ids)
        bound = np.zeros(n // BLOCK + 1)
        for f, w in query.items():
            blocks, most = self.bounds[f]
            bound[blocks] += w * most
        scores, done = np.zeros(n), np.zeros(len(bound), bool)
        k_more = k + (leave_out is not None)
        todo = np.argsort(-bound, kind="stable")[: max(2, 2 * k_more // BLOCK)]
        todo = todo[bound[todo] > 0]
        while len(todo):
            now = np.zeros(len(bound), bool)
            now[todo] = True
            for f, w in query.items():
                places, weights = self.postings[f]
                own = now[places // BLOCK]
                scores[places[own]] += w * weights[own]
            done |= now
            best = np.partition(scores, n - k_more)[n - k_more] if n > k_more else 0.0
            todo = np.flatnonzero(~done & (bound > 0) & (bound >= best - 1e-9))
        if leave_out is not None:
            scores[leave_out] = 0.0
        found = np.argsort(-scores, kind="stable")[:k]
        found = found[scores[found] > 0]
        return found, np.minimum(scores[found], 1.0)


@dataclass
class ToxicityModel:
    """Features with their idf, the index, the share of toxic labels among rows without features, and the calibration."""

    features: dict[str, tuple[int, float]] = field(repr=False)
    index: BlockMaxIndex | None
    base: float
    k: int = 25
    steps: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        weights = {self.features[f][0]: (1 + math.log(n)) * self.features[f][1] for f, n in counts.items() if f in self.features}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {f: w / norm for f, w in sorted(weights.items())} if norm else {}

    def vote(self, vector: dict[int, float], leave_out: int | None = None) -> tuple[float, list[tuple[int, float]]]:
        if not vector or self.index is None:
            return self.base, []
        found, near = self.index.search(vector, self.k, leave_out)
        weight = near**2
        raw = (float((weight * self.index.labels[found]).sum()) + 0.25 * self.base) / (float(weight.sum()) + 0.25)
        return raw, [(self.index.ids[i], float(c)) for i, c in zip(found[:3], near[:3])]

    def calibrate(self, vectors: list[dict[int, float]]) -> None:
        """Isotonic steps of left-out votes against labels, each vote counting as one observation of itself too."""
        votes = [self.vote(v, i)[0] for i, v in enumerate(vectors)]
        order = np.argsort(votes, kind="stable")
        blocks: list[list[float]] = []
        for i in order:
            blocks.append([votes[i], (votes[i] + self.index.labels[i]) / 2, 1.0])
            while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
                x, y, n = blocks.pop()
                blocks[-1] = [max(x, blocks[-1][0]), (blocks[-1][1] * blocks[-1][2] + y * n) / (blocks[-1][2] + n), blocks[-1][2] + n]
        self.steps = (np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks]))

    def score(self, counts: dict[str, int]) -> tuple[float, list[tuple[int, float]]]:
        vector = self.vector(counts)
        raw, evidence = self.vote(vector)
        if vector and self.steps is not None and len(self.steps[0]):
            raw = float(np.interp(raw, *self.steps))
        return min(1.0, max(0.0, raw)), evidence


def counted(text: str, known: Callable[[str], list[str]]) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for f in known(word):
            out[f] += n
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", max_examples: int = 12_000, k: int = 25) -> ToxicityModel:
    """Fit on at most ``max_examples`` labelled rows, the first by a hash of their id, then of id and text.

    Several labels of one id count as the largest; null labels, and ids without a text, teach
    nothing; rows of equal id and text are one example. Without examples of both labels every text gets the share of
    toxic labels seen (0.5 if there are none).
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit("toxic")), id_col)
        .limit(max_examples)
    )
    examples = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).join(F.broadcast(chosen), id_col)
    examples = examples.withColumn("_h", F.xxhash64(id_col, text_col)).dropDuplicates([id_col, "_h"])
    if examples.count() > max_examples:
        # ids that repeat with other texts: the hash that stands at the bound
        last = examples.select("_h").orderBy("_h").limit(max_examples).agg(F.max("_h")).first()[0]
        examples = examples.where(F.col("_h") <= last)
    examples = cut(examples.drop("_h"))

    total = {r["_label"]: r["n"] for r in examples.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n, positive = sum(total.values()), total.get(1, 0)
    share = positive / n if n else 0.5
    if not positive or positive == n:
        return ToxicityModel({}, None, share, k)

    def features_in(known: frozenset[str] | None) -> Callable:
        def make() -> Callable:
            def apply(texts: list[str]) -> list[list]:
                found = ({f for w in set(WORD.findall(t.lower())) for f in word_features(w)} for t in texts)
                return [[sorted(f if known is None else f & known) for f in found]]

            return apply

        return make

    def seen(rows: DataFrame, known: frozenset[str] | None) -> DataFrame:
        spread = append_by_text(rows, text_col, "_features array<string>", features_in(known))
        return spread.select("_label", F.explode("_features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("_label").alias("pos"))

    # one feature in so many would reach this gain by chance; it takes so many toxic examples at least, without others
    needed = 2 * math.log(20 * n)
    least = math.ceil(needed / (-2 * math.log(share)))
    candidates = frozenset(r["f"] for r in seen(examples.where("_label = 1"), None).where(F.col("pos") >= least).select("f").collect())

    def term(a: F.Column, b: F.Column) -> F.Column:
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    gain = 2 * (term(pos, F.col("n") * share) + term(neg, F.col("n") * (1 - share)))
    picked = seen(examples, candidates).withColumn("gain", gain).where((pos > F.col("n") * max(0.5, share)) & (F.col("gain") > needed))
    # the sample bounds how many there are
    rows = picked.orderBy(F.desc("gain"), "f").collect()
    features = {r["f"]: (i, math.log((n + 1) / (r["n"] + 1)) + 1) for i, r in enumerate(rows)}

    def own_features() -> Callable:
        def apply(texts: list[str]) -> list[list]:
            found = [counted(t, lambda w: [f for f in word_features(w) if f in features]) for t in texts]
            return [[list(c) for c in found], [list(c.values()) for c in found]]

        return apply

    with_counts = append_by_text(examples, text_col, "_names array<string>, _counts array<bigint>", own_features)
    got = sorted(tuple(r) for r in with_counts.select(id_col, "_label", "_names", "_counts").collect())
    model = ToxicityModel(features, None, share, k)
    vectors = [(i, label, v) for i, label, names, counts in got if (v := model.vector(dict(zip(names, counts))))]
    bare = [label for _, label, names, _ in got if not names]
    model.base = (sum(bare) + share) / (len(bare) + 1)
    if vectors:
        model.index = BlockMaxIndex.build([i for i, _, _ in vectors], [y for _, y, _ in vectors], [v for _, _, v in vectors], len(features))
        by_id: dict[int, list] = {}
        for i, _, v in vectors:
            by_id.setdefault(i, []).append(v)
        model.calibrate([by_id[i].pop() for i in model.index.ids])
    return model


FIELDS = "score double, predicted int, evidence string"


def scoring(sent, threshold: float) -> Callable:
    """What a task does with its texts, by the broadcast model."""

    def make() -> Callable:
        own = sent.value
        names, memo, held = own.features, {}, {}

        def known(word: str) -> list[str]:
            hit = memo.get(word)
            if hit is None:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                hit = memo[word] = tuple(f for f in word_features(word) if f in names)
            return hit

        def judge(text: str) -> tuple[float, int, str]:
            counts = counted(text, known)
            key = tuple(sorted(counts.items()))
            if key not in held:
                if len(held) > MEMO_VECTORS:
                    held.clear()
                s, near = own.score(counts)
                held[key] = (s, int(s >= threshold), ",".join(f"{i}:{c:.4f}" for i, c in near))
            return held[key]

        def apply(texts: list[str]) -> list[list]:
            return [list(x) for x in zip(*map(judge, texts))] if texts else [[], [], []]

        return apply

    return make


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score, predicted and evidence (the nearest examples as id:cosine).

    Null and empty texts, and texts without any feature, get the share of toxic labels among the
    examples without features. Rows are scored one by one, so repeats and an empty table need no rule.
    """
    return append_by_text(docs, text_col, FIELDS, scoring(docs.sparkSession.sparkContext.broadcast(model), threshold))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, as they are, that score under the threshold."""
    return filter_by_text(docs, text_col, FIELDS, scoring(docs.sparkSession.sparkContext.broadcast(model), threshold), lambda found: found["predicted"] == 0)
