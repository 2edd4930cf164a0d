"""Language identification by compression.

Each learned language has a raw-content dictionary made of its training texts. A text is encoded
against every dictionary and goes to the language that makes it smallest. The saving against the
runner-up is the evidence: small savings are rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import append_by_text, filter_by_text

#: Texts are encoded whole, in blocks of so many bytes: a long text can't outgrow its dictionary.
BLOCK = 4096
#: zstd level of every block.
LEVEL = 6
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is encoded: lower case, anything between letters as one space."""
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, most frequent language first.

    ``min_saving`` is the relative saving against the runner-up below which a text is rejected, if it
    has ``min_letters`` letters: a shorter one is no evidence against any language.
    """

    dictionaries: tuple[tuple[str, bytes], ...]
    min_saving: float = 0.005
    min_letters: int = 40

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for _, body in self.dictionaries:
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", dict_bytes: int = 110_000, shares: int = 48, min_saving: float = 0.005) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled texts of ``docs``.

    Texts are cut to blocks of ``dict_bytes / shares`` characters, and of each language about
    ``3 * shares`` blocks are drawn by a hash of id and place, from anywhere in a text. Blocks equal in
    hash go by their words. Null languages and texts teach nothing; a null id draws like any other.
    """
    part = dict_bytes // shares
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    blocks = F.ceil(F.length(text_col) / part).cast("long")
    ranked = labelled.groupBy(lang_col).agg(F.count("*").alias("rows"), F.sum(blocks).alias("blocks")).collect()
    if not ranked:
        return LanguageModel((), min_saving)
    keep = F.create_map(*[x for r in ranked for x in (F.lit(r[lang_col]), F.lit(min(1_000_000, 3 * shares * 1_000_000 // r["blocks"] + 1)))])
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    place = lambda i: F.pmod(F.xxhash64(key, i, F.lit("lang")), F.lit(1_000_000))
    drawn = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: place(i) < keep[F.col(lang_col)])
    found = F.transform(drawn, lambda i: F.struct(place(i).alias("order"), F.substring(F.col(text_col), (i * part + 1).cast("int"), F.lit(part)).alias("part")))
    rows = labelled.select(F.col(lang_col), found.alias("_drawn")).select(lang_col, F.inline("_drawn")).collect()
    texts: dict[str, list[bytes]] = {}
    for lang, _, body in sorted(map(tuple, rows)):
        texts.setdefault(lang, []).append(letters(body)[:part])
    order = [r[lang_col] for r in sorted(ranked, key=lambda r: (-r["rows"], r[lang_col]))]
    # zstd finds the end of a dictionary at the least cost; all texts are of equal standing
    return LanguageModel(tuple((lang, b" ".join(texts[lang])[-dict_bytes:]) for lang in order if texts.get(lang)), min_saving)


FIELDS = "lang_pred string, score double, saving double, rejected boolean"


def judging(model: LanguageModel) -> Callable:
    """What a task does with its texts."""

    def make() -> Callable:
        encoders, langs = model.encoders(), [lang for lang, _ in model.dictionaries]

        def judge(text: str) -> tuple[str, float, float, bool]:
            if not langs or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, 0.0, True
            body = letters(text)
            blocks = [body[i : i + BLOCK] for i in range(0, len(body), BLOCK)]
            sizes = [sum([len(c) for c in map(e.compress, blocks)]) for e in encoders]
            best = min(sizes)
            rest = sorted(sizes)[1:2]
            share = 1 / sum(math.exp(-min(600, (s - best) * 0.5)) for s in sizes)
            saving = (rest[0] - best) / rest[0] if rest else 1.0
            return langs[sizes.index(best)], share, saving, saving < model.min_saving and sum(map(str.isalpha, text)) >= model.min_letters

        def apply(texts: list[str]) -> list[list]:
            return [list(x) for x in zip(*map(judge, texts))] if texts else [[], [], [], []]

        return apply

    return make


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, saving and rejected.

    ``und`` with score 0 and rejected where the text is null or has no letter, or nothing was
    learned. Ties go to the language with more training rows. The score is the share of the winner
    when the encoded sizes are read as likelihoods. Rows are judged one by one, so repeats and an
    empty table need no rule.
    """
    return append_by_text(docs, text_col, FIELDS, judging(model))


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose language is told."""
    return filter_by_text(docs, text_col, FIELDS, judging(model), lambda found: ~found["rejected"])
