import pytest

FILLER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture
def make_docs(spark):
    """Documents with the driver's columns and two columns whose names clash with results."""

    def make(texts, first=0, langs=None):
        rows = [(first + i, t, (langs or ["en"] * len(texts))[i], "src", None if t is None else len(t), -1.0, "mine") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, Spans string")

    return make


@pytest.fixture
def odd_texts():
    return [None, "", " ", "word", "É", "a\tb\nc", "x" * 50_000, "same text here", "same text here", "日本語 text", "😀 emoji", "  two  spaces \r\n"]
