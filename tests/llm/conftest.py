import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_text import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(id, text), ...], **extra columns as lists) -> documents, extra columns with clashing names included."""

    def make(rows, **extra):
        data = [(i, t, "en", "src0", len(t) if t is not None else None, *(extra[c][k] for c in extra)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, SCHEMA + "".join(f", {c} string" for c in extra))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with the operators' own names."""
    long_text = prose(7, 30_000)
    rows = [
        (1, prose(1), "en", "src0", 10), (2, prose(1), "en", "src1", 10), (2, prose(1), "en", "src1", 10), (3, "", "en", "src0", 0),
        (4, None, "en", "src0", None), (None, prose(2), None, None, None), (None, None, None, None, None), (5, " \n\t ", "en", "src0", 4),
        (6, long_text, "en", "src0", len(long_text)), (7, "one two", "en", "src2", 7), (7, prose(3), "en", "src2", 9), (8, "ä ß 漢字 😀 " * 30, "de", "src2", 9),
    ]
    names = ("shard", "kept", "fp", "digest", "probability", "host", "bin_id", "row_key", "size", "__key", "n_words", "start_pos")
    data = [(*r, *[f"{n}-{k}" for n in names]) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA + "".join(f", {n} string" for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
