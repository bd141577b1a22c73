import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(*r, "en", "s1")[:4] if len(r) < 4 else tuple(r[:4]) for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = prose(1, 40_000)
    return [
        (None, "no id but a text of six words", "en", "s1"),
        (None, None, None, None),
        (1, None, "en", None),
        (2, "", None, "s1"),
        (3, " \t\n ", "", "s2"),
        (4, "one", "en", "s1"),
        (5, "one", "en", "s1"),
        (5, "one", "en", "s1"),
        (6, prose(2, 60), "fr", "s2"),
        (6, prose(3, 60), "fr", "s2"),
        (7, prose(2, 60), "fr", "s2"),
        (8, long, "en", "s1"),
        (9, long + " end", "en", "s1"),
        (10, "é ñ   日本 \U0001f600 ABC abc", "de", "s3"),
        (11, "x" * 150_000, "en", "s1"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd documents with extra columns named as the operators name theirs."""
    names = (
        "key row part kind start end ids n_tokens shard slot size spans set_id component item_id "
        "covered held_out language kept posterior halo place value before after tie to "
        "_spans _id _hash _kept _language _posterior _by_text _declared _suffix _host _host_mass "
        "_suffix_mass _at_host _at_suffix _html _tiled_item _tiled_words _tiled_length _tiled_count "
        "_before _after _same _row _salt _of _r _short _part _tie"
    )
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.lit("mine") for c in names.split()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
