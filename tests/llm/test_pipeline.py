"""Every stage on odd rows, and the pipeline against plain versions of its stages."""

import brute
import pytest
import tiktoken
from brute import prose
from test_language_id import text
from test_pii import plain
from test_tokens import PATTERN, RANKS

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rows = [(k, text(("en", "fr")[k % 2], 30 + k, k), ("en", "fr")[k % 2], f"s{k % 3}") for k in range(40)]
    item = text("en", 30, 900)
    rows += [(100, rows[3][1], "fr", "s1"), (101, rows[4][1].upper(), "en", "s0"),
             (102, f"{text('en', 9, 901)} {item} {text('en', 9, 902)}", "en", "s2"),
             (103, f"{text('en', 40, 903)} ann@x.org {text('en', 9, 904)} 10.0.0.1", "en", "s2"),
             (104, None, "en", "s1"), (105, "12 34", "en", "s1")]
    path = str(tmp_path_factory.mktemp("sf"))
    make_docs(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run(spark, folder):
    path, rows = folder
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, path).collect()}
    kept = [(i, t) for i, t, *_ in rows if i not in (104, 105)]  # no letters, no language
    classes = brute.op6(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i and i != 102]
    kept = [(i, t.replace("ann@x.org", "<EMAIL>").replace("10.0.0.1", "<IP>")) for i, t in kept]
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert got == brute.op4(kept, encoding)


def test_stages_keep_the_columns(spark, folder, clashing, no_docs):
    path, _ = folder
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, clashing, path).columns == clashing.columns, name
        empty = stage(spark, no_docs, path)
        assert empty.columns == no_docs.columns and empty.count() == 0, name
    assert stage is cp.STAGES[3][1] and cp.STAGES[4][1](spark, no_docs, path).count() == 0


def test_odd_rows(spark, folder, clashing):
    path, _ = folder
    kept = cp.one_of_each_group(spark, clashing, path)
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {None, 1, 2, 3, 4, 6, 8, 10, 11}
    assert cp.without_benchmark(spark, clashing, path).count() == clashing.count()
    assert cp.tokenized(spark, clashing, path).count() == clashing.count()
    texts = {r.doc_id: r.text for r in cp.without_personal_data(spark, clashing, path).collect()}
    assert all(plain(t) == plain("") for t in texts.values())


def test_names_and_numbers():
    assert [name for name, _ in cp.STAGES] == [
        "language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE",
    ]
    assert prose(1, 5) == prose(1, 5)
