import zlib

from brute import prose
from pyspark.sql import functions as F

from logloom.llm import sharding


def shards(docs, n=7):
    return sharding.by_bytes(sharding.sizes(docs), n).collect()


def test_contiguous_balanced_gapless(make_docs):
    rows = [(k, prose(k, 1 + 13 * k % 97) if k % 11 else None) for k in range(500)]
    got = shards(make_docs(rows))
    texts = {i: (t or "").encode() for i, t in rows}
    assert all(r.size == len(texts[r.doc_id]) + 16 for r in got)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    got.sort(key=lambda r: r.doc_id)
    place = [(r.shard, r.slot) for r in got]
    assert place == sorted(place)
    by = [[r for r in got if r.shard == s] for s in range(7)]
    assert all([r.slot for r in b] == list(range(len(b))) for b in by)
    target, most = sum(r.size for r in got) / 7, max(r.size for r in got)
    assert all(abs(sum(r.size for r in b) - target) <= most for b in by)


def test_odd_rows(clashing, odd_rows, no_docs, make_docs):
    got = shards(clashing)
    assert len(got) == len(odd_rows)
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert shards(no_docs) == []
    assert [(r.shard, r.slot) for r in shards(make_docs([(1, "a")]), 40)] == [(20, 0)]


def test_many_rows_with_one_key(make_docs):
    got = shards(make_docs([(None, "same text")] * 300 + [(k, "t") for k in range(100)]), 4)
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
    sums = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(sums) - min(sums) <= 2 * 25


def test_write(spark, make_docs, tmp_path):
    docs = make_docs([(k, prose(k, 20)) for k in range(50)])
    assigned = sharding.by_bytes(sharding.sizes(docs), 5)
    sharding.write_shards(docs, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    want = {r.doc_id: r.shard for r in assigned.collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", F.col("shard").cast("int")).collect()} == want
