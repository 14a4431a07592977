import zlib
from collections import Counter

from folio.llm import sharding

from tests.llm.conftest import ODD


def _check(rows, shards):
    per: dict = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    counts = [len(per.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_rows_law_and_mixture(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 3 == 0 else f"s{i % 7}") for i in range(4000)], "doc_id long, text string, source string")
    rows = sharding.interleave(docs, 40).collect()
    _check(rows, 40)
    assert {r.doc_id for r in rows} == set(range(4000))
    total = Counter(r.source for r in rows)
    for source, n in total.items():
        each = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(each[s] - n / 40) <= 2 for s in range(40))


def test_order_is_the_fractional_rank(spark, monkeypatch):
    """Against a sort of all rows, with many small buckets."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    docs = spark.createDataFrame([(i, "x" * (i % 9), f"s{i % 4}" if i % 2 else "big") for i in range(700)], "doc_id long, text string, source string")
    rows = sharding.interleave(docs, 7).collect()
    _check(rows, 7)
    keys = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(7, doc_id, cast(octet_length(text) + 16 as bigint), crc32(cast(text as binary))) as h").collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.doc_id)
    place = []
    for source, ids in by.items():
        for k, i in enumerate(sorted(ids, key=lambda i: (keys[i] & (2**64 - 1) if len(ids) >= 16 else keys[i]))):
            place.append(((k + 0.5) / len(ids), "s" + source, i))
    want = [i for _, _, i in sorted(place)]
    got = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert got == want


def test_odd_rows(odd, none):
    rows = sharding.interleave(odd, 40).collect()
    assert len(rows) == len(ODD)
    _check(rows, 40)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {16}
    assert sharding.interleave(none, 40).count() == 0


def test_every_column_of_every_row(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = sharding.interleave(documents, 40).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    n = len(rows)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    starts = [-(-s * n // 40) for s in range(41)]
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(40) for k in range(starts[s + 1] - starts[s])]
