import zlib

import pytest
from pyspark.errors import AnalysisException

from lektra.llm import sharding
from lektra.llm.common import fresh_path
from tests.conftest import SF


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.sharded(docs, 40).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert len(rows) == len(texts)
    loads, slots = {}, {}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and r.map_version == 2
    assert set(loads) == set(range(40))
    assert max(loads.values()) - min(loads.values()) < 0.1 * sum(loads.values()) / 40
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_map_edits(spark):
    sizes = {s: 1 + (s * 7919) % 1000 for s in range(sharding.SLOTS)}
    first = sharding.ShardMap.even(40)
    second = first.rebalanced(sizes)
    moved = sum(a != b for a, b in zip(first.shard_of, second.shard_of))
    assert moved < 0.08 * sharding.SLOTS and max(second.loads(sizes)) - min(second.loads(sizes)) <= 1000
    grown = second.grown()
    assert {b for a, b in zip(second.shard_of, grown.shard_of) if a != b} == {40} and grown.shards == 41
    path = fresh_path(spark, "map")
    sharding.store(spark, first, path)
    sharding.store(spark, second, path)
    assert [r.shard for r in sharding.load(spark, path, 1).orderBy("virtual_slot").collect()] == list(first.shard_of)
    assert [r.shard for r in sharding.load(spark, path).orderBy("virtual_slot").collect()] == list(second.shard_of)


def test_kept_map_is_edited(spark):
    docs, path = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fresh_path(spark, "map")
    first = {r.doc_id: r for r in sharding.sharded(docs.filter("doc_id % 5 <> 0"), 40, map_path=path).collect()}
    again = sharding.sharded(docs, 40, map_path=path).collect()
    assert len(again) == docs.count() and {r.map_version for r in again} == {3} and sharding.load(spark, path).count() == sharding.SLOTS
    stays = [first[r.doc_id].shard == r.shard for r in again if r.doc_id in first]
    assert sum(stays) > 0.5 * len(stays)  # dealing out anew would leave a fortieth
    more = sharding.sharded(docs, 41, map_path=path).collect()
    assert len(more) == docs.count() and {r.shard for r in more} == set(range(41)) and {r.map_version for r in more} == {4}
    assert sharding.load(spark, path, 2).count() == sharding.load(spark, path, 3).count() == sharding.SLOTS
    with pytest.raises(AnalysisException):
        sharding.store(spark, sharding.newest(spark, path), path)


def test_same_rows_same_places(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.shard for r in sharding.sharded(docs, 40).collect()}
    assert a == {r.doc_id: r.shard for r in sharding.sharded(docs.repartition(7), 40).collect()}


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a", 5), (1, "a", None), (None, None, 1), (None, "b", 2), (2, "", 3), (3, "é" * 100_000, 1)] + [(9, "same", 1)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.sharded(docs, 3).collect()
    assert len(got) == 206 and {r.size for r in got} == {17, 16, 20, 200_016}
    assert sorted(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(3)) == [True] * 3
    assert sharding.sharded(spark.createDataFrame([], docs.schema), 40).count() == 0
