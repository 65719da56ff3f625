import zlib
from collections import Counter

from pathloom.llm import shards
from pathloom.llm.common import fresh_path, table
from tests.llm.cases import DOCS, clashing, odd_rows


def test_shards_are_even_and_slots_gapless(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = shards.shard_documents(docs, 24).collect()
    load, places = Counter(), {}
    for r in rows:
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == docs.count() and len(load) == 24
    assert max(load.values()) <= 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_new_shards_take_and_others_keep(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = shards.sized_rows(docs)
    path = fresh_path(spark, "map")
    before = {r.doc_id: r.shard for r in shards.shard_documents(docs, 8, path).collect()}
    after = {r.doc_id: r.shard for r in shards.placed(rows, shards.rebalanced(rows, 9, path)).collect()}
    moved = {d for d in before if before[d] != after[d]}
    assert 0 < len(moved) < 0.3 * len(before)
    sizes = {r.doc_id: r.size for r in rows.collect()}
    load = Counter()
    for d, p in after.items():
        load[p] += sizes[d]
    assert len(load) == 9 and max(load.values()) <= 1.1 * min(load.values())
    assert {r.version for r in shards.read_map(spark, path).collect()} == {2}
    first = {r.slot: r.shard for r in shards.read_map(spark, path, 1).collect()}
    assert len(first) == shards.SLOTS
    same = {r.slot: r.shard for r in shards.rebalanced(rows, 9, path).collect()}
    assert same == {r.slot: r.shard for r in shards.read_map(spark, path, 2).collect()}  # even already: nothing moves


def test_heavy_slot_does_not_stop_the_plan():
    weights = {i: 1 for i in range(100)} | {7: 10_000}
    plan = shards.planned(weights, 4, None, 128)
    assert len(plan) == 128 and sum(plan[s] == plan[7] for s in range(100)) == 1
    assert shards.planned({}, 3, None, 16).keys() == set(range(16))


def test_odd_rows(make):
    docs = make(DOCS, odd_rows())
    for t in (docs, clashing(docs)):
        rows = shards.shard_documents(t, 3).collect()
        assert len(rows) == len(odd_rows())
        for p in range(3):
            mine = sorted(r.slot for r in rows if r.shard == p)
            assert mine == list(range(len(mine)))
    assert shards.shard_documents(make(DOCS, []), 24).count() == 0
