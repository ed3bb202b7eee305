import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from segprofile.llm import mixing, sharding


def water(sizes, weights, limit=3):
    """Targets by definition: share by weight, cut at the limit, share the excess again."""
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        share = sum(weights[s] for s in free)
        target = {s: float(limit * sizes[s]) if s in capped else left * weights[s] / share for s in sizes}
        over = [s for s in free if target[s] > limit * sizes[s]]
        if not over:
            return target
        capped |= set(over)
        left = sum(sizes.values()) - sum(limit * sizes[s] for s in capped)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 1, "b": 1, "c": 1}, {"x": 0, "y": 50}, {"a": 1, "b": 2, "c": 3, "d": 4000, "é": 100, None: 0}])
def test_targets_by_definition(spark, sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes, weights))


def test_mix_of_odd_rows(odd, none):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == 12 and all(0 <= r.taken <= 3 * r["size"] for r in plan)
    assert Counter(r["size"] for r in plan if r.doc_id == 4) == {60_000: 2}
    assert [r["size"] for r in plan if r.doc_id == 2] == [0]
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    taken = sum(r.taken for r in plan)
    assert mixed.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == taken
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_taken_is_near_the_target(spark, documents):
    docs = documents([(i, f"w{i} " * (1 + i % 40), "en", f"s{i % 7 if i % 3 else 0}") for i in range(6000)])
    rows = mixing.mix_plan(docs.join(docs.select("doc_id"), "doc_id").repartition(7)).collect()
    sums = defaultdict(lambda: [0, 0.0])
    for i, r in enumerate(sorted(rows)):
        sums[r.source_size, r.target][0] += r.taken
    assert all(abs(t - target) <= 0.1 * target for (_, target), (t, _) in sums.items())
    again = mixing.mix_plan(docs).collect()
    assert sorted(rows) == sorted(again)


def test_one_more_shard_takes_rows_only_into_itself(spark, documents):
    tree = sharding.even_tree(16)
    docs = documents([(i, f"text {i}", "en", "a") for i in range(8000)])
    rows = sharding.shard_table(docs, tree, sharding.grow(tree)).collect()
    assert {(r.shard, r.grown_shard) for r in rows if r.shard != r.grown_shard} == {(s, 16) for s in range(16)}
    assert 8000 / 17 * 0.8 < sum(r.grown_shard == 16 for r in rows) < 8000 / 17 * 1.2
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) < 1.25 * 500
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r["size"] == len(f"text {r.doc_id}") + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode()) for r in rows)


def test_weights_move_only_what_they_must(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.even_tree(8, per_rack=2, racks=2)
    heavier = [s._replace(weight=3.0) if s.shard == 0 else s for s in tree]
    rows = ids.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), heavier).alias("b")).collect()
    for r in rows:
        if r.a != r.b:  # out of other regions, or towards the heavier shard's own subtree
            assert r.b in (0, 1, 2, 3)
    assert 0.22 < sum(r.b == 0 for r in rows) / 20_000 < 0.38
    none = [s._replace(weight=0.0) if s.shard == 5 else s for s in tree]
    assert 5 not in {r[0] for r in ids.select(sharding.shard_of(F.col("doc_id"), none)).distinct().collect()}
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [sharding.Shard("g", "k", 0, 0.0)])


def test_shards_of_odd_rows(odd, none):
    tree = sharding.even_tree(16)
    rows = sharding.shard_table(odd, tree).collect()
    assert len(rows) == 12 and all(r.grown_shard is None and r.law == "key" for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in rows}) == 12
    assert [r["size"] for r in rows if r.doc_id == 2] == [1]
    assert sharding.shard_table(none, tree).count() == 0


def test_many_equal_rows_get_slots_of_their_own(documents):
    docs = documents([(None, "same", "en", "a")] * 500 + [(1, "x", "en", "a")])
    rows = sharding.shard_table(docs, sharding.even_tree(4)).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 501
