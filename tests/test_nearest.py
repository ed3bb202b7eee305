"""Nearest rows by cells against the scoring of every row with every profile."""

import random

import pytest
from pyspark.sql import functions as F

from segprofile.operators.nearest import PivotIndex
from segprofile.operators.similarity import nearest_rows


def rows_of(df):
    return sorted((r.profile_id, r.rank, r.id, round(r.similarity, 9)) for r in df.collect())


def table(make, n, seed, values=6, gaps=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        centre = rng.choice([0, 10, 50])
        c1 = None if gaps and rng.random() < 0.1 else f"v{rng.randrange(values)}"
        x = float("nan") if gaps and rng.random() < 0.03 else centre + rng.gauss(0, 1)
        rows.append((i, "g", c1, f"w{rng.randrange(values)}", x, centre + rng.gauss(0, 2), rng.random()))
    return make(rows)


@pytest.mark.parametrize(("categorical", "k", "pivots"), [(("c1", "c2"), 5, 16), (("c1",), 3, 4), ((), 4, 16), (("c1", "c2"), 1, 1)])
def test_same_rows_as_scoring_all(make, categorical, k, pivots):
    rows = table(make, 300, 1).cache()
    profiles = table(make, 60, 2).withColumn("p", F.concat(F.lit("p"), "id")).where("x = x AND NOT isnan(x)")
    numeric = ("x", "y", "m")
    index = PivotIndex(rows, ["id"], numeric, categorical, pivots=pivots)
    expected = nearest_rows(rows, profiles, "p", ["id"], numeric, categorical, k)
    assert rows_of(index.nearest(profiles, "p", k)) == rows_of(expected)


def test_few_rows_look_at_few_profiles(make):
    rows = table(make, 4000, 3, values=40, gaps=False).cache()
    profiles = rows.where("id < 400").withColumn("p", F.col("id").cast("string"))
    index = PivotIndex(rows, ["id"], ("x", "y", "m"), ("c1", "c2"))
    opened = index.opened(profiles, "p", 10).agg(F.sum("n")).first()[0]
    assert opened < 0.2 * 4000 * 400
    found = rows_of(index.nearest(profiles, "p", 10))
    assert len(found) == 4000
    some = profiles.where("id < 20")
    assert [r for r in found if int(r[0]) < 20] == rows_of(nearest_rows(rows, some, "p", ["id"], ("x", "y", "m"), ("c1", "c2"), 10))


def test_fewer_rows_than_asked_and_ties(make):
    rows = make([(2, "g", "a", "b", 1.0, 1.0, 1.0), (1, "g", "a", "b", 1.0, 1.0, 1.0), (3, "g", None, "b", 5.0, 1.0, 1.0), (4, "g", "a", "b", None, 1.0, 1.0)])
    profiles = make([(9, "g", "a", "b", 1.0, 1.0, 1.0)]).withColumn("p", F.lit("one"))
    index = PivotIndex(rows, ["id"], ("x", "y"), ("c1", "c2"), label=["grp"])
    got = index.nearest(profiles, "p", 10).collect()
    assert sorted((r.rank, r.id) for r in got) == [(1, 1), (2, 2), (3, 3)]
    assert got[0].asDict().keys() == {"profile_id", "rank", "id", "grp", "similarity", "x", "y", "c1", "c2"}


def test_rounding_decides_no_tie(make):
    rows = make([(i, "g", "a", "b", 0.1 * i, 0.7 * i, 1.0) for i in (9, 4)] + [(1, "g", "a", "b", 50.0, 1.0, 1.0)])
    middle = make([(0, "g", "a", "b", (0.1 * 9 + 0.1 * 4) / 2, (0.7 * 9 + 0.7 * 4) / 2, 1.0)]).withColumn("p", F.lit("one"))
    got = PivotIndex(rows, ["id"], ("x", "y"), ("c1",)).nearest(middle, "p", 2).collect()
    assert sorted((r.rank, r.id) for r in got) == [(1, 4), (2, 9)]


def test_empty_tables(make):
    some = make([(1, "g", "a", "b", 1.0, 1.0, 1.0)]).withColumn("p", F.lit("one"))
    empty = make([])
    assert PivotIndex(empty, ["id"], ("x",), ("c1",)).nearest(some, "p").count() == 0
    assert PivotIndex(some, ["id"], ("x",), ("c1",)).nearest(empty.withColumn("p", F.lit("one")), "p").count() == 0


def test_no_pairs_are_formed(make):
    rows = table(make, 50, 5)
    profiles = rows.where("id < 9").withColumn("p", F.col("id").cast("string"))
    plan = PivotIndex(rows, ["id"], ("x",), ("c1", "c2")).nearest(profiles, "p")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
