import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from segprofile.operators import profiles, similarity

NUM, CAT = ["x", "y"], ["c1", "c2"]


def table(spark, n=400):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "grp": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
            "c1": rng.choice(["p", "q"], n),
            "c2": rng.choice(["u", "v", "w"], n),
            "x": rng.normal(0, 10, n).round(1),
            "y": rng.integers(0, 3, n).astype(float),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def brute(pdf, profile, numeric=NUM, categorical=CAT):
    """Scores by definition."""
    parts = []
    if numeric:
        scale = pdf[numeric].std(ddof=0).replace(0, 1)
        z = (pdf[numeric] - pd.Series({c: profile[c] for c in numeric})) / scale
        d = np.sqrt((z**2).sum(axis=1, skipna=False))
        parts.append(1 - d / d.max() if d.max() > 0 else 1 - d)
    if categorical:
        parts.append(sum((pdf[c] == profile[c]).astype(float) for c in categorical) / len(categorical))
    return sum(parts) / len(parts)


def check(pdf, found, prof, id_column="grp", k=10, numeric=NUM, categorical=CAT):
    for p in prof.collect():
        score = brute(pdf, p, numeric, categorical)
        want = (
            pd.DataFrame({"id": pdf["id"], "s": score})
            .sort_values(["s", "id"], ascending=[False, True], na_position="last", kind="stable")
            .head(k)
        )
        mine = sorted((r for r in found if r.profile_id == str(p[id_column])), key=lambda r: r.rank)
        assert [r.id for r in mine] == list(want["id"])
        assert [r.similarity for r in mine] == pytest.approx(list(want["s"]), nan_ok=True)


def test_nearest_rows_equal_brute_force(spark):
    pdf, df = table(spark)
    prof = profiles.profile_table(df, "grp", NUM, ["grp", *CAT])
    found = similarity.nearest_rows(df, prof, "grp", ["id"], NUM, CAT).collect()
    check(pdf, found, prof)


@pytest.mark.parametrize("numeric,categorical", [(NUM, []), ([], CAT), (["x"], ["c1"])])
def test_one_kind_of_feature(spark, numeric, categorical):
    """Scores of categories alone tie in masses; the key decides."""
    pdf, df = table(spark)
    prof = profiles.profile_table(df, "grp", NUM, CAT)
    found = similarity.nearest_rows(df, prof, "grp", ["id"], numeric, categorical, k=7).collect()
    check(pdf, found, prof, k=7, numeric=numeric, categorical=categorical)


def test_many_profiles_go_in_blocks(spark, monkeypatch):
    pdf, df = table(spark, 120)
    prof = profiles.profile_table(df.withColumn("own", F.col("id") % 9), "own", NUM, CAT)
    monkeypatch.setattr(similarity, "MAX_PROFILES", 4)
    found = similarity.nearest_rows(df, prof, "own", ["id"], NUM, CAT, k=3).collect()
    assert len(found) == 27
    check(pdf, found, prof, "own", k=3)


def test_more_wanted_than_rows(spark):
    pdf, df = table(spark, 6)
    prof = profiles.overall_profile(df, NUM, CAT).withColumn("grp", F.lit("all"))
    found = similarity.nearest_rows(df, prof, "grp", ["id"], NUM, CAT).collect()
    assert len(found) == 6
    check(pdf, found, prof)


def test_missing_values(make):
    rows = make(
        [
            (1, "a", "p", "u", 1.0, 1.0),
            (2, "a", None, "u", 1.0, 1.0),
            (3, "a", "p", "u", None, 1.0),
            (4, "a", "p", "u", 9.0, 1.0),
        ]
    )
    prof = make([(0, "me", "p", "u", 1.0, 1.0)])
    found = similarity.nearest_rows(rows, prof, "grp", ["id"], NUM, CAT).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.rank)] == [1, 2, 4, 3]
    score = {r.id: r.similarity for r in found}
    assert score[1] == 1.0 and score[2] == 0.75 and score[4] == 0.5 and score[3] is None


def test_mostly_missing_column_still_gives_k_rows(spark):
    df = spark.range(300).select(
        "id",
        F.when(F.col("id") % 100 == 7, F.col("id").cast("double")).alias("x"),
        F.lit("a").alias("c1"),
    )
    prof = spark.createDataFrame([("me", 107.0, "a")], "grp string, x double, c1 string")
    found = similarity.nearest_rows(df, prof, "grp", ["id"], ["x"], ["c1"], k=5).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.rank)] == [107, 7, 207, 0, 1]


def test_identical_rows_score_one(make):
    rows = make([(i, "a", "p", "u", 2.0, 3.0) for i in range(4)])
    prof = profiles.profile_table(rows, "grp", NUM, CAT)
    found = similarity.similarity_scores(rows, prof, "grp", ["id"], NUM, CAT).collect()
    assert [r.similarity for r in found] == [1.0] * 4


def test_scores_lie_between_zero_and_one(spark):
    pdf, df = table(spark, 200)
    prof = profiles.profile_table(df, "grp", NUM, CAT)
    found = similarity.similarity_scores(df, prof, "grp", ["id"], NUM, CAT).collect()
    assert len(found) == 600 and all(0 <= r.similarity <= 1 for r in found)
    for p in prof.collect():
        want = dict(zip(pdf["id"], brute(pdf, p)))
        assert all(r.similarity == pytest.approx(want[r.id]) for r in found if r.profile_id == p["grp"])


def test_no_features(spark):
    _, df = table(spark, 10)
    with pytest.raises(ValueError):
        similarity.nearest_rows(df, df.limit(1), "grp", ["id"], [], [])


def test_top_rows_ties_and_missing(make):
    rows = make([(3, "", "", "", 1.0), (1, "", "", "", 1.0), (2, "", "", "", None), (4, "", "", "", 5.0)])
    assert [r.id for r in similarity.top_rows(rows, "x", ["id"], 4).collect()] == [4, 1, 3, 2]


def test_infinite_values_are_refused(make):
    rows = make([(1, "a", "", "", float("inf")), (2, "a", "", "", 1.0), (3, "b", "", "", 2.0)])
    profiles = make([(1, "a", "", "", 1.0)])
    with pytest.raises(Exception, match="infinite values in x"):
        similarity.nearest_rows(rows, profiles, "grp", ["id"], ["x"], []).collect()
