import pytest
from pyspark.sql import functions as F

from segprofile.operators import crosstab, profiles

NAN = float("nan")


@pytest.fixture(scope="module")
def rows(make):
    return make(
        [
            (1, "a", "y", "Yes", 1.0, 7.0),
            (2, "a", "x", "No", 3.0, 7.0),
            (3, "a", "x", "Yes", NAN, 7.0),
            (4, "a", "y", "Yes", None, 7.0),
            (5, "b", "z", None, 4.0, 7.0),
            (6, None, "z", "No", 100.0, 7.0),
        ]
    ).cache()


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_overall(rows):
    r = profiles.overall_profile(rows, ["x", "y"], ["c1", "c2"]).first()
    assert r.x == pytest.approx(27.0) and r.y == 7.0
    # x, y and z occur twice each: the smallest value wins
    assert (r.c1, r.c2) == ("x", "Yes")


def test_overall_without_categories_or_rows(rows, make):
    assert profiles.overall_profile(rows, ["x"], []).columns == ["x"]
    assert profiles.overall_profile(rows, [], ["c1"]).first().c1 == "x"
    empty = profiles.overall_profile(make([]), ["x"], ["c1"]).first()
    assert tuple(empty) == (None, None)


def test_category_mean_and_std(rows):
    mean = by(profiles.category_mean(rows, "grp", ["x", "y"]), "grp")
    assert set(mean) == {"a", "b"} and mean["a"].x == 2.0
    std = by(profiles.category_std(rows, "grp", ["x", "y"]), "grp")
    assert std["a"].x == pytest.approx(2**0.5) and std["b"].x is None


def test_std_filled_only_where_all_are_missing(make):
    singles = make([(1, "a", "", "", 1.0), (2, "b", "", "", 2.0)])
    assert [r.x for r in profiles.category_std_filled(singles, "grp", ["x"]).collect()] == [0.0, 0.0]
    mixed = make([(1, "a", "", "", 1.0), (2, "b", "", "", 2.0), (3, "b", "", "", 4.0)])
    found = by(profiles.category_std_filled(mixed, "grp", ["x"]), "grp")
    assert found["a"].x is None and found["b"].x == pytest.approx(2**0.5)


def test_two_tie_rules(rows):
    smallest = by(profiles.category_mode(rows, "grp", ["grp", "c1", "c2"]), "grp")
    assert smallest["a"].c1 == "x" and smallest["b"].c2 is None
    first = by(profiles.mode_first_seen(rows, "grp", ["c1"], ["id"]), "grp")
    assert first["a"].c1 == "y"
    composite = by(profiles.mode_first_seen(rows, "grp", ["c1"], ["m", "id"]), "grp")
    assert composite["a"].c1 == "y"


def test_profile_table_and_selection(rows):
    table = by(profiles.profile_table(rows, "grp", ["x", "y"], ["grp", "c1"]), "grp")
    assert table["a"].x == 2.0 and table["a"].c1 == "x"
    found = profiles.category_summary_selected(rows, "grp", ["y", "x"], ["b", "nowhere", "a"]).collect()
    assert [(r.category, r.feature) for r in found] == [("b", "x"), ("b", "y"), ("a", "x"), ("a", "y")]


def test_errorbars(rows):
    found = {(r.category, r.feature): r for r in profiles.category_mean_errorbars(rows, "grp", ["x"]).collect()}
    a = found["a", "x"]
    assert a.hi - a.mean == pytest.approx(a.std) and a.mean - a.lo == pytest.approx(a.std)


def test_counts_skip_missing(rows):
    found = {(r.category, r.feature, r.value): r.n for r in crosstab.category_value_counts(rows, "grp", ["c1", "c2"]).collect()}
    assert found == {
        ("a", "c1", "x"): 2, ("a", "c1", "y"): 2, ("b", "c1", "z"): 1, ("a", "c2", "Yes"): 3, ("a", "c2", "No"): 1,
    }


def test_group_key_crossed_with_itself(rows):
    labels = crosstab.crosstab_labels(rows, ["grp", "c1"])
    found = crosstab.crosstab_pct(rows, "grp", ["grp", "c1"], labels).collect()
    own = {(r.category, r.value): r.pct for r in found if r.is_group_key}
    assert own == {("a", "a"): 100.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 100.0}
    for category in ("a", "b"):
        assert sum(r.pct for r in found if r.category == category and r.feature == "c1") == pytest.approx(100.0)


def test_shared_values_stay_apart(make):
    rows = make([(1, "a", "Yes", "No"), (2, "a", "Yes", "Yes"), (3, "b", "No", "Yes")])
    wide = {(r["feature"], r["category"]): r for r in crosstab.crosstab_pct_wide(rows, "grp", ["c1", "c2"]).collect()}
    assert wide["c1", "a"]["c1-Yes"] == 100.0 and wide["c1", "a"]["c1-No"] == 0.0
    assert wide["c2", "a"]["c2-Yes"] == 50.0 and wide["c2", "a"]["c1-Yes"] is None


def test_sparse_form_has_observed_cells_only(rows):
    assert crosstab.crosstab_pct(rows, "grp", ["c1"]).count() == 3
    with pytest.raises(ValueError):
        crosstab.crosstab_labels(rows, ["c1"], max_labels=2)


def test_crosstab_counts_and_value_counts(rows):
    wide = by(crosstab.crosstab_counts(rows, "grp", "c1"), "category")
    assert (wide["a"]["x"], wide["a"]["z"], wide["b"]["z"]) == (2, 0, 1)
    counts = crosstab.value_counts_pct(rows.where(F.col("id") < 6), "c1").collect()
    assert [(r.value, r.n) for r in counts] == [("x", 2), ("y", 2), ("z", 1)]
    assert sum(r.pct for r in counts) == pytest.approx(100.0)


def test_dense_form_takes_any_number_of_values(spark):
    rows = spark.range(1501).selectExpr("IF(id = 0, 'a', 'b') AS grp", "CAST(id AS STRING) AS c1")
    dense = crosstab.crosstab_pct(rows, "grp", ["c1"], dense=True).collect()
    assert len(dense) == 2 * 1501 and sum(r.n for r in dense) == 1501
    assert sum(r.pct for r in dense if r.category == "a") == 100.0
