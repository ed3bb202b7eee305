import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segprofile import Exact, FeatureSpec, FilterSpec, OneOf, Range, SpecError
from segprofile.functions.columns import nan_to_null
from segprofile.operators import filters, metrics

SPEC = FeatureSpec(
    key=("id",), descriptive=("id",), numeric=("x", "y"), categorical=("c1", "c2"), group_key="grp", measures=("m",)
)
NAN = float("nan")
INF = float("inf")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture(scope="module")
def rows(make):
    return make(
        [
            (1, "a", "p", "Yes", 1.0, 1.0, 10.0),
            (2, "a", "q", "No", 2.0, 1.0, 20.0),
            (3, "b", None, "Yes", NAN, 1.0, 30.0),
            (4, "b", "p", None, None, 1.0, 40.0),
            (5, None, "r", "No", 5.0, 1.0, 0.0),
        ]
    ).cache()


def test_full_range_drops_missing_numbers(rows):
    assert ids(filters.select_rows(rows, SPEC, FilterSpec())) == [1, 2, 5]


def test_no_filter_keeps_everything_without_full_range(rows):
    assert ids(filters.select_rows(rows, SPEC, FilterSpec(full_range=False))) == [1, 2, 3, 4, 5]


def test_range_keep_null_takes_nan_and_null(rows):
    chosen = FilterSpec([Range("x", 1, 2, keep_null=True)], excluded=["y"])
    assert ids(filters.select_rows(rows, SPEC, chosen)) == [1, 2, 3, 4]


def test_selected_rows_have_no_nan(rows):
    chosen = FilterSpec(full_range=False)
    assert filters.select_rows(rows, SPEC, chosen).where(F.isnan("x")).count() == 0
    assert nan_to_null(rows).where("x IS NULL").count() == 2


def test_membership_and_null(rows):
    off = dict(full_range=False)
    assert ids(filters.select_rows(rows, SPEC, FilterSpec([OneOf("c1", ["p"])], **off))) == [1, 4]
    assert ids(filters.select_rows(rows, SPEC, FilterSpec([OneOf("c1", ["p", None])], **off))) == [1, 3, 4]
    assert ids(filters.select_rows(rows, SPEC, FilterSpec([OneOf("c1", [None])], **off))) == [3]
    assert ids(filters.select_rows(rows, SPEC, FilterSpec([OneOf("c1", [])], **off))) == []


def test_exclusion_drops_the_filter_but_not_key_or_measure(rows):
    chosen = FilterSpec([OneOf("c1", ["p"]), Range("x", 1, 5)], excluded=["c1", "y"])
    found = filters.select_rows(rows, SPEC, chosen)
    assert found.columns == ["id", "x", "c2"] and ids(found) == [1, 2, 5]
    assert {"grp", "m"} <= set(filters.profile_rows(rows, SPEC, chosen).columns)


def test_percent_and_exact(make):
    rows = make([(1, "a", "", "", 0.02), (2, "a", "", "", 0.05), (3, "a", "", "", 0.5)])
    spec = FeatureSpec(key=("id",), numeric=("x",), percent_scaled=("x",))
    assert ids(filters.select_rows(rows, spec, FilterSpec([Range("x", 2, 5)]))) == [1, 2]
    assert ids(filters.select_rows(rows, spec, FilterSpec([Exact("x", "5")]))) == [2]
    assert ids(filters.select_rows(rows, spec, FilterSpec([Range("x", 2, 2), Exact("x", "50")]))) == [3]


def test_bad_specs(rows):
    with pytest.raises(SpecError):
        FilterSpec([Exact("x", "five")]).predicate(rows, SPEC)
    with pytest.raises(SpecError):
        FilterSpec([Range("c1", 1, 2)]).predicate(rows, SPEC)
    with pytest.raises(SpecError):
        FilterSpec([Exact("nope", "1")]).predicate(rows, SPEC)
    with pytest.raises(SpecError):
        FeatureSpec(key=("id",), numeric=("c1",)).validate(rows)
    with pytest.raises(SpecError):
        FeatureSpec(key=("gone",)).validate(rows)


def test_roles_by_type(spark):
    df = spark.sql(
        "SELECT 1 AS id, true AS flag, 1.5 AS x, CAST(2 AS decimal(5,1)) AS dec, 'a' AS c, current_date() AS day"
    )
    spec = FeatureSpec.infer(df, ["id"])
    assert spec.numeric == ("x", "dec") and spec.categorical == ("flag", "c", "day")
    assert spec.features == ("x", "dec", "flag", "c", "day")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, "u"), (2, 8.0, "v")], "`id` long, `A/B (km)` double, `a.b` string")
    spec = FeatureSpec.infer(df, ["id"])
    found = filters.select_rows(df, spec, FilterSpec([Range("A/B (km)", 1, 5), OneOf("a.b", ["u", "v"])]))
    assert ids(found) == [1]
    assert filters.columns_from(df, "A/B (km)").columns == ["A/B (km)", "a.b"]
    domains = {r["feature"]: (r["min"], r["max"]) for r in filters.numeric_domains(df, ["A/B (km)"]).collect()}
    assert domains == {"A/B (km)": (2.0, 8.0)}
    assert filters.categorical_domains(df, ["a.b"]).count() == 2


def test_domains(rows):
    found = {r["feature"]: r for r in filters.numeric_domains(rows, ["x", "y"]).collect()}
    assert (found["x"]["min"], found["x"]["max"], found["x"]["is_constant"]) == (1.0, 5.0, False)
    assert found["y"]["is_constant"] is True
    values = filters.categorical_domains(rows, ["c1"]).collect()
    assert {r["value"] for r in values} == {"p", "q", "r", None}


def test_bad_values(make):
    rows = make([(1, "a", "", "", INF, 1.0), (2, "a", "", "", NAN, -INF), (3, "a", "", "", None, 2.0)])
    found = {r["feature"]: tuple(r)[1:] for r in filters.bad_value_report(rows, ["x", "y"]).collect()}
    assert found == {"x": (1, 1, 1), "y": (0, 0, 1)}


def test_flag_missing_and_size_guard(rows):
    assert ids(filters.exclude_flagged(rows, "c2")) == [2, 5]
    assert ids(filters.drop_missing(rows, ["x"])) == [1, 2, 5]
    assert filters.has_at_least(rows, 5) and not filters.has_at_least(rows, 6)


def test_match_summary(rows):
    predicate = FilterSpec([OneOf("c1", ["p", "q"])], full_range=False).predicate(rows, SPEC)
    r = metrics.match_summary(rows, predicate, {"m": "m"}).first()
    assert (r.total_n, r.match_n, r.total_m, r.match_m) == (5, 3, 100.0, 70.0)
    assert r.pct_n == pytest.approx(60.0) and r.pct_m == pytest.approx(70.0)


def test_match_summary_of_nothing(rows, make):
    nothing = metrics.match_summary(rows, F.lit(False), {"m": "m"}).first()
    assert (nothing.match_n, nothing.match_m, nothing.pct_n) == (0, 0.0, 0.0)
    empty = metrics.match_summary(make([]), F.lit(True), {"m": "m"}).first()
    assert (empty.total_n, empty.total_m, empty.pct_n, empty.pct_m) == (0, 0.0, None, None)
    zero = metrics.match_summary(make([(1, "a", "", "", 1.0, 1.0, 0.0)]), F.lit(True), {"m": "m"}).first()
    assert zero.pct_n == 100.0 and zero.pct_m is None


def test_match_split_adds_up(rows):
    found = metrics.match_split(rows, F.col("c2") == "Yes", {"m": "m"}).collect()
    for measure in ("count", "m"):
        assert sum(r.pct for r in found if r.measure == measure) == pytest.approx(100.0)
    assert {(r.part, r.amount) for r in found if r.measure == "count"} == {("Matching", 2.0), ("Not Matching", 3.0)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.floats(0, 5), st.floats(0, 5), st.sets(st.sampled_from(["p", "q", "r", None])), st.booleans()
)
def test_one_predicate_equals_joins_per_column(rows, a, b, chosen, excluded):
    """The conjunction gives what joining one filtered column after another on the key gives."""
    lo, hi = min(a, b), max(a, b)
    out = ["c1"] if excluded else []
    spec = FilterSpec([Range("x", lo, hi), OneOf("c1", chosen)], excluded=[*out, "y", "c2"])
    got = filters.select_rows(rows, SPEC, spec)
    joined = rows.select("id").join(rows.where(F.col("x").between(lo, hi)).select("id"), "id")
    if not excluded:
        member = F.col("c1").isin([c for c in chosen if c]) if chosen - {None} else F.lit(False)
        if None in chosen:
            member = member | F.col("c1").isNull()
        joined = joined.join(rows.where(member).select("id"), "id")
    assert ids(got) == ids(joined)
