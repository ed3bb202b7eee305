"""What the plans must look like to hold on a large cluster."""

import re

from segprofile.catalog.bindings import LINE_KEY, LINE_MEASURES, LINES, ORDERS, table
from segprofile.catalog.queries import QUERIES
from segprofile.operators import crosstab, distributions, filters, metrics, profiles, similarity
from segprofile.spec import FilterSpec, OneOf, Range

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def scans(text: str) -> int:
    return len(re.findall(r"^\(\d+\) Scan parquet", text, re.M))


def test_selection_is_one_scan_with_pushed_filters(spark):
    chosen = FilterSpec(
        [Range("o_totalprice", 100000, 300000), OneOf("o_orderstatus", ["O", "F"])], excluded=["o_orderpriority"]
    )
    text = plan(filters.select_rows(table(spark, SF, "orders"), ORDERS, chosen))
    assert scans(text) == 1 and "Exchange" not in text
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "GreaterThanOrEqual(o_totalprice,100000" in pushed and "In(o_orderstatus" in pushed
    assert "o_orderpriority" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_match_summary_is_one_scan_of_the_needed_columns(spark):
    lines = table(spark, SF, "lineitem")
    text = plan(metrics.match_summary(lines, OneOf("l_returnflag", ["A"]).predicate(lines.schema["l_returnflag"].dataType, 1), LINE_MEASURES))
    assert scans(text) == 1 and text.count("Exchange (") == 1
    assert re.search(r"ReadSchema: (.*)", text).group(1).count(":") == 3


def test_top_rows_keep_only_k_per_task(spark):
    text = plan(similarity.top_rows(table(spark, SF, "orders"), "o_totalprice", ["o_orderkey"]))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_counts_are_added_up_before_the_shuffle(spark):
    text = plan(crosstab.category_value_counts(table(spark, SF, "orders"), "o_orderstatus", ORDERS.categorical))
    assert scans(text) == 1 and "partial_count" in text and text.count("Exchange (") == 1


def test_means_and_deviations_share_a_pass(spark):
    text = plan(profiles.category_mean_errorbars(table(spark, SF, "lineitem"), "l_returnflag", LINES.numeric))
    assert scans(text) == 1 and "partial_stddev_samp" in text


def test_histogram_and_curve_shuffle_counts_only(spark):
    lines = table(spark, SF, "lineitem")
    layout = distributions.fixed_bins(lines, ["l_quantity"], 10)
    for df, partial in (
        (distributions.histogram(lines, ["l_quantity"], layout), "partial_count"),
        (distributions.kde_curve(lines, ["l_quantity"], layout), "partial_sum"),
    ):
        text = plan(df)
        assert partial in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_nearest_rows_neither_join_nor_sort_the_candidates(spark):
    lines = table(spark, SF, "lineitem")
    prof = profiles.profile_table(lines, "l_returnflag", LINES.numeric, LINES.categorical)
    text = plan(similarity.nearest_rows(lines, prof, "l_returnflag", LINE_KEY, LINES.numeric, LINES.categorical))
    assert "Join" not in text and "CartesianProduct" not in text
    # only rows at or above the bound are ranked, and at most k per task are shuffled
    assert "WindowGroupLimit" in text and "Filter" in text


def test_no_query_multiplies_tables(spark):
    for name, build in QUERIES.items():
        if name.startswith(("kmeans", "cluster", "similar_rows_by_cluster", "pca")):
            continue
        text = plan(build(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_key_is_never_made_up(spark):
    text = plan(filters.select_rows(table(spark, SF, "orders"), ORDERS, FilterSpec()))
    assert "monotonically_increasing_id" not in text
