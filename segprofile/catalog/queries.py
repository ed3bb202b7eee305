"""One query per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segprofile.catalog.bindings import (
    LINE_KEY,
    LINE_MEASURES,
    LINES,
    ORDERS,
    SECTIONS,
    nullable_orders,
    sections,
    table,
)
from segprofile.functions.staging import stage, staging_root
from segprofile.operators import clustering, crosstab, distributions, filters, metrics, nearest, observed, profiles
from segprofile.operators import reduction, similarity
from segprofile.plans import analyses
from segprofile.sources import cluster_view, report
from segprofile.sources.readers import column_roles as roles_of
from segprofile.sources.readers import relabel as relabelled
from segprofile.sources.readers import relabel_from
from segprofile.spec import Exact, FilterSpec, OneOf, Range

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles to a fixed number of places, as the order of a sum moves the last ones."""
    chosen = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in chosen})


# --- scans and columns ---------------------------------------------------------------------


@query
def scan_sections(spark, d):
    return table(spark, d, "part")


@query
def column_roles(spark, d):
    return roles_of(nullable_orders(spark, d), ORDERS)


@query
def columns_from(spark, d):
    return filters.columns_from(table(spark, d, "part"), "p_type")


@query
def relabel(spark, d):
    """Customers with Dutch names; segments by dictionary, nations by a table of labels."""
    customer = table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment", "c_acctbal"
    )
    nation = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    named = relabel_from(customer, "c_nationkey", nation, "n_nationkey", "n_name")
    return relabelled(
        named,
        {"c_custkey": "klant", "c_nationkey": "land", "c_mktsegment": "segment", "c_acctbal": "saldo"},
        {"c_mktsegment": {"BUILDING": "BOUW", "MACHINERY": "MACHINES", "HOUSEHOLD": "HUISHOUDEN"}},
    )


@query
def align_feature_tables(spark, d):
    return rounded(sections(spark, d), columns=["avg_discount"])


# --- filters -------------------------------------------------------------------------------


@query
def filter_range(spark, d):
    chosen = FilterSpec([Range("l_quantity", 10, 20)], full_range=False)
    return filters.select_rows(table(spark, d, "lineitem"), LINES, chosen)


@query
def filter_range_missing(spark, d):
    """Without a filter of its own an included numeric column still drops missing values."""
    return filters.select_rows(nullable_orders(spark, d), ORDERS, FilterSpec())


@query
def filter_range_keep_null(spark, d):
    chosen = FilterSpec([Range("o_totalprice", 50000, 150000, keep_null=True)])
    return filters.select_rows(nullable_orders(spark, d), ORDERS, chosen)


@query
def filter_membership(spark, d):
    chosen = FilterSpec([OneOf("o_orderpriority", ["1-URGENT", "2-HIGH"])])
    return filters.select_rows(table(spark, d, "orders"), ORDERS, chosen)


@query
def filter_membership_null(spark, d):
    chosen = FilterSpec([OneOf("o_orderpriority", ["1-URGENT", None])], full_range=False)
    return filters.select_rows(nullable_orders(spark, d), ORDERS, chosen)


@query
def filter_membership_nan(spark, d):
    """Small prices read as NaN, which is missing."""
    gaps = table(spark, d, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") < 50000, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    )
    chosen = FilterSpec([OneOf("o_totalprice", [None])], full_range=False)
    return filters.select_rows(gaps, ORDERS, chosen).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query
def filter_exact_scaled(spark, d):
    chosen = FilterSpec([Exact("l_discount", "5")], full_range=False)
    return filters.select_rows(table(spark, d, "lineitem"), LINES, chosen)


@query
def filter_percent_range(spark, d):
    chosen = FilterSpec([Range("l_discount", 2, 6)], full_range=False)
    return filters.select_rows(table(spark, d, "lineitem"), LINES, chosen)


@query
def filter_precedence(spark, d):
    chosen = FilterSpec([Range("l_quantity", 1, 50), Exact("l_quantity", "17")], full_range=False)
    return filters.select_rows(table(spark, d, "lineitem"), LINES, chosen)


@query
def filter_exact_id(spark, d):
    lines = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return lines.where(FilterSpec([Exact("c_name", "Customer#000000042")], full_range=False).predicate(lines, ORDERS))


@query
def filter_flag(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_KEY, "l_returnflag", "l_linestatus")
    return filters.exclude_flagged(lines, "l_linestatus", keep="F")


@query
def filter_conjunction(spark, d):
    chosen = FilterSpec(
        [
            OneOf("l_returnflag", ["A", "R"]),
            OneOf("l_linestatus", ["F"]),
            Range("l_quantity", 5, 45),
            Range("l_extendedprice", 1000, 60000),
            Range("l_discount", 1, 9),
            Range("l_tax", 0.01, 0.07),
        ],
        full_range=False,
    )
    return filters.select_rows(table(spark, d, "lineitem"), LINES, chosen)


@query
def filter_empty_selection(spark, d):
    """A cleared list matches nothing: everything is left in the total."""
    orders = table(spark, d, "orders")
    chosen = FilterSpec([OneOf("o_orderpriority", [])])
    return rounded(
        metrics.match_summary(orders, chosen.predicate(orders, ORDERS), {"price": "o_totalprice"}), 2
    )


@query
def filter_and_project(spark, d):
    chosen = FilterSpec(
        [Range("o_totalprice", 100000, 300000), OneOf("o_orderstatus", ["O", "F"])],
        excluded=["o_orderpriority"],
    )
    return filters.select_rows(table(spark, d, "orders"), ORDERS, chosen)


@query
def exclude_column_drops_filter(spark, d):
    chosen = FilterSpec(
        [Range("o_totalprice", 100000, 300000), OneOf("o_orderstatus", ["O"])],
        excluded=["o_orderstatus"],
    )
    return filters.select_rows(table(spark, d, "orders"), ORDERS, chosen)


@query
def drop_missing(spark, d):
    return filters.drop_missing(nullable_orders(spark, d), ["o_totalprice"])


@query
def bad_value_report(spark, d):
    """Quantity is missing for flag R, discount not a number for A, tax infinite at 0."""
    x = table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_returnflag") == "A", F.lit(float("nan")))
        .otherwise(F.col("l_discount"))
        .alias("discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("tax"),
    )
    return filters.bad_value_report(x, ["quantity", "discount", "tax"])


@query
def numeric_domains(spark, d):
    lines = table(spark, d, "lineitem").withColumn("one", F.col("l_quantity") * 0 + 1)
    found = filters.numeric_domains(lines, [*LINES.numeric, "one"])
    # zero may be stored with either sign
    return found.withColumns({c: F.col(c) + F.lit(0.0) for c in ("min", "max")})


@query
def categorical_domains(spark, d):
    return filters.categorical_domains(nullable_orders(spark, d), ORDERS.categorical)


# --- match metrics -------------------------------------------------------------------------

_MATCH = FilterSpec([Range("l_discount", 2, 6), OneOf("l_returnflag", ["A", "R"])])


@query
def match_summary(spark, d):
    lines = table(spark, d, "lineitem")
    found = metrics.match_summary(lines, _MATCH.predicate(lines, LINES), LINE_MEASURES)
    return rounded(rounded(found, 2, ["total_price", "match_price"]))


@query
def match_summary_observed(spark, d):
    """The same figures, seen while the matching rows are written, and how many rows were written."""
    lines = table(spark, d, "lineitem")
    path = f"{staging_root(spark).rstrip('/')}/segprofile-matching-{uuid.uuid4().hex}"
    found = observed.write_matching(lines, _MATCH.predicate(lines, LINES), LINE_KEY, path, LINE_MEASURES)
    written = spark.read.parquet(path).agg(F.count("*")).scalar()
    return rounded(rounded(found.summary(), 2, ["total_price", "match_price"])).withColumn("n_written", written)


@query
def bad_values_observed(spark, d):
    """Missing and impossible values of all orders, counted while some of them are written."""
    orders = nullable_orders(spark, d)
    path = f"{staging_root(spark).rstrip('/')}/segprofile-matching-{uuid.uuid4().hex}"
    dear = F.col("o_totalprice") >= 100000
    return observed.write_matching(orders, dear, ["o_orderkey"], path, {}, ["o_totalprice", "o_custkey"]).bad_values()


@query
def match_split(spark, d):
    lines = table(spark, d, "lineitem")
    found = metrics.match_split(lines, _MATCH.predicate(lines, LINES), LINE_MEASURES)
    return rounded(rounded(found, 2, ["amount"]))


# --- profiles ------------------------------------------------------------------------------


@query
def overall_profile(spark, d):
    return rounded(
        profiles.overall_profile(table(spark, d, "lineitem"), LINES.numeric, LINES.categorical)
    )


@query
def overall_profile_long(spark, d):
    wide = profiles.overall_profile(nullable_orders(spark, d), ORDERS.numeric, ORDERS.categorical)
    return rounded(profiles.profile_long(wide, ORDERS.numeric, ORDERS.categorical))


@query
def filtered_profile_long(spark, d):
    rows = filters.select_rows(table(spark, d, "lineitem"), LINES, _MATCH)
    return rounded(profiles.mean_long(rows, LINES.numeric))


@query
def category_mean(spark, d):
    found = profiles.category_mean(table(spark, d, "lineitem"), "l_returnflag", LINES.numeric)
    return rounded(found).orderBy("l_returnflag")


@query
def category_mean_null_key(spark, d):
    found = profiles.category_mean(nullable_orders(spark, d), "o_orderstatus", ORDERS.numeric)
    return rounded(found).orderBy("o_orderstatus")


@query
def category_std(spark, d):
    found = profiles.category_std(table(spark, d, "lineitem"), "l_returnflag", LINES.numeric)
    return rounded(found).orderBy("l_returnflag")


@query
def category_std_filled(spark, d):
    """Every status total is a group of one row per status, so its deviation is 0 throughout."""
    totals = (
        table(spark, d, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"))
    )
    return profiles.category_std_filled(totals, "o_orderstatus", ["n", "price"]).orderBy("o_orderstatus")


@query
def category_mode(spark, d):
    found = profiles.category_mode(sections(spark, d), "p_type", ["p_type", "p_brand", "p_name"])
    return found.orderBy("p_type")


@query
def mode_first_seen(spark, d):
    return profiles.mode_first_seen(
        sections(spark, d), "p_brand", ["p_type", "p_name"], ["p_partkey"]
    ).orderBy("p_brand")


@query
def mode_first_seen_lines(spark, d):
    """The row key has several columns."""
    lines = table(spark, d, "lineitem").withColumn("quantity", F.col("l_quantity").cast("int").cast("string"))
    return profiles.mode_first_seen(
        lines, "l_returnflag", ["l_linestatus", "quantity"], ["l_orderkey", "l_linenumber"]
    ).orderBy("l_returnflag")


@query
def profile_table(spark, d):
    return rounded(
        profiles.profile_table(sections(spark, d), "p_type", SECTIONS.numeric, SECTIONS.categorical)
    )


@query
def category_summary_selected(spark, d):
    found = profiles.category_summary_selected(
        table(spark, d, "lineitem"), "l_returnflag", LINES.numeric, ["R", "A", "X"]
    )
    return rounded(found)


@query
def category_mean_errorbars(spark, d):
    return rounded(
        profiles.category_mean_errorbars(table(spark, d, "lineitem"), "l_returnflag", LINES.numeric)
    )


# --- counts --------------------------------------------------------------------------------


@query
def category_value_counts(spark, d):
    return crosstab.category_value_counts(nullable_orders(spark, d), "o_orderstatus", ORDERS.categorical)


@query
def value_counts_pct(spark, d):
    return rounded(crosstab.value_counts_pct(table(spark, d, "orders"), "o_orderpriority"))


@query
def crosstab_counts(spark, d):
    return crosstab.crosstab_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query
def crosstab_pct(spark, d):
    """Brand by type with a cell for every brand, and type by itself."""
    parts = table(spark, d, "part")
    columns = ["p_type", "p_brand", "p_name"]
    return rounded(crosstab.crosstab_pct(parts, "p_type", columns, dense=True))


@query
def crosstab_pct_sparse(spark, d):
    parts = table(spark, d, "part")
    return rounded(crosstab.crosstab_pct(parts, "p_brand", ["p_type", "p_name"]))


@query
def crosstab_pct_wide(spark, d):
    return rounded(
        crosstab.crosstab_pct_wide(
            table(spark, d, "orders"), "o_orderstatus", ["o_orderstatus", "o_orderpriority"]
        )
    )


# --- distributions -------------------------------------------------------------------------


@query
def histogram_fixed(spark, d):
    lines = table(spark, d, "lineitem")
    columns = ["l_quantity", "l_extendedprice"]
    return rounded(distributions.histogram(lines, columns, distributions.fixed_bins(lines, columns, 17)))


@query
def histogram_auto(spark, d):
    lines = table(spark, d, "lineitem")
    layout = distributions.auto_bins(lines, LINES.numeric)
    return rounded(distributions.histogram(lines, LINES.numeric, layout))


@query
def histogram_integer(spark, d):
    """Integers: no bin is narrower than 1."""
    lines = table(spark, d, "lineitem")
    layout = distributions.auto_bins(lines, ["l_linenumber"])
    part = table(spark, d, "part")
    sizes = distributions.histogram(part, ["p_size"], distributions.auto_bins(part, ["p_size"]))
    return rounded(distributions.histogram(lines, ["l_linenumber"], layout).unionByName(sizes))


@query
def histogram_events(spark, d):
    """A skewed column."""
    events = table(spark, d, "events")
    return rounded(distributions.histogram(events, ["value"], distributions.auto_bins(events, ["value"])))


@query
def kde_curve(spark, d):
    """Skewed event values on their own bins."""
    events = table(spark, d, "events")
    return rounded(distributions.kde_curve(events, ["value"], distributions.auto_bins(events, ["value"])))


@query
def kde_curve_fixed(spark, d):
    """Prices, nearly all distinct, over 40 bins."""
    lines = table(spark, d, "lineitem")
    columns = ["l_quantity", "l_extendedprice"]
    return rounded(distributions.kde_curve(lines, columns, distributions.fixed_bins(lines, columns, 40)), 5)


@query
def box_stats(spark, d):
    return rounded(
        distributions.box_stats(table(spark, d, "lineitem"), "l_returnflag", LINES.numeric)
    )


@query
def box_stats_events(spark, d):
    return rounded(distributions.box_stats(table(spark, d, "events"), "event_type", ["value"]))


@query
def box_outliers(spark, d):
    return distributions.box_outliers(table(spark, d, "events"), "event_type", ["value"], ["event_id"])


# --- scaling and similarity ----------------------------------------------------------------


@query
def impute_mean(spark, d):
    return rounded(
        clustering.impute_mean(nullable_orders(spark, d), ["o_totalprice"]).select(
            "o_orderkey", "o_totalprice"
        )
    )


@query
def standardize(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    one = orders.withColumn("constant", F.col("o_totalprice") * 0 + 7)
    return rounded(clustering.standardize(one, ["o_totalprice", "o_custkey", "constant"]))


@query
def similarity_scores(spark, d):
    """Every part against the profile of each type."""
    parts = stage(sections(spark, d))
    table_ = profiles.profile_table(parts, "p_type", SECTIONS.numeric, SECTIONS.categorical)
    return rounded(
        similarity.similarity_scores(
            parts, table_, "p_type", SECTIONS.key, SECTIONS.numeric, SECTIONS.categorical
        )
    )


@query
def similar_rows_overall(spark, d):
    """The ten order lines nearest to the average line."""
    lines = table(spark, d, "lineitem")
    overall = profiles.overall_profile(lines, LINES.numeric, LINES.categorical)
    return rounded(
        similarity.nearest_rows(
            lines,
            overall.withColumn("profile_id", F.lit("overall")),
            "profile_id",
            LINE_KEY,
            LINES.numeric,
            LINES.categorical,
        )
    )


@query
def similar_rows_by_category(spark, d):
    """For every part type the ten real parts nearest to the type's profile."""
    parts = stage(sections(spark, d))
    table_ = profiles.profile_table(parts, "p_type", SECTIONS.numeric, SECTIONS.categorical)
    return rounded(
        similarity.nearest_rows(
            parts,
            table_,
            "p_type",
            SECTIONS.key,
            SECTIONS.numeric,
            SECTIONS.categorical,
            label=("p_name",),
        )
    )


@query
def similar_rows_filtered_profile(spark, d):
    """Profiles of the matching lines only, candidates and scales from all lines."""
    lines = table(spark, d, "lineitem")
    rows = filters.profile_rows(lines, LINES, _MATCH)
    table_ = profiles.profile_table(rows, "l_returnflag", LINES.numeric, LINES.categorical)
    return rounded(
        similarity.nearest_rows(
            lines, table_, "l_returnflag", LINE_KEY, LINES.numeric, LINES.categorical
        )
    )


@query
def topk_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return similarity.top_rows(orders, "o_totalprice", ["o_orderkey"])


# --- clusters and components ---------------------------------------------------------------


def _clusters(spark, d):
    parts = stage(sections(spark, d))
    return clustering.cluster_rows(parts, SECTIONS.numeric)


@query
def kmeans_labels(spark, d):
    """Every part with its cluster."""
    return _clusters(spark, d).rows.select("p_partkey", "cluster")


@query
def kmeans_clusters(spark, d):
    """What any k-means result must satisfy, checked on every row.

    No row is nearer to another centre than to its own, every centre is the mean
    of its rows, and numbers run from the largest cluster down.
    """
    parts = stage(sections(spark, d))
    found = clustering.cluster_rows(parts, SECTIONS.numeric)
    names = [f"z{i}" for i in range(len(SECTIONS.numeric))]
    both = found.rows.withColumns({n: F.col(c).cast("double") for n, c in zip(names, SECTIONS.numeric)})
    z = clustering.standardize(both, names)
    centers = found.centers

    def squared(center):
        return sum(((F.col(n) - F.lit(x)) * (F.col(n) - F.lit(x)) for n, x in zip(names, center)), F.lit(0.0))

    distances = F.array(*[squared(c) for c in centers])
    own = F.get("distances", F.col("cluster"))
    checked = z.withColumn("distances", distances).withColumn(
        "astray", own > F.array_min("distances") + 1e-9
    )
    per = checked.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.count_if("astray").alias("astray"),
        *[F.avg(n).alias(n) for n in names],
    )
    center = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers])
    shift = F.greatest(*[F.abs(F.col(n) - F.get(F.get(center, F.col("cluster")), F.lit(i))) for i, n in enumerate(names)])
    larger = F.lag("n").over(W.partitionBy(F.lit(0)).orderBy("cluster")) < F.col("n")
    ordered = per.withColumn("shift", shift).withColumn("larger", larger)
    return ordered.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_clusters"),
        F.sum("astray").alias("n_astray"),
        (F.max("shift") < 0.05).alias("centers_are_means"),
        (F.count_if("larger") == 0).alias("numbered_by_size"),
        (F.lit(found.cost) < F.lit(float(len(names))) * F.sum("n")).alias("better_than_one_cluster"),
    )


@query
def cluster_points(spark, d):
    """Every part with its cluster and its place on three principal components."""
    rows = stage(_clusters(spark, d).rows)
    return reduction.principal_components(rows, SECTIONS.numeric, ["p_partkey", "cluster"]).rows


@query
def kmeans_small_n(spark, d):
    """Three rows, five clusters wanted: every row its own cluster."""
    totals = (
        table(spark, d, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))
    )
    rows = clustering.cluster_rows(stage(totals), ["n", "price"]).rows
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"))


@query
def cluster_sizes(spark, d):
    sizes = clustering.cluster_sizes(_clusters(spark, d).rows)
    return sizes.agg(
        F.sum("n").alias("n_rows"),
        F.min("cluster").alias("first_cluster"),
        F.max("cluster").alias("last_cluster"),
        F.round(F.sum("pct"), 6).alias("pct_sum"),
        (F.min("n") > 0).alias("none_empty"),
    )


@query
def cluster_summary(spark, d):
    """Cluster means weighted by size give the overall means; each mode is a value of its column."""
    rows = stage(_clusters(spark, d).rows)
    summary = clustering.cluster_summary(rows, SECTIONS.numeric, SECTIONS.categorical, SECTIONS.key)
    sized = summary.join(clustering.cluster_sizes(rows), "cluster")
    return sized.agg(
        F.count("*").alias("n_clusters"),
        *[F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(c) for c in SECTIONS.numeric],
        F.count("p_type").alias("n_types"),
        F.count("p_brand").alias("n_brands"),
    )


@query
def similar_rows_many_profiles(spark, d):
    """For every brand and type of part, thousands of profiles, the ten parts nearest to it; no row meets every profile."""
    parts = stage(sections(spark, d))
    index = nearest.PivotIndex(parts, SECTIONS.key, SECTIONS.numeric, SECTIONS.categorical)
    means = parts.groupBy("p_brand", "p_type").agg(*[F.avg(c).alias(c) for c in SECTIONS.numeric])
    near = index.nearest(means.withColumn("kind", F.concat_ws("/", "p_brand", "p_type")), "kind")
    return rounded(near.select("profile_id", "rank", "p_partkey", "similarity"))


@query
def similar_rows_by_cluster(spark, d):
    parts = stage(sections(spark, d))
    rows = stage(clustering.cluster_rows(parts, SECTIONS.numeric).rows)
    summary = clustering.cluster_summary(rows, SECTIONS.numeric, SECTIONS.categorical, SECTIONS.key)
    near = similarity.nearest_rows(
        parts, summary, "cluster", SECTIONS.key, SECTIONS.numeric, SECTIONS.categorical
    )
    better = F.lag("similarity").over(W.partitionBy("profile_id").orderBy("rank")) < F.col("similarity")
    return near.withColumn("better", better).agg(
        F.countDistinct("profile_id").alias("n_profiles"),
        F.count("*").alias("n_rows"),
        F.max("rank").alias("last_rank"),
        (F.min("similarity") >= 0).alias("not_negative"),
        (F.max("similarity") <= 1).alias("at_most_one"),
        F.count_if("better").alias("n_out_of_order"),
    )


def _given(spark, d):
    """Parts with a label that is given, as clusters whose every figure can be stated."""
    return stage(sections(spark, d).withColumn("cluster", (F.col("p_size") % 5).cast("int")))


@query
def cluster_points_checked(spark, d):
    """Every part once: a cluster of five, and a place on the axes no farther out than the part's scaled features."""
    rows = stage(_clusters(spark, d).rows)
    view = cluster_view.cluster_view(rows, SECTIONS.numeric)
    along = sum((F.col(f"pc{i}") * F.col(f"pc{i}") for i in (1, 2, 3)), F.lit(0.0))
    whole = sum((F.col(f"z_{c}") * F.col(f"z_{c}") for c in SECTIONS.numeric), F.lit(0.0))
    return view.select(
        "p_partkey",
        F.col("cluster").between(0, 4).alias("known_cluster"),
        (along <= whole + 1e-9).alias("inside"),
        F.round(whole, 6).alias("squared"),
    )


@query
def cluster_subset_view(spark, d):
    """The scaled features of one given cluster, read from its folder of the written view."""
    path = f"{staging_root(spark).rstrip('/')}/segprofile-view-{uuid.uuid4().hex}"
    cluster_view.write_cluster_view(cluster_view.cluster_view(_given(spark, d), SECTIONS.numeric), path)
    subset = cluster_view.read_clusters(spark, path, [2])
    return rounded(subset.select("p_partkey", "cluster", "p_type", *[f"z_{c}" for c in SECTIONS.numeric]))


@query
def cluster_summary_given(spark, d):
    """Means and first-seen modes of given clusters."""
    rows = _given(spark, d)
    return rounded(clustering.cluster_summary(rows, SECTIONS.numeric, SECTIONS.categorical, SECTIONS.key))


@query
def similar_rows_given_clusters(spark, d):
    """The ten parts nearest to the summary of every given cluster."""
    rows = _given(spark, d)
    summary = clustering.cluster_summary(rows, SECTIONS.numeric, SECTIONS.categorical, SECTIONS.key)
    near = similarity.nearest_rows(rows, summary, "cluster", SECTIONS.key, SECTIONS.numeric, SECTIONS.categorical)
    return rounded(near.select("profile_id", "rank", "p_partkey", "similarity"))


@query
def clusters_missing_modes(spark, d):
    """Clusters that have means and, as they miss their categories, no modes."""
    known = F.col("cluster").isin(1, 3)
    rows = stage(_given(spark, d).withColumns({c: F.when(~known, F.col(c)) for c in SECTIONS.categorical}))
    means = profiles.category_mean(rows, "cluster", SECTIONS.numeric)
    complete = filters.drop_missing(rows, SECTIONS.categorical)
    modes = profiles.mode_first_seen(complete, "cluster", SECTIONS.categorical, SECTIONS.key)
    return clustering.clusters_without_modes(means, modes)


def _committed_long(spark, frames: dict[str, DataFrame], by: str) -> DataFrame:
    """A report committed and read back: counts of the manifest, means, modes, and nearest rows, in one long frame."""
    path = f"{staging_root(spark).rstrip('/')}/segprofile-report-{uuid.uuid4().hex}"
    report.commit_report(frames, path, skip_empty=True)
    none = F.lit(None).cast("string")

    def long(name: str, table: DataFrame, category, feature, number, text) -> DataFrame:
        return table.select(
            F.lit(name).alias("frame"), category.cast("string").alias("category"), feature.alias("feature"),
            number.cast("double").alias("number"), text.alias("text"),
        )

    read = {name: report.read_committed(spark, path, name) for name in ("means", "modes", "nearest_rows")}
    means = read["means"].unpivot([by], [F.col(c).cast("double").alias(c) for c in SECTIONS.numeric], "feature", "number")
    kinds = [c for c in SECTIONS.categorical if c != by]
    modes = read["modes"].unpivot([by], kinds, "feature", "text")
    near = read["nearest_rows"]
    tables = report.committed_tables(spark, path)
    null = F.lit(None).cast("double")
    parts = [
        long("manifest", tables, none, F.col("name"), F.col("n_rows"), none),
        long("means", means, F.col(by), F.col("feature"), F.round("number", 6) + F.lit(0.0), none),
        long("modes", modes, F.col(by), F.col("feature"), null, F.col("text")),
        long("nearest_rows", near, F.col("profile_id"), F.col("rank").cast("string"), F.round("similarity", 6), F.col("p_partkey").cast("string")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def category_report_long(spark, d):
    """The report per type of part, written, committed and read back."""
    found = analyses.category_report(stage(sections(spark, d)), SECTIONS)
    return _committed_long(spark, {n: found[n] for n in ("means", "modes", "value_counts", "nearest_rows")}, "p_type")


@query
def cluster_report_long(spark, d):
    """The report per given cluster, written, committed and read back; frames without rows are left out."""
    rows = _given(spark, d)
    return _committed_long(spark, analyses.labelled_report(rows, rows.drop("cluster"), SECTIONS), "cluster")


@query
def feature_covariance(spark, d):
    return rounded(reduction.feature_covariance(table(spark, d, "lineitem"), LINES.numeric), 4)


_AXES = ["l_quantity", "l_extendedprice", "l_discount"]


@query
def pca_projection(spark, d):
    """Every order line on its three principal components."""
    lines = table(spark, d, "lineitem")
    found = reduction.principal_components(lines, _AXES, LINE_KEY)
    return rounded(found.rows, 4, ["pc1", "pc2", "pc3"])


@query
def pca_variance(spark, d):
    found = reduction.principal_components(table(spark, d, "lineitem"), _AXES, LINE_KEY)
    return rounded(reduction.component_variance(found))


@query
def pca_embeddings(spark, d):
    """Three components of 64 features: centred, uncorrelated, variance as announced."""
    vectors = table(spark, d, "embeddings")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select("vec_id", "label", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)])
    found = reduction.principal_components(wide, names, ["vec_id", "label"])
    dots = [
        sum(x * y for x, y in zip(a, b)) for i, a in enumerate(found.loadings) for b in found.loadings[i:]
    ]
    unit = [1.0, 0.0, 0.0, 1.0, 0.0, 1.0]
    stats = found.rows.agg(
        F.count("*").alias("n_rows"),
        *[F.avg(f"pc{i}").alias(f"m{i}") for i in (1, 2, 3)],
        *[F.var_pop(f"pc{i}").alias(f"v{i}") for i in (1, 2, 3)],
        F.corr("pc1", "pc2").alias("r12"),
        F.corr("pc1", "pc3").alias("r13"),
        F.corr("pc2", "pc3").alias("r23"),
    )
    small = F.greatest(*[F.abs(F.col(c)) for c in ("m1", "m2", "m3", "r12", "r13", "r23")])
    agree = F.greatest(*[F.abs(F.col(f"v{i + 1}") / 64 - F.lit(x)) for i, x in enumerate(found.explained)])
    return stats.select(
        "n_rows",
        (small < 1e-6).alias("centred_and_uncorrelated"),
        (agree < 1e-6).alias("variance_as_announced"),
        ((F.col("v1") >= F.col("v2")) & (F.col("v2") >= F.col("v3"))).alias("descending"),
        F.lit(max(abs(x - u) for x, u in zip(dots, unit)) < 1e-6).alias("orthonormal"),
    )
