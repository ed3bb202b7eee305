"""The three analyses: filter and match, profile per category, profile per cluster.

Each returns named frames, ready for ``write_report`` or ``commit_report``. Rows that several frames read are
written once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.operators.clustering import cluster_rows, cluster_sizes, clusters_without_modes
from segprofile.operators.distributions import auto_bins, box_stats, histogram, kde_curve
from segprofile.operators.crosstab import category_value_counts, crosstab_pct
from segprofile.operators.filters import profile_rows, select_rows
from segprofile.operators.metrics import match_split, match_summary
from segprofile.operators.profiles import (
    category_mean,
    category_mean_errorbars,
    category_mode,
    category_std_filled,
    mean_long,
    mode_first_seen,
    overall_profile,
    profile_long,
    profile_table,
)
from segprofile.operators.reduction import principal_components
from segprofile.operators.similarity import nearest_rows
from segprofile.spec import FeatureSpec, FilterSpec


def match_report(
    df: DataFrame, spec: FeatureSpec, filters: FilterSpec, measures: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Matching rows, how much of the whole they are, and the average entity."""
    measures = measures if measures is not None else {m: m for m in spec.measures}
    predicate = filters.predicate(df, spec)
    kept = filters.included(spec)
    rows = select_rows(df, spec, filters)
    profile = overall_profile(df, spec.numeric, spec.categorical)
    report = {
        "matching_rows": rows,
        "match_summary": match_summary(df, predicate, measures),
        "match_split": match_split(df, predicate, measures),
        "mean_profile": profile_long(profile, spec.numeric, spec.categorical),
        "nearest_rows": nearest_rows(
            df,
            profile.withColumn("profile_id", F.lit("overall")),
            "profile_id",
            spec.key,
            kept.numeric,
            kept.categorical,
            label=spec.descriptive,
        ),
    }
    if kept.numeric:
        layout = auto_bins(rows, kept.numeric)
        report["filtered_means"] = mean_long(rows, kept.numeric)
        report["histograms"] = histogram(rows, kept.numeric, layout)
        report["density_curves"] = kde_curve(rows, kept.numeric, layout)
    return report


def category_report(
    df: DataFrame, spec: FeatureSpec, filters: FilterSpec | None = None, k: int = 10
) -> dict[str, DataFrame]:
    """Means, deviations, modes and distributions per category, and the nearest real rows."""
    filters = filters or FilterSpec()
    kept = filters.included(spec)
    by = spec.group_key
    categorical = list(dict.fromkeys([by, *kept.categorical]))
    rows = stage(profile_rows(df, spec, filters))
    profiles = profile_table(rows, by, kept.numeric, kept.categorical)
    return {
        "means": category_mean(rows, by, kept.numeric).orderBy(f"`{by}`"),
        "deviations": category_std_filled(rows, by, kept.numeric).orderBy(f"`{by}`"),
        "modes": category_mode(rows, by, categorical).orderBy(f"`{by}`"),
        "errorbars": category_mean_errorbars(rows, by, kept.numeric),
        "box_stats": box_stats(rows, by, kept.numeric),
        "value_counts": category_value_counts(rows, by, categorical),
        "crosstab": crosstab_pct(rows, by, categorical),
        "nearest_rows": nearest_rows(
            df, profiles, by, spec.key, kept.numeric, kept.categorical, k, spec.descriptive
        ),
    }


def cluster_report(
    df: DataFrame,
    spec: FeatureSpec,
    filters: FilterSpec | None = None,
    k: int = 5,
    missing: str = "error",
    nearest: int = 10,
) -> dict[str, DataFrame]:
    """Clusters of the matching rows, their summaries, a 3-axis view and the nearest real rows."""
    filters = filters or FilterSpec()
    kept = filters.included(spec)
    found = cluster_rows(stage(profile_rows(df, spec, filters)), kept.numeric, k, missing=missing)
    if found.k == 0:
        return _sizes_and_means(found.rows, kept, "cluster", spec)
    return labelled_report(found.rows, df, spec, filters, "cluster", nearest)


def labelled_report(
    rows: DataFrame,
    df: DataFrame,
    spec: FeatureSpec,
    filters: FilterSpec | None = None,
    label: str = "cluster",
    nearest: int = 10,
) -> dict[str, DataFrame]:
    """The frames of ``cluster_report`` for rows that have a label already, whoever gave it.

    Rows and modes are written once and shared by all frames. ``without_modes`` names the
    clusters that have means and no modes.
    """
    kept = (filters or FilterSpec()).included(spec)
    rows = stage(rows)
    report = _sizes_and_means(rows, kept, label, spec)
    modes = report.get("modes")
    summary = profile_table(rows, label, kept.numeric, kept.categorical, modes)
    report["summary"] = summary
    if modes is not None:
        report["without_modes"] = clusters_without_modes(report["means"], modes, label)
    report["points"] = principal_components(rows, kept.numeric, [*spec.key, label]).rows
    report["nearest_rows"] = nearest_rows(
        df, summary, label, spec.key, kept.numeric, kept.categorical, nearest, spec.descriptive
    )
    return report


def _sizes_and_means(rows: DataFrame, kept: FeatureSpec, label: str, spec: FeatureSpec) -> dict[str, DataFrame]:
    report = {
        "rows": rows,
        "sizes": cluster_sizes(rows, label),
        "means": category_mean(rows, label, kept.numeric),
    }
    if kept.categorical:
        report["modes"] = stage(mode_first_seen(rows, label, kept.categorical, spec.key))
    return report
