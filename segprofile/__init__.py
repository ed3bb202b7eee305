"""Segment profiling of wide tables with Spark DataFrames."""

from segprofile.spec import Exact, FeatureSpec, FilterSpec, OneOf, Range, SpecError

__all__ = ["Exact", "FeatureSpec", "FilterSpec", "OneOf", "Range", "SpecError"]
