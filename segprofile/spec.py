"""Declarative description of a wide table and of the filters put on it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segprofile.functions.columns import col, is_missing, is_numeric


class SpecError(ValueError):
    """The spec does not fit the table or the text given for a value."""


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of the columns of a wide table of entities."""

    key: tuple[str, ...]
    descriptive: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    group_key: str | None = None
    measures: tuple[str, ...] = ()
    percent_scaled: tuple[str, ...] = ()
    row_label: str | None = None

    @classmethod
    def infer(
        cls,
        df: DataFrame,
        key: Sequence[str],
        descriptive: Sequence[str] = (),
        group_key: str | None = None,
        measures: Sequence[str] = (),
        percent_scaled: Sequence[str] = (),
        row_label: str | None = None,
    ) -> FeatureSpec:
        """Roles by data type; key and descriptive columns are never features."""
        aside = set(key) | set(descriptive)
        fields = [f for f in df.schema.fields if f.name not in aside]
        spec = cls(
            key=tuple(key),
            descriptive=tuple(descriptive),
            numeric=tuple(f.name for f in fields if is_numeric(f.dataType)),
            categorical=tuple(f.name for f in fields if not is_numeric(f.dataType)),
            group_key=group_key,
            measures=tuple(measures),
            percent_scaled=tuple(percent_scaled),
            row_label=row_label,
        )
        return spec.validate(df)

    @property
    def features(self) -> tuple[str, ...]:
        """Numeric features first, then categorical ones."""
        return self.numeric + self.categorical

    def validate(self, df: DataFrame) -> FeatureSpec:
        types = {f.name: f.dataType for f in df.schema.fields}
        named = (*self.key, *self.descriptive, *self.features, *self.measures, *self.percent_scaled)
        missing = sorted({n for n in named if n not in types})
        if self.group_key and self.group_key not in types:
            missing.append(self.group_key)
        if missing:
            raise SpecError(f"columns not in the table: {missing}")
        wrong = [n for n in (*self.numeric, *self.measures) if not is_numeric(types[n])]
        if wrong:
            raise SpecError(f"columns used as numbers are not numeric: {wrong}")
        return self

    def excluding(self, columns: Iterable[str]) -> FeatureSpec:
        """The spec without some features. Key, group key and measures stay."""
        out = set(columns)
        return replace(
            self,
            numeric=tuple(c for c in self.numeric if c not in out),
            categorical=tuple(c for c in self.categorical if c not in out),
        )

    def multiplier(self, column: str) -> float:
        """What a stored value is multiplied by for display."""
        return 100.0 if column in self.percent_scaled else 1.0


@dataclass(frozen=True)
class Range:
    """Inclusive range in display units. A missing value fails unless kept."""

    column: str
    low: float
    high: float
    keep_null: bool = False

    def predicate(self, data_type: T.DataType, multiplier: float) -> Column:
        if not is_numeric(data_type):
            raise SpecError(f"range filter on non-numeric column {self.column}")
        inside = col(self.column).between(_stored(self.low, multiplier), _stored(self.high, multiplier))
        return inside | is_missing(self.column, data_type) if self.keep_null else inside


@dataclass(frozen=True)
class OneOf:
    """Membership, numbers in display units. None in the list keeps missing values (NaN too); an empty list keeps nothing."""

    column: str
    values: tuple

    def __init__(self, column: str, values: Iterable):
        object.__setattr__(self, "column", column)
        object.__setattr__(self, "values", tuple(values))

    def predicate(self, data_type: T.DataType, multiplier: float) -> Column:
        present = [v if multiplier == 1 else _stored(v, multiplier) for v in self.values if v is not None]
        parts = []
        if present:
            parts.append(col(self.column).isin(present))
        if len(present) < len(self.values):
            parts.append(is_missing(self.column, data_type))
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


@dataclass(frozen=True)
class Exact:
    """Equality. Text for a numeric column is read as a number in display units."""

    column: str
    value: object

    def predicate(self, data_type: T.DataType, multiplier: float) -> Column:
        if not is_numeric(data_type):
            return col(self.column) == F.lit(self.value)
        try:
            number = float(self.value)
        except (TypeError, ValueError) as err:
            raise SpecError(f"not a number for column {self.column}: {self.value!r}") from err
        return col(self.column) == F.lit(_stored(number, multiplier))


def _stored(value: float, multiplier: float):
    return value if multiplier == 1 else value / multiplier


@dataclass(frozen=True)
class FilterSpec:
    """All filters of one selection, compiled to a single predicate.

    Excluding a column drops its filters too. Included numeric features without
    a filter of their own count as filtered to their full range, which a missing
    value fails (``full_range=True``); with ``full_range=False`` a column
    without a filter does not restrict anything. On one column an exact value
    beats a range.
    """

    filters: tuple = ()
    excluded: frozenset[str] = field(default_factory=frozenset)
    full_range: bool = True

    def __init__(self, filters: Iterable = (), excluded: Iterable[str] = (), full_range: bool = True):
        object.__setattr__(self, "filters", tuple(filters))
        object.__setattr__(self, "excluded", frozenset(excluded))
        object.__setattr__(self, "full_range", full_range)

    def included(self, spec: FeatureSpec) -> FeatureSpec:
        return spec.excluding(self.excluded)

    def active(self) -> list:
        """Filters that count: column included, and no exact value beside a range."""
        kept = [f for f in self.filters if f.column not in self.excluded]
        exact = {f.column for f in kept if isinstance(f, Exact)}
        return [f for f in kept if not (isinstance(f, Range) and f.column in exact)]

    def predicate(self, df: DataFrame, spec: FeatureSpec) -> Column:
        """One boolean column; nothing but built-in comparisons, so it is pushed to the scan."""
        types = {f.name: f.dataType for f in df.schema.fields}
        active = self.active()
        unknown = [f.column for f in active if f.column not in types]
        if unknown:
            raise SpecError(f"filtered columns not in the table: {unknown}")
        parts = [f.predicate(types[f.column], spec.multiplier(f.column)) for f in active]
        if self.full_range:
            filtered = {f.column for f in active}
            parts += [
                ~is_missing(c, types[c]) for c in self.included(spec).numeric if c not in filtered
            ]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
