"""The rows nearest to each of very many profiles, without meeting every row with every profile.

The score is that of ``operators.similarity``. Rows are dealt into cells once: the nearest of a few pivot rows, and the
values of the categories. A cell keeps its number of rows and the smallest and largest distance to its pivot, so by the triangle inequality it
tells for any profile how near and how far its rows can be, and how many categories match. Profiles meet cells:

1. Largest distance. A profile's distance to the outermost row of every pivot bounds it from below; only
   pivots, and of these only rows, that may lie beyond are measured.
2. Floor. Cells in the order of their worst possible score, until they hold k rows, give a score that k rows reach.
3. Rows of cells whose best possible score is below the floor are never looked at; the others are scored.

Categories are found by equality joins. A cell without any equal category is bounded by its pivot alone, all categories together,
so a profile meets pivots + cells that share a value with it. Everything is joined on cells: the plan is the
same for one profile and for a million, profiles are a table and never travel through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segprofile.functions.columns import col, cols, double
from segprofile.functions.staging import stage
from segprofile.operators.similarity import _scales

PIVOTS = 64
_SLACK = 1e-9  # of the scales; rounding must not close a cell
_TIE_PLACES = 12  # scores that agree so far are ties: the mean of two rows is as near to the one as to the other


@dataclass(frozen=True)
class _Features:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def x(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.numeric))]

    @property
    def v(self) -> list[str]:
        return [f"v{i}" for i in range(len(self.categorical))]

    def score(self, d: Column, max_d: Column, matches: Column) -> Column:
        near = 1.0 - F.when(max_d > 0, d / max_d).otherwise(d)
        return (near + matches / F.lit(float(len(self.categorical)))) / 2.0 if self.categorical else near


def _euclid(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]))


class PivotIndex:
    """Candidate rows in cells, written once; serves any number of profile tables.

    Rows that miss a number have no score and are in no cell.
    """

    def __init__(self, candidates: DataFrame, key: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], label: Sequence[str] = (), pivots: int = PIVOTS):
        if not numeric:
            raise ValueError("cells need at least one numeric feature")
        self.features = f = _Features(tuple(numeric), tuple(categorical))
        self.key, self.label = list(key), list(label)
        self.names = list(dict.fromkeys([*key, *label, *numeric, *categorical]))
        scales = _scales(candidates, numeric).first()
        self.scales = [1.0 if scales[f"s{i}"] is None else float(scales[f"s{i}"]) for i in range(len(numeric))]
        rows = candidates.select(
            F.struct(*[col(c).alias(c) for c in self.names]).alias("row"),
            *[double(c).alias(x) for c, x in zip(numeric, f.x, strict=True)],
            *[col(c).cast("string").alias(v) for c, v in zip(categorical, f.v, strict=True)],
        ).dropna(subset=f.x)
        # a bounded sample by hash: as many rows as there are pivots
        picked = rows.orderBy(F.xxhash64("row"), *f.x).limit(pivots).select(*f.x).collect()
        points = sorted({tuple(x / s for x, s in zip(r, self.scales, strict=True)) for r in picked})
        self._points = points
        if points:
            every = F.array(*[F.struct(self._from_point(p).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(points)])
            nearest = F.array_min(every)
        else:
            nearest = F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i"))
        self.rows = stage(rows.withColumn("_n", nearest).select("row", *f.x, *f.v, F.col("_n.i").alias("pivot"), F.col("_n.d").alias("off")))
        by_cell = self.rows.groupBy("pivot", *f.v).agg(F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high"))
        self.cells = stage(by_cell.withColumn("cell", F.xxhash64("pivot", *f.v)))
        outermost = self.rows.groupBy("pivot").agg(F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high"), F.max_by(F.struct(*f.x), "off").alias("edge"))
        self.pivots = stage(outermost)

    def _from_point(self, point: Sequence[float]) -> Column:
        return _euclid([F.col(x) / F.lit(s) for x, s in zip(self.features.x, self.scales, strict=True)], [F.lit(p) for p in point])

    def _distance(self, left: Sequence[Column], right: Sequence[Column]) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [((x - m) / F.lit(s)) * ((x - m) / F.lit(s)) for x, m, s in zip(left, right, self.scales, strict=True)]))

    # -- profiles and cells ---------------------------------------------------------------------

    def _profiles(self, profiles: DataFrame, profile_id: str) -> DataFrame:
        f = self.features
        return stage(
            profiles.select(
                col(profile_id).cast("string").alias("profile_id"),
                *[double(c).alias(f"m_{x}") for c, x in zip(f.numeric, f.x, strict=True)],
                *[col(c).cast("string").alias(f"w_{v}") for c, v in zip(f.categorical, f.v, strict=True)],
            ).dropna(subset=[f"m_{x}" for x in f.x])
        )

    def _means(self) -> list[Column]:
        return [F.col(f"m_{x}") for x in self.features.x]

    def _to_pivots(self, table: DataFrame) -> DataFrame:
        """Every profile once per pivot, with its distance ``to`` it; as many rows as profiles x pivots."""
        means = [m / F.lit(s) for m, s in zip(self._means(), self.scales, strict=True)]
        every = [F.struct(F.lit(i).alias("pivot"), _euclid(means, [F.lit(p) for p in point]).alias("to")) for i, point in enumerate(self._points)]
        if not every:
            return table.withColumn("pivot", F.lit(0)).withColumn("to", F.lit(0.0)).where(F.lit(False))
        return table.withColumn("_at", F.explode(F.array(*every))).select("*", "_at.pivot", "_at.to").drop("_at")

    def _with_max(self, met: DataFrame) -> DataFrame:
        """(profile_id, max_d): the exact largest distance of any row."""
        f = self.features
        edges = met.join(self.pivots, "pivot").withColumn("edge_d", self._distance([F.col(f"edge.{x}") for x in f.x], self._means()))
        known = edges.groupBy("profile_id").agg(F.max("edge_d").alias("known"))
        beyond = edges.join(known, "profile_id").where(F.col("to") + F.col("high") >= F.col("known") - _SLACK)
        means = [f"m_{x}" for x in f.x]
        far = beyond.select("profile_id", "pivot", "to", "known", *means).join(self.rows.select("pivot", "off", *f.x), "pivot")
        far = far.where(F.col("to") + F.col("off") >= F.col("known") - _SLACK)
        found = far.groupBy("profile_id").agg(F.max(self._distance([F.col(x) for x in f.x], self._means())).alias("max_d"))
        return stage(found)

    def opened(self, profiles: DataFrame, profile_id: str, k: int = 10) -> DataFrame:
        """Cells that may hold one of a profile's k best rows: ``cell`` of one set of categories, or a whole ``pivot``."""
        f = self.features
        table = self._profiles(profiles, profile_id)
        met = stage(self._to_pivots(table))
        largest = self._with_max(met)
        met = met.join(largest, "profile_id")
        least = F.greatest(F.lit(0.0), F.col("to") - F.col("high"), F.col("low") - F.col("to"))
        most = F.least(F.col("to") + F.col("high"), F.col("max_d"))
        bounds = [f.score(most + _SLACK, F.col("max_d"), F.col("matches")).alias("worst"), f.score(least - _SLACK, F.col("max_d"), F.col("matches")).alias("best")]
        keep = ["profile_id", "max_d", *[f"m_{x}" for x in f.x], *[f"w_{v}" for v in f.v]]
        # all rows of a pivot, whatever their categories
        alone = met.join(self.pivots.select("pivot", "n", "low", "high"), "pivot").withColumn("matches", F.lit(0))
        alone = alone.select(*keep, "pivot", F.lit(None).cast("long").alias("cell"), "n", *bounds)
        parts = [alone]
        if f.categorical:
            matches = reduce(lambda a, b: a + b, [F.coalesce((F.col(v) == F.col(f"w_{v}")).cast("int"), F.lit(0)) for v in f.v])
            for i, v in enumerate(f.v):
                # a cell is met through the first of its equal categories
                first = [F.coalesce(F.col(w) != F.col(f"w_{w}"), F.lit(True)) for w in f.v[:i]]
                equal = self.cells.join(largest.join(table, "profile_id"), F.col(v) == F.col(f"w_{v}"))
                equal = reduce(lambda a, c: a.where(c), first, equal).join(met.select("profile_id", "pivot", "to"), ["profile_id", "pivot"])
                parts.append(equal.withColumn("matches", matches).select(*keep, "pivot", "cell", "n", *bounds))
        cells = stage(reduce(lambda a, b: a.unionByName(b), parts))
        # rows of a pivot may be in cells too, so each kind gives a floor of its own
        running = W.partitionBy("profile_id", F.col("cell").isNull()).orderBy(F.desc("worst"), "pivot", "cell").rowsBetween(W.unboundedPreceding, 0)
        enough = cells.select("profile_id", "pivot", "cell", "worst", "n").withColumn("held", F.sum("n").over(running)).where(F.col("held") >= k)
        floors = enough.groupBy("profile_id").agg(F.max("worst").alias("floor"))
        return cells.join(floors, "profile_id", "left").where(F.coalesce(F.col("best") >= F.col("floor"), F.lit(True)))

    def nearest(self, profiles: DataFrame, profile_id: str, k: int = 10) -> DataFrame:
        """(profile_id, rank, key..., label..., similarity, features...) of the k best rows of every profile, ties (to 12 places) by key."""
        f = self.features
        open_ = stage(self.opened(profiles, profile_id, k))
        rows = self.rows.withColumn("cell", F.xxhash64("pivot", *f.v))
        alone = open_.where("cell IS NULL").drop("cell", "n").join(rows.drop("cell", "off"), "pivot")
        equal = open_.where("cell IS NOT NULL").drop("pivot", "n").join(rows.drop("pivot", "off"), "cell")
        matches = [F.coalesce((F.col(v) == F.col(f"w_{v}")).cast("int"), F.lit(0)) for v in f.v]
        total = reduce(lambda a, b: a + b, matches, F.lit(0))
        # rows with an equal category come through their cell only
        kept = ["profile_id", "max_d", "floor", "row", *f.x, *f.v, *[f"m_{x}" for x in f.x], *[f"w_{v}" for v in f.v]]
        met = alone.select(*kept).where(total == 0).unionByName(equal.select(*kept))
        d = self._distance([F.col(x) for x in f.x], self._means())
        scored = met.select("profile_id", "floor", "row", f.score(d, F.col("max_d"), total).alias("similarity"))
        near = scored.where(F.coalesce(F.col("similarity") >= F.col("floor") - _SLACK, F.lit(True)))
        order = W.partitionBy("profile_id").orderBy(F.round("similarity", _TIE_PLACES).desc(), *[F.col("row").getField(c) for c in self.key])
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = list(dict.fromkeys([*self.key, *self.label]))
        rest = [c for c in self.names if c not in first]
        return ranked.select("profile_id", "rank", "row.*", "similarity").select("profile_id", "rank", *cols(first), "similarity", *cols(rest))
