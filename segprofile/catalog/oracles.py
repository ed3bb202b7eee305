"""ANSI SQL that states each query's result on the same tables.

Written from the definition of the operator, not from its implementation:
quantiles by ``quantile_cont``, modes by ranking counts, similarity by scoring
every pair, principal components by solving the 3 x 3 eigenproblem in closed form.
"""

from __future__ import annotations

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_LINE_ROW = f"{_LINE}, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
_LINE_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SEC_NUM = ("p_size", "p_retailprice", "n_lines", "sum_qty", "avg_discount")
_SEC_CAT = ("p_type", "p_brand")

_SECTIONS = """sections AS (
  SELECT p.p_partkey, p.p_name, p.p_type, p.p_brand, p.p_size, p.p_retailprice,
         l.n_lines, l.sum_qty, l.avg_discount
  FROM part p JOIN (
    SELECT l_partkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_discount
    FROM lineitem GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey)"""

_GAPS = """gaps AS (
  SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
         nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority,
         CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS o_totalprice
  FROM orders)"""

_MATCH = "l_discount BETWEEN 2.0 / 100 AND 6.0 / 100 AND l_returnflag IN ('A', 'R')"


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _each(names, template: str, joiner: str = ", ") -> str:
    return joiner.join(template.format(c=c, i=i) for i, c in enumerate(names))


def _mode(source: str, by: str, column: str, tie: str = "value") -> str:
    """(by, column): the most frequent value per group, smallest first on ties."""
    first = f", min({tie}) AS first_key" if tie != "value" else ""
    order = "n DESC, first_key" if tie != "value" else "n DESC, value"
    return f"""(SELECT {by}, value AS {column} FROM (
      SELECT {by}, value, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM (
        SELECT {by}, {column} AS value, count(*) AS n{first} FROM {source}
        WHERE {by} IS NOT NULL AND {column} IS NOT NULL GROUP BY {by}, {column})) WHERE rn = 1)"""


def _long(source: str, numeric, by: str | None = None) -> str:
    keep = f"{by} AS category, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {source}" for c in numeric
    )


ORACLES: dict[str, str] = {}

# --- scans and columns ---------------------------------------------------------------------

ORACLES["scan_sections"] = "SELECT * FROM part"

_ROLES = (
    ("o_orderkey", "bigint", "descriptive"),
    ("o_custkey", "bigint", "descriptive"),
    ("o_orderstatus", "string", "categorical"),
    ("o_orderpriority", "string", "categorical"),
    ("o_totalprice", "double", "numeric"),
)
ORACLES["column_roles"] = f"WITH {_GAPS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{t}' AS type, '{r}' AS role, count(*) - count({c}) AS n_missing FROM gaps"
    for c, t, r in _ROLES
)
ORACLES["columns_from"] = "SELECT p_type, p_size, p_retailprice FROM part"
ORACLES["relabel"] = """
SELECT c_custkey AS klant, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS land,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'BOUW' WHEN 'MACHINERY' THEN 'MACHINES'
            WHEN 'HOUSEHOLD' THEN 'HUISHOUDEN' ELSE c_mktsegment END AS segment,
       c_acctbal AS saldo
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
ORACLES["align_feature_tables"] = f"""
WITH {_SECTIONS}
SELECT p_partkey, p_name, p_type, p_brand, p_size, p_retailprice, n_lines, sum_qty,
       {_r("avg_discount", "avg_discount")} FROM sections"""

# --- filters -------------------------------------------------------------------------------

ORACLES["filter_range"] = f"SELECT {_LINE_ROW} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20"
ORACLES["filter_range_missing"] = f"WITH {_GAPS} SELECT * FROM gaps WHERE o_totalprice IS NOT NULL"
ORACLES["filter_range_keep_null"] = f"""
WITH {_GAPS} SELECT * FROM gaps
WHERE o_totalprice BETWEEN 50000 AND 150000 OR o_totalprice IS NULL"""
ORACLES["filter_membership"] = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
ORACLES["filter_membership_null"] = f"""
WITH {_GAPS} SELECT * FROM gaps WHERE o_orderpriority = '1-URGENT' OR o_orderpriority IS NULL"""
ORACLES["filter_membership_nan"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice < 50000"""
ORACLES["filter_exact_scaled"] = f"""
SELECT {_LINE_ROW} FROM lineitem WHERE l_discount = CAST('5' AS DOUBLE) / 100"""
ORACLES["filter_percent_range"] = f"""
SELECT {_LINE_ROW} FROM lineitem WHERE l_discount BETWEEN 2.0 / 100 AND 6.0 / 100"""
ORACLES["filter_precedence"] = f"SELECT {_LINE_ROW} FROM lineitem WHERE l_quantity = 17"
ORACLES["filter_exact_id"] = """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'"""
ORACLES["filter_flag"] = f"""
SELECT {_LINE}, l_returnflag, l_linestatus FROM lineitem WHERE l_linestatus = 'F'"""
ORACLES["filter_conjunction"] = f"""
SELECT {_LINE_ROW} FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_quantity BETWEEN 5 AND 45
  AND l_extendedprice BETWEEN 1000 AND 60000
  AND l_discount BETWEEN 1.0 / 100 AND 9.0 / 100 AND l_tax BETWEEN 0.01 AND 0.07"""
ORACLES["filter_empty_selection"] = """
SELECT count(*) AS total_n, CAST(0 AS BIGINT) AS match_n, 0.0::DOUBLE AS pct_n,
       round(sum(o_totalprice), 2) AS total_price, 0.0::DOUBLE AS match_price, 0.0::DOUBLE AS pct_price
FROM orders"""
ORACLES["filter_and_project"] = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('O', 'F')"""
ORACLES["exclude_column_drops_filter"] = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice BETWEEN 100000 AND 300000"""
ORACLES["drop_missing"] = f"WITH {_GAPS} SELECT * FROM gaps WHERE o_totalprice IS NOT NULL"
ORACLES["bad_value_report"] = """
SELECT 'quantity' AS feature, count(*) FILTER (l_returnflag = 'R') AS n_null,
       CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_infinite FROM lineitem
UNION ALL SELECT 'discount', 0, count(*) FILTER (l_returnflag = 'A'), 0 FROM lineitem
UNION ALL SELECT 'tax', 0, 0, count(*) FILTER (l_tax = 0) FROM lineitem"""
ORACLES["numeric_domains"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({e}) + 0.0 AS min, max({e}) + 0.0 AS max, min({e}) = max({e}) AS is_constant FROM lineitem"
    for c, e in [*((c, c) for c in _LINE_NUM), ("one", "l_quantity * 0 + 1")]
)
ORACLES["categorical_domains"] = f"""
WITH {_GAPS}
SELECT DISTINCT 'o_orderstatus' AS feature, o_orderstatus AS value FROM gaps
UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM gaps"""

# --- match metrics -------------------------------------------------------------------------

_TOTALS = f"""totals AS (
  SELECT count(*) AS total_n, count(*) FILTER ({_MATCH}) AS match_n,
         sum(l_quantity) AS total_qty, sum(l_quantity) FILTER ({_MATCH}) AS match_qty,
         sum(l_extendedprice) AS total_price, sum(l_extendedprice) FILTER ({_MATCH}) AS match_price
  FROM lineitem)"""
ORACLES["match_summary"] = f"""
WITH {_TOTALS}
SELECT total_n, match_n, {_r("100.0 * match_n / total_n", "pct_n")},
       total_qty, match_qty, {_r("100.0 * match_qty / total_qty", "pct_qty")},
       round(total_price, 2) AS total_price, round(match_price, 2) AS match_price,
       {_r("100.0 * match_price / total_price", "pct_price")}
FROM totals"""
ORACLES["match_summary_observed"] = ORACLES["match_summary"].replace("FROM totals", ", match_n AS n_written FROM totals")
ORACLES["bad_values_observed"] = f"""
WITH {_GAPS}
SELECT 'o_totalprice' AS feature, count(*) - count(o_totalprice) AS n_null, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_infinite FROM gaps
UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), 0, 0 FROM gaps"""
ORACLES["match_split"] = f"WITH {_TOTALS} " + " UNION ALL ".join(
    f"""SELECT '{measure}' AS measure, '{part}' AS part,
        round(CAST({amount} AS DOUBLE), 2) + 0.0 AS amount, {_r(f"100.0 * ({amount}) / total_{m}", "pct")} FROM totals"""
    for m, measure in (("n", "count"), ("qty", "qty"), ("price", "price"))
    for part, amount in (("Matching", f"match_{m}"), ("Not Matching", f"total_{m} - match_{m}"))
)

# --- profiles ------------------------------------------------------------------------------

ORACLES["overall_profile"] = f"""
SELECT {_each(_LINE_NUM, "round(avg({c}), 6) AS {c}")},
  (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_returnflag,
  (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_linestatus
FROM lineitem"""
ORACLES["overall_profile_long"] = f"""
WITH {_GAPS}
SELECT 'o_totalprice' AS feature, 'mean' AS kind, round(avg(o_totalprice), 6) AS mean,
       CAST(NULL AS VARCHAR) AS mode FROM gaps
UNION ALL SELECT 'o_orderpriority', 'mode', NULL, (SELECT o_orderpriority FROM gaps
  WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'o_orderstatus', 'mode', NULL, (SELECT o_orderstatus FROM gaps
  WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
ORACLES["filtered_profile_long"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean FROM lineitem WHERE {_MATCH}" for c in _LINE_NUM
)
ORACLES["category_mean"] = f"""
SELECT l_returnflag, {_each(_LINE_NUM, "round(avg({c}), 6) AS {c}")} FROM lineitem GROUP BY l_returnflag"""
ORACLES["category_mean_null_key"] = f"""
WITH {_GAPS} SELECT o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice
FROM gaps WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus"""
ORACLES["category_std"] = f"""
SELECT l_returnflag, {_each(_LINE_NUM, "round(stddev_samp({c}), 6) AS {c}")} FROM lineitem GROUP BY l_returnflag"""
ORACLES["category_std_filled"] = """
WITH totals AS (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS price FROM orders GROUP BY 1),
sd AS (SELECT o_orderstatus, stddev_samp(n) AS n, stddev_samp(price) AS price FROM totals GROUP BY 1)
SELECT o_orderstatus,
  CASE WHEN (SELECT count(n) FROM sd) = 0 THEN 0.0 ELSE n END AS n,
  CASE WHEN (SELECT count(price) FROM sd) = 0 THEN 0.0 ELSE price END AS price
FROM sd"""
ORACLES["category_mode"] = f"""
WITH {_SECTIONS}
SELECT p_type, b.p_brand, n.p_name FROM {_mode("sections", "p_type", "p_brand")} b
JOIN {_mode("sections", "p_type", "p_name")} n USING (p_type)"""
ORACLES["mode_first_seen"] = f"""
WITH {_SECTIONS}
SELECT p_brand, t.p_type, n.p_name FROM {_mode("sections", "p_brand", "p_type", "p_partkey")} t
JOIN {_mode("sections", "p_brand", "p_name", "p_partkey")} n USING (p_brand)"""
ORACLES["mode_first_seen_lines"] = f"""
WITH lines AS (SELECT l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity,
  {{'a': l_orderkey, 'b': l_linenumber}} AS line FROM lineitem)
SELECT l_returnflag, s.l_linestatus, q.quantity FROM {_mode("lines", "l_returnflag", "l_linestatus", "line")} s
JOIN {_mode("lines", "l_returnflag", "quantity", "line")} q USING (l_returnflag)"""
ORACLES["profile_table"] = f"""
WITH {_SECTIONS},
means AS (SELECT p_type, {_each(_SEC_NUM, "round(avg({c}), 6) AS {c}")} FROM sections GROUP BY p_type)
SELECT * FROM means JOIN {_mode("sections", "p_type", "p_brand")} b USING (p_type)"""
ORACLES["category_summary_selected"] = " UNION ALL ".join(
    f"""SELECT CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS position, l_returnflag AS category,
        '{c}' AS feature, round(avg({c}), 6) AS mean FROM lineitem
        WHERE l_returnflag IN ('R', 'A', 'X') GROUP BY l_returnflag"""
    for c in _LINE_NUM
)
ORACLES["category_mean_errorbars"] = " UNION ALL ".join(
    f"""SELECT l_returnflag AS category, '{c}' AS feature, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(avg({c}) - stddev_samp({c}), 6) AS lo,
        round(avg({c}) + stddev_samp({c}), 6) AS hi FROM lineitem GROUP BY l_returnflag"""
    for c in _LINE_NUM
)

# --- counts --------------------------------------------------------------------------------

ORACLES["category_value_counts"] = f"WITH {_GAPS} " + " UNION ALL ".join(
    f"""SELECT o_orderstatus AS category, '{c}' AS feature, {c} AS value, count(*) AS n FROM gaps
        WHERE o_orderstatus IS NOT NULL AND {c} IS NOT NULL GROUP BY ALL"""
    for c in ("o_orderstatus", "o_orderpriority")
)
ORACLES["value_counts_pct"] = """
SELECT o_orderpriority AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
FROM orders GROUP BY o_orderpriority"""
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORACLES["crosstab_counts"] = (
    "SELECT o_orderstatus AS category, "
    + ", ".join(f"""count(*) FILTER (o_orderpriority = '{p}') AS "{p}\"""" for p in _PRIORITIES)
    + " FROM orders GROUP BY o_orderstatus"
)


def _crosstab(by: str, columns, dense: bool) -> str:
    parts = []
    for c in columns:
        cells = f"SELECT {by} AS category, {c} AS value, count(*) AS n FROM part GROUP BY ALL"
        if dense:
            cells = f"""SELECT g.category, g.value, coalesce(c.n, 0) AS n FROM
              (SELECT * FROM (SELECT DISTINCT {by} AS category FROM part), (SELECT DISTINCT {c} AS value FROM part)) g
              LEFT JOIN ({cells}) c USING (category, value)"""
        parts.append(
            f"""SELECT category, '{c}' AS feature, value, n,
                round(100.0 * n / sum(n) OVER (PARTITION BY category), 6) AS pct,
                {str(c == by).lower()} AS is_group_key FROM ({cells})"""
        )
    return " UNION ALL ".join(parts)


ORACLES["crosstab_pct"] = _crosstab("p_type", ("p_type", "p_brand", "p_name"), True)
ORACLES["crosstab_pct_sparse"] = _crosstab("p_brand", ("p_type", "p_name"), False)
ORACLES["crosstab_pct_wide"] = (
    "SELECT 'o_orderstatus' AS feature, o_orderstatus AS category, "
    + ", ".join(
        f"""CASE WHEN o_orderstatus = '{s}' THEN 100.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus-{s}\""""
        for s in ("F", "O", "P")
    )
    + ", "
    + ", ".join(f"""NULL::DOUBLE AS "o_orderpriority-{p}\"""" for p in _PRIORITIES)
    + " FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderstatus, NULL, NULL, NULL, "
    + ", ".join(
        f"round(100.0 * count(*) FILTER (o_orderpriority = '{p}') / count(*), 6)" for p in _PRIORITIES
    )
    + " FROM orders GROUP BY o_orderstatus"
)

# --- distributions -------------------------------------------------------------------------


def _bins(source: str, numeric, bins: str) -> str:
    """CTEs long, stats and layout; ``bins`` is SQL over n, lo, hi, iqr."""
    return f"""long AS ({_long(source, numeric)}),
stats AS (SELECT feature, count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd,
            quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM long GROUP BY feature),
layout AS (SELECT *, (hi - lo) / bins AS width FROM (SELECT *, CAST({bins} AS BIGINT) AS bins FROM stats))"""


_AUTO = """ceil((hi - lo) / least(greatest(2 * iqr / cbrt(n), (hi - lo) / sqrt(n) / 2),
                                  (hi - lo) / (log2(n) + 1)))"""


def _histogram(source: str, numeric, bins: str) -> str:
    return f"""WITH {_bins(source, numeric, bins)},
counts AS (SELECT feature, CAST(least(floor((x - lo) / width), bins - 1) AS BIGINT) AS bin, count(*) AS n
  FROM long JOIN layout USING (feature) GROUP BY ALL),
cells AS (SELECT feature, lo, width, unnest(range(bins)) AS bin FROM layout)
SELECT feature, bin, round(g.lo + bin * width, 6) AS lo, round(g.lo + (bin + 1) * width, 6) AS hi,
       coalesce(c.n, 0) AS n
FROM cells g LEFT JOIN counts c USING (feature, bin)"""


ORACLES["histogram_fixed"] = _histogram("lineitem", ("l_quantity", "l_extendedprice"), "17")
ORACLES["histogram_auto"] = _histogram("lineitem", _LINE_NUM, _AUTO)
_AUTO_WHOLE = """ceil((hi - lo) / greatest(1.0, least(greatest(2 * iqr / cbrt(n), (hi - lo) / sqrt(n) / 2),
                                              (hi - lo) / (log2(n) + 1))))"""
ORACLES["histogram_integer"] = (
    f"SELECT * FROM ({_histogram('lineitem', ('l_linenumber',), _AUTO_WHOLE)}) "
    f"UNION ALL SELECT * FROM ({_histogram('part', ('p_size',), _AUTO_WHOLE)})"
)
ORACLES["histogram_events"] = _histogram("events", ("value",), _AUTO)


def _kde(source: str, numeric, bins: str, digits: int) -> str:
    return f"""WITH {_bins(source, numeric, bins)},
setup AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / 199 AS step FROM layout),
grid AS (SELECT feature, CAST(unnest(range(200)) AS INTEGER) AS point FROM setup),
density AS (SELECT feature, point, sum(exp(-0.5 * pow((lo + point * step - x) / h, 2))) AS kernel
  FROM grid JOIN setup USING (feature) JOIN long USING (feature) GROUP BY ALL)
SELECT feature, point, round(lo + point * step, {digits}) AS x,
       round(kernel * width / (h * sqrt(2 * pi())), {digits}) AS density
FROM density JOIN setup USING (feature)"""


ORACLES["kde_curve"] = _kde("events", ("value",), _AUTO, 6)
ORACLES["kde_curve_fixed"] = _kde("lineitem", ("l_quantity", "l_extendedprice"), "40", 5)


def _fenced(source: str, by: str, numeric) -> str:
    return f"""long AS ({_long(source, numeric, by)}),
q AS (SELECT category, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
       quantile_cont(x, 0.75) AS q3 FROM long GROUP BY ALL),
fences AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


def _box(source: str, by: str, numeric) -> str:
    return f"""WITH {_fenced(source, by, numeric)}
SELECT category, feature, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3, round(min(x) FILTER (x >= lo), 6) AS whisker_lo,
  round(max(x) FILTER (x <= hi), 6) AS whisker_hi, count(*) FILTER (x < lo OR x > hi) AS n_outliers
FROM long JOIN fences USING (category, feature) GROUP BY category, feature"""


ORACLES["box_stats"] = _box("lineitem", "l_returnflag", _LINE_NUM)
ORACLES["box_stats_events"] = _box("events", "event_type", ("value",))
ORACLES["box_outliers"] = f"""
WITH {_fenced("events", "event_type", ("value",))}
SELECT event_id, event_type AS category, 'value' AS feature, value
FROM events JOIN fences ON category = event_type WHERE value < lo OR value > hi"""

# --- scaling and similarity ----------------------------------------------------------------

ORACLES["impute_mean"] = f"""
WITH {_GAPS}
SELECT o_orderkey, {_r("coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gaps))", "o_totalprice")} FROM gaps"""
ORACLES["standardize"] = f"""
SELECT o_orderkey,
  {_r("(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)", "o_totalprice")},
  {_r("(o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders)", "o_custkey")},
  0.0::DOUBLE AS constant
FROM orders"""


def _scored(source: str, key: str, numeric, categorical) -> str:
    """CTE scored: every row of ``source`` against every row of ``prof`` (profile_id, features)."""
    distance = " + ".join(f"pow((r.{c} - p.{c}) / s.{c}, 2)" for c in numeric)
    equal = " + ".join(f"CASE WHEN r.{c} = p.{c} THEN 1 ELSE 0 END" for c in categorical)
    return f"""scales AS (SELECT {_each(numeric, "coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}")} FROM {source}),
pairs AS (SELECT p.profile_id, {key}, {_each([*numeric, *categorical], "r.{c} AS v_{c}")},
    sqrt({distance}) AS d, ({equal}) / {len(categorical)}.0 AS cat
  FROM {source} r, prof p, scales s),
scored AS (SELECT *, ((1 - d / max(d) OVER (PARTITION BY profile_id)) + cat) / 2 AS similarity FROM pairs)"""


def _section_profiles() -> str:
    return f"""prof AS (SELECT p_type AS profile_id, * FROM
  (SELECT p_type, {_each(_SEC_NUM, "avg({c}) AS {c}")} FROM sections GROUP BY p_type)
  JOIN {_mode("sections", "p_type", "p_brand")} b USING (p_type))"""


def _nearest(key: str, order: str, features, skip=()) -> str:
    shown = ", ".join(
        f"round(v_{c}, 6) AS {c}" if c in (*_LINE_NUM, "p_retailprice", "sum_qty", "avg_discount") else f"v_{c} AS {c}"
        for c in features
        if c not in skip
    )
    return f"""SELECT profile_id, CAST(rank AS INTEGER) AS rank, {key}, round(similarity, 6) AS similarity, {shown}
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY similarity DESC, {order}) AS rank FROM scored)
WHERE rank <= 10"""


ORACLES["similarity_scores"] = f"""
WITH {_SECTIONS}, {_section_profiles()}, {_scored("sections", "r.p_partkey", _SEC_NUM, _SEC_CAT)}
SELECT p_partkey, profile_id, round(similarity, 6) AS similarity FROM scored"""
ORACLES["similar_rows_by_category"] = f"""
WITH {_SECTIONS}, {_section_profiles()}, {_scored("sections", "r.p_partkey, r.p_name", _SEC_NUM, _SEC_CAT)}
{_nearest("p_partkey, p_name", "p_partkey", (*_SEC_NUM, *_SEC_CAT))}"""
ORACLES["similar_rows_many_profiles"] = f"""
WITH {_SECTIONS}, prof AS (SELECT concat_ws('/', p_brand, p_type) AS profile_id, p_brand, p_type,
  {_each(_SEC_NUM, "avg({c}) AS {c}")} FROM sections GROUP BY p_brand, p_type),
{_scored("sections", "r.p_partkey", _SEC_NUM, _SEC_CAT)}
SELECT profile_id, CAST(rank AS INTEGER) AS rank, p_partkey, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(similarity, 12) DESC, p_partkey) AS rank FROM scored)
WHERE rank <= 10"""
_LINE_FEATURES = (*_LINE_NUM, "l_returnflag", "l_linestatus")
_LINE_KEY_R = ", ".join(f"r.{c.strip()}" for c in _LINE.split(","))
ORACLES["similar_rows_overall"] = f"""
WITH prof AS (SELECT 'overall' AS profile_id, {_each(_LINE_NUM, "avg({c}) AS {c}")},
  (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_returnflag,
  (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_linestatus
  FROM lineitem),
{_scored("lineitem", _LINE_KEY_R, _LINE_NUM, ("l_returnflag", "l_linestatus"))}
{_nearest(_LINE, _LINE, _LINE_FEATURES, skip=("l_extendedprice",))}"""
ORACLES["similar_rows_filtered_profile"] = f"""
WITH chosen AS (SELECT * FROM lineitem WHERE {_MATCH}),
prof AS (SELECT l_returnflag AS profile_id, * FROM
  (SELECT l_returnflag, {_each(_LINE_NUM, "avg({c}) AS {c}")} FROM chosen GROUP BY l_returnflag)
  JOIN {_mode("chosen", "l_returnflag", "l_linestatus")} m USING (l_returnflag)),
{_scored("lineitem", _LINE_KEY_R, _LINE_NUM, ("l_returnflag", "l_linestatus"))}
{_nearest(_LINE, _LINE, _LINE_FEATURES, skip=("l_extendedprice",))}"""
ORACLES["topk_rows"] = """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"""

# --- clusters and components ---------------------------------------------------------------

ORACLES["kmeans_clusters"] = f"""
WITH {_SECTIONS}
SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_astray,
       true AS centers_are_means, true AS numbered_by_size, true AS better_than_one_cluster FROM sections"""
ORACLES["kmeans_small_n"] = """
SELECT count(DISTINCT o_orderstatus) AS n_rows, least(5, count(DISTINCT o_orderstatus)) AS n_clusters FROM orders"""
ORACLES["cluster_sizes"] = f"""
WITH {_SECTIONS}
SELECT count(*) AS n_rows, 0 AS first_cluster, 4 AS last_cluster, 100.0::DOUBLE AS pct_sum, true AS none_empty
FROM sections"""
ORACLES["cluster_summary"] = f"""
WITH {_SECTIONS}
SELECT CAST(5 AS BIGINT) AS n_clusters, {_each(_SEC_NUM, "round(avg({c}), 6) AS {c}")},
       CAST(5 AS BIGINT) AS n_types, CAST(5 AS BIGINT) AS n_brands FROM sections"""
_GIVEN = f"{_SECTIONS}, given AS (SELECT *, CAST(p_size % 5 AS INTEGER) AS cluster FROM sections)"
_SCALED = _each(_SEC_NUM, "({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS z_{c}")
ORACLES["cluster_points_checked"] = f"""
WITH {_SECTIONS}, scaled AS (SELECT p_partkey, {_SCALED} FROM sections)
SELECT p_partkey, true AS known_cluster, true AS inside, round({_each(_SEC_NUM, "z_{c} * z_{c}", " + ")}, 6) AS squared FROM scaled"""
ORACLES["cluster_subset_view"] = f"""
WITH {_GIVEN}, scaled AS (SELECT p_partkey, cluster, p_type, {_SCALED} FROM given)
SELECT p_partkey, cluster, p_type, {_each([f"z_{c}" for c in _SEC_NUM], "round({c}, 6) + 0.0 AS {c}")} FROM scaled WHERE cluster = 2"""
_GIVEN_SUMMARY = f"""summary AS (SELECT * FROM
  (SELECT cluster, {_each(_SEC_NUM, "avg({c}) AS {c}")} FROM given GROUP BY cluster)
  JOIN {_mode("given", "cluster", "p_type", "p_partkey")} t USING (cluster)
  JOIN {_mode("given", "cluster", "p_brand", "p_partkey")} b USING (cluster))"""
ORACLES["cluster_summary_given"] = f"""
WITH {_GIVEN}, {_GIVEN_SUMMARY}
SELECT cluster, {_each(_SEC_NUM, "round({c}, 6) + 0.0 AS {c}")}, p_type, p_brand FROM summary"""
_GIVEN_SCORED = f"""{_GIVEN}, {_GIVEN_SUMMARY}, prof AS (SELECT CAST(cluster AS VARCHAR) AS profile_id, * FROM summary),
{_scored("given", "r.p_partkey", _SEC_NUM, _SEC_CAT)}"""
_TEN = """SELECT profile_id, CAST(rank AS INTEGER) AS rank, p_partkey, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY similarity DESC, p_partkey) AS rank FROM scored) WHERE rank <= 10"""
ORACLES["similar_rows_given_clusters"] = f"WITH {_GIVEN_SCORED} {_TEN}"
ORACLES["clusters_missing_modes"] = f"WITH {_GIVEN} SELECT DISTINCT cluster FROM given WHERE cluster IN (1, 3)"


def _report_long(by: str, profiles: str, source: str, modes, counts) -> str:
    """The long frame of a committed report: ``counts`` gives the number of rows of each table that is not empty."""
    manifest = " UNION ALL ".join(
        f"SELECT 'manifest', CAST(NULL AS VARCHAR), '{n}', CAST(({c}) AS DOUBLE), CAST(NULL AS VARCHAR) WHERE ({c}) > 0" for n, c in counts
    )
    means = " UNION ALL ".join(
        f"SELECT 'means', CAST({by} AS VARCHAR), '{c}', round(avg({c}), 6) + 0.0, CAST(NULL AS VARCHAR) FROM {source} GROUP BY {by}" for c in _SEC_NUM
    )
    found = " UNION ALL ".join(f"SELECT 'modes', CAST({by} AS VARCHAR), '{c}', CAST(NULL AS DOUBLE), {c} FROM {profiles}" for c in modes)
    return f"""SELECT CAST(NULL AS VARCHAR) AS frame, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS feature,
  CAST(NULL AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text WHERE false
UNION ALL {manifest} UNION ALL {means} UNION ALL {found}
UNION ALL SELECT 'nearest_rows', profile_id, CAST(rank AS VARCHAR), similarity, CAST(p_partkey AS VARCHAR) FROM ({_TEN})"""


ORACLES["category_report_long"] = f"""
WITH {_SECTIONS}, {_section_profiles()}, {_scored("sections", "r.p_partkey", _SEC_NUM, _SEC_CAT)}
""" + _report_long(
    "p_type",
    "prof",
    "sections",
    ("p_brand",),
    (
        ("means", "SELECT count(DISTINCT p_type) FROM sections"),
        ("modes", "SELECT count(DISTINCT p_type) FROM sections"),
        ("value_counts", "SELECT count(DISTINCT (p_type, p_brand)) + count(DISTINCT p_type) FROM sections"),
        ("nearest_rows", f"SELECT count(*) FROM ({_TEN})"),
    ),
)
_PER_CLUSTER = "SELECT count(DISTINCT cluster) FROM given"
ORACLES["cluster_report_long"] = f"WITH {_GIVEN_SCORED} " + _report_long(
    "cluster",
    "summary",
    "given",
    _SEC_CAT,
    (
        ("rows", "SELECT count(*) FROM given"),
        *[(n, _PER_CLUSTER) for n in ("sizes", "means", "modes", "summary")],
        ("points", "SELECT count(*) FROM given"),
        ("nearest_rows", f"SELECT count(*) FROM ({_TEN})"),
    ),
)
ORACLES["similar_rows_by_cluster"] = f"""
WITH {_SECTIONS}
SELECT CAST(5 AS BIGINT) AS n_profiles, 5 * least(10, count(*)) AS n_rows,
       CAST(least(10, count(*)) AS INTEGER) AS last_rank, true AS not_negative, true AS at_most_one,
       CAST(0 AS BIGINT) AS n_out_of_order FROM sections"""
ORACLES["feature_covariance"] = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance FROM lineitem"
    for i, a in enumerate(_LINE_NUM)
    for b in _LINE_NUM[i:]
)

# The correlation matrix is [[1,a,b],[a,1,c],[b,c,1]]. Its eigenvalues are 1 + s with
# s^3 - (a^2+b^2+c^2) s - 2abc = 0, solved by the cosine formula; an eigenvector is the
# longest cross product of two rows of the matrix less its eigenvalue.
_EIGEN = """r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b,
           corr(l_extendedprice, l_discount) AS c FROM lineitem),
t AS (SELECT *, sqrt((a*a + b*b + c*c) / 3) AS p FROM r),
roots AS (SELECT a, b, c, 2 * p * cos(acos(greatest(-1.0, least(1.0, a*b*c / (p*p*p)))) / 3
            - 2 * pi() * k / 3) AS s FROM t, (VALUES (0), (1), (2)) v(k)),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY s DESC) AS INTEGER) AS component FROM roots),
crossed AS (
  SELECT component, s, a*c + b*s AS x, a*b + s*c AS y, s*s - a*a AS z FROM ranked
  UNION ALL SELECT component, s, -a*s - b*c, b*b - s*s, -s*c - a*b FROM ranked
  UNION ALL SELECT component, s, s*s - c*c, b*c + a*s, a*c + b*s FROM ranked),
longest AS (SELECT component, s, x, y, z, sqrt(x*x + y*y + z*z) AS norm FROM crossed
  QUALIFY row_number() OVER (PARTITION BY component ORDER BY x*x + y*y + z*z DESC) = 1),
signed AS (SELECT *, CASE WHEN greatest(x, y, z) >= -least(x, y, z) THEN norm ELSE -norm END AS len FROM longest),
vectors AS (SELECT component, s, x / len AS x, y / len AS y, z / len AS z FROM signed),
wide AS (SELECT
  max(x) FILTER (component = 1) AS x1, max(y) FILTER (component = 1) AS y1, max(z) FILTER (component = 1) AS z1,
  max(x) FILTER (component = 2) AS x2, max(y) FILTER (component = 2) AS y2, max(z) FILTER (component = 2) AS z2,
  max(x) FILTER (component = 3) AS x3, max(y) FILTER (component = 3) AS y3, max(z) FILTER (component = 3) AS z3
  FROM vectors),
m AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my,
        stddev_pop(l_extendedprice) AS sy, avg(l_discount) AS mz, stddev_pop(l_discount) AS sz FROM lineitem),
scaled AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  (l_quantity - mx) / sx AS q, (l_extendedprice - my) / sy AS e, (l_discount - mz) / sz AS d FROM lineitem, m)"""
ORACLES["pca_projection"] = f"""
WITH {_EIGEN}
SELECT {_LINE}, {_r("q*x1 + e*y1 + d*z1", "pc1", 4)}, {_r("q*x2 + e*y2 + d*z2", "pc2", 4)},
       {_r("q*x3 + e*y3 + d*z3", "pc3", 4)} FROM scaled, wide"""
ORACLES["pca_variance"] = f"""
WITH {_EIGEN}
SELECT component, {_r("1 + s", "variance")}, {_r("(1 + s) / 3", "explained")} FROM vectors"""
ORACLES["pca_embeddings"] = """
SELECT count(*) AS n_rows, true AS centred_and_uncorrelated, true AS variance_as_announced,
       true AS descending, true AS orthonormal FROM embeddings"""
