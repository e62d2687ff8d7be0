"""Registered queries: one Spark query and, where SQL can say it exactly, the
equivalent DuckDB SQL, per operator of the library.

Every query reads whole tables under ``sf_dir``.  Doubles are rounded the same
way on both sides (``round(x * 10^d) / 10^d``, negative zero folded to zero)
so the value hashes compare engines, not last-digit noise.  NULLs, padding
and duplicates that the test tables lack are injected with the same ``CASE``
expression on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import qcol
from tabulon.operators import charts, clean, profile, stats, trend
from tabulon.operators.ranking import exact_quantiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ rounding
def rnd(c: Column, digits: int = 4) -> Column:
    scale = float(10 ** digits)
    v = F.round(c * F.lit(scale)) / F.lit(scale)
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def round_doubles(df: DataFrame, digits: int = 4, only: list[str] | None = None) -> DataFrame:
    cols = only if only is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: rnd(qcol(c).cast("double"), digits) for c in cols}) if cols else df


def sr(expr: str, digits: int = 4) -> str:
    s = f"CAST({10 ** digits} AS DOUBLE)"
    return (f"(CASE WHEN round(CAST({expr} AS DOUBLE) * {s}) = 0 THEN CAST(0 AS DOUBLE) "
            f"ELSE round(CAST({expr} AS DOUBLE) * {s}) / {s} END)")


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ fixtures in SQL
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]

# orders with missing values injected (the test tables have none)
ORDERS_GAPS_SQL = """(SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders)"""


def orders_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 13 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS_GAPS_COLS = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
                    ("o_orderstatus", "string", "categorical"),
                    ("o_totalprice", "double", "numeric"),
                    ("o_orderdate", "timestamp_ntz", "datetime"),
                    ("o_orderpriority", "string", "categorical")]


# ================================================================== profiling
@register("describe_numeric", union_all([
    f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", count({c}) AS count,
  {sr(f'avg({c})')} AS mean, {sr(f'stddev_samp({c})')} AS std, {sr(f'min({c})')} AS min,
  {sr(f'quantile_cont({c}, 0.25)')} AS q25, {sr(f'quantile_cont({c}, 0.5)')} AS q50,
  {sr(f'quantile_cont({c}, 0.75)')} AS q75, {sr(f'max({c})')} AS max FROM lineitem"""
    for i, c in enumerate(LINEITEM_NUM)]))
def q_describe(spark, d):
    return round_doubles(profile.describe(table(spark, d, "lineitem")))


@register("skew_kurtosis", union_all([
    f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column",
  {sr(f'skewness({c})', 6)} AS skewness, {sr(f'kurtosis({c})', 6)} AS kurtosis FROM lineitem"""
    for i, c in enumerate(LINEITEM_NUM)]))
def q_skew(spark, d):
    return round_doubles(profile.skew_kurtosis(table(spark, d, "lineitem")), 6)


@register("profile_missing", union_all([
    f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{t}' AS dtype, '{k}' AS kind,
  count(*) FILTER (WHERE {c} IS NULL) AS missing FROM {ORDERS_GAPS_SQL} g"""
    for i, (c, t, k) in enumerate(ORDERS_GAPS_COLS)]))
def q_profile_missing(spark, d):
    return profile.profile_columns(orders_gaps(spark, d))


@register("basic_summary", f"""
SELECT count(*) AS total_rows, CAST(6 AS INTEGER) AS total_columns,
  CAST(3 AS INTEGER) AS numeric_columns, CAST(2 AS INTEGER) AS categorical_columns,
  CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c, _, _ in ORDERS_GAPS_COLS)}
       AS BIGINT) AS missing_values_total,
  {sr('(' + ' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c, _, _ in ORDERS_GAPS_COLS)
      + ') * 100.0 / (count(*) * 6)')} AS missing_pct
FROM {ORDERS_GAPS_SQL} g""")
def q_basic_summary(spark, d):
    return round_doubles(profile.basic_summary(orders_gaps(spark, d)))


@register("row_count", "SELECT count(*) AS row_count FROM lineitem")
def q_row_count(spark, d):
    return profile.row_count(table(spark, d, "lineitem"))


@register("first_numeric_mean",
          "SELECT 'o_orderkey' AS \"column\", round(avg(o_orderkey), 2) AS mean FROM orders")
def q_first_numeric_mean(spark, d):
    return profile.first_numeric_mean(table(spark, d, "orders"))


CUSTOMER_BYTES = [("c_custkey", "8 * count(c_custkey)"), ("c_name", "sum(strlen(c_name))"),
                  ("c_nationkey", "4 * count(c_nationkey)"),
                  ("c_acctbal", "8 * count(c_acctbal)"),
                  ("c_mktsegment", "sum(strlen(c_mktsegment))")]


@register("column_bytes", union_all([
    f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", CAST({e} AS BIGINT) AS bytes
FROM customer""" for i, (c, e) in enumerate(CUSTOMER_BYTES)]))
def q_column_bytes(spark, d):
    return profile.column_bytes(table(spark, d, "customer"))


PART_TEXT = ["p_name", "p_brand", "p_type"]
PART_LONG_SQL = "(" + union_all(
    [f"SELECT '{c}' AS col, {c} AS value FROM part WHERE {c} IS NOT NULL" for c in PART_TEXT]) + ")"


@register("top_values", f"""
SELECT col AS "column", value, cnt, CAST(rn AS INTEGER) AS rank FROM (
  SELECT col, value, count(*) AS cnt,
         row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, value) AS rn
  FROM {PART_LONG_SQL} u GROUP BY col, value) t WHERE rn <= 5""")
def q_top_values(spark, d):
    return profile.top_values(table(spark, d, "part"), k=5)


@register("unique_counts", union_all([
    f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column",
  count(DISTINCT {c}) AS unique_count FROM part""" for i, c in enumerate(PART_TEXT)]))
def q_unique_counts(spark, d):
    return profile.unique_counts(table(spark, d, "part"))


def _iqr_sql(c: str, src: str = "lineitem") -> str:
    b = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src})"
    lo, hi = "(b.q1 - 1.5 * (b.q3 - b.q1))", "(b.q3 + 1.5 * (b.q3 - b.q1))"
    return (f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS count,
  {sr(f'count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) * 100.0 / count(*)')} AS percentage,
  {sr(f'any_value({lo})')} AS lower, {sr(f'any_value({hi})')} AS upper
FROM {src}, {b} b""")


@register("outliers_iqr", union_all([_iqr_sql(c) for c in LINEITEM_NUM]))
def q_outliers(spark, d):
    return round_doubles(profile.outliers_iqr(table(spark, d, "lineitem")))


@register("outlier_rows", """
SELECT event_id, value FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) b
WHERE value < b.q1 - 1.5 * (b.q3 - b.q1) OR value > b.q3 + 1.5 * (b.q3 - b.q1)""")
def q_outlier_rows(spark, d):
    ev = table(spark, d, "events")
    q = {r["prob"]: r["value"] for r in exact_quantiles(ev, ["value"], [0.25, 0.75]).collect()}
    iqr = q[0.75] - q[0.25]
    return profile.outlier_rows(ev, "value", q[0.25] - 1.5 * iqr,
                                q[0.75] + 1.5 * iqr).select("event_id", "value")


# ================================================================== statistics
@register("correlation_matrix", union_all([
    f"""SELECT '{a}' AS var1, '{b}' AS var2, {sr(f'corr({a}, {b})', 6)} AS r FROM lineitem"""
    for a in LINEITEM_NUM for b in LINEITEM_NUM]))
def q_corr(spark, d):
    return round_doubles(stats.correlation_matrix(table(spark, d, "lineitem")), 6)


ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


# pairs are complete pairwise: each has its own missing rows
@register("correlation_gaps", union_all([
    f"""SELECT '{a}' AS var1, '{b}' AS var2, {sr(f'corr({a}, {b})', 6)} AS r FROM {ORDERS_GAPS_SQL} g"""
    for a in ORDERS_NUM for b in ORDERS_NUM]))
def q_corr_gaps(spark, d):
    return round_doubles(stats.correlation_matrix(orders_gaps(spark, d)), 6)


@register("trend_gaps", union_all([f"""
SELECT '{c}' AS "column", count(*) AS n, {sr('regr_slope(y, x)', 6)} AS slope,
  {sr('regr_intercept(y, x)', 4)} AS intercept,
  {sr('CASE WHEN var_pop(y) = 0 THEN 0 ELSE regr_r2(y, x) END', 8)} AS r_squared,
  CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
FROM (SELECT CAST({c} AS DOUBLE) AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS x
      FROM {ORDERS_GAPS_SQL} g WHERE {c} IS NOT NULL) s""" for c in ORDERS_NUM]))
def q_trend_gaps(spark, d):
    out = trend.trends(orders_gaps(spark, d), "o_orderdate", ["o_orderdate", "o_orderkey"])
    return round_doubles(round_doubles(round_doubles(out, 6, ["slope"]), 4, ["intercept"]), 8, ["r_squared"])


# lineitem with the pricing-summary columns: strongly correlated by construction
PRICED = ["l_quantity", "l_extendedprice", "l_discount", "disc_price", "charge"]
PRICED_SQL = """(SELECT l_quantity, l_extendedprice, l_discount,
  l_extendedprice * (1 - l_discount) AS disc_price,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"""


def priced_lineitem(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_quantity", "l_extendedprice", "l_discount", disc.alias("disc_price"),
                     (disc * (1 + F.col("l_tax"))).alias("charge"))


@register("strong_correlations", union_all([
    f"""SELECT '{a}' AS var1, '{b}' AS var2, {sr(f'corr({a}, {b})', 6)} AS r FROM {PRICED_SQL} p
HAVING abs(corr({a}, {b})) > 0.7"""
    for i, a in enumerate(PRICED) for b in PRICED[i + 1:]]))
def q_strong(spark, d):
    return round_doubles(stats.strong_correlations(priced_lineitem(spark, d)), 6)


def _normal_p_sql(n: str, g1: str, b2: str) -> str:
    """D'Agostino-Pearson p-value as a DuckDB expression of n, g1 and b2."""
    y0 = f"({g1} * sqrt(({n} + 1) * ({n} + 3) / (6.0 * ({n} - 2))))"
    beta2 = (f"(3.0 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / "
             f"(({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))")
    w2 = f"(-1 + sqrt(2 * ({beta2} - 1)))"
    delta = f"(1 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1))"
    y = f"(CASE WHEN {y0} = 0 THEN 1 ELSE {y0} END)"
    z1 = f"({delta} * ln({y} / {alpha} + sqrt(({y} / {alpha}) * ({y} / {alpha}) + 1)))"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    varb2 = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    x = f"(({b2} - {e}) / sqrt({varb2}))"
    sb = (f"(6.0 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * "
          f"sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))")
    a = f"(6.0 + 8.0 / {sb} * (2.0 / {sb} + sqrt(1 + 4.0 / ({sb} * {sb}))))"
    d = f"(1 + {x} * sqrt(2 / ({a} - 4.0)))"
    t2 = f"(sign({d}) * pow((1 - 2.0 / {a}) / abs({d}), 1 / 3.0))"
    z2 = f"(((1 - 2 / (9.0 * {a})) - {t2}) / sqrt(2 / (9.0 * {a})))"
    return f"exp(-({z1} * {z1} + {z2} * {z2}) / 2)"


def _normality_sql(cols: list[str], src: str) -> str:
    parts = []
    for i, c in enumerate(cols):
        m = (f"(SELECT count({c}) AS n, avg({c}) AS mu, median({c}) AS med, "
             f"stddev_samp({c}) AS sd, min({c}) AS mn, max({c}) AS mx FROM {src})")
        mom = (f"(SELECT avg(power({c} - m.mu, 2)) AS m2, avg(power({c} - m.mu, 3)) AS m3, "
               f"avg(power({c} - m.mu, 4)) AS m4 FROM {src}, {m} m)")
        n = "CAST(m.n AS DOUBLE)"
        g1 = "(k.m3 / pow(k.m2, 1.5))"
        b2 = "(k.m4 / (k.m2 * k.m2))"
        p = _normal_p_sql(n, g1, b2)
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column",
  {sr('m.mu')} AS mean, {sr('m.med')} AS median, {sr('m.sd')} AS std,
  {sr('m.mn')} AS min, {sr('m.mx')} AS max, coalesce({p} > 0.05, false) AS is_normal,
  {sr(p, 6)} AS p_value FROM {m} m, {mom} k""")
    return union_all(parts)


# a column that is close to normal: sum of the three price-like columns
ORDERS_NORMAL_SQL = """(SELECT o_totalprice,
  o_totalprice + c_acctbal AS mixed, c_acctbal
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@register("normality_test", _normality_sql(["o_totalprice", "mixed", "c_acctbal"],
                                           ORDERS_NORMAL_SQL))
def q_normality(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_totalprice", (F.col("o_totalprice") + F.col("c_acctbal")).alias("mixed"), "c_acctbal")
    out = stats.distribution(j)
    return round_doubles(round_doubles(out, 6, ["p_value"]), 4,
                         ["mean", "median", "std", "min", "max"])


# ================================================================== cleaning
@register("zscore", """
SELECT """ + ", ".join(
    f"{sr(f'({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 '
          f'ELSE stddev_pop({c}) OVER () END')} AS {c}"
    for c in ["c_custkey", "c_nationkey", "c_acctbal"]) + """, c_name, c_mktsegment
FROM customer""")
def q_zscore(spark, d):
    return round_doubles(clean.zscore(table(spark, d, "customer")))


_MODE_SQL = ("(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
             "ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("fill_missing", f"""
SELECT o_orderkey,
  {sr('coalesce(o_custkey, (SELECT median(o_custkey) FROM ' + ORDERS_GAPS_SQL + ' g))')} AS o_custkey,
  coalesce(o_orderstatus, {_MODE_SQL.format(c='o_orderstatus', src=ORDERS_GAPS_SQL + ' g2')})
    AS o_orderstatus,
  {sr('coalesce(o_totalprice, (SELECT median(o_totalprice) FROM ' + ORDERS_GAPS_SQL + ' g))')}
    AS o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate,
  coalesce(o_orderpriority, {_MODE_SQL.format(c='o_orderpriority', src=ORDERS_GAPS_SQL + ' g3')})
    AS o_orderpriority
FROM {ORDERS_GAPS_SQL} g0""")
def q_fill(spark, d):
    out = clean.fill_missing(orders_gaps(spark, d))
    out = out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return round_doubles(out, 4, ["o_custkey", "o_totalprice"])


@register("encode_flags", """
SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate),
  CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus_encoded,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_encoded
FROM orders""")
def q_encode(spark, d):
    out = clean.encode_categorical(table(spark, d, "orders"))
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


# a fifth of the rows are there twice
@register("dedup_rows", """
SELECT DISTINCT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM lineitem""")
def q_dedup(spark, d):
    li = table(spark, d, "lineitem")
    out = clean.dedup(li.unionByName(li.where("l_orderkey % 5 = 0")))
    return out.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


PADDED_SQL = """(SELECT * REPLACE (
  CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment || chr(9) ELSE c_mktsegment END
    AS c_mktsegment), CAST(NULL AS VARCHAR) AS note FROM customer)"""


def padded_customer(spark: SparkSession, d: str) -> DataFrame:
    padded = F.when(F.col("c_custkey") % 2 == 0,
                    F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("\t"))).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").withColumns(
        {"c_mktsegment": padded, "note": F.lit(None).cast("string")})


@register("clean_strings", f"""
SELECT * EXCLUDE (note) REPLACE (regexp_replace(c_mktsegment, '^\\s+|\\s+$', '', 'g') AS c_mktsegment)
FROM (SELECT DISTINCT * FROM {PADDED_SQL} p) t""")
def q_clean_strings(spark, d):
    p = padded_customer(spark, d)
    return clean.clean_data(p.unionByName(p.where("c_custkey % 3 = 0")))


@register("drop_empty_columns", f"SELECT * EXCLUDE (note) FROM {PADDED_SQL} p")
def q_drop_empty(spark, d):
    return clean.drop_empty_columns(padded_customer(spark, d))


MONEY_TEXT_SQL = "'$' || format('{:,.2f}', o_totalprice)"


@register("money_to_double", f"""
SELECT o_orderkey, o_orderpriority, {MONEY_TEXT_SQL} AS price_text,
  {sr(f"CAST(replace({MONEY_TEXT_SQL}, ',', '') [2:] AS DOUBLE)")} AS price_text_numeric
FROM orders""")
def q_money(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority",
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price_text"))
    return round_doubles(clean.text_to_number(o))


# ================================================================== charts
@register("histogram", union_all([f"""
SELECT '{c}' AS "column", CAST(b.i AS INTEGER) AS bin,
  {sr('r.lo + b.i * (r.hi - r.lo) / 30')} AS lo, {sr('r.lo + (b.i + 1) * (r.hi - r.lo) / 30')} AS hi,
  CAST(count(x.bin) AS BIGINT) AS cnt
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) r
CROSS JOIN range(30) b(i)
LEFT JOIN (SELECT least(floor((CAST({c} AS DOUBLE) - r2.lo) * (30 / (r2.hi - r2.lo))), 29) AS bin
           FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS lo,
                                  CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) r2) x
  ON x.bin = b.i
GROUP BY b.i, r.lo, r.hi""" for c in LINEITEM_NUM]))
def q_histogram(spark, d):
    return round_doubles(charts.histogram(table(spark, d, "lineitem")))


@register("box_plot", union_all([f"""
SELECT '{c}' AS "column", {sr('any_value(b.q1)')} AS q1, {sr('any_value(b.med)')} AS med,
  {sr('any_value(b.q3)')} AS q3,
  {sr(f'min({c}) FILTER (WHERE {c} >= b.q1 - 1.5 * (b.q3 - b.q1) AND {c} <= b.q3 + 1.5 * (b.q3 - b.q1))')} AS whisker_lo,
  {sr(f'max({c}) FILTER (WHERE {c} >= b.q1 - 1.5 * (b.q3 - b.q1) AND {c} <= b.q3 + 1.5 * (b.q3 - b.q1))')} AS whisker_hi,
  count(*) FILTER (WHERE {c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS n_fliers
FROM orders, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
                     quantile_cont({c}, 0.75) AS q3 FROM orders) b"""
    for c in ORDERS_NUM]))
def q_box(spark, d):
    return round_doubles(charts.box_plot(table(spark, d, "orders")))


@register("bar_chart", """
SELECT value, cnt, CAST(rn AS INTEGER) AS rank FROM (
  SELECT p_type AS value, count(*) AS cnt,
         row_number() OVER (ORDER BY count(*) DESC, p_type) AS rn
  FROM part WHERE p_type IS NOT NULL GROUP BY p_type) t WHERE rn <= 10""")
def q_bar(spark, d):
    return charts.bar_chart(table(spark, d, "part"), "p_type", 10)


@register("scatter_fit", f"""
SELECT CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS y,
  {sr('f.icpt + f.slope * o_totalprice')} AS fit
FROM orders, (SELECT regr_slope(o_custkey, o_totalprice) AS slope,
                     regr_intercept(o_custkey, o_totalprice) AS icpt FROM orders) f
WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL""")
def q_scatter(spark, d):
    o = table(spark, d, "orders")
    return round_doubles(charts.scatter_fit(o, "o_totalprice", "o_custkey"), 4, ["fit"])


@register("scatter_bins", f"""
WITH p AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
r AS (SELECT min(x) AS xl, (max(x) - min(x)) / 40 AS xw, min(y) AS yl, (max(y) - min(y)) / 11 AS yw,
        regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt FROM p),
c AS (SELECT CAST(least(floor((x - xl) / xw), 39) AS INTEGER) AS i, CAST(least(floor((y - yl) / yw), 10) AS INTEGER) AS j,
        count(*) AS cnt FROM p, r GROUP BY i, j)
SELECT i AS x_bin, j AS y_bin, {sr('xl + i * xw')} AS x_lo, {sr('xl + (i + 1) * xw')} AS x_hi, {sr('yl + j * yw', 6)} AS y_lo,
  {sr('yl + (j + 1) * yw', 6)} AS y_hi, cnt, {sr('icpt + slope * ((xl + i * xw) + (xl + (i + 1) * xw)) / 2', 6)} AS fit FROM c, r""")
def q_scatter_bins(spark, d):
    out = charts.scatter_bins(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", 40, 11)
    return round_doubles(round_doubles(out, 4, ["x_lo", "x_hi"]), 6, ["y_lo", "y_hi", "fit"])


@register("line_chart", """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
  CAST(o_totalprice AS DOUBLE) AS value FROM orders""")
def q_line(spark, d):
    return charts_line(spark, d)


def charts_line(spark, d):
    o = table(spark, d, "orders")
    return trend.line_chart(o, ["o_orderdate", "o_orderkey"], "o_totalprice")


KDE_COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("kde", union_all([f"""
SELECT '{c}' AS "column", CAST(p.i AS INTEGER) AS point, {sr('r.lo + p.i * (r.hi - r.lo) / 199', 6)} AS x,
  {sr(f'sum(c.cnt * exp(-0.5 * ((r.lo + p.i * (r.hi - r.lo) / 199 - (r.lo + (c.cell + 0.5) * (r.hi - r.lo) / 2000)) / r.h) * ((r.lo + p.i * (r.hi - r.lo) / 199 - (r.lo + (c.cell + 0.5) * (r.hi - r.lo) / 2000)) / r.h))) / (any_value(r.n) * any_value(r.h) * sqrt(2 * pi()))', 12)} AS density
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n,
             stddev_samp({c}) * pow(count({c}), -0.2) AS h FROM orders) r
CROSS JOIN range(200) p(i)
JOIN (SELECT least(floor((CAST({c} AS DOUBLE) - r2.lo) * (2000 / (r2.hi - r2.lo))), 1999) AS cell,
             count(*) AS cnt
      FROM orders, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi
                    FROM orders) r2
      WHERE {c} IS NOT NULL GROUP BY 1) c ON true
GROUP BY p.i, r.lo, r.hi""" for c in KDE_COLS]))
def q_kde(spark, d):
    o = table(spark, d, "orders")
    out = charts.kde(o)
    return round_doubles(round_doubles(out, 12, ["density"]), 6, ["x"])


# ================================================================== trend
TREND_COLS = ["event_id", "user_id", "value"]


@register("trend_events", union_all([f"""
SELECT '{c}' AS "column", count(*) AS n, {sr('regr_slope(y, x)', 10)} AS slope,
  {sr('regr_intercept(y, x)', 8)} AS intercept,
  {sr('CASE WHEN var_pop(y) = 0 THEN 0 ELSE regr_r2(y, x) END', 10)} AS r_squared,
  CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
FROM (SELECT CAST({c} AS DOUBLE) AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS x
      FROM events WHERE {c} IS NOT NULL AND ts IS NOT NULL) s
HAVING count(*) > 2""" for c in TREND_COLS]))
def q_trend(spark, d):
    ev = table(spark, d, "events")
    out = trend.trends(ev, "ts", ["ts", "event_id"], TREND_COLS)
    out = round_doubles(out, 10, ["slope", "r_squared"])
    return round_doubles(out, 8, ["intercept"])


@register("trend_range", """
SELECT 'ts' AS date_column,
  CASE WHEN microsecond(min(ts)) % 1000000 = 0 THEN strftime(min(ts), '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') END AS start,
  CASE WHEN microsecond(max(ts)) % 1000000 = 0 THEN strftime(max(ts), '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') END AS "end",
  count(*) AS total_periods FROM events""")
def q_trend_range(spark, d):
    return trend.trend_summary(table(spark, d, "events"), "ts")


# ================================================================== runner
RUN_OPS = ["clean_data", "handle_missing", "normalize", "encode_categorical", "detect_outliers"]


def doubled_gaps(spark: SparkSession, d: str) -> DataFrame:
    """orders with gaps, a ninth of the rows twice."""
    g = orders_gaps(spark, d).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return g.unionByName(g.where("o_orderkey % 9 = 0"))


@register("run_operations", f"""
WITH g AS (SELECT * FROM {ORDERS_GAPS_SQL} o),
f AS (SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey,
        coalesce(CAST(o_custkey AS DOUBLE), (SELECT median(o_custkey) FROM g)) AS o_custkey,
        coalesce(o_totalprice, (SELECT median(o_totalprice) FROM g)) AS o_totalprice,
        coalesce(o_orderstatus, {_MODE_SQL.format(c='o_orderstatus', src='g')}) AS o_orderstatus,
        CAST(o_orderdate AS VARCHAR) AS o_orderdate,
        coalesce(o_orderpriority, {_MODE_SQL.format(c='o_orderpriority', src='g')}) AS o_orderpriority
      FROM g)
SELECT """ + ", ".join(
    f"{sr(f'({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END')} AS {c}"
    for c in ["o_orderkey", "o_custkey", "o_totalprice"]) + """,
  o_orderstatus, o_orderdate, o_orderpriority,
  CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus_encoded,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_encoded
FROM f""")
def q_run_operations(spark, d):
    from tabulon.plans.runner import run_operations
    out, _log = run_operations(doubled_gaps(spark, d), RUN_OPS, with_log=False)
    return round_doubles(out)


def _filled_sql(ord_: int, col: str, how: str) -> str:
    return (f"SELECT {ord_}, 'Filled ' || count(*) || ' missing values in {col} with {how}' "
            f"FROM {ORDERS_GAPS_SQL} g WHERE {col} IS NULL")


@register("run_operations_log", f"""
SELECT CAST(ord AS INTEGER) AS ord, text FROM (
SELECT 0 AS ord, 'Removed ' || count(*) || ' duplicate rows' AS text FROM orders WHERE o_orderkey % 9 = 0
UNION ALL SELECT 1, 'Applied basic data cleaning'
UNION ALL {_filled_sql(2, 'o_custkey', 'median')}
UNION ALL {_filled_sql(3, 'o_totalprice', 'median')}
UNION ALL {_filled_sql(4, 'o_orderpriority', 'mode')}
UNION ALL SELECT 5, 'Encoded categorical column: o_orderstatus'
UNION ALL SELECT 6, 'Encoded categorical column: o_orderpriority') t""")
def q_run_operations_log(spark, d):
    from tabulon.plans.runner import run_operations
    _out, log = run_operations(doubled_gaps(spark, d), ["clean_data", "handle_missing", "encode_categorical"])
    return spark.createDataFrame(list(enumerate(log)), "ord int, text string")


def _insights_sql() -> str:
    pairs = union_all([f"SELECT corr({a}, {b}) AS r FROM {PRICED_SQL} p"
                       for i, a in enumerate(PRICED) for b in PRICED[i + 1:]])
    normal = _normality_sql(PRICED, PRICED_SQL)
    return f"""
WITH strong AS (SELECT count(*) AS n FROM ({pairs}) c WHERE abs(r) > 0.7),
normal AS (SELECT string_agg(chr(39) || "column" || chr(39), ', ' ORDER BY position) AS cols,
                  count(*) AS n FROM ({normal}) t WHERE is_normal),
lines AS (
  SELECT 1 AS k, 'Found ' || CAST(n AS VARCHAR) || ' strong correlations between variables'
    AS text FROM strong WHERE n > 0
  UNION ALL
  SELECT 2, 'Variables [' || cols || '] follow normal distribution' FROM normal WHERE n > 0)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS ord, text FROM lines"""


# NULL-free table: no missing-value line; strong pairs and normal columns from
# the same formulas as the correlation and normality oracles
@register("insights", _insights_sql())
def q_insights(spark, d):
    from tabulon.plans.runner import run_steps
    res = run_steps(priced_lineitem(spark, d),
                    ["summary_statistics", "correlation_analysis", "distribution_analysis"])
    return res["insights"]


# ================================================================== sources
@register("flatten_events_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events""")
def q_flatten(spark, d):
    from tabulon.sources.files import parse_json_column
    ev = table(spark, d, "events").select("event_id", "props")
    return parse_json_column(ev, "props")


def orders_json(spark: SparkSession, d: str) -> DataFrame:
    """``o_orderkey`` and the other columns of orders (with gaps) as JSON text:
    missing keys differ by row, the price is nested."""
    g = orders_gaps(spark, d)
    return g.select("o_orderkey", F.to_json(F.struct(
        "o_custkey", "o_orderstatus", F.when(F.col("o_totalprice").isNotNull(), F.struct(
            F.col("o_totalprice").alias("total"), F.lit("usd").alias("unit"))).alias("price"),
        "o_orderpriority")).alias("doc"))


_JSON_COLS = """CAST(o_custkey AS DOUBLE) AS "{p}o_custkey", 'bigint' AS custkey_type, o_orderpriority AS "{p}o_orderpriority",
  o_orderstatus AS "{p}o_orderstatus", {total} AS "{p}price.total",
  CASE WHEN o_totalprice IS NOT NULL THEN 'usd' END AS "{p}price.unit\""""


@register("json_column_keys", f"""
SELECT o_orderkey, {_JSON_COLS.format(p='doc.', total=sr('o_totalprice', 2))} FROM {ORDERS_GAPS_SQL} g""")
def q_json_column(spark, d):
    from tabulon.sources.files import parse_json_column
    return round_doubles(_with_type(parse_json_column(orders_json(spark, d), "doc"), "doc.o_custkey"), 2)


def _with_type(df: DataFrame, col: str) -> DataFrame:
    """``col`` as double (gaps and all) beside the type that was found for it."""
    return df.withColumns({"custkey_type": F.lit(dict(df.dtypes)[col]), col: qcol(col).cast("double")})


def _written(df: DataFrame, kind: str, **options) -> str:
    """``df`` written under the shared checkpoint folder; its place."""
    import uuid

    from tabulon.session import checkpoint_dir
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}.{kind}"
    fmt = {"tsv": "csv", "txt": "csv"}.get(kind, kind)
    (df.write.options(**options).text(path) if options.pop("plain", False) else
     df.write.format(fmt).options(**options).save(path))
    return path


@register("json_lines_file", f"""
SELECT {_JSON_COLS.format(p='', total=sr('o_totalprice', 2))} FROM {ORDERS_GAPS_SQL} g""")
def q_json_file(spark, d):
    from tabulon.sources.files import load
    docs = orders_json(spark, d).select("doc")
    # blank lines first and between: they are no rows
    path = _written(docs.select(F.explode(F.array(F.lit(""), F.col("doc"))).alias("doc")), "json", plain=True)
    return round_doubles(_with_type(load(spark, path), "o_custkey"), 2)


# even blocks of customers as JSON lines, odd ones each as one indented document
@register("json_mixed_files", f"""
SELECT c_custkey, c_name, {sr('c_acctbal', 2)} AS "money.balance", c_mktsegment AS "money.segment",
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey AS DOUBLE) END AS nation, 'bigint' AS nation_type FROM customer""")
def q_json_mixed(spark, d):
    from tabulon.sources.files import read_json
    c = table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 100).alias("block"), "c_custkey", "c_name",
        F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("money"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey")).alias("nation"))
    row = F.struct("c_custkey", "c_name", "money", "nation")
    lines = c.where("block % 2 = 0").select(F.to_json(row).alias("doc"))
    documents = c.where("block % 2 = 1").groupBy("block").agg(
        F.to_json(F.collect_list(row), {"pretty": "true"}).alias("doc"))
    root = _written(lines, "json", plain=True)
    documents.write.partitionBy("block").text(f"{root}/documents")
    out = read_json(spark, root, recursiveFileLookup=True)
    return round_doubles(out.withColumns({"nation_type": F.lit(dict(out.dtypes)["nation"]),
                                          "nation": F.col("nation").cast("double")}), 2)


_NA_ORDERS = """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, 'bigint' AS custkey_type, o_orderstatus, {total} AS o_totalprice,
  CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM {src} g"""


def _na_text(df: DataFrame, words: tuple[str, str]) -> DataFrame:
    """All columns as text, gaps as two of the words that mean missing, names padded."""
    word = F.when(F.col("o_orderkey") % 2 == 0, words[0]).otherwise(words[1])
    return df.select(*[F.coalesce(F.col(c).cast("string"), word).alias(f" {c} ") for c in df.columns])


def _delimited(spark, d, kind: str, sep: str, words: tuple[str, str]) -> DataFrame:
    from tabulon.sources.files import load
    path = _written(_na_text(orders_gaps(spark, d), words), kind, sep=sep, header=True)
    out = load(spark, path)
    out = out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return round_doubles(_with_type(out, "o_custkey"), 2)


_CSV_SQL = _NA_ORDERS.format(total=sr("o_totalprice", 2), src=ORDERS_GAPS_SQL).replace(
    "CAST(o_orderdate AS VARCHAR)", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")


@register("csv_file", _CSV_SQL)
def q_csv(spark, d):
    return _delimited(spark, d, "csv", ",", ("NA", "n/a"))


@register("tsv_file", _CSV_SQL)
def q_tsv(spark, d):
    return _delimited(spark, d, "tsv", "\t", ("NULL", "None"))


@register("pipe_text_file", _CSV_SQL)
def q_pipe(spark, d):
    return _delimited(spark, d, "txt", "|", ("#N/A", "nan"))


@register("date_column_from_text", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""")
def q_date_text(spark, d):
    # padded names are stripped, the date column is found by its name and values, then parsed
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias(" o_orderkey"), F.date_format(
        "o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate  "))
    o = clean.strip_column_names(o)
    col = clean.find_datetime_column(o)
    out = clean.parse_datetime(o, col)
    return out.withColumn(col, F.date_format(col, "yyyy-MM-dd HH:mm:ss"))


@register("request_log_days", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1""")
def q_request_log(spark, d):
    import uuid

    from tabulon.session import checkpoint_dir
    from tabulon.sources.files import write_request_log
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    ev = table(spark, d, "events")
    write_request_log(ev.where("event_id % 2 = 0"), path, "ts")
    write_request_log(ev.where("event_id % 2 = 1"), path, "ts")  # a second batch is appended
    back = spark.read.json(path)
    return back.groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@register("scan_parquet_count", "SELECT count(*) AS n FROM lineitem")
def q_scan_count(spark, d):
    from tabulon.sources.files import read_parquet
    return read_parquet(spark, f"{d}/lineitem*.parquet").agg(F.count(F.lit(1)).alias("n"))


@register("append_files", """
SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer""")
def q_append(spark, d):
    from tabulon.sources.files import append_tables
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return append_tables([s, c])


# one batch of suppliers, one of customers, and the latter once more as after a failure
@register("append_to_table", """
SELECT s_suppkey AS k, s_name AS name, s_acctbal AS acctbal, 'supplier' AS batch FROM supplier
UNION ALL SELECT c_custkey, c_name, c_acctbal, 'customer' FROM customer""")
def q_append_sink(spark, d):
    from tabulon.sources.files import append_to_table
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").toDF("k", "name", "acctbal")
    path = _fresh_path(spark)
    for rows, batch in ((s, "supplier"), (c.limit(0), "customer"), (c, "customer"), (c, "customer")):
        append_to_table(rows, path, batch=batch)
    return spark.read.parquet(path)


def _fresh_path(spark: SparkSession) -> str:
    import uuid

    from tabulon.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


# one status of a partitioned table, read by its folders: both partition columns are kept
@register("partitioned_parquet", f"""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, {sr('o_totalprice', 2)} AS total
FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) % 2 = 0""")
def q_partitioned(spark, d):
    from tabulon.sources.files import read_parquet
    path = _fresh_path(spark)
    table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("total"), F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("status")).write.partitionBy("year", "status").parquet(path)
    out = read_parquet(spark, f"{path}/year=*/status=F", base_path=path).where("year % 2 = 0")
    return round_doubles(out, 2)


# events as files that a stream picks up, logged by day and read back
@register("request_log_stream", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1""")
def q_request_stream(spark, d):
    from tabulon.streaming.ingest import file_stream, request_log_stream
    ev = table(spark, d, "events").select("event_id", "ts")
    src, out = _fresh_path(spark), _fresh_path(spark)
    for part in (0, 1):
        ev.where(F.col("event_id") % 2 == part).write.mode("append").parquet(src)
    for _ in range(2):  # a restart logs nothing twice
        stream = file_stream(spark, src, ev.schema, max_files_per_trigger=1)
        request_log_stream(stream, out, f"{out}-state", "ts", trigger_once=True).awaitTermination()
    return spark.read.json(out).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


# two text columns are named like dates; only the second is one, in a form of its own
@register("date_formats", """
SELECT o_orderkey, o_orderpriority AS update_time, strftime(o_orderdate, '%Y-%m-%d') AS order_date, 'dd.MM.yyyy' AS fmt
FROM orders""")
def q_date_formats(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("update_time"),
                                         F.date_format("o_orderdate", "dd.MM.yyyy").alias("order_date"))
    out, col, fmt = clean.convert_first_date(o)
    return out.withColumns({col: F.date_format(col, "yyyy-MM-dd"), "fmt": F.lit(fmt)})


@register("sample_head", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 5""")
def q_head(spark, d):
    from tabulon.sources.files import sample_head
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                            "l_quantity")
    return sample_head(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 5)


@register("sample_preview", """
SELECT '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey)
  || ']' AS sample_json, count(*) AS sample_size, (SELECT count(*) FROM orders) AS total_size
FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5) t""")
def q_preview(spark, d):
    from tabulon.sources.files import sample_preview
    return sample_preview(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


@register("file_manifest", """
SELECT extension, category, count(*) AS files, readable FROM (
  SELECT DISTINCT n_regionkey, '.csv' AS extension, 'data' AS category, true AS readable FROM nation
  UNION ALL SELECT DISTINCT n_nationkey, '.json', 'data', true FROM nation
  UNION ALL SELECT DISTINCT r_regionkey, '.txt', 'text', true FROM region) t
GROUP BY extension, category, readable""")
def q_manifest(spark, d):
    from tabulon.sources.files import file_manifest
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    files = None
    for df, key, kind in ((nation, "n_regionkey", "csv"), (nation, "n_nationkey", "json"),
                          (region.select("r_regionkey", F.col("r_name").alias("value")), "r_regionkey", "text")):
        path = _written_by(df, key, kind)
        one = file_manifest(spark, path).where("bytes > 0 and within_limit")
        files = one if files is None else files.union(one)
    return files.groupBy("extension", "category", "readable").agg(F.count(F.lit(1)).alias("files"))


def _written_by(df: DataFrame, key: str, fmt: str) -> str:
    """``df`` with one file for each value of ``key``."""
    import uuid

    from tabulon.session import checkpoint_dir
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.repartition(1).write.partitionBy(key).format(fmt).save(path)
    return path


# ------------------------------------------------------------------ pages rendered from orders
def order_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a page: a table with spanned headers, a table with an empty
    row, and on every tenth (an encyclopedia page) a ranked film table and a
    longer list."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit("<p>order<table><tr><th rowspan=2>Key</th><th colspan=2>Info</th></tr><tr><th>Status</th>"
              "<th>Priority</th></tr><tr><td>"), key, F.lit("</td><td>"), F.col("o_orderstatus"),
        F.lit("<td>"), F.col("o_orderpriority"),
        F.lit("</table><table><tr><td>a</td><td rowspan=3>"), key,
        F.lit("</td></tr><tr></tr><tr><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"),
        F.when(F.col("o_orderkey") % 10 == 0, F.concat(
            F.lit("<table><tr><th>Rank</th><th>Title</th><th>Gross</th><th>Year</th></tr>"),
            F.repeat(F.concat(F.lit("<tr><td>1</td><td>"), key, F.lit("</td><td>$1</td><td>1999</td></tr>")), 12),
            F.lit("</table><table>"), F.repeat(F.lit("<tr><td>x</td></tr>"), 20), F.lit("</table>"))).otherwise(""))
    url = F.when(F.col("o_orderkey") % 10 == 0, F.lit("https://en.wikipedia.org/wiki/")) \
        .otherwise(F.lit("https://shop.example/"))
    return o.select(F.col("o_orderkey").alias("page_id"), F.concat(url, key).alias("url"), html.alias("html"))


_PAGE_ROWS = """
SELECT page_id, CAST(t AS INTEGER) AS table_idx, CAST(r AS INTEGER) AS row_idx, h AS is_header, cells FROM (
  SELECT o_orderkey AS page_id, v.t, v.r, v.h,
    replace(replace(replace(v.c, '#K', CAST(o_orderkey AS VARCHAR)), '#S', o_orderstatus), '#P', o_orderpriority) AS cells
  FROM orders, (VALUES (0, 0, true, 'Key|Info|Info'), (0, 1, true, 'Key|Status|Priority'), (0, 2, false, '#K|#S|#P'),
    (1, 0, false, 'a|#K'), (1, 1, false, '-|#K'), (1, 2, false, 'b|#K'), (1, 3, false, 'c|d')) v(t, r, h, c)
  UNION ALL
  SELECT o_orderkey, 2, 0, true, 'Rank|Title|Gross|Year' FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT o_orderkey, 2, i, false, '1|' || o_orderkey || '|$1|1999' FROM orders, range(1, 13) n(i) WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT o_orderkey, 3, i, false, 'x' FROM orders, range(20) n(i) WHERE o_orderkey % 10 = 0) t"""


@register("html_tables", _PAGE_ROWS)
def q_html_tables(spark, d):
    from tabulon.sources.html_tables import html_tables
    return html_tables(order_pages(spark, d)).select(
        "page_id", "table_idx", "row_idx", "is_header", F.array_join("cells", "|", "-").alias("cells"))


@register("html_best_table", """
SELECT o_orderkey AS page_id, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS INTEGER) AS table_idx,
  CASE WHEN o_orderkey % 10 = 0 THEN 12 ELSE 4 END::BIGINT AS n_rows, o_orderkey % 10 = 0 AS matched FROM orders""")
def q_html_best(spark, d):
    from tabulon.sources.html_tables import best_tables, html_tables
    pages = order_pages(spark, d)
    return best_tables(html_tables(pages), pages).select("page_id", "table_idx", "n_rows", "matched")


@register("page_table_count", """
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 10 = 0 THEN 4 ELSE 2 END::BIGINT AS n_tables FROM orders
UNION ALL SELECT -1 - page_id, CAST((length(lower(html)) - length(replace(lower(html), '<table', ''))) / 6 AS BIGINT)
FROM pages""")
def q_page_tables(spark, d):
    from tabulon.sources.html_tables import page_table_counts
    raw = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return page_table_counts(order_pages(spark, d).unionByName(raw))


# ================================================================== prompt text
@register("extract_urls", r"""
SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(url || ' ' || html,
  'https?://[^\s\n]+'))) AS url FROM pages""")
def q_urls(spark, d):
    from tabulon.functions.text import extract_urls
    p = table(spark, d, "pages").select(
        "page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return extract_urls(p, "page_id", "text")


# conversations of all roles, and a prompt rendered from every part
PROMPTS_SQL = """(SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text FROM conversations
UNION ALL
SELECT 'p' || p_partkey, CASE CAST(p_partkey % 4 AS INTEGER)
  WHEN 0 THEN 'Answer:' || chr(10) || '1. How many ' || p_name || '?' || chr(10) || '2. Which size, ' || p_size || chr(10)
    || 'Return a JSON object with keys:' || chr(10) || '- `name`: text' || chr(10) || '- `size`: number'
  WHEN 1 THEN '  ' || p_name || '  '
  WHEN 2 THEN 'Respond with a JSON array of 3. ' || p_type || ' and base64 charts?'
  ELSE 'Return JSON. - `brand` : ' || p_brand || ' ' || chr(10) || '10.' || p_type || '?? 4. ' || p_size END
FROM part)"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    p, k = table(spark, d, "part"), F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(
        F.lit("Answer:\n1. How many "), F.col("p_name"), F.lit("?\n2. Which size, "), size,
        F.lit("\nReturn a JSON object with keys:\n- `name`: text\n- `size`: number"))) \
        .when(k == 1, F.concat(F.lit("  "), F.col("p_name"), F.lit("  "))) \
        .when(k == 2, F.concat(F.lit("Respond with a JSON array of 3. "), F.col("p_type"),
                               F.lit(" and base64 charts?"))) \
        .otherwise(F.concat(F.lit("Return JSON. - `brand` : "), F.col("p_brand"), F.lit(" \n10."),
                            F.col("p_type"), F.lit("?? 4. "), size))
    return c.union(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), text.alias("text")))


@register("extract_questions", rf"""
WITH q AS (SELECT id,
  list_filter(list_transform(regexp_extract_all(text, '\d+\.\s*([^?\n]+\??)', 1),
                             lambda x: trim(x)), lambda x: x <> '') AS found, trim(text) AS whole
  FROM {PROMPTS_SQL} p),
l AS (SELECT id, CASE WHEN len(found) > 0 THEN found
                      WHEN whole <> '' THEN [whole] ELSE [] END AS qs FROM q)
SELECT id, CAST(generate_subscripts(qs, 1) - 1 AS INTEGER) AS pos, unnest(qs) AS question FROM l""")
def q_questions(spark, d):
    from tabulon.functions.text import extract_questions
    return extract_questions(prompts(spark, d), "id", "text")


@register("answer_shape", f"""
SELECT id,
  CASE WHEN contains(lower(text), 'base64')
       THEN (CASE WHEN contains(lower(text), 'json array') THEN 'JSON array' ELSE 'standard' END)
            || ' with base64 images'
       ELSE (CASE WHEN contains(lower(text), 'json array') THEN 'JSON array' ELSE 'standard' END)
  END AS format,
  (""" + " OR ".join(f"contains(lower(text), '{p}')" for p in [
    "return a json object", "json object with keys", "return json", "output json",
    "respond with json"]) + r""")
    AND len(regexp_extract_all(text, '-\s*`([^`]+)`\s*:', 1)) > 0 AS json_object,
  array_to_string(regexp_extract_all(text, '-\s*`([^`]+)`\s*:', 1), ',') AS keys
FROM """ + PROMPTS_SQL + " p")
def q_answer_shape(spark, d):
    from tabulon.functions.text import answer_shape
    return answer_shape(prompts(spark, d), "id", "text").withColumn("keys", F.array_join("keys", ","))


@register("answers_array", """
SELECT l_orderkey AS id, '[' || string_agg('"' || l_returnflag || '"', ',' ORDER BY l_linenumber, l_returnflag) || ']'
  AS json FROM lineitem GROUP BY l_orderkey""")
def q_answers_array(spark, d):
    from tabulon.sources.files import answers_json
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")
    return answers_json(li, "id", "l_linenumber", "l_returnflag")


# the keys a prompt names (two of part, none or one elsewhere) against two answers of every fourth part
@register("answers_object", """
SELECT 'p' || p_partkey AS id, '{"name":"' || p_name || '","size":"' || p_size || '"}' AS json,
  '{"name":"' || p_brand || '","size":null}' AS first_only
FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'p' || p_partkey, '{"brand":null}', '{"brand":"' || p_brand || '"}' FROM part WHERE p_partkey % 4 = 3""")
def q_answers_object(spark, d):
    from tabulon.functions.text import answers_object, json_keys
    from tabulon.sources.files import answers_json
    p = table(spark, d, "part").withColumn("id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    keys = prompts(spark, d).select("id", json_keys("text").alias("keys")).where("id like 'p%' and size(keys) > 0")
    answers = p.where("p_partkey % 4 = 0").select("id", F.posexplode(F.array(
        "p_name", F.col("p_size").cast("string"))).alias("pos", "answer"))
    joined = answers_json(answers, "id", "pos", "answer", keys)
    first = keys.join(p.select("id", "p_brand"), "id").select(
        "id", answers_object("keys", F.array("p_brand")).alias("first_only"))
    return joined.join(first, "id")


# ================================================================== models
@register("ols_single", f"""
SELECT regr_count(l_extendedprice, l_quantity) AS n,
  {sr('regr_slope(l_extendedprice, l_quantity)')} AS slope,
  {sr('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
  {sr('regr_r2(l_extendedprice, l_quantity)', 8)} AS r2 FROM lineitem""")
def q_ols(spark, d):
    from tabulon.operators.models import ols
    out = ols(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return round_doubles(round_doubles(out, 8, ["r2"]), 4, ["slope", "intercept"])


@register("rf_importance", """
SELECT count(*) FILTER (WHERE {split} >= 1) AS n_train, count(*) FILTER (WHERE {split} < 1) AS n_test,
  4::BIGINT AS features, 1.0::DOUBLE AS importance, 'charge' AS target FROM lineitem""".format(
    split="CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8)) "
          "AS BIGINT) % 5"))
def q_rf(spark, d):
    # what holds for any forest: the split, the number of features, importances that add up to one;
    # tree_splits compares the splits themselves
    from tabulon.operators.models import random_forest
    li = table(spark, d, "lineitem") \
        .withColumn("disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount"))) \
        .withColumn("charge", F.col("disc_price") * (1 + F.col("l_tax")))
    imps, m = random_forest(li, ["l_orderkey", "l_linenumber"], "charge",
                            ["l_quantity", "l_extendedprice", "l_discount", "disc_price"])
    total = imps.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 6).alias("importance"))
    return m.select("n_train", "n_test", "target").join(F.broadcast(total)).select(
        "n_train", "n_test", "features", "importance", "target")


# the best cut of the root and of its two children among the cuts at 1/16 quantiles
TREE_FEATURES = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]


def _tree_sql() -> str:
    cuts = " UNION ALL ".join(
        f"SELECT {i} AS f, unnest(list_distinct(quantile_cont(CAST({c} AS DOUBLE), "
        f"[{', '.join(str(q / 16) for q in range(1, 16))}]))) AS t FROM r" for i, c in enumerate(TREE_FEATURES))

    def level(node: str, source: str) -> str:
        sides = " UNION ALL ".join(
            f"SELECT node, f, t, count(*) AS n, sum(y) AS s, count(*) FILTER (WHERE x <= t) AS nl, "
            f"coalesce(sum(y) FILTER (WHERE x <= t), 0) AS sl FROM (SELECT {node} AS node, {c} AS x, y FROM {source}) a "
            f"JOIN cuts ON f = {i} GROUP BY node, f, t" for i, c in enumerate(TREE_FEATURES))
        return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, t) AS best FROM (
  SELECT *, round((sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n) / total, 9) AS gain
  FROM ({sides}) b, (SELECT sum(y * y) AS total FROM r) z WHERE nl > 0 AND nl < n) c WHERE gain > 0) d WHERE best = 1"""
    value = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(TREE_FEATURES))
    name = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(TREE_FEATURES))
    return f"""
WITH m AS (SELECT avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS mean FROM lineitem),
r AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in TREE_FEATURES)},
  l_extendedprice * (1 - l_discount) * (1 + l_tax) - mean AS y FROM lineitem, m),
cuts AS ({cuts}),
root AS ({level('1', 'r')}),
q AS (SELECT r.*, CASE WHEN CASE root.f {value} END <= root.t THEN 2 ELSE 3 END AS node FROM r, root),
kids AS ({level('node', 'q')})
SELECT CAST(node AS BIGINT) AS node, CASE f {name} END AS feature, {sr('t', 4)} AS threshold, n, {sr('s / n + mean', 4)} AS mean,
  {sr('gain', 6)} AS gain, nl AS n_left, {sr('sl / nl + mean', 4)} AS mean_left, {sr('(s - sl) / (n - nl) + mean', 4)} AS mean_right
FROM (SELECT * FROM root UNION ALL SELECT * FROM kids) a, m"""


@register("tree_splits", _tree_sql())
def q_tree_splits(spark, d):
    from tabulon.operators.splits import tree_splits
    li = table(spark, d, "lineitem").withColumn(
        "charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    out = tree_splits(li, "charge", TREE_FEATURES, depth=2, bins=16).drop("depth")
    return round_doubles(round_doubles(out, 6, ["gain"]), 4, ["threshold", "mean", "mean_left", "mean_right"])


@register("kmeans_elbow", """
SELECT count(*) AS points, 8::BIGINT AS fits, true AS falls, true AS chosen FROM embeddings
WHERE embedding IS NOT NULL""")
def q_kmeans(spark, d):
    # what holds for any clustering: every point in one cluster, one fit a k, less inertia with
    # more clusters, a k among those tried; kmeans_steps compares the clusters themselves
    from tabulon.operators.models import kmeans_elbow
    elbow, clusters, k = kmeans_elbow(table(spark, d, "embeddings"), vector_col="embedding", key=["vec_id"])
    ends = elbow.agg(F.count(F.lit(1)).alias("fits"), (F.max_by("inertia", "k") < F.min_by("inertia", "k")).alias("falls"))
    return clusters.agg(F.sum("size").alias("points")).join(F.broadcast(ends)).select(
        "points", "fits", "falls", (F.lit(k) >= 2).alias("chosen"))


def _lloyd_sql(steps: int) -> str:
    """Sizes and inertia of 2 to 9 clusters after that many steps from the first start."""
    def nearest(centers: str) -> str:
        return f"""SELECT * FROM (SELECT k, c, p.n, p.v, apart, row_number() OVER (PARTITION BY k, p.n ORDER BY apart, c) AS near
  FROM (SELECT k, c, p.n, p.v, list_sum(list_transform(list_zip(p.v, {centers}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS apart
        FROM p, {centers}) p) x WHERE near = 1"""
    parts = []
    for i in range(steps):
        parts.append(f"a{i} AS ({nearest(f'c{i}')})")
        parts.append(f"""c{i + 1} AS (SELECT c{i}.k, c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
  SELECT k, c, list(x ORDER BY i) AS v FROM (SELECT k, c, i, avg(x) AS x FROM (
    SELECT k, c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i}) u GROUP BY k, c, i) w GROUP BY k, c) m USING (k, c))""")
    return f"""
WITH p AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT v, row_number() OVER (ORDER BY h) - 1 AS c FROM (
  SELECT v, min(md5('0:' || CAST(vec_id AS VARCHAR))) AS h FROM p GROUP BY v) g),
c0 AS (SELECT k, c, v FROM s, (SELECT unnest(range(2, 10)) AS k) t WHERE c < k),
{', '.join(parts)},
last AS ({nearest(f'c{steps}')})
SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS cluster, count(last.n) AS size, {sr('inertia', 4)} AS inertia
FROM c{steps} LEFT JOIN last USING (k, c) JOIN (SELECT k, sum(apart) AS inertia FROM last GROUP BY k) t USING (k)
GROUP BY k, c, inertia"""


@register("kmeans_steps", _lloyd_sql(2))
def q_kmeans_steps(spark, d):
    from tabulon.operators import kmeans
    points = table(spark, d, "embeddings").where("embedding is not null").select(
        F.col("embedding").cast("array<double>").alias("features"), F.col("vec_id").cast("string").alias("key"))
    start = kmeans.start_points(points, 9, 1)[0]
    ks = range(2, 10)
    fits = kmeans.lloyd(points, [start[:k] for k in ks], max_iter=2, tol=0.0)
    out = spark.createDataFrame([(k, c, int(n), fit.inertia) for k, fit in zip(ks, fits) for c, n in enumerate(fit.sizes)],
                                "k int, cluster int, size long, inertia double")
    return round_doubles(out, 4)


# a regression on the dotted names that flattening gives
@register("ols_flattened", f"""
WITH t AS (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS x, value AS y FROM events
  WHERE CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 >= 1)
SELECT 'props.k' AS feature, {sr('regr_slope(y, x)', 6)} AS coefficient FROM t WHERE x IS NOT NULL
UNION ALL SELECT '(intercept)', {sr('regr_intercept(y, x)', 6)} FROM t WHERE x IS NOT NULL""")
def q_ols_flattened(spark, d):
    from tabulon.operators.models import linear_regression
    from tabulon.sources.files import parse_json_column
    ev = parse_json_column(table(spark, d, "events"), "props")
    coefs, _m = linear_regression(ev, ["event_id"], "value", ["props.k"])
    return round_doubles(coefs, 6)


# ================================================================== questions
PRICING_SUMMARY = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
  count(*) AS count_order, avg(l_discount) AS avg_disc
FROM lineitem GROUP BY l_returnflag, l_linestatus"""


@register("sql_adhoc", f"""
SELECT l_returnflag, l_linestatus, {sr('sum_qty', 2)} AS sum_qty, count_order,
  {sr('avg_disc', 6)} AS avg_disc FROM ({PRICING_SUMMARY}) t""")
def q_sql(spark, d):
    from tabulon.plans.questions import sql
    out = sql(spark, {"lineitem": table(spark, d, "lineitem")}, PRICING_SUMMARY)
    return round_doubles(round_doubles(out, 2, ["sum_qty"]), 6, ["avg_disc"])


@register("corr_day_of_month", f"""
SELECT {sr('corr(o_totalprice, dayofmonth(o_orderdate))', 6)} AS r FROM orders""")
def q_corr_dom(spark, d):
    from tabulon.plans.questions import corr_with_day_of_month
    return round_doubles(corr_with_day_of_month(table(spark, d, "orders"), "o_totalprice",
                                                "o_orderdate"), 6)


@register("grand_total", f"SELECT {sr('sum(l_extendedprice)', 2)} AS total FROM lineitem")
def q_total(spark, d):
    from tabulon.plans.questions import grand_total
    return round_doubles(grand_total(table(spark, d, "lineitem"), "l_extendedprice"), 2)


@register("top_group_mean", f"""
SELECT c_mktsegment AS "group", {sr('avg(c_acctbal)')} AS mean FROM customer
GROUP BY c_mktsegment ORDER BY avg(c_acctbal) DESC, c_mktsegment LIMIT 1""")
def q_top_group(spark, d):
    from tabulon.plans.questions import top_group_by_mean
    return round_doubles(top_group_by_mean(table(spark, d, "customer"), "c_mktsegment",
                                           "c_acctbal"))


@register("count_where", """
SELECT count(*) AS n FROM orders
WHERE o_totalprice >= 200000 AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'""")
def q_count_where(spark, d):
    from tabulon.plans.questions import count_where
    pred = (F.col("o_totalprice") >= 200000) & (F.col("o_orderdate") < F.lit("1998-01-01").cast(
        "timestamp_ntz"))
    return count_where(table(spark, d, "orders"), pred)


@register("earliest_above", """
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_totalprice FROM orders
WHERE o_totalprice > 450000 ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def q_earliest(spark, d):
    from tabulon.plans.questions import earliest_above
    o = table(spark, d, "orders")
    out = earliest_above(o, "o_totalprice", 450000, "o_orderdate", "o_orderkey",
                         ["o_orderkey", "o_orderdate", "o_totalprice"])
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@register("extreme_record", """
SELECT c_custkey, c_name, c_acctbal FROM customer
ORDER BY c_acctbal DESC, c_custkey LIMIT 1""")
def q_extreme(spark, d):
    from tabulon.plans.questions import extreme_record
    return extreme_record(table(spark, d, "customer"), "c_acctbal",
                          ["c_custkey", "c_name", "c_acctbal"], True, "c_custkey")


@register("earliest_above_none", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1e15 ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def q_earliest_none(spark, d):
    from tabulon.plans.questions import earliest_above
    return earliest_above(table(spark, d, "orders"), "o_totalprice", 1e15, "o_orderdate", "o_orderkey",
                          ["o_orderkey", "o_totalprice"])


@register("extreme_record_text_key", """
SELECT * FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment DESC, c_name LIMIT 1) a
UNION ALL SELECT * FROM (SELECT c_custkey, c_name FROM customer WHERE c_acctbal IS NULL
  ORDER BY c_acctbal, c_name LIMIT 1) b""")
def q_extreme_text(spark, d):
    from tabulon.plans.questions import extreme_record
    c = table(spark, d, "customer")
    empty = c.withColumn("c_acctbal", F.lit(None).cast("double"))
    return extreme_record(c, "c_mktsegment", ["c_custkey", "c_name"], True, "c_name").union(
        extreme_record(empty, "c_acctbal", ["c_custkey", "c_name"], False, "c_name"))


@register("most_frequent_in_range", """
SELECT o_orderpriority AS category, count(*) AS n FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY o_orderpriority
ORDER BY n DESC, category LIMIT 1""")
def q_most_frequent(spark, d):
    from tabulon.plans.questions import most_frequent_in_range
    return most_frequent_in_range(table(spark, d, "orders"), "o_orderpriority", "o_orderdate",
                                  1996, 1998)


@register("delay_slope", f"""
WITH y AS (SELECT year(o_orderdate) AS year,
                  avg(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS m
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT count(*) AS years, {sr('regr_slope(m, year)', 6)} AS slope FROM y""")
def q_delay(spark, d):
    from tabulon.plans.questions import slope_of_yearly_mean
    # aggregate the fact table per join key first (its lines collapse map-side),
    # so the join moves one row per order instead of one per line
    li = (table(spark, d, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum(F.unix_date(F.col("l_shipdate").cast("date"))).alias("ship_days"),
               F.count(F.lit(1)).alias("n")))
    o = (table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
         .select("o_orderkey", F.col("o_orderdate").cast("date").alias("od")))
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.year("od").alias("year"), "n",
        (F.col("ship_days") - F.col("n") * F.unix_date("od")).alias("delay"))
    return round_doubles(slope_of_yearly_mean(j, "year", "delay", "n"), 6)


@register("top_parts_revenue", f"""
SELECT p_partkey AS key, p_name, {sr('total', 2)} AS total FROM (
  SELECT l_partkey, sum(l_extendedprice * (1 - l_discount)) AS total FROM lineitem
  GROUP BY l_partkey ORDER BY total DESC, l_partkey LIMIT 5) t
JOIN part ON p_partkey = t.l_partkey""")
def q_top_parts(spark, d):
    from tabulon.plans.questions import top_by_sum
    li = table(spark, d, "lineitem")
    top = top_by_sum(li, "l_partkey", F.col("l_extendedprice") * (1 - F.col("l_discount")), 5)
    part = table(spark, d, "part").select("p_partkey", "p_name")
    out = top.join(part, top.key == part.p_partkey).select("key", "p_name", "total")
    return round_doubles(out, 2)


@register("monthly_revenue", f"""
SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS month,
  {sr('sum(l_extendedprice * (1 - l_discount))', 2)} AS total FROM lineitem GROUP BY 1""")
def q_monthly(spark, d):
    from tabulon.plans.questions import monthly_totals
    li = table(spark, d, "lineitem")
    return round_doubles(monthly_totals(li, "l_shipdate",
                                        F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)


@register("top_customers", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def q_top_customers(spark, d):
    from tabulon.plans.questions import top_n
    return top_n(table(spark, d, "customer"), "c_acctbal", ["c_custkey", "c_name", "c_acctbal"],
                 10, "c_custkey")


@register("region_average", f"""
SELECT r_name, {sr('avg(c_acctbal)')} AS avg_acctbal, count(*) AS customers
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name""")
def q_region_avg(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    out = j.groupBy("r_name").agg(F.avg("c_acctbal").alias("avg_acctbal"),
                                  F.count(F.lit(1)).alias("customers"))
    return round_doubles(out)


# ================================================================== graph (Q13)
EDGES_SQL = """(SELECT DISTINCT least('s' || l_suppkey, 'p' || l_partkey) AS a,
  greatest('s' || l_suppkey, 'p' || l_partkey) AS b FROM lineitem)"""


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
                     F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))


@register("graph_degrees", f"""
SELECT node, count(*) AS degree FROM (
  SELECT a AS node FROM {EDGES_SQL} e1 UNION ALL SELECT b FROM {EDGES_SQL} e2) t GROUP BY node""")
def q_degrees(spark, d):
    from tabulon.operators.graph import degrees
    return degrees(supply_edges(spark, d))


@register("graph_summary", f"""
WITH e AS {EDGES_SQL},
deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) t
        GROUP BY node),
top AS (SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 1)
SELECT (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM deg) AS n_nodes,
  {sr('2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1))', 8)} AS density,
  {sr('2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM deg)', 6)} AS average_degree,
  top.node AS max_degree_node, top.degree AS max_degree FROM top""")
def q_graph_summary(spark, d):
    from tabulon.operators.graph import graph_summary
    out = graph_summary(supply_edges(spark, d))
    return round_doubles(round_doubles(out, 8, ["density"]), 6, ["average_degree"])


@register("degree_histogram", f"""
SELECT degree, count(*) AS nodes FROM (
  SELECT node, count(*) AS degree FROM (
    SELECT a AS node FROM {EDGES_SQL} e1 UNION ALL SELECT b FROM {EDGES_SQL} e2) t
  GROUP BY node) g GROUP BY degree""")
def q_degree_hist(spark, d):
    from tabulon.operators.graph import degree_histogram
    return degree_histogram(supply_edges(spark, d))


@register("graph_shortest_path", f"""
WITH e AS {EDGES_SQL},
n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
ends AS (SELECT 's' || min(l_suppkey) AS s, 'p' || max(l_partkey) AS g FROM lineitem),
l1 AS (SELECT DISTINCT n.b AS node FROM n, ends WHERE n.a = s),
l2 AS (SELECT n.b AS node, min(n.a) AS parent FROM n JOIN l1 ON n.a = l1.node, ends
       WHERE n.b <> s AND n.b NOT IN (SELECT node FROM l1) GROUP BY n.b),
far AS (SELECT min(n.a) AS last FROM n JOIN l2 ON n.a = l2.node, ends WHERE n.b = g),
near AS (SELECT count(*) AS direct FROM l1, ends WHERE node = g)
SELECT CAST(step AS INTEGER) AS step, node FROM (
  SELECT 0 AS step, s AS node FROM ends
  UNION ALL SELECT 1, g FROM ends, near WHERE direct = 1
  UNION ALL SELECT 1, parent FROM l2, far, near WHERE direct = 0 AND l2.node = far.last
  UNION ALL SELECT 2, last FROM far, near WHERE direct = 0
  UNION ALL SELECT 3, g FROM ends, near WHERE direct = 0) p""")
def q_path(spark, d):
    from tabulon.operators.graph import shortest_path
    li = table(spark, d, "lineitem")
    ends = li.agg(F.min("l_suppkey").alias("s"), F.max("l_partkey").alias("p")).first()
    return shortest_path(supply_edges(spark, d), f"s{ends['s']}", f"p{ends['p']}")


# ================================================================== more charts / questions
@register("heatmap", union_all([
    f"""SELECT '{a}' AS var1, '{b}' AS var2, {sr(f'corr({a}, {b})', 2)} AS r FROM {PRICED_SQL} p"""
    for a in PRICED for b in PRICED]))
def q_heatmap(spark, d):
    from tabulon.plans.runner import chart_data
    return chart_data(priced_lineitem(spark, d), ["correlation_heatmap"])["correlation_heatmap"]


@register("pair_correlation", f"""
SELECT 'l_quantity' AS var1, 'charge' AS var2, {sr('corr(l_quantity, charge)', 6)} AS r
FROM {PRICED_SQL} p""")
def q_pair(spark, d):
    m = stats.correlation_matrix(priced_lineitem(spark, d), ["l_quantity", "charge"])
    return round_doubles(m.where((F.col("var1") == "l_quantity") & (F.col("var2") == "charge")), 6)


@register("delay_slope_text_dates", f"""
WITH y AS (SELECT year(l_shipdate) AS year,
                  avg(datediff('day', strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y'),
                               CAST(l_shipdate AS DATE))) AS m
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT count(*) AS years, {sr('regr_slope(m, year)', 6)} AS slope FROM y""")
def q_delay_text(spark, d):
    from tabulon.plans.questions import slope_of_yearly_mean
    li = (table(spark, d, "lineitem")
          .select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"))
          .groupBy("l_orderkey", F.year("ship").alias("year"))
          .agg(F.sum(F.unix_date("ship")).alias("ship_days"), F.count(F.lit(1)).alias("n")))
    # registration dates arrive as dd-MM-yyyy text and are parsed
    o = (table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
         .select("o_orderkey", F.try_to_date(F.date_format("o_orderdate", "dd-MM-yyyy"),
                                             "dd-MM-yyyy").alias("registered")))
    j = li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("registered").isNotNull()).select(
        "year", "n", (F.col("ship_days") - F.col("n") * F.unix_date("registered")).alias("delay"))
    return round_doubles(slope_of_yearly_mean(j, "year", "delay", "n"), 6)


# ================================================================== S9 multi-source status
ALL_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events",
              "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@register("load_sources_status", union_all([
    f"""SELECT '{t}.parquet' AS name, CAST({i} AS INTEGER) AS "index", true AS success,
  (SELECT count(*) FROM {t}) AS n_rows,
  CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS n_cols"""
    for i, t in enumerate(ALL_TABLES)]))
def q_load_sources(spark, d):
    from tabulon.sources.files import load_sources
    _frames, status = load_sources(spark, [f"{d}/{t}.parquet" for t in ALL_TABLES])
    return status.select(F.regexp_extract("source", r"([^/]+)$", 1).alias("name"),
                         "index", "success", "n_rows", "n_cols")


# ================================================================== M3 with the hash split
_SPLIT_SQL = ("CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || "
              "CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 5")


@register("ols_split", f"""
WITH t AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem
           WHERE {_SPLIT_SQL} >= 1),
m AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
             covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y,
             avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM t),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM m)
SELECT 'l_quantity' AS feature, {sr('b1')} AS coefficient FROM b
UNION ALL SELECT 'l_discount', {sr('b2')} FROM b
UNION ALL SELECT '(intercept)', {sr('my - b1 * m1 - b2 * m2')} FROM b""")
def q_ols_split(spark, d):
    # least squares on the 80 % training rows of an md5 split of the row key
    from tabulon.operators.models import linear_regression
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                            "l_discount", "l_extendedprice")
    coefs, _m = linear_regression(li, ["l_orderkey", "l_linenumber"], "l_extendedprice",
                                  ["l_quantity", "l_discount"])
    return round_doubles(coefs)


@register("ols_split_metrics", f"""
WITH t AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem
           WHERE {_SPLIT_SQL} >= 1),
h AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem
      WHERE {_SPLIT_SQL} < 1),
m AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
             covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y,
             avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS n FROM t),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my, n FROM m),
e AS (SELECT h.y, (b.my - b.b1 * b.m1 - b.b2 * b.m2) + b.b1 * h.x1 + b.b2 * h.x2 - h.y AS err
      FROM h, b)
SELECT 'l_extendedprice' AS target, (SELECT n FROM b) AS n_train, count(*) AS n_test,
  {sr('1 - sum(err * err) / (count(*) * var_pop(y))', 6)} AS r2,
  {sr('avg(err * err)', 2)} AS mse FROM e""")
def q_ols_split_metrics(spark, d):
    from tabulon.operators.models import linear_regression
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                            "l_discount", "l_extendedprice")
    _c, m = linear_regression(li, ["l_orderkey", "l_linenumber"], "l_extendedprice",
                              ["l_quantity", "l_discount"])
    return round_doubles(round_doubles(m, 6, ["r2"]), 2, ["mse"])


# ================================================================== S11 on pages derived from a table
def customer_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every customer row rendered as a one-table HTML page (header row of
    <th>, data row with inline markup and an entity), so the parser runs on
    pages whose content is known from the table itself."""
    c = table(spark, d, "customer")
    html = F.concat(
        F.lit("<html><body><p>card<table><thead><tr><th>Name</th><th>Segment</th>"
              "<th>Balance</th></tr></thead><tbody><tr><td><b>"),
        F.col("c_name"), F.lit("</b></td><td>"), F.col("c_mktsegment"),
        F.lit(" &amp; co</td><td>"), F.col("c_acctbal").cast("string"),
        F.lit("</td></tr></tbody></table></body></html>"))
    return c.select(F.col("c_custkey").alias("page_id"), html.alias("html"))


@register("html_tables_derived", """
SELECT c_custkey AS page_id, CAST(0 AS INTEGER) AS row_idx, true AS is_header,
  'Name' AS cell0, 'Segment' AS cell1, 'Balance' AS cell2 FROM customer
UNION ALL
SELECT c_custkey, CAST(1 AS INTEGER), false, c_name, c_mktsegment || ' & co',
  CAST(c_acctbal AS VARCHAR) FROM customer""")
def q_html_derived(spark, d):
    from tabulon.sources.html_tables import html_tables
    t = html_tables(customer_pages(spark, d))
    return t.select("page_id", "row_idx", "is_header",
                    *[F.get(F.col("cells"), i).alias(f"cell{i}") for i in range(3)])
