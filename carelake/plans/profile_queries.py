"""Queries on statistics and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.operators import profile
from carelake.plans import clinical as cfg
from carelake.plans.fixtures import patients, patients_raw, with_views
from carelake.plans.registry import query
from carelake.sources.tables import table

RAW_COLUMNS = ["patient_id", *cfg.FEATURES, cfg.TARGET]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("null_counts", with_views("patients_raw", _union(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM patients_raw" for c in RAW_COLUMNS)))
def null_counts(spark, sf_dir):
    return profile.null_counts(patients_raw(spark, sf_dir), RAW_COLUMNS)


_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {t}"""
_DESCRIBE_ROUNDED = ("mean", "std", "q25", "q50", "q75")


@query("describe_numeric", with_views("patients", _union(_DESCRIBE.format(c=c, t="patients") for c in cfg.FEATURES)))
def describe_numeric(spark, sf_dir):
    return _rounded(profile.describe_numeric(patients(spark, sf_dir), cfg.FEATURES), *_DESCRIBE_ROUNDED)


@query("describe_wide_range", _union(_DESCRIBE.format(c=c, t="lineitem") for c in NUMERIC))
def describe_wide_range(spark, sf_dir):
    return _rounded(profile.describe_numeric(table(spark, sf_dir, "lineitem"), NUMERIC), *_DESCRIBE_ROUNDED)


_CATEGORIES = ["l_returnflag", "l_linestatus"]


@query("describe_categorical", _union(
    f"""(SELECT '{c}' AS "column", (SELECT count({c}) FROM lineitem) AS count, (SELECT count(DISTINCT {c}) FROM lineitem) AS "unique",
    {c} AS top, count(*) AS freq FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in _CATEGORIES))
def describe_categorical(spark, sf_dir):
    return profile.describe_categorical(table(spark, sf_dir, "lineitem"), _CATEGORIES)


_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("table_info", _union(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM orders" for i, (c, t) in enumerate(_ORDER_TYPES)))
def table_info(spark, sf_dir):
    return profile.table_info(table(spark, sf_dir, "orders"))


@query("table_head", with_views("patients_raw", "SELECT * FROM patients_raw ORDER BY patient_id LIMIT 5"))
def table_head(spark, sf_dir):
    return profile.head(patients_raw(spark, sf_dir), "patient_id", 5)


_DISTINCT = ["dob", "nivo_rizika", "dijabetes"]


@query("distinct_values", with_views("patients_raw", _union(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM patients_raw" for c in _DISTINCT)))
def distinct_values(spark, sf_dir):
    return profile.distinct_values(patients_raw(spark, sf_dir), _DISTINCT)


@query("distinct_counts", _union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")))
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("value_counts", with_views("patients_raw", """SELECT nivo_rizika AS value, count(*) AS n,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM patients_raw), 6) AS percent FROM patients_raw GROUP BY nivo_rizika"""))
def value_counts(spark, sf_dir):
    return _rounded(profile.value_counts(patients_raw(spark, sf_dir), cfg.TARGET, dropna=False), "percent")


@query("value_counts_known", with_views("patients_raw", """SELECT dijabetes AS value, count(*) AS n,
  round(count(*) * 100.0::DOUBLE / (SELECT count(dijabetes) FROM patients_raw), 6) AS percent FROM patients_raw WHERE dijabetes IS NOT NULL GROUP BY dijabetes"""))
def value_counts_known(spark, sf_dir):
    return _rounded(profile.value_counts(patients_raw(spark, sf_dir), "dijabetes"), "percent")


@query("skewness", with_views("patients_raw", _union(
    f"""SELECT '{c}' AS "column", round(avg(power({c} - (SELECT avg({c}) FROM patients_raw), 3)) / power(var_pop({c}), 1.5), 6) AS skewness FROM patients_raw"""
    for c in cfg.SKEW_COLUMNS)))
def skewness(spark, sf_dir):
    return _rounded(profile.skewness(patients_raw(spark, sf_dir), cfg.SKEW_COLUMNS), "skewness")


@query("kurtosis", with_views("patients", _union(
    f"SELECT '{c}' AS \"column\", round(kurtosis_pop({c}), 6) AS kurtosis FROM patients" for c in cfg.SKEW_COLUMNS)))
def kurtosis(spark, sf_dir):
    return _rounded(profile.kurtosis(patients(spark, sf_dir), cfg.SKEW_COLUMNS), "kurtosis")


# ---- contingency --------------------------------------------------------------------------


@query("crosstab", with_views("kept", """SELECT gestacijski_dijabetes, count(*) FILTER (nivo_rizika = 'High') AS "High",
  count(*) FILTER (nivo_rizika = 'Low') AS "Low" FROM kept GROUP BY gestacijski_dijabetes"""))
def crosstab(spark, sf_dir):
    return profile.crosstab(patients(spark, sf_dir), "gestacijski_dijabetes", cfg.TARGET, ["High", "Low"])


@query("crosstab_margins", """SELECT CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS "row",
  CASE WHEN GROUPING(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS col, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def crosstab_margins(spark, sf_dir):
    return profile.crosstab_margins(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("crosstab_percent", with_views("patients_raw", ", c AS (" + _union(
    f"SELECT '{c}' AS variable, nivo_rizika AS \"row\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM patients_raw "
    f"WHERE nivo_rizika IS NOT NULL AND {c} IS NOT NULL GROUP BY nivo_rizika, {c}" for c in cfg.FLAGS)
    + ') SELECT variable, "row", value, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY variable, "row"), 6) AS percent FROM c'))
def crosstab_percent(spark, sf_dir):
    return _rounded(profile.crosstab_percent(patients_raw(spark, sf_dir), cfg.TARGET, cfg.FLAGS), "percent")


_NORMAL_AREA = """(SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 2000, 2) / 2)) * z / 2000 / 3
  / sqrt(2 * pi()) FROM range(2001) g(i))"""


@query("chi2_yates", with_views("patients", """, o AS (SELECT gestacijski_dijabetes AS a, nivo_rizika AS b, count(*) AS o FROM patients GROUP BY ALL),
e AS (SELECT o.*, (sum(o) OVER (PARTITION BY a)) * (sum(o) OVER (PARTITION BY b)) / (sum(o) OVER ())::DOUBLE AS e FROM o),
s AS (SELECT sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e),
z AS (SELECT chi2, dof, least(sqrt(chi2), 40) AS z FROM s)
SELECT round(chi2, 6) AS chi2, dof, round(abs(1 - 2 * """ + _NORMAL_AREA + "), 6) AS p FROM z"))
def chi2_yates(spark, sf_dir):
    return _rounded(profile.chi_square(patients(spark, sf_dir), "gestacijski_dijabetes", cfg.TARGET), "chi2", "p")


@query("chi2_independence", """WITH o AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY ALL),
e AS (SELECT o.*, (sum(o) OVER (PARTITION BY a)) * (sum(o) OVER (PARTITION BY b)) / (sum(o) OVER ())::DOUBLE AS e FROM o)
SELECT round(sum(power(o - e, 2) / e), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e""")
def chi2_independence(spark, sf_dir):
    return _rounded(profile.chi_square(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), "chi2").drop("p")


@query("expected_counts", with_views("patients", """, o AS (SELECT CAST(gestacijski_dijabetes AS VARCHAR) AS "row", nivo_rizika AS col, count(*) AS observed FROM patients GROUP BY ALL)
SELECT "row", col, observed, round((sum(observed) OVER (PARTITION BY "row")) * (sum(observed) OVER (PARTITION BY col)) / (sum(observed) OVER ())::DOUBLE, 6) AS expected FROM o"""))
def expected_counts(spark, sf_dir):
    return _rounded(
        profile.expected_counts(patients(spark, sf_dir), "gestacijski_dijabetes", cfg.TARGET, ["High", "Low"]), "expected"
    )


@query("separation_check", with_views("patients", """SELECT gestacijski_dijabetes AS flag, count(*) FILTER (nivo_rizika = 'High') AS n_positive,
  count(*) FILTER (nivo_rizika <> 'High') AS n_negative, min(nivo_rizika) = max(nivo_rizika) AS separated FROM patients GROUP BY gestacijski_dijabetes"""))
def separation_check(spark, sf_dir):
    return profile.separation_check(patients(spark, sf_dir), "gestacijski_dijabetes", cfg.TARGET, "High")


@query("flag_overlap", with_views("patients", """SELECT count(*) FILTER (dijabetes = 1) AS n_first, count(*) FILTER (gestacijski_dijabetes = 1) AS n_second,
  count(*) FILTER (dijabetes = 1 AND gestacijski_dijabetes = 1) AS n_both FROM patients"""))
def flag_overlap(spark, sf_dir):
    return profile.flag_overlap(patients(spark, sf_dir), "dijabetes", "gestacijski_dijabetes")


# ---- distributions ------------------------------------------------------------------------


@query("histogram", with_views("patients", ", cells AS (" + _union(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM patients" for c in cfg.FEATURES) + """),
span AS (SELECT "column", min(v) AS lo, max(v) AS hi, count(v) AS total FROM cells GROUP BY "column"),
hits AS (SELECT "column", CAST(least(floor((v - lo) / (hi - lo) * 15), 14) + 1 AS INTEGER) AS bin, count(*) AS n FROM cells JOIN span USING ("column") GROUP BY ALL),
bins AS (SELECT "column", CAST(i AS INTEGER) AS bin, lo + (hi - lo) * (i - 1) / 15 AS b_lo, lo + (hi - lo) * i / 15 AS b_hi, total FROM span, range(1, 16) g(i))
SELECT "column", bin, round(b_lo, 6) AS lo, round(b_hi, 6) AS hi, COALESCE(n, 0) AS n, round(COALESCE(n, 0) / (total * (b_hi - b_lo)), 6) AS density
FROM bins LEFT JOIN hits USING ("column", bin)"""))
def histogram(spark, sf_dir):
    return _rounded(profile.histogram(patients(spark, sf_dir), cfg.FEATURES, 15), "lo", "hi", "density")


@query("kde_grid", with_views("patients", """, v AS (SELECT BMI AS x, count(*) AS n FROM patients GROUP BY BMI),
s AS (SELECT count(*) AS n, avg(BMI) AS mean, quantile_cont(BMI, 0.5) AS median, stddev_samp(BMI) * power(count(*), -0.2) AS h, min(BMI) AS lo, max(BMI) AS hi FROM patients),
g AS (SELECT i AS point, lo - 3 * h + (hi - lo + 6 * h) * i / 199.0::DOUBLE AS gx, n AS total, h, mean, median FROM s, range(200) r(i))
SELECT CAST(point AS INTEGER) AS point, round(gx, 6) AS x, round(sum(v.n * exp(-power((gx - v.x) / h, 2) / 2)) / (total * h * sqrt(2 * pi())), 6) AS density,
  round(mean, 6) AS mean, round(median, 6) AS median FROM g, v GROUP BY point, gx, total, h, mean, median"""))
def kde_grid(spark, sf_dir):
    return _rounded(profile.kde_grid(patients(spark, sf_dir), "BMI", 200), "x", "density", "mean", "median")


# ---- correlation --------------------------------------------------------------------------

CORR_COLUMNS = [*cfg.FEATURES, "target"]


def _with_target(df):
    return df.withColumn("target", (F.col(cfg.TARGET) == "High").cast("int"))


_CODED = ", coded AS (SELECT *, CASE WHEN nivo_rizika = 'High' THEN 1 ELSE 0 END AS target FROM patients)"
_PAIRS = [(a, b) for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i + 1:]]
_T_AREA = """(SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-(n - 1) / 2 * ln(1 + power(z * i / 2000, 2) / (n - 2)))) * z / 2000 / 3
    * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt((n - 2) * pi()) FROM range(2001) g(i))"""
_TESTED = """, z AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, least(abs(r * sqrt((n - 2) / (1 - r * r))), 40) AS z FROM pairs),
tested AS (SELECT *, abs(1 - 2 * """ + _T_AREA + ") AS p FROM z)"
_PAIR_ROWS = ", pairs AS (" + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, CAST(count(*) AS DOUBLE) AS n FROM coded" for a, b in _PAIRS) + ")"


@query("corr_matrix", with_views("patients", _CODED + " SELECT a, b, round(r, 6) AS r FROM (" + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, {'1.0::DOUBLE' if a == b else f'corr({a}, {b})'} AS r FROM coded"
    + (" HAVING count(*) > 0" if a == b else "") for a in CORR_COLUMNS for b in CORR_COLUMNS) + ") m"))
def corr_matrix(spark, sf_dir):
    return _rounded(profile.corr_matrix(_with_target(patients(spark, sf_dir)), CORR_COLUMNS), "r")


@query("corr_pvalues", with_views("patients", _CODED + _PAIR_ROWS + _TESTED + """
SELECT a, b, round(r, 6) AS r, CAST(n AS BIGINT) AS n, round(t, 5) AS t, round(p, 6) AS p FROM tested"""))
def corr_pvalues(spark, sf_dir):
    tested = profile.corr_pvalues(_with_target(patients(spark, sf_dir)), CORR_COLUMNS)
    return _rounded(_rounded(tested, "r", "p"), "t", digits=5)


_RAW_PAIRS = [(a, b) for i, a in enumerate(cfg.SKEW_COLUMNS) for b in cfg.SKEW_COLUMNS[i + 1:]]


@query("corr_pairwise", with_views("patients_raw", ", pairs AS (" + _union(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, CAST(count(*) AS DOUBLE) AS n FROM patients_raw WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a, b in _RAW_PAIRS) + ")" + _TESTED + """
SELECT a, b, round(r, 6) AS r, CAST(n AS BIGINT) AS n, round(t, 5) AS t, round(p, 6) AS p FROM tested"""))
def corr_pairwise(spark, sf_dir):
    tested = profile.corr_pvalues(patients_raw(spark, sf_dir), cfg.SKEW_COLUMNS, complete_rows=False)
    return _rounded(_rounded(tested, "r", "p"), "t", digits=5)


@query("corr_significant", with_views("patients", _CODED + _PAIR_ROWS + _TESTED + """
SELECT a, b, round(r, 6) AS r, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' ELSE '*' END AS stars FROM tested WHERE p < 0.05"""))
def corr_significant(spark, sf_dir):
    return _rounded(profile.corr_significant(_with_target(patients(spark, sf_dir)), CORR_COLUMNS), "r", "p")


@query("corr_with_target", with_views("patients", _CODED + _PAIR_ROWS + _TESTED + """
SELECT a AS variable, round(r, 6) AS r, round(p, 6) AS p, p < 0.05 AS significant FROM tested WHERE b = 'target'"""))
def corr_with_target(spark, sf_dir):
    df = _with_target(patients(spark, sf_dir))
    return _rounded(profile.corr_significant(df, CORR_COLUMNS, target="target"), "r", "p")


def _group_corr_sql(x, y):
    return with_views("patients", f""", z0 AS (SELECT nivo_rizika, corr({x}, {y}) AS r, CAST(count(*) AS DOUBLE) AS n FROM patients GROUP BY nivo_rizika),
pairs AS (SELECT * FROM z0)""" + _TESTED + " SELECT nivo_rizika, round(r, 6) AS r, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM tested")


@query("corr_by_group", _group_corr_sql("glukoza_u_krvi", "dijabetes"))
def corr_by_group(spark, sf_dir):
    return _rounded(profile.corr_by_group(patients(spark, sf_dir), cfg.TARGET, "glukoza_u_krvi", "dijabetes"), "r", "p")


@query("point_biserial", _group_corr_sql("gestacijski_dijabetes", "glukoza_u_krvi"))
def point_biserial(spark, sf_dir):
    return _rounded(profile.corr_by_group(patients(spark, sf_dir), cfg.TARGET, "gestacijski_dijabetes", "glukoza_u_krvi"), "r", "p")


@query("spearman_by_group", with_views("patients", """, rk AS (SELECT nivo_rizika,
  rank() OVER (PARTITION BY nivo_rizika ORDER BY gestacijski_dijabetes) + (count(*) OVER (PARTITION BY nivo_rizika, gestacijski_dijabetes) - 1) / 2 AS a,
  rank() OVER (PARTITION BY nivo_rizika ORDER BY glukoza_u_krvi) + (count(*) OVER (PARTITION BY nivo_rizika, glukoza_u_krvi) - 1) / 2 AS b FROM patients),
pairs AS (SELECT nivo_rizika, corr(a, b) AS r, CAST(count(*) AS DOUBLE) AS n FROM rk GROUP BY nivo_rizika)""" + _TESTED + """
SELECT nivo_rizika, round(r, 6) AS rho, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM tested"""))
def spearman_by_group(spark, sf_dir):
    df = patients(spark, sf_dir)
    return _rounded(profile.spearman_by_group(df, cfg.TARGET, "gestacijski_dijabetes", "glukoza_u_krvi"), "rho", "p")


@query("group_compare", with_views("patients", "SELECT nivo_rizika, " + ", ".join(
    f"count(*) FILTER (dijabetes = {v}) AS n_{n}, round(avg(glukoza_u_krvi) FILTER (dijabetes = {v}), 6) AS mean_{n}, "
    f"round(stddev_samp(glukoza_u_krvi) FILTER (dijabetes = {v}), 6) AS std_{n}" for n, v in (("yes", 1), ("no", 0)))
    + ", round(avg(glukoza_u_krvi) FILTER (dijabetes = 1) - avg(glukoza_u_krvi) FILTER (dijabetes = 0), 6) AS difference FROM patients GROUP BY nivo_rizika"))
def group_compare(spark, sf_dir):
    found = profile.group_compare(patients(spark, sf_dir), cfg.TARGET, "dijabetes", "glukoza_u_krvi")
    return _rounded(found, "mean_yes", "std_yes", "mean_no", "std_no", "difference")
