"""Queries on record tables: projections, validation, imputation and risk interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import columns as fx
from carelake.operators import clean, risk
from carelake.plans import clinical as cfg
from carelake.plans.fixtures import patients, patients_raw, with_views
from carelake.plans.registry import query
from carelake.sources.tables import table


@query(
    "factor_frequency",
    with_views("weighted", """, f AS (
  SELECT CASE w_glucose WHEN 4 THEN 'glukoza_kriticna' WHEN 3 THEN 'glukoza_visoka' END AS factor, w_glucose AS weight FROM weighted
  UNION ALL SELECT CASE WHEN dijabetes = 1 THEN 'dijabetes_tip1_2' END, 3 FROM weighted
  UNION ALL SELECT CASE WHEN gestacijski_dijabetes = 1 THEN 'gestacijski_dijabetes' END, 3 FROM weighted
  UNION ALL SELECT CASE w_pressure WHEN 5 THEN 'hipertenzija_3' WHEN 4 THEN 'hipertenzija_2' WHEN 3 THEN 'hipertenzija_1'
                   WHEN 1 THEN 'normalno_visok_tlak' END, w_pressure FROM weighted
  UNION ALL SELECT CASE w_bmi WHEN 3 THEN 'gojaznost_teska' WHEN 2 THEN 'gojaznost' WHEN 1 THEN 'prekomjerna_tezina' END, w_bmi FROM weighted
  UNION ALL SELECT CASE w_temp WHEN 3 THEN 'febrilno_stanje' WHEN 1 THEN 'subfebrilan' END, w_temp FROM weighted
  UNION ALL SELECT CASE w_heart WHEN 2 THEN 'tahikardija' WHEN 1 THEN 'bradikardija' END, w_heart FROM weighted
  UNION ALL SELECT CASE WHEN mentalno_zdravlje = 1 THEN 'mentalno_zdravlje' END, 2 FROM weighted
  UNION ALL SELECT CASE WHEN komplikacije_u_proslosti = 1 THEN 'komplikacije_proslost' END, 2 FROM weighted)
SELECT factor, count(*) AS n_patients, CAST(sum(weight) AS BIGINT) AS weight_sum FROM f WHERE factor IS NOT NULL GROUP BY factor"""),
)
def factor_frequency(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return (
        df.select(F.inline(risk.factors_column(risk.factor_slots())))
        .groupBy("factor")
        .agg(F.count(F.lit(1)).alias("n_patients"), F.sum("weight").alias("weight_sum"))
    )


R6 = 6


def _r(c, alias=None):
    name = alias or c
    return F.round(F.col(c) if isinstance(c, str) else c, R6).alias(name)


# ---- projections --------------------------------------------------------------------------


@query(
    "temp_f_to_c",
    with_views("celsius", "SELECT patient_id, tjelesna_temp AS temp_c FROM celsius"),
)
def temp_f_to_c(spark, sf_dir):
    df = patients_raw(spark, sf_dir)
    return df.select("patient_id", fx.fahrenheit_to_celsius(F.col("tjelesna_temp")).alias("temp_c"))


@query(
    "temp_autodetect",
    with_views("celsius", """, mixed AS (SELECT r.patient_id, CASE WHEN r.patient_id % 3 = 0 THEN c.tjelesna_temp ELSE r.tjelesna_temp END AS t
  FROM patients_raw r JOIN celsius c USING (patient_id))
SELECT patient_id, CASE WHEN t > 50 THEN round_even((t - 32) * 5 / 9 * 100, 0) / 100 ELSE t END AS temp_c FROM mixed"""),
)
def temp_autodetect(spark, sf_dir):
    t = F.col("tjelesna_temp")
    mixed = patients_raw(spark, sf_dir).select(
        "patient_id", F.when(F.col("patient_id") % 3 == 0, fx.fahrenheit_to_celsius(t)).otherwise(t).alias("t")
    )
    return mixed.select("patient_id", fx.celsius(F.col("t"), cfg.FAHRENHEIT_ABOVE).alias("temp_c"))


@query(
    "drop_null_target",
    with_views("patients_raw", "SELECT patient_id, nivo_rizika FROM patients_raw WHERE nivo_rizika IS NOT NULL"),
)
def drop_null_target(spark, sf_dir):
    return clean.drop_null_target(patients_raw(spark, sf_dir), cfg.TARGET).select("patient_id", cfg.TARGET)


@query(
    "clean_report",
    with_views("patients_raw", """, a AS (SELECT * FROM patients_raw WHERE nivo_rizika IS NOT NULL),
b AS (SELECT * FROM a WHERE dob IS NULL OR dob <> 325), c AS (SELECT * FROM b WHERE dob BETWEEN 15 AND 50)
SELECT (SELECT count(*) FROM patients_raw) AS rows_in,
  (SELECT count(*) FROM patients_raw) - (SELECT count(*) FROM a) AS removed_null_target,
  (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS removed_sentinel,
  (SELECT count(*) FROM b) - (SELECT count(*) FROM c) AS removed_age_range, (SELECT count(*) FROM c) AS rows_out"""),
)
def clean_report(spark, sf_dir):
    return clean.clean_report(
        patients_raw(spark, sf_dir), cfg.TARGET, "dob", cfg.AGE_SENTINEL, cfg.AGE_MIN, cfg.AGE_MAX
    )


@query(
    "missing_fields",
    with_views("patients_raw", "SELECT * FROM (SELECT patient_id, concat_ws(',', "
               + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in cfg.FEATURES)
               + ") AS missing FROM patients_raw) m WHERE missing <> ''"),
)
def missing_fields(spark, sf_dir):
    df = patients_raw(spark, sf_dir).select("patient_id", clean.missing_fields(cfg.FEATURES).alias("m"))
    return df.where(F.size("m") > 0).select("patient_id", F.array_join("m", ",").alias("missing"))


_FORM = """SELECT patient_id, dob, CASE WHEN patient_id % 83 = 0 THEN NULL ELSE 95 + (patient_id * 7) % 130 END AS height,
  25 + (patient_id * 11) % 185 AS weight, sistolicki_krvni_tlak AS systolic, dijastolicki_krvni_tlak AS diastolic,
  glukoza_u_krvi AS glucose, (tjelesna_temp - 32) * 5 / 9 AS temperature, otkucaji_srca AS heart_rate,
  komplikacije_u_proslosti AS complications, dijabetes AS diabetes, gestacijski_dijabetes AS gdm,
  CASE WHEN patient_id % 41 = 0 THEN 2 ELSE mentalno_zdravlje END AS mental FROM {raw}"""


@query(
    "validate_ranges",
    with_views("patients_raw", ", form AS (" + _FORM.format(raw="patients_raw") + "), v AS ("
               + " UNION ALL ".join(
                   [f"SELECT patient_id, '{f}' AS field, CASE WHEN {f} IS NULL THEN 'empty' WHEN {f} < {lo} THEN 'min' "
                    f"WHEN {f} > {hi} THEN 'max' END AS reason FROM form" for f, (lo, hi) in cfg.FORM_LIMITS.items()]
                   + [f"SELECT patient_id, '{f}', CASE WHEN {f} IS NULL OR {f} NOT IN (0, 1) THEN 'option' END FROM form"
                      for f in ("complications", "diabetes", "gdm", "mental")])
               + ") SELECT patient_id, field, reason FROM v WHERE reason IS NOT NULL"),
)
def validate_ranges(spark, sf_dir):
    form = spark.sql(_FORM, raw=patients_raw(spark, sf_dir))
    checks = clean.violations(
        {f: (F.col(f), lo, hi) for f, (lo, hi) in cfg.FORM_LIMITS.items()},
        {f: F.col(f) for f in ("complications", "diabetes", "gdm", "mental")},
    )
    _, quarantine = clean.split_valid(form, checks)
    return quarantine.select("patient_id", F.inline("violations"))


_NUMBER_TEXT = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
  WHEN 1 THEN concat(CAST(l_partkey AS {s}), ',', CAST(l_suppkey AS {s}), ' kg')
  WHEN 2 THEN concat('  ', CAST(l_partkey AS {s}), '.', CAST(l_suppkey AS {s}))
  WHEN 3 THEN concat('-,', CAST(l_suppkey AS {s}))
  WHEN 4 THEN concat(CAST(l_linenumber AS {s}), 'e2', ',5')
  WHEN 5 THEN concat('x', CAST(l_partkey AS {s}))
  WHEN 6 THEN concat(CAST(l_partkey AS {s}), ',5,7')
  ELSE '' END AS raw FROM {lineitem}"""


@query(
    "parse_locale_number",
    "WITH t AS (" + _NUMBER_TEXT.format(s="VARCHAR", lineitem="lineitem") + r""")
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, COALESCE(TRY_CAST(regexp_extract(regexp_replace(trim(raw), '^([^,]*),', '\1.'),
  '^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?') AS DOUBLE), 0) AS parsed FROM t""",
)
def parse_locale_number(spark, sf_dir):
    text = spark.sql(_NUMBER_TEXT.replace("{s}", "STRING"), lineitem=table(spark, sf_dir, "lineitem"))
    return text.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fx.parse_locale_number(F.col("raw")).alias("parsed")
    )


_BODY = """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 140 + p_size END AS height,
  CASE WHEN p_partkey % 70 = 0 THEN NULL ELSE p_retailprice / CAST(15 AS DOUBLE) END AS weight FROM {part}"""


@query(
    "bmi",
    "WITH b AS (" + _BODY.format(part="part") + """), x AS (
  SELECT p_partkey, CASE WHEN height > 0 AND weight > 0
    THEN weight / ((CAST(height AS DOUBLE) / 100) * (CAST(height AS DOUBLE) / 100)) ELSE 0 END AS v FROM b)
SELECT p_partkey, CASE WHEN v * 4 = floor(v * 4) AND v * 2 <> floor(v * 2) THEN (floor(v * 10) + 1) / 10
  ELSE CAST(printf('%.1f', v) AS DOUBLE) END AS bmi FROM x""",
)
def bmi(spark, sf_dir):
    body = spark.sql(_BODY, part=table(spark, sf_dir, "part"))
    return body.select("p_partkey", fx.body_mass_index(F.col("weight"), F.col("height")).alias("bmi"))


def _case_bands(column: str, bands, otherwise: str) -> str:
    whens = " ".join(
        f"WHEN {column} >= {lo}" + ("" if hi == cfg.INF else f" AND {column} < {hi}") + f" THEN '{name}'"
        for name, lo, hi in bands
    )
    return f"CASE {whens} ELSE '{otherwise}' END"


@query(
    "classify_vitals",
    with_views("patients", "SELECT patient_id, "
               + ", ".join(f"{_case_bands(cfg.BAND_COLUMNS[p], b, cfg.UNKNOWN_CLASS)} AS class_{p}" for p, b in cfg.BANDS.items())
               + " FROM patients"),
)
def classify_vitals(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return df.select("patient_id", *[f"class_{p}" for p in cfg.BANDS])


@query(
    "classify_range_join",
    with_views("patients", ", l AS ("
               + " UNION ALL ".join(f"SELECT '{p}' AS param, {_case_bands(cfg.BAND_COLUMNS[p], b, cfg.UNKNOWN_CLASS)} AS label FROM patients"
                                    for p, b in cfg.BANDS.items())
               + ") SELECT param, label, count(*) AS n FROM l GROUP BY param, label"),
)
def classify_range_join(spark, sf_dir):
    cells = [F.struct(F.lit(p).alias("param"), F.col(cfg.BAND_COLUMNS[p]).alias("value")) for p in cfg.BANDS]
    long = patients(spark, sf_dir).select("patient_id", F.inline(F.array(*cells)))
    labelled = risk.classify_by_table(long, risk.band_table(spark))
    return labelled.groupBy("param", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "zone_display",
    with_views("patients", " UNION ALL ".join(
        f"SELECT patient_id, '{c}' AS param, {_case_bands(c, b, b[-1][0])} AS zone FROM patients" for c, (_, _, b) in cfg.ZONES.items())),
)
def zone_display(spark, sf_dir):
    return patients(spark, sf_dir).select("patient_id", F.inline(risk.zones_column())).select("patient_id", "param", "zone")


@query("percent_text", "SELECT o_orderkey, printf('%.1f%%', (o_orderkey % 1601) / 16.0::DOUBLE) AS percent FROM orders")
def percent_text(spark, sf_dir):
    """Shares as the scoring writes them; every eighth one is a tie."""
    share = (F.col("o_orderkey") % 1601) / F.lit(16.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(fx.format_fixed(share, 1), F.lit("%")).alias("percent"))


@query(
    "gauge_percent",
    with_views("patients", " UNION ALL ".join(
        f"SELECT patient_id, '{c}' AS param, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, ({c} - {lo}) / {hi - lo}::DOUBLE * 100)), 6) AS percent FROM patients"
        for c, (lo, hi, _) in cfg.ZONES.items())),
)
def gauge_percent(spark, sf_dir):
    cells = patients(spark, sf_dir).select("patient_id", F.inline(risk.zones_column()))
    return cells.select("patient_id", "param", _r("percent"))


@query(
    "bp_worst_class",
    with_views("patients", """, r AS (SELECT patient_id, greatest(
  CASE WHEN sistolicki_krvni_tlak >= 180 THEN 5 WHEN sistolicki_krvni_tlak >= 160 THEN 4 WHEN sistolicki_krvni_tlak >= 140 THEN 3
       WHEN sistolicki_krvni_tlak >= 130 THEN 2 WHEN sistolicki_krvni_tlak >= 120 THEN 1 ELSE 0 END,
  CASE WHEN dijastolicki_krvni_tlak >= 110 THEN 5 WHEN dijastolicki_krvni_tlak >= 100 THEN 4 WHEN dijastolicki_krvni_tlak >= 90 THEN 3
       WHEN dijastolicki_krvni_tlak >= 85 THEN 2 WHEN dijastolicki_krvni_tlak >= 80 THEN 1 ELSE 0 END) AS worst FROM patients)
SELECT patient_id, worst, CASE worst WHEN 0 THEN 'optimalan' WHEN 1 THEN 'normalan' WHEN 2 THEN 'normalno visok'
  WHEN 3 THEN 'blaga hipertenzija' WHEN 4 THEN 'umjerena hipertenzija' ELSE 'teška hipertenzija' END AS worst_text FROM r"""),
)
def bp_worst_class(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    worst, text = risk.worse_class(F.col("class_sistolicki"), F.col("class_dijastolicki"))
    return df.select("patient_id", worst.alias("worst"), text.alias("worst_text"))


@query(
    "encode_target",
    with_views("kept", "SELECT patient_id, dob, CASE nivo_rizika WHEN 'Low' THEN 0 WHEN 'High' THEN 1 END AS nivo_rizika FROM kept"),
)
def encode_target(spark, sf_dir):
    df = clean.drop_null_target(patients_raw(spark, sf_dir), cfg.TARGET)
    df = clean.keep_age_range(df, "dob", cfg.AGE_SENTINEL, cfg.AGE_MIN, cfg.AGE_MAX)
    coded = df.withColumn(cfg.TARGET, clean.encode_target(F.col(cfg.TARGET), cfg.TARGET_CODES))
    return clean.target_last(coded.select(cfg.TARGET, "patient_id", "dob"), [cfg.TARGET])


_ORDINALS = """SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' WHEN 2 THEN '3rd'
  ELSE '4th' END AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS answer FROM {orders}"""
_PRIORITY_CODES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}


@query(
    "value_map",
    "WITH o AS (" + _ORDINALS.format(orders="orders") + """)
SELECT o_orderkey, CASE ordinal WHEN '1st' THEN 1 WHEN '2nd' THEN 2 WHEN '3rd' THEN 3 END AS ordinal_code,
  CASE answer WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS answer_code,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 END AS priority_code
FROM o""",
)
def value_map(spark, sf_dir):
    df = spark.sql(_ORDINALS, orders=table(spark, sf_dir, "orders"))
    return df.select(
        "o_orderkey",
        fx.code_map(F.col("ordinal"), cfg.ORDINAL_CODES).alias("ordinal_code"),
        fx.code_map(F.col("answer"), cfg.YES_NO_CODES).alias("answer_code"),
        fx.code_map(F.col("o_orderpriority"), _PRIORITY_CODES).alias("priority_code"),
    )


@query(
    "extract_int",
    r"SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '(\d+)', 1) AS BIGINT) AS number FROM customer",
)
def extract_int(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", fx.first_integer(F.col("c_name")).alias("number"))


_PAIRS = """SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN CAST(p_size AS {s})
  ELSE concat(CAST(90 + p_size AS {s}), '/', CAST(60 + p_partkey % 40 AS {s})) END AS pair FROM {part}"""


@query(
    "split_pair",
    "WITH p AS (" + _PAIRS.format(s="VARCHAR", part="part") + """)
SELECT p_partkey, TRY_CAST(split_part(pair, '/', 1) AS INTEGER) AS first, TRY_CAST(split_part(pair, '/', 2) AS INTEGER) AS second FROM p""",
)
def split_pair(spark, sf_dir):
    df = spark.sql(_PAIRS.replace("{s}", "STRING"), part=table(spark, sf_dir, "part"))
    first, second = fx.split_pair(F.col("pair"))
    return df.select("p_partkey", first.alias("first"), second.alias("second"))


_FEET = """SELECT p_partkey, concat(CAST(4 + p_size % 3 AS {s}), '.', CAST(p_partkey % 100 AS {s}), '''''') AS height FROM {part}"""


@query(
    "feet_to_cm",
    "WITH p AS (" + _FEET.format(s="VARCHAR", part="part") + """)
SELECT p_partkey, CAST(round_even(CAST(replace(height, '''''', '') AS DOUBLE) * CAST(30.48 AS DOUBLE), 0) AS INTEGER) AS cm FROM p""",
)
def feet_to_cm(spark, sf_dir):
    df = spark.sql(_FEET.replace("{s}", "STRING"), part=table(spark, sf_dir, "part"))
    return df.select("p_partkey", fx.feet_to_cm(F.col("height"), cfg.CM_PER_FOOT).alias("cm"))


_SPARSE = """SELECT c_custkey, c_name AS ime, CASE WHEN c_custkey % 97 = 0 THEN 'Yes' END AS zutica,
  'Normal' AS pokreti_fetusa, c_mktsegment AS segment, c_acctbal AS balance FROM {customer}"""


@query(
    "column_drop_plan",
    "WITH c AS (" + _SPARSE.format(customer="customer") + """), p AS (
  SELECT unnest(['c_custkey', 'ime', 'zutica', 'pokreti_fetusa', 'segment', 'balance']) AS "column",
    unnest([count(c_custkey), count(ime), count(zutica), count(pokreti_fetusa), count(segment), count(balance)]) AS n, count(*) AS total,
    unnest([count(DISTINCT c_custkey), count(DISTINCT ime), count(DISTINCT zutica), count(DISTINCT pokreti_fetusa),
            count(DISTINCT segment), count(DISTINCT balance)]) AS d FROM c)
SELECT "column", round(1 - n / total, 6) AS null_share, CASE WHEN "column" = 'ime' THEN 'identifier' WHEN 1 - n / total > 0.98 THEN 'mostly_null'
  ELSE 'constant' END AS reason FROM p WHERE "column" = 'ime' OR 1 - n / total > 0.98 OR d = 1""",
)
def column_drop_plan(spark, sf_dir):
    df = spark.sql(_SPARSE, customer=table(spark, sf_dir, "customer"))
    return clean.column_drop_plan(df, ["ime"]).withColumn("null_share", _r("null_share"))


@query(
    "fill_constant",
    with_views("patients_raw", "SELECT patient_id, " + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in cfg.FLAGS)
               + ", COALESCE(nivo_rizika, 'None') AS nivo_rizika FROM patients_raw"),
)
def fill_constant(spark, sf_dir):
    values = {**{c: 0 for c in cfg.FLAGS}, cfg.TARGET: "None"}
    return clean.fill_constant(patients_raw(spark, sf_dir).select("patient_id", *cfg.FLAGS, cfg.TARGET), values)


# ---- imputation ---------------------------------------------------------------------------


@query("impute_median", with_views("patients", "SELECT patient_id, " + ", ".join(cfg.FEATURES) + ", nivo_rizika FROM patients"))
def impute_median(spark, sf_dir):
    return patients(spark, sf_dir).select("patient_id", *cfg.FEATURES, cfg.TARGET)


@query(
    "imputation_report",
    with_views("kept", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS filled, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM kept" for c in cfg.VITALS)),
)
def imputation_report(spark, sf_dir):
    raw = patients_raw(spark, sf_dir).withColumn("tjelesna_temp", fx.fahrenheit_to_celsius(F.col("tjelesna_temp")))
    kept = clean.keep_age_range(
        clean.drop_null_target(raw, cfg.TARGET), "dob", cfg.AGE_SENTINEL, cfg.AGE_MIN, cfg.AGE_MAX
    )
    return clean.imputation_report(kept, cfg.VITALS)


def _skew_sql(c, source):
    mean = f"(SELECT avg({c}) FROM {source})"
    return f"avg(power({c} - {mean}, 3)) / power(var_pop({c}), 1.5)"


_SKEW_FILLS = ", fills AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_skew_sql(c, 'patients_raw')} AS skewness, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med, avg({c}) AS mean FROM patients_raw"
    for c in cfg.SKEW_COLUMNS
) + """), chosen AS (SELECT "column", skewness, CASE WHEN abs(skewness) > 1 THEN 'median' ELSE 'mean' END AS method,
  CASE WHEN abs(skewness) > 1 THEN med ELSE mean END AS fill_value FROM fills)"""


@query(
    "skew_fill_values",
    with_views("patients_raw", _SKEW_FILLS + ' SELECT "column", round(skewness, 6) AS skewness, method, round(fill_value, 6) AS fill_value FROM chosen'),
)
def skew_fill_values(spark, sf_dir):
    fills = clean.skew_fill_values(patients_raw(spark, sf_dir), cfg.SKEW_COLUMNS)
    return fills.select("column", _r("skewness"), "method", _r("fill_value"))


@query(
    "impute_by_skew",
    with_views("patients_raw", _SKEW_FILLS + " SELECT patient_id, " + ", ".join(
        f"round(COALESCE(CAST({c} AS DOUBLE), (SELECT fill_value FROM chosen WHERE \"column\" = '{c}')), 6) AS {c}" for c in cfg.SKEW_COLUMNS)
        + " FROM patients_raw"),
)
def impute_by_skew(spark, sf_dir):
    df = clean.impute_by_skew(patients_raw(spark, sf_dir), cfg.SKEW_COLUMNS)
    return df.select("patient_id", *[_r(c) for c in cfg.SKEW_COLUMNS])


_GAPS = """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM {orders}"""


@query(
    "impute_mode",
    "WITH g AS (" + _GAPS.format(orders="orders") + """)
SELECT o_orderkey, COALESCE(status, (SELECT status FROM g WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status,
  COALESCE(priority, (SELECT priority FROM g WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM g""",
)
def impute_mode(spark, sf_dir):
    return clean.impute_mode(spark.sql(_GAPS, orders=table(spark, sf_dir, "orders")), ["status", "priority"])


_TEXT_FEATURES = ("SELECT patient_id, nivo_rizika, "
                  + ", ".join(f"CAST({c} AS {{s}}) AS {c}" for c in cfg.FEATURES if c != "otkucaji_srca")
                  + ", CASE WHEN patient_id % 59 = 0 THEN 'n/a' ELSE CAST(otkucaji_srca AS {s}) END AS otkucaji_srca FROM {raw}")


@query(
    "complete_cases",
    with_views("patients_raw", ", t AS (" + _TEXT_FEATURES.format(s="VARCHAR", raw="patients_raw") + ") SELECT patient_id, nivo_rizika, "
               + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cfg.FEATURES)
               + " FROM t WHERE " + " AND ".join(f"TRY_CAST({c} AS DOUBLE) IS NOT NULL" for c in cfg.FEATURES)),
)
def complete_cases(spark, sf_dir):
    text = spark.sql(_TEXT_FEATURES.replace("{s}", "STRING"), raw=patients_raw(spark, sf_dir))
    return clean.complete_cases(text, cfg.FEATURES).select("patient_id", cfg.TARGET, *cfg.FEATURES)


# ---- risk interpretation ------------------------------------------------------------------

_FACTOR_ROWS = """, f AS (
  SELECT patient_id, CASE WHEN glukoza_u_krvi >= 11 THEN 0 WHEN glukoza_u_krvi >= 7.8 THEN 1 END AS ord, glukoza_u_krvi AS v1, CAST(NULL AS DOUBLE) AS v2, w_glucose AS weight FROM weighted
  UNION ALL SELECT patient_id, CASE WHEN dijabetes = 1 THEN 3 END, NULL, NULL, 3 FROM weighted
  UNION ALL SELECT patient_id, CASE WHEN gestacijski_dijabetes = 1 THEN 4 END, NULL, NULL, 3 FROM weighted
  UNION ALL SELECT patient_id, CASE w_pressure WHEN 5 THEN 5 WHEN 4 THEN 6 WHEN 3 THEN 7 WHEN 1 THEN 8 END, sistolicki_krvni_tlak, dijastolicki_krvni_tlak, w_pressure FROM weighted
  UNION ALL SELECT patient_id, CASE w_bmi WHEN 3 THEN 9 WHEN 2 THEN 10 WHEN 1 THEN 11 END, BMI, NULL, w_bmi FROM weighted
  UNION ALL SELECT patient_id, CASE w_temp WHEN 3 THEN 12 WHEN 1 THEN 13 END, tjelesna_temp, NULL, w_temp FROM weighted
  UNION ALL SELECT patient_id, CASE w_heart WHEN 2 THEN 14 WHEN 1 THEN 15 END, otkucaji_srca, NULL, w_heart FROM weighted
  UNION ALL SELECT patient_id, CASE WHEN mentalno_zdravlje = 1 THEN 16 END, NULL, NULL, 2 FROM weighted
  UNION ALL SELECT patient_id, CASE WHEN komplikacije_u_proslosti = 1 THEN 17 END, NULL, NULL, 2 FROM weighted),
named AS (SELECT patient_id, ord, v1, v2, weight, (['glukoza_kriticna', 'glukoza_visoka', 'glukoza_povisena', 'dijabetes_tip1_2',
  'gestacijski_dijabetes', 'hipertenzija_3', 'hipertenzija_2', 'hipertenzija_1', 'normalno_visok_tlak', 'gojaznost_teska', 'gojaznost',
  'prekomjerna_tezina', 'febrilno_stanje', 'subfebrilan', 'tahikardija', 'bradikardija', 'mentalno_zdravlje',
  'komplikacije_proslost'])[ord + 1] AS factor FROM f WHERE ord IS NOT NULL)"""


@query("risk_factors", with_views("weighted", _FACTOR_ROWS + " SELECT patient_id, ord, factor, v1, v2, weight FROM named"))
def risk_factors(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return df.select("patient_id", F.inline(risk.factors_column(risk.factor_slots())))


@query("risk_weight", with_views("weighted", "SELECT patient_id, CAST(total AS INTEGER) AS total FROM weighted"))
def risk_weight(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return df.select("patient_id", risk.weight_column(risk.factor_slots()).alias("total"))


@query(
    "normal_params",
    with_views("weighted", """SELECT patient_id, concat_ws(',', CASE WHEN w_glucose = 0 THEN 'glukoza' END,
  CASE WHEN w_pressure = 0 THEN 'krvni_tlak' END, CASE WHEN w_bmi = 0 THEN 'bmi' END) AS normal FROM weighted"""),
)
def normal_params(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return df.select("patient_id", F.array_join(risk.normal_params_column(), ",").alias("normal"))


_FLAG_ORDER = ["dijabetes", "gestacijski_dijabetes", "komplikacije_u_proslosti", "mentalno_zdravlje"]


@query(
    "binary_flags",
    with_views("patients", "SELECT patient_id, " + ", ".join(
        "concat_ws(',', " + ", ".join(f"CASE WHEN {c} = {v} THEN '{c}' END" for c in _FLAG_ORDER) + f") AS {n}"
        for n, v in (("active", 1), ("inactive", 0))) + " FROM patients"),
)
def binary_flags(spark, sf_dir):
    return patients(spark, sf_dir).select(
        "patient_id",
        F.array_join(risk.flags_column(_FLAG_ORDER, 1), ",").alias("active"),
        F.array_join(risk.flags_column(_FLAG_ORDER, 0), ",").alias("inactive"),
    )


_SLOT_SQL = {
    "glukoza_kriticna": ("w_glucose = 4", "glukoza_u_krvi", None), "glukoza_visoka": ("w_glucose = 3", "glukoza_u_krvi", None),
    "dijabetes_tip1_2": ("dijabetes = 1", None, None), "gestacijski_dijabetes": ("gestacijski_dijabetes = 1", None, None),
    "hipertenzija_3": ("w_pressure = 5", "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak"),
    "hipertenzija_2": ("w_pressure = 4", "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak"),
    "hipertenzija_1": ("w_pressure = 3", "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak"),
    "normalno_visok_tlak": ("w_pressure = 1", "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak"),
    "gojaznost_teska": ("w_bmi = 3", "BMI", None), "gojaznost": ("w_bmi = 2", "BMI", None), "prekomjerna_tezina": ("w_bmi = 1", "BMI", None),
    "febrilno_stanje": ("w_temp = 3", "tjelesna_temp", None), "subfebrilan": ("w_temp = 1", "tjelesna_temp", None),
    "tahikardija": ("w_heart = 2", "otkucaji_srca", None), "bradikardija": ("w_heart = 1", "otkucaji_srca", None),
    "mentalno_zdravlje": ("mentalno_zdravlje = 1", None, None), "komplikacije_proslost": ("komplikacije_u_proslosti = 1", None, None),
}


def _sql_text(template: str, v: str | None, w: str | None = None, c: str | None = None) -> str:
    """A template as a DuckDB ``printf`` call; ``%.nf`` there rounds the exact binary value, ties to even."""
    args, out = [], template.replace("%", "%%")
    for mark, arg in (("{v:.1f}", v), ("{v:.0f}", v), ("{v:d}", v), ("{w:.0f}", w), ("{c}", c)):
        if mark in out:
            out = out.replace(mark, {"d": "%d", "f": "%" + mark[3:-1]}.get(mark[-2], "%s"))
            args.append(f"CAST({arg} AS BIGINT)" if mark[-2] == "d" else arg)
    out = out.replace("'", "''")
    return f"printf('{out}', {', '.join(args)})" if args else f"'{out}'".replace("%%", "%")


_QUERY_TEXT_SQL = "concat_ws(' ', " + ", ".join(
    f"CASE WHEN {cond} THEN {_sql_text(' '.join(cfg.QUERY_PHRASES[name]), v, w)} END" for name, (cond, v, w) in _SLOT_SQL.items()
) + ")"
QUERY_TEXTS_VIEW = f""", texts AS (SELECT patient_id, CASE WHEN total > 0 THEN {_QUERY_TEXT_SQL}
  ELSE concat(CASE WHEN dob > 35 THEN {_sql_text(cfg.NO_FACTOR_AGE[1] + ' ', 'dob')} ELSE '' END, '{' '.join(cfg.NO_FACTOR_PHRASES)}') END AS query_text
  FROM weighted)"""


@query("semantic_query_text", with_views("weighted", QUERY_TEXTS_VIEW + " SELECT patient_id, query_text FROM texts"))
def semantic_query_text(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return df.select("patient_id", risk.query_text_column(risk.factor_slots(), F.col("dob")).alias("query_text"))


@query(
    "multi_query_plan",
    with_views("weighted", QUERY_TEXTS_VIEW + _FACTOR_ROWS + """
SELECT patient_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY weight DESC, ord) - 1 AS INTEGER) AS query_ord, weight,
  concat(replace(factor, '_', ' '), ' ', query_text) AS query_text FROM named JOIN texts USING (patient_id)
UNION ALL
SELECT patient_id, CAST((SELECT count(*) FROM named n WHERE n.patient_id = t.patient_id) AS INTEGER), 1, query_text FROM texts t"""),
)
def multi_query_plan(spark, sf_dir):
    slots = risk.factor_slots()
    df = risk.with_classes(patients(spark, sf_dir))
    return risk.multi_query_plan(
        df, "patient_id", risk.factors_column(slots), risk.query_text_column(slots, F.col("dob"))
    )


def _summary_sql() -> str:
    lines = []
    for param, quiet, template in cfg.SUMMARY_LINES:
        names = ", ".join(f"'{q}'" for q in quiet)
        if param == "krvni_tlak":
            text = "(['optimalan', 'normalan', 'normalno visok', 'blaga hipertenzija', 'umjerena hipertenzija', 'teška hipertenzija'])[worst + 1]"
            lines.append("CASE WHEN worst > 1 THEN "
                         + _sql_text(template, "sistolicki_krvni_tlak", "dijastolicki_krvni_tlak", text) + " END")
        else:
            column = cfg.BAND_COLUMNS[param]
            label = _case_bands(column, cfg.BANDS[param], cfg.UNKNOWN_CLASS)
            lines.append(f"CASE WHEN {label} NOT IN ({names}) THEN {_sql_text(template, column, None, f'replace({label}, {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})')} END")
    lines += [f"CASE WHEN {flag} = 1 THEN '{text}' END" for flag, text in cfg.SUMMARY_FLAG_LINES]
    return (f"CASE WHEN total = 0 THEN '{cfg.SUMMARY_NONE}' ELSE concat(concat_ws(chr(10), '{cfg.SUMMARY_HEAD}', "
            + ", ".join(lines) + f"), '{cfg.SUMMARY_TAIL}') END")


@query(
    "patient_summary",
    with_views("weighted", """, r AS (SELECT *, greatest(
  CASE WHEN sistolicki_krvni_tlak >= 180 THEN 5 WHEN sistolicki_krvni_tlak >= 160 THEN 4 WHEN sistolicki_krvni_tlak >= 140 THEN 3
       WHEN sistolicki_krvni_tlak >= 130 THEN 2 WHEN sistolicki_krvni_tlak >= 120 THEN 1 ELSE 0 END,
  CASE WHEN dijastolicki_krvni_tlak >= 110 THEN 5 WHEN dijastolicki_krvni_tlak >= 100 THEN 4 WHEN dijastolicki_krvni_tlak >= 90 THEN 3
       WHEN dijastolicki_krvni_tlak >= 85 THEN 2 WHEN dijastolicki_krvni_tlak >= 80 THEN 1 ELSE 0 END) AS worst FROM weighted)
SELECT patient_id, """ + _summary_sql() + " AS summary FROM r"),
)
def patient_summary(spark, sf_dir):
    df = risk.with_classes(patients(spark, sf_dir))
    return df.select("patient_id", risk.summary_column(risk.factor_slots()).alias("summary"))
