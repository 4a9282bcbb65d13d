"""Sources, sinks, typing, profiling and missing-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    FIXTURES, LINEITEM_ORDER, SCHEMAS, cte, gaps, lineitem, messy, numeric_of, r, rnd, survey, table, text_of, union,
)
from colprep.operators import missing as M
from colprep.operators import profile as P
from colprep.operators import typing as TY
from colprep.session import scratch_dir
from colprep.sources import files
from colprep.sources.fingerprint import fingerprint

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


# --- sources and sinks ------------------------------------------------------

def _csv_na(spark, sf):
    path = scratch_dir(spark, "csv")
    files.write_csv(messy(spark, sf), path)
    return files.read_csv(spark, path)


add("src_csv_na_tokens", _csv_na, cte("fx_messy_text") + """
SELECT row_id, label_raw, nullif(amount_raw, 'n/a') AS amount_raw, date_raw, name_raw, value FROM fx_messy_text""")

add("src_fingerprint", lambda s, sf: fingerprint(lineitem(s, sf)))


def _csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "csv")
    orders = table(spark, sf, "orders")
    files.write_csv(orders, path)
    return files.read_csv(spark, path, schema=orders.schema)


add("sink_csv_roundtrip", _csv_roundtrip, "SELECT * FROM orders")


def _report_json(spark, sf):
    df = survey(spark, sf)
    path = scratch_dir(spark, "json")
    files.write_report_json({"missing": P.missing_summary(df), "dataset": P.profile_dataset(df)}, {"source": "survey"}, path)
    back = spark.read.schema("section string, metadata string, record string").json(path)
    field = lambda k: F.get_json_object("record", f"$.{k}")
    return back.select(
        "section", F.get_json_object("metadata", "$.source").alias("source"), field("column").alias("column"),
        field("missing").cast("long").alias("missing"), field("rows").cast("long").alias("rows"), field("missing_cells").cast("long").alias("missing_cells"),
    )


_SURVEY_COLS = list(SCHEMAS["fx_survey"])
_MISSING_CELLS = " + ".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in _SURVEY_COLS)
add("sink_report_json", _report_json, cte("fx_survey") + union(
    [f"""SELECT 'missing' AS section, 'survey' AS source, '{x}' AS "column", count(*) - count({x}) AS missing, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS missing_cells
FROM fx_survey HAVING count(*) > count({x})""" for x in _SURVEY_COLS]
    + [f"SELECT 'dataset', 'survey', NULL, NULL, count(*), {_MISSING_CELLS} FROM fx_survey"]))

add("src_preview", lambda s, sf: survey(s, sf).orderBy("respondent_id").limit(10),
    cte("fx_survey") + "SELECT * FROM fx_survey ORDER BY respondent_id LIMIT 10")

add("src_sample_values", lambda s, sf: P.sample_values(survey(s, sf), ["respondent_id"]), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", string_agg(v, ', ' ORDER BY k) AS samples FROM (
  SELECT respondent_id AS k, CASE WHEN length(CAST({x} AS VARCHAR)) > 20 THEN concat(substr(CAST({x} AS VARCHAR), 1, 20), '...') ELSE CAST({x} AS VARCHAR) END AS v
  FROM fx_survey WHERE {x} IS NOT NULL ORDER BY respondent_id LIMIT 3)""" for x in _SURVEY_COLS))


def _info(name, x, dtype, extra="", tail=""):
    return f"""SELECT '{x}' AS "column", '{dtype}' AS dtype{extra} FROM {name}{tail}"""


add("src_column_info", lambda s, sf: rnd(P.column_info(survey(s, sf))), cte("fx_survey") + union(
    _info("fx_survey", x, t, f""", count({x}) AS non_null, count(*) - count({x}) AS missing,
  {r(f'100.0E0 * (count(*) - count({x})) / count(*)')} AS missing_pct, count(DISTINCT {x}) AS unique_count""")
    for x, t in SCHEMAS["fx_survey"].items()))

add("src_systematic_sample",
    lambda s, sf: M.systematic_sample(gaps(s, sf).select("row_id", "price", "w"), ["row_id"], 3),
    cte("fx_orders_gaps", """p AS (SELECT row_id, price, w, row_number() OVER (ORDER BY row_id) - 1 AS position FROM fx_orders_gaps)""")
    + "SELECT row_id, price, w, position FROM p WHERE position % 3 = 0")

add("src_dataset_flags", lambda s, sf: rnd(P.dataset_flags(gaps(s, sf))), cte("fx_orders_gaps", "d AS (SELECT count(*) AS n, "
    + " + ".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in SCHEMAS["fx_orders_gaps"]) + " AS m FROM fx_orders_gaps)")
    + f"SELECT n AS rows, {r('100.0E0 * m / (n * 9)')} AS missing_pct, m > n * 9 * 0.2E0 AS high_missing, n > 50000 AS large_dataset FROM d")

# --- typing -----------------------------------------------------------------

_TYPE_SQL = {
    "string": "CASE WHEN n = 0 THEN 'empty' WHEN d = 2 THEN 'binary' WHEN d * 1.0E0 / n < 0.1 AND d < 20 THEN 'categorical' ELSE 'text' END",
    "bigint": "CASE WHEN n = 0 THEN 'empty' WHEN d = 2 THEN 'binary' WHEN d < 10 AND lo >= 0 THEN 'ordinal' ELSE 'integer' END",
    "double": "CASE WHEN n = 0 THEN 'empty' WHEN d = 2 THEN 'binary' ELSE 'continuous' END",
    "timestamp_ntz": "CASE WHEN n = 0 THEN 'empty' WHEN d = 2 THEN 'binary' ELSE 'datetime' END",
}


def _types(name):
    def one(x, t):
        low = f"min({x})" if t in ("bigint", "double") else "0"
        return f"""SELECT '{x}' AS "column", '{t}' AS dtype, {_TYPE_SQL[t]} AS semantic_type
FROM (SELECT count({x}) AS n, count(DISTINCT {x}) AS d, {low} AS lo FROM {name})"""
    return union(one(x, t) for x, t in SCHEMAS[name].items())


add("type_detect", lambda s, sf: TY.detect_types(survey(s, sf)).unionByName(TY.detect_types(gaps(s, sf))),
    cte("fx_survey", f"fx_orders_gaps AS ({FIXTURES['fx_orders_gaps']})")
    + _types("fx_survey") + "\nUNION ALL\n" + _types("fx_orders_gaps"))

add("type_override", lambda s, sf: TY.override_types(TY.detect_types(survey(s, sf)), {"age": "continuous", "zip": "categorical"}),
    cte("fx_survey", f"t AS ({_types('fx_survey')})") + """
SELECT "column", dtype, CASE "column" WHEN 'age' THEN 'continuous' WHEN 'zip' THEN 'categorical' ELSE semantic_type END AS semantic_type,
  "column" IN ('age', 'zip') AS overridden FROM t""")

# --- profile ----------------------------------------------------------------


def _basic(name, x, t):
    if t in ("string", "timestamp_ntz"):
        stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {k}" for k in ("mean", "median", "std", "min", "max", "q25", "q75"))
    else:
        stats = (f"{r(f'avg({x})', 4)} AS mean, {r(f'quantile_cont(CAST({x} AS DOUBLE), 0.5)', 4)} AS median, {r(f'stddev_samp({x})', 4)} AS std, "
                 f"CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max, {r(f'quantile_cont(CAST({x} AS DOUBLE), 0.25)', 4)} AS q25, "
                 f"{r(f'quantile_cont(CAST({x} AS DOUBLE), 0.75)', 4)} AS q75")
    return f"""SELECT '{x}' AS "column", count(*) AS count, count(*) - count({x}) AS missing,
  {r(f'100.0E0 * (count(*) - count({x})) / count(*)', 4)} AS missing_pct, count(DISTINCT {x}) AS unique_count,
  {r(f'100.0E0 * count(DISTINCT {x}) / count(*)', 4)} AS unique_pct, {stats} FROM {name}"""


add("profile_basic", lambda s, sf: rnd(P.profile_basic(lineitem(s, sf)), 4),
    union(_basic("lineitem", x, t) for x, t in SCHEMAS["lineitem"].items()))


def _moments(name, x, body):
    return f"""SELECT '{x}' AS "column", {body} FROM (
  SELECT count(x) AS n, avg(x) AS a, stddev_samp(x) AS sd, avg(power(x - m, 2)) AS m2, avg(power(x - m, 3)) AS m3, avg(power(x - m, 4)) AS m4
  FROM (SELECT CAST({x} AS DOUBLE) AS x, avg(CAST({x} AS DOUBLE)) OVER () AS m FROM {name}))"""


_SKEW = "CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5E0) END"
_KURT = "CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END"
add("profile_moments", lambda s, sf: rnd(P.profile_moments(lineitem(s, sf)), 5, mean=4, std=4), union(
    _moments("lineitem", x, f"n AS non_null, {r('a', 4)} AS mean, {r('sd', 4)} AS std, {r(_SKEW, 5)} AS skewness, {r(_KURT, 5)} AS kurtosis")
    for x in numeric_of("lineitem")))



def _summary_text(x, t):
    span = f"concat('. Range: ', printf('%.2f', CAST(min({x}) AS DOUBLE)), ' to ', printf('%.2f', CAST(max({x}) AS DOUBLE)))" if t != "string" else "''"
    return f"""SELECT '{x}' AS "column", concat('Column ''{x}'' has ', format('{{:,}}', count(*)), ' total values',
  CASE WHEN count({x}) < count(*) THEN concat(', ', format('{{:,}}', count(*) - count({x})), ' missing (', printf('%.1f', 100.0E0 * (count(*) - count({x})) / count(*)), '%)') ELSE '' END,
  ', ', format('{{:,}}', count(DISTINCT {x})), ' unique values', {span}) AS summary FROM fx_survey"""


add("profile_summary_text", lambda s, sf: P.profile_summary_text(survey(s, sf)), cte("fx_survey") + union(_summary_text(x, t) for x, t in SCHEMAS["fx_survey"].items()))

add("profile_dataset", lambda s, sf: rnd(P.profile_dataset(survey(s, sf))), cte("fx_survey") + f"""
SELECT n AS rows, CAST({len(_SURVEY_COLS)} AS BIGINT) AS columns, m AS missing_cells, {r(f'100.0E0 * m / (n * {len(_SURVEY_COLS)})')} AS missing_pct
FROM (SELECT count(*) AS n, {_MISSING_CELLS} AS m FROM fx_survey)""")

_DESCRIBE = {"count": "CAST(count({x}) AS DOUBLE)", "mean": "avg({x})", "std": "stddev_samp({x})", "min": "CAST(min({x}) AS DOUBLE)",
             "25%": "quantile_cont(CAST({x} AS DOUBLE), 0.25)", "50%": "quantile_cont(CAST({x} AS DOUBLE), 0.5)",
             "75%": "quantile_cont(CAST({x} AS DOUBLE), 0.75)", "max": "CAST(max({x}) AS DOUBLE)"}
add("profile_describe", lambda s, sf: rnd(P.profile_describe(survey(s, sf)), 4), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", '{k}' AS statistic, {r(v.format(x=x), 4)} AS value FROM fx_survey"""
    for x in numeric_of("fx_survey") for k, v in _DESCRIBE.items()))

_SHAPE = f"CASE WHEN n < 10 THEN 'insufficient_data' WHEN abs({_SKEW}) < 0.5 THEN 'approximately_normal' WHEN abs({_SKEW}) < 1 THEN 'moderately_skewed' ELSE 'highly_skewed' END"
_GAP_NUM = numeric_of("fx_orders_gaps")
add("dist_shape", lambda s, sf: rnd(P.dist_shape(gaps(s, sf)), 4), cte("fx_orders_gaps") + union(
    _moments("fx_orders_gaps", x, f"{r(_SKEW, 4)} AS skewness, {r(_KURT, 4)} AS kurtosis, {_SHAPE} AS shape") for x in _GAP_NUM))

add("dist_labels", lambda s, sf: P.dist_labels(gaps(s, sf)), cte("fx_orders_gaps") + union(
    _moments("fx_orders_gaps", x, f"""CASE WHEN {_SKEW} > 0.1 THEN 'right' WHEN {_SKEW} < -0.1 THEN 'left' ELSE 'symmetric' END AS direction,
  CASE WHEN {_KURT} < -0.5 THEN 'platykurtic' WHEN {_KURT} > 0.5 THEN 'leptokurtic' ELSE 'mesokurtic' END AS tails""") for x in _GAP_NUM))

_JB = f"(n / 6.0E0 * (power({_SKEW}, 2) + power({_KURT}, 2) / 4.0E0))"
add("dist_jarque_bera", lambda s, sf: rnd(P.dist_jarque_bera(survey(s, sf)), 4, p_value=6), cte("fx_survey") + union(
    _moments("fx_survey", x, f"{r(_JB, 4)} AS jarque_bera, {r(f'exp(-{_JB} / 2.0E0)')} AS p_value, exp(-{_JB} / 2.0E0) > 0.05 AS is_normal")
    for x in numeric_of("fx_survey")))



def _vf(name, x):
    return f"SELECT {x} AS v, count(*) AS n FROM {name} WHERE {x} IS NOT NULL GROUP BY {x}"


_SURVEY_TEXT = text_of("fx_survey")
add("dist_top10", lambda s, sf: P.dist_top(survey(s, sf), _SURVEY_TEXT), cte("fx_survey") + union(
    f"""SELECT * FROM (SELECT '{x}' AS "column", v AS value, n AS count, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank FROM ({_vf('fx_survey', x)})) WHERE rank <= 10"""
    for x in _SURVEY_TEXT))

_ENTROPY = "-sum((n * 1.0E0 / t) * ln(n * 1.0E0 / t))"
add("dist_entropy", lambda s, sf: rnd(P.dist_entropy(survey(s, sf), _SURVEY_TEXT)), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", count(*) AS unique_count, max(v) FILTER (WHERE rk = 1) AS mode_value, max(n) AS mode_count, {r(_ENTROPY)} AS entropy
FROM (SELECT v, n, sum(n) OVER () AS t, row_number() OVER (ORDER BY n DESC, v) AS rk FROM ({_vf('fx_survey', x)}))""" for x in _SURVEY_TEXT))

add("dist_balance", lambda s, sf: rnd(P.dist_balance(survey(s, sf), ["gender", "title", "education", "phone", "consent_flag"])), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", CAST(rk AS INTEGER) AS rank, v AS value, n AS count, {r('100.0E0 * n / sum(n) OVER ()')} AS share_pct,
  first_value(v) OVER (ORDER BY rk) AS most_common, last_value(v) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS least_common,
  {r('e / ln(k)')} AS entropy_ratio, CASE WHEN e / ln(k) > 0.9 THEN 'even' WHEN e / ln(k) > 0.7 THEN 'moderate' ELSE 'imbalanced' END AS balance
FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rk FROM ({_vf('fx_survey', x)})),
  (SELECT {_ENTROPY} AS e, count(*) AS k FROM (SELECT n, sum(n) OVER () AS t FROM ({_vf('fx_survey', x)}))) WHERE rk <= 10"""
    for x in ["gender", "title", "education", "phone", "consent_flag"]))

add("missing_summary", lambda s, sf: P.missing_summary(survey(s, sf)), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", count(*) - count({x}) AS missing, round(100.0E0 * (count(*) - count({x})) / count(*), 2) AS missing_pct
FROM fx_survey HAVING count(*) > count({x})""" for x in _SURVEY_COLS))

add("profile_overview", lambda s, sf: rnd(P.profile_overview(survey(s, sf))), cte("fx_survey") + union(
    _info("fx_survey", x, t, f""", {r(f'100.0E0 * (count(*) - count({x})) / count(*)')} AS missing_pct, {r(f'100.0E0 * count(DISTINCT {x}) / count(*)')} AS unique_pct""")
    for x, t in SCHEMAS["fx_survey"].items()))

add("fmt_number", lambda s, sf: lineitem(s, sf).select(
    "l_orderkey", "l_linenumber", "l_extendedprice",
    P.format_number(F.col("l_extendedprice") * F.col("l_quantity")).alias("amount"), P.format_number(F.col("l_partkey"), integral=True).alias("part"),
    P.format_number(F.col("l_tax")).alias("tax")), """
SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN a >= 1000000 THEN printf('%.2fM', a / 1000000) WHEN a >= 1000 THEN printf('%.2fK', a / 1000) ELSE printf('%.3f', a) END AS amount,
  CASE WHEN l_partkey >= 1000 THEN printf('%.2fK', l_partkey / 1000.0E0) ELSE CAST(l_partkey AS VARCHAR) END AS part,
  printf('%.3f', l_tax) AS tax
FROM (SELECT *, l_extendedprice * l_quantity AS a FROM lineitem)""")

# --- missing patterns -------------------------------------------------------

_HOLES = ["price", "priority", "price_spiky", "empty_col"]


def _islands(x):
    return f"""SELECT pos - row_number() OVER (ORDER BY pos) AS island, pos FROM
  (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, {x} AS x FROM fx_orders_gaps) WHERE x IS NULL"""


add("missing_runs", lambda s, sf: M.missing_runs(gaps(s, sf), _HOLES, ["row_id"], buckets=16), cte("fx_orders_gaps") + union(
    f"""SELECT '{x}' AS "column", min(pos) AS start, count(*) AS length FROM ({_islands(x)}) GROUP BY island""" for x in _HOLES))

add("missing_max_run", lambda s, sf: M.missing_max_run(gaps(s, sf), _HOLES, ["row_id"]), cte("fx_orders_gaps") + union(
    f"""SELECT '{x}' AS "column", count(*) AS runs, max(length) AS max_run FROM (SELECT count(*) AS length FROM ({_islands(x)}) GROUP BY island)"""
    for x in _HOLES))


def _pattern(x):
    return f"""SELECT '{x}' AS "column", m AS missing, {r('100.0E0 * m / n')} AS missing_pct, CAST(coalesce(run, 0) AS BIGINT) AS max_run,
  f AS front_missing, l AS tail_missing,
  CASE WHEN m = 0 THEN 'none' WHEN 100.0E0 * m / n < 5 THEN 'sporadic' WHEN run > n * 0.1E0 THEN 'systematic_blocks'
    WHEN f > l * 2 THEN 'front_loaded' WHEN l > f * 2 THEN 'tail_loaded' ELSE 'random' END AS pattern
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS m,
    count(*) FILTER (WHERE x IS NULL AND pos < floor(c * 0.1E0)) AS f, count(*) FILTER (WHERE x IS NULL AND pos >= floor(c * 0.9E0)) AS l
  FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, {x} AS x, count(*) OVER () AS c FROM fx_orders_gaps)),
  (SELECT max(length) AS run FROM (SELECT count(*) AS length FROM ({_islands(x)}) GROUP BY island))"""


add("missing_pattern", lambda s, sf: rnd(M.missing_pattern(gaps(s, sf), ["row_id"])),
    cte("fx_orders_gaps") + union(_pattern(x) for x in SCHEMAS["fx_orders_gaps"]))

add("missing_matrix", lambda s, sf: M.missing_matrix(gaps(s, sf), ["row_id"]),
    cte("fx_orders_gaps", "p AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM fx_orders_gaps)")
    + "SELECT position, " + ", ".join(f"CAST({x} IS NULL AS TINYINT) AS {x}" for x in SCHEMAS["fx_orders_gaps"])
    + " FROM p")

_SURVEY_HOLES = ["age", "income", "household_income", "email", "phone"]
add("missing_comissing", lambda s, sf: rnd(M.comissing_pairs(survey(s, sf))), cte("fx_survey") + "SELECT * FROM (" + union(
    f"""SELECT '{a}' AS column1, '{b}' AS column2, {r(f'corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER))')} AS phi,
  least(count(*) FILTER (WHERE {a} IS NULL), count(*) FILTER (WHERE {b} IS NULL)) AS violations FROM fx_survey"""
    for i, a in enumerate(_SURVEY_HOLES) for b in _SURVEY_HOLES[i + 1:]) + ") WHERE phi > 0.8")

_PAIRS = [("email", "phone"), ("start_date", "end_date"), ("income", "employment"), ("household_income", "employment")]
add("missing_required_pair", lambda s, sf: M.required_missing(survey(s, sf)), cte("fx_survey") + union(
    f"""SELECT '{a}' AS primary_column, '{b}' AS required_column, count(*) AS violations FROM fx_survey WHERE {a} IS NOT NULL AND {b} IS NULL HAVING count(*) > 0"""
    for a, b in _PAIRS))
