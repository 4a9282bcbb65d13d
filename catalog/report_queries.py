"""Weights, recipe, audit, chart and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SCHEMAS, YEAR, cte, gaps, lineitem, numeric_of, r, rnd, survey, union
from catalog.quality_queries import _by_column, joined, metrics_sql, rule_total, scores_sql
from catalog.recipes import SURVEY_RECIPE
from colprep.functions.statfn import normal_quantile
from colprep.operators import charts as CH
from colprep.operators import quality as Q
from colprep.operators import weights as W
from colprep.plans import recipe as RC
from colprep.plans import report as RP

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


_S = cte("fx_survey")
_G = cte("fx_orders_gaps")
_WCOLS = ["age", "income", "household_income", "score_a", "completion_percent"]
_DW = "design_weight"

# --- weights ----------------------------------------------------------------

add("weights_validate", lambda s, sf: rnd(joined(W.weights_validate(gaps(s, sf), "signed_qty"), "warnings"), 4), _G + f"""
SELECT m AS missing, neg AS negative, z AS zero, {r('q99 / nullif(q01, 0)', 4)} AS quantile_ratio,
  concat_ws(',', CASE WHEN m > 0 THEN 'missing_weights' END, CASE WHEN neg > 0 THEN 'negative_weights' END, CASE WHEN z > 0 THEN 'zero_weights' END,
    CASE WHEN q99 / nullif(q01, 0) > 100 OR (q01 = 0 AND q99 > 0) THEN 'high_variability' END, CASE WHEN d <= 1 THEN 'constant_weights' END) AS warnings, true AS valid
FROM (SELECT count(*) - count(signed_qty) AS m, count(*) FILTER (WHERE signed_qty < 0) AS neg, count(*) FILTER (WHERE signed_qty = 0) AS z, quantile_cont(signed_qty, 0.99) AS q99,
  quantile_cont(signed_qty, 0.01) AS q01, count(DISTINCT signed_qty) AS d FROM fx_orders_gaps)""")
add("weights_metadata", lambda s, sf: rnd(W.weights_metadata(lineitem(s, sf), "l_quantity"), 4), f"""
SELECT {r('avg(l_quantity)', 4)} AS mean, min(l_quantity) AS min, max(l_quantity) AS max, {r('stddev_samp(l_quantity)', 4)} AS std, {r('sum(l_quantity)', 4)} AS total_weight,
  count(*) FILTER (WHERE l_quantity < 0) AS negative_weights, count(*) FILTER (WHERE l_quantity = 0) AS zero_weights FROM lineitem""")


def wsum(x, name="fx_survey", w=_DW):
    """One row of weighted sums of ``x``."""
    return f"""(SELECT *, (SELECT sum({w} * power({x} - sx / sw, 2)) FROM {name}) / sw AS va FROM (
  SELECT count(*) AS n, sum(w) AS sw, sum(w * w) AS sww, sum(w * x) AS sx, min(x) AS lo, max(x) AS hi
  FROM (SELECT CAST({x} AS DOUBLE) AS x, {w} AS w FROM {name} WHERE {x} IS NOT NULL AND {w} IS NOT NULL)))"""


add("weighted_summary", lambda s, sf: rnd(W.weighted_summary(survey(s, sf), _WCOLS, _DW), 3, variance=0), _S + union(
    f"""SELECT '{x}' AS "column", n AS valid_observations, {r('sw', 3)} AS total_weight, {r('sw * sw / sww', 3)} AS effective_sample_size, {r('sx / sw', 3)} AS mean,
  {r('va', 0)} AS variance, {r('sqrt(va)', 3)} AS std, lo AS min, hi AS max FROM {wsum(x)}""" for x in _WCOLS))
add("weighted_quantiles", lambda s, sf: rnd(W.weighted_quantiles(survey(s, sf), "income", _DW), 3), _S + """
, v AS (SELECT income AS x, sum(design_weight) AS w FROM fx_survey WHERE income IS NOT NULL GROUP BY income),
c AS (SELECT x, sum(w) OVER (ORDER BY x) AS cum, sum(w) OVER () AS total FROM v)
""" + union(f"""SELECT 'income' AS "column", {p}E0 AS p, {r('min(x)', 3)} AS value, {r('min(cum)', 3)} AS cumulative_weight FROM c WHERE cum >= {p}E0 * total * (1 - 1e-12)"""
            for p in ("0.25", "0.5", "0.75")))
add("weighted_top5", lambda s, sf: rnd(W.weighted_top(survey(s, sf), "segment", _DW), 3), _S + f"""
SELECT 'segment' AS "column", CAST(row_number() OVER (ORDER BY w DESC, segment) AS INTEGER) AS rank, segment AS value, {r('w', 3)} AS weight, count(*) OVER () AS unique_values
FROM (SELECT segment, sum(design_weight) AS w FROM fx_survey GROUP BY segment) QUALIFY rank <= 5""")
add("unweighted_summary", lambda s, sf: rnd(W.unweighted_summary(survey(s, sf), _WCOLS, _DW), 3, variance=0, q25=4, q50=4, q75=4), _S + union(
    f"""SELECT '{x}' AS "column", count({x}) AS count, {r(f'avg({x})', 3)} AS mean, {r(f'stddev_samp({x})', 3)} AS std, {r(f'var_samp({x})', 0)} AS variance, CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max,
  {', '.join(f"{r(f'quantile_cont(CAST({x} AS DOUBLE), {p})', 4)} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))}, count(DISTINCT {x}) AS unique_values FROM fx_survey""" for x in _WCOLS))
add("unweighted_top5", lambda s, sf: W.unweighted_top(survey(s, sf), "segment", _DW), _S + """
SELECT 'segment' AS "column", segment AS value, count(*) AS count FROM fx_survey GROUP BY segment ORDER BY count DESC, value LIMIT 5""")
add("moe_numeric", lambda s, sf: rnd(W.moe_numeric(survey(s, sf), _WCOLS, _DW).drop("critical_value", "margin_of_error", "ci_low", "ci_high"), 4), _S + union(
    f"""SELECT '{x}' AS "column", 0.95E0 AS confidence_level, n AS sample_size, {r('sw', 4)} AS total_weight, {r('sx / sw', 4)} AS weighted_mean,
  {r('sqrt(va / (sw * sw / sww))', 4)} AS standard_error, {r('n / (sw * sw / sww)', 4)} AS design_effect, {r('sw * sw / sww', 4)} AS effective_sample_size FROM {wsum(x)}""" for x in _WCOLS))
_Z = normal_quantile(0.975)
# Expansion of the t quantile in 1/df; exact to ten digits at these sample sizes.
_T = f"""({_Z!r} + {(_Z**3 + _Z) / 4!r} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (df * df) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / (df * df * df))"""
add("moe_numeric_interval", lambda s, sf: rnd(W.moe_numeric(survey(s, sf), _WCOLS, _DW).select("column", "critical_value", "margin_of_error", "ci_low", "ci_high"), 4), _S + union(
    f"""SELECT '{x}' AS "column", {r(_T, 4)} AS critical_value, {r(f'{_T} * se', 4)} AS margin_of_error, {r(f'm - {_T} * se', 4)} AS ci_low, {r(f'm + {_T} * se', 4)} AS ci_high
FROM (SELECT sx / sw AS m, sqrt(va / (sw * sw / sww)) AS se, sw * sw / sww - 1 AS df FROM {wsum(x)})""" for x in _WCOLS))
add("moe_categorical", lambda s, sf: rnd(W.moe_categorical(survey(s, sf), "segment", _DW)), _S + f"""
SELECT segment AS category, {r('p')} AS proportion, {r('m')} AS margin_of_error, {r('p - m')} AS ci_low, {r('p + m')} AS ci_high FROM (
  SELECT segment, p, {_Z!r} * sqrt(p * (1 - p) / ne * (n / ne)) AS m FROM (SELECT segment, sum(design_weight) / (SELECT sum(design_weight) FROM fx_survey) AS p FROM fx_survey GROUP BY segment),
  (SELECT count(*) AS n, power(sum(design_weight), 2) / sum(design_weight * design_weight) AS ne FROM fx_survey))""")
add("weights_compare", lambda s, sf: rnd(W.weights_compare(survey(s, sf), _WCOLS, _DW), 3), _S + union(
    f"""SELECT '{x}' AS "column", {r('sx / sw', 3)} AS weighted_mean, {r('a', 3)} AS mean, {r('sx / sw - a', 3)} AS mean_difference, {r('100.0E0 * (sx / sw - a) / a', 3)} AS mean_percent_change,
  {r('sqrt(va)', 3)} AS weighted_std, {r('sd', 3)} AS std, {r('sqrt(va) - sd', 3)} AS std_difference FROM {wsum(x)}, (SELECT avg({x}) AS a, stddev_samp({x}) AS sd FROM fx_survey)""" for x in _WCOLS))
add("weights_diagnostics", lambda s, sf: rnd(joined(W.weights_diagnostics(survey(s, sf), _DW), "recommendations"), 4), _S + f"""
SELECT n AS count, m AS missing, {r('a', 4)} AS mean, {r('med', 4)} AS median, {r('sd', 4)} AS std, lo AS min, hi AS max, {r('q25', 4)} AS q25, {r('q75', 4)} AS q75, d AS unique_values,
  {r('sd / a', 4)} AS coefficient_of_variation, {r('hi / lo', 4)} AS range_ratio, neg AS negative_weights, z AS zero_weights, ext AS extreme_weights, {r('s * s / ss', 4)} AS effective_sample_size,
  {r('n / (s * s / ss)', 4)} AS design_effect, concat_ws(',', CASE WHEN m > 0 THEN 'handle_missing_weights' END, CASE WHEN neg > 0 THEN 'review_negative_weights' END,
    CASE WHEN sd / a > 2 THEN 'consider_trimming' END, CASE WHEN n / (s * s / ss) > 2 THEN 'high_design_effect' END) AS recommendations
FROM (SELECT count(*) AS n, count(*) - count(w) AS m, avg(w) AS a, quantile_cont(w, 0.5) AS med, stddev_samp(w) AS sd, min(w) AS lo, max(w) AS hi, quantile_cont(w, 0.25) AS q25, quantile_cont(w, 0.75) AS q75,
  count(DISTINCT w) AS d, count(*) FILTER (WHERE w < 0) AS neg, count(*) FILTER (WHERE w = 0) AS z,
  count(*) FILTER (WHERE w < (SELECT quantile_cont({_DW}, 0.01) FROM fx_survey) OR w > (SELECT quantile_cont({_DW}, 0.99) FROM fx_survey)) AS ext, sum(w) AS s, sum(w * w) AS ss FROM (SELECT {_DW} AS w FROM fx_survey))""")


def weights_report_sql(columns):
    return union(
        f"""SELECT '{x}' AS "column", {r('a', 3)} AS mean, {r('sd', 3)} AS std, {r('med', 3)} AS median, {r('t', 2)} AS total, {r('sx / sw', 3)} AS weighted_mean, {r('sx / sw * k', 2)} AS weighted_total,
  {r('sw * sw / sww', 3)} AS effective_sample_size, {r('sx / sw - a', 3)} AS mean_difference, {r('100.0E0 * (sx / sw - a) / a', 3)} AS relative_difference
FROM {wsum(x)}, (SELECT avg({x}) AS a, stddev_samp({x}) AS sd, quantile_cont(CAST({x} AS DOUBLE), 0.5) AS med, CAST(sum({x}) AS DOUBLE) AS t, count({x}) AS k FROM fx_survey)""" for x in columns)


add("weights_report", lambda s, sf: rnd(W.weights_report(survey(s, sf), _DW), 3, total=2, weighted_total=2),
    _S + weights_report_sql([x for x in numeric_of("fx_survey") if x != _DW]))

# --- recipe and audit -------------------------------------------------------

_MED = "(SELECT quantile_cont(income, 0.5) FROM fx_survey)"
_MODE = "(SELECT phone FROM fx_survey WHERE phone IS NOT NULL GROUP BY phone ORDER BY count(*) DESC, phone LIMIT 1)"
_REPLAY = f"""i AS (SELECT *, coalesce(income, {_MED}) AS inc FROM fx_survey),
b AS (SELECT quantile_cont(inc, 0.05) AS lo, quantile_cont(inc, 0.95) AS hi FROM i),
c AS (SELECT respondent_id, inc, greatest(lo, least(inc, hi)) AS income, income AS income0, age AS age0, email AS email0, phone AS phone0, gender AS gender0,
  coalesce(CAST(age AS DOUBLE), (SELECT avg(age) FROM fx_survey)) AS age, coalesce(email, 'Missing') AS email, lower(gender) AS gender, coalesce(phone, {_MODE}) AS phone FROM i, b)"""
add("recipe_replay", lambda s, sf: rnd(SURVEY_RECIPE.replay(survey(s, sf)).select("respondent_id", "income", "age", "email", "gender", "phone", "title"), 4),
    cte("fx_survey", _REPLAY) + f"SELECT respondent_id, {r('c.income', 4)} AS income, {r('c.age', 4)} AS age, c.email, c.gender, c.phone, s.title FROM c JOIN (SELECT respondent_id, title FROM fx_survey) s USING (respondent_id)")
add("recipe_undo", lambda s, sf: rnd(SURVEY_RECIPE.undo().undo().undo().undo().replay(survey(s, sf)).select("respondent_id", "income", "age", "email", "gender"), 4),
    cte("fx_survey", _REPLAY) + f"SELECT respondent_id, {r('inc', 4)} AS income, {r('age', 4)} AS age, email, gender0 AS gender FROM c")

_OPS = [(i, op.timestamp, op.column, op.method_type, op.method) for i, op in enumerate(SURVEY_RECIPE.operations, 1)]
_EFFECT = {  # step -> changed, missing before, missing after
    1: ("count(*) FILTER (WHERE income0 IS NULL)", "count(*) - count(income0)", "CAST(0 AS BIGINT)"),
    2: ("count(*) FILTER (WHERE age0 IS NULL)", "count(*) - count(age0)", "CAST(0 AS BIGINT)"),
    3: ("count(*) FILTER (WHERE email0 IS NULL)", "count(*) - count(email0)", "CAST(0 AS BIGINT)"),
    4: ("count(*) FILTER (WHERE inc <> income)", "CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)"),
    5: ("count(*) FILTER (WHERE gender0 <> gender)", "CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)"),
    6: ("count(*) FILTER (WHERE phone0 IS NULL)", "count(*) - count(phone0)", "CAST(0 AS BIGINT)"),
    7: ("count(*) * 0", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)"),
}
_LOG = "log AS (" + union(
    f"""SELECT {i} AS seq, '{ts}' AS ts, '{x}' AS "column", '{t}' AS method_type, '{m}' AS method, {str(i != 7).lower()} AS success,
  {_EFFECT[i][0]} AS rows_changed, {_EFFECT[i][1]} AS missing_before, {_EFFECT[i][2]} AS missing_after FROM c""" for i, ts, x, t, m in _OPS) + ")"
_L = cte("fx_survey", _REPLAY, _LOG)


def log(s, sf):
    return RC.operation_log(survey(s, sf), SURVEY_RECIPE)


add("audit_trail", lambda s, sf: RC.audit_trail(log(s, sf)), _L + "SELECT * FROM log")
add("audit_timeline", lambda s, sf: RC.audit_trail(log(s, sf), newest=5), _L + "SELECT * FROM log ORDER BY ts DESC, seq DESC LIMIT 5")
add("audit_by_column", lambda s, sf: RC.audit_by_column(log(s, sf)), _L + """
SELECT "column", count(*) AS operations, max_by(method, seq) AS last_method, max_by(ts, seq) AS last_applied, CAST(sum(rows_changed) AS BIGINT) AS rows_changed FROM log GROUP BY "column\"""")
add("audit_methods", lambda s, sf: RC.audit_methods(log(s, sf)), _L + """
SELECT method_type, method, count(*) AS operations, count(DISTINCT "column") AS columns, CAST(sum(rows_changed) AS BIGINT) AS rows_changed FROM log GROUP BY method_type, method""")


def _imputed(s, sf):
    number = F.when(F.col("column").isin("income", "age"), F.round(F.expr("try_cast(imputed_value AS double)"), 4))
    text = F.when(~F.col("column").isin("income", "age"), F.col("imputed_value"))
    return RC.audit_imputed(log(s, sf)).select("seq", "column", "method", number.alias("number"), text.alias("text"), "rows_imputed", "missing_after")


add("audit_imputed", _imputed, _L + f"""
SELECT seq, "column", method, CASE seq WHEN 1 THEN round({_MED}, 4) WHEN 2 THEN round((SELECT avg(age) FROM fx_survey), 4) END AS number,
  CASE seq WHEN 3 THEN 'Missing' WHEN 6 THEN {_MODE} END AS text, missing_before - missing_after AS rows_imputed, missing_after
FROM log WHERE method_type = 'missing_values' AND success""")

# --- charts -----------------------------------------------------------------

add("chart_bar_top20", lambda s, sf: CH.bar_top(lineitem(s, sf), "l_quantity"),
    "SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY l_quantity ORDER BY count DESC, value LIMIT 20")
add("chart_bar_xy", lambda s, sf: rnd(CH.bar_xy(lineitem(s, sf), "l_returnflag", "l_quantity"), 2),
    f"SELECT l_returnflag AS x, {r('sum(l_quantity)', 2)} AS y FROM lineitem GROUP BY l_returnflag")
add("chart_line", lambda s, sf: rnd(CH.line(gaps(s, sf), "price", ["row_id"], step=3), 3), _G + f"""
, p AS (SELECT price, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM fx_orders_gaps WHERE price IS NOT NULL)
SELECT pos // 3 AS point, min(pos) AS position, {r('avg(price)', 3)} AS value, count(*) AS rows FROM p GROUP BY point""")
add("chart_scatter", lambda s, sf: CH.scatter(gaps(s, sf), "price", "w", ["row_id"], color="priority"), _G + """
, p AS (SELECT price AS x, w AS y, priority AS color, row_number() OVER (ORDER BY row_id) - 1 AS position FROM fx_orders_gaps)
SELECT position, x, y, color FROM p""")
add("chart_box", lambda s, sf: rnd(CH.box(gaps(s, sf), "price_spiky"), 3), _G + f"""
, q AS (SELECT quantile_cont(price_spiky, 0.25) AS q1, quantile_cont(price_spiky, 0.5) AS q2, quantile_cont(price_spiky, 0.75) AS q3 FROM fx_orders_gaps),
f AS (SELECT *, q1 - 1.5E0 * (q3 - q1) AS lo, q3 + 1.5E0 * (q3 - q1) AS hi FROM q)
SELECT 'price_spiky' AS "column", {r('max(q1)', 3)} AS q1, {r('max(q2)', 3)} AS median, {r('max(q3)', 3)} AS q3, {r('max(lo)', 3)} AS lower_fence, {r('max(hi)', 3)} AS upper_fence,
  {r('min(price_spiky) FILTER (WHERE price_spiky BETWEEN lo AND hi)', 3)} AS whisker_low, {r('max(price_spiky) FILTER (WHERE price_spiky BETWEEN lo AND hi)', 3)} AS whisker_high,
  {r('avg(price_spiky)', 3)} AS mean, {r('stddev_samp(price_spiky)', 3)} AS std, count(*) FILTER (WHERE price_spiky IS NOT NULL AND NOT price_spiky BETWEEN lo AND hi) AS outliers FROM fx_orders_gaps, f""")
_H = """l AS (SELECT min(price) AS lo, count(price) AS n, least(50, count(price) // 10) AS k, (max(price) - min(price)) / least(50, count(price) // 10) AS wd FROM fx_orders_gaps),
h AS (SELECT CAST(least(floor((price - lo) / wd), k - 1) AS BIGINT) AS bin, any_value(lo) AS lo, any_value(wd) AS wd, any_value(n) AS n, count(*) AS c FROM fx_orders_gaps, l WHERE price IS NOT NULL GROUP BY 1),
q AS (SELECT avg(price) AS a, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM fx_orders_gaps)"""
add("chart_histogram", lambda s, sf: rnd(CH.histogram(gaps(s, sf), "price"), 3), cte("fx_orders_gaps", _H) + f"""
SELECT bin, {r('lo + bin * wd', 3)} AS bin_start, {r('lo + bin * wd + wd', 3)} AS bin_end, c AS count, {r('a', 3)} AS mean, {r('q2', 3)} AS median, {r('q1', 3)} AS q25, {r('q3', 3)} AS q75 FROM h, q""")
add("chart_density", lambda s, sf: rnd(CH.density(gaps(s, sf), "price"), 3, density=10), cte("fx_orders_gaps", _H) + f"""
SELECT bin, {r('lo + bin * wd', 3)} AS bin_start, c AS count, {r('c / (n * wd)', 10)} AS density, {r('q2', 3)} AS median, {r('q1', 3)} AS q25, {r('q3', 3)} AS q75 FROM h, q""")
add("chart_pie", lambda s, sf: rnd(CH.pie(survey(s, sf), "segment")), _S + f"""
SELECT segment AS value, n AS count, {r('100.0E0 * n / sum(n) OVER ()')} AS share_pct FROM (SELECT segment, count(*) AS n FROM fx_survey GROUP BY segment ORDER BY n DESC, segment LIMIT 15)""")

# --- reports ----------------------------------------------------------------


def metrics(s, sf):
    return Q.column_metrics(survey(s, sf), ["respondent_id"], YEAR)


_CELLS = " + ".join(f"count(*) - count({x})" for x in SCHEMAS["fx_survey"])
_K = len(SCHEMAS["fx_survey"])
add("report_executive", lambda s, sf: RP.executive(survey(s, sf), metrics(s, sf), log(s, sf)), cte("fx_survey", f"q AS ({scores_sql('fx_survey')})",
    f"d AS (SELECT count(*) AS n, {_CELLS} AS m FROM fx_survey)", "e AS (SELECT round(avg(score), 2) AS sc FROM q)", f"p AS (SELECT *, round(100.0E0 * m / (n * {_K}), 2) AS mp FROM d, e)") + f"""
SELECT n AS total_rows, CAST({_K} AS BIGINT) AS total_columns, m AS total_missing, mp AS missing_pct, CASE WHEN mp < 5 THEN 'low' WHEN mp < 15 THEN 'moderate' ELSE 'high' END AS missing_level,
  sc AS avg_quality_score, CASE WHEN sc >= 80 THEN 'acceptable' WHEN sc >= 60 THEN 'conditional' ELSE 'caution' END AS quality_status,
  CAST({len(_OPS)} AS BIGINT) AS total_operations, CAST({len({o[2] for o in _OPS})} AS BIGINT) AS columns_cleaned FROM p""")
add("report_methodology", lambda s, sf: RP.methodology(log(s, sf)).drop("purpose", "rationale", "applicability"), _L + """
SELECT method, count(*) AS operations, CAST(sum(rows_changed) AS BIGINT) AS rows_changed FROM log GROUP BY method""")
add("report_comprehensive", lambda s, sf: RP.comprehensive(survey(s, sf), metrics(s, sf), log(s, sf), YEAR, _DW))

_RULES = cte("fx_survey", "rv AS (SELECT count(*) AS n, " + ", ".join(f"{rule_total(x)} AS v_{x}" for x in _by_column()) + " FROM fx_survey)",
             "m AS (" + metrics_sql("fx_survey", "respondent_id", {x: f"(SELECT v_{x} FROM rv)" for x in _by_column()}) + ")")
_SHAPES = union(f"""SELECT '{x}' AS "column", avg(power(x - m, 3)) / nullif(power(avg(power(x - m, 2)), 1.5E0), 0) AS sk, avg(power(x - m, 4)) / nullif(power(avg(power(x - m, 2)), 2), 0) - 3 AS ku,
  abs(avg(x) - quantile_cont(x, 0.5)) / (stddev_samp(x) + 0.001E0) AS px FROM (SELECT CAST({x} AS DOUBLE) AS x, avg({x}) OVER () AS m FROM fx_survey)""" for x in numeric_of("fx_survey"))
add("report_issues", lambda s, sf: RP.issues(metrics(s, sf)).select("column", "issue"), _RULES + f""", k AS ({_SHAPES}), a AS (SELECT m.*, k.sk, k.ku, k.px FROM m LEFT JOIN k USING ("column"))
SELECT "column", 'missing' AS issue FROM a WHERE missing > 0
UNION ALL SELECT "column", 'use_median' FROM a WHERE is_numeric AND missing > 0 AND px > 0.5
UNION ALL SELECT "column", 'outliers' FROM a WHERE v1 > 0 UNION ALL SELECT "column", 'quality' FROM a WHERE score < 80
UNION ALL SELECT "column", 'skewed' FROM a WHERE abs(sk) > 1 UNION ALL SELECT "column", 'heavy_tails' FROM a WHERE abs(ku) > 3
UNION ALL SELECT "column", 'violations' FROM a WHERE violations > 0""")
