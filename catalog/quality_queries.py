"""Outlier, relation, quality and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SCHEMAS, YEAR, cte, gaps, messy, numeric_of, r, rnd, survey, table, text_of, union
from colprep.operators import outliers as O
from colprep.operators import quality as Q
from colprep.operators import relations as R
from colprep.operators import rules_cross as X
from colprep.operators import rules_single as S
from colprep.plans.recipe import operation_log
from catalog.recipes import SURVEY_RECIPE

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def joined(df, *arrays):
    """Array columns as comma-separated text, for plain comparison."""
    return df.withColumns({a: F.concat_ws(",", a) for a in arrays})


# --- outliers ---------------------------------------------------------------

def fit_sql(name: str, x: str) -> str:
    """One row of fitted limits for column ``x``."""
    return f"""(SELECT *, (SELECT quantile_cont(abs(CAST({x} AS DOUBLE) - med), 0.5) FROM {name}) AS mad FROM (
  SELECT count({x}) AS n, quantile_cont(CAST({x} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({x} AS DOUBLE), 0.75) AS q3,
    quantile_cont(CAST({x} AS DOUBLE), 0.5) AS med, avg({x}) AS mu, stddev_pop({x}) AS sp FROM {name}))"""


IQR = "coalesce(n >= 5 AND (x < q1 - 1.5E0 * (q3 - q1) OR x > q3 + 1.5E0 * (q3 - q1)), false)"
ZSC = "coalesce(n >= 10 AND sp > 0 AND abs((x - mu) / sp) > 3, false)"
MZS = "coalesce(n >= 10 AND mad > 0 AND abs(0.6745E0 * (x - med) / mad) > 3.5, false)"


def flags_sql(name: str, x: str, keep: str = "") -> str:
    return f"""(SELECT {keep} x, n, q1, q3, {IQR} AS f1, {ZSC} AS f2, {MZS} AS f3
  FROM (SELECT {keep} CAST({x} AS DOUBLE) AS x FROM {name}), {fit_sql(name, x)})"""


_GAP_NUM = numeric_of("fx_orders_gaps")
_OUT = ["price", "price_spiky", "signed_qty", "constant_col", "w", "row_id"]


def _method(i, need, bounds=""):
    return cte("fx_orders_gaps") + union(
        f"""SELECT '{x}' AS "column", count(*) FILTER (WHERE f{i}) AS outlier_count, {r(f'100.0E0 * count(*) FILTER (WHERE f{i}) / max(n)')} AS outlier_pct{bounds}
FROM {flags_sql('fx_orders_gaps', x)} HAVING max(n) >= {need}""" for x in _GAP_NUM)


add("outlier_iqr", lambda s, sf: rnd(O.outlier_method(gaps(s, sf), "iqr"), 6, lower_bound=3, upper_bound=3),
    _method(1, 5, f", {r('max(q1 - 1.5E0 * (q3 - q1))', 3)} AS lower_bound, {r('max(q3 + 1.5E0 * (q3 - q1))', 3)} AS upper_bound"))
add("outlier_zscore", lambda s, sf: rnd(O.outlier_method(gaps(s, sf), "zscore")), _method(2, 10))
add("outlier_modified_z", lambda s, sf: rnd(O.outlier_method(gaps(s, sf), "modified_zscore")), _method(3, 10))
add("outlier_status", lambda s, sf: O.outlier_status(gaps(s, sf)), cte("fx_orders_gaps") + union(
    f"""SELECT '{x}' AS "column", count({x}) AS non_null, """
    + ("'not_applicable'" if t in ("string", "timestamp_ntz") else f"CASE WHEN count({x}) < 5 THEN 'insufficient_data' WHEN count({x}) < 10 THEN 'iqr_only' ELSE 'all_methods' END")
    + " AS status FROM fx_orders_gaps" for x, t in SCHEMAS["fx_orders_gaps"].items()))

_PCT = "100.0E0 * greatest(c1, c2, c3) / n"
SEVERITY = f"CASE WHEN {_PCT} > 10 THEN 'high' WHEN {_PCT} > 5 THEN 'moderate' ELSE 'low' END"


def counts_sql(name, x):
    return f"""(SELECT max(n) AS n, count(*) FILTER (WHERE f1) AS c1, count(*) FILTER (WHERE f2) AS c2, count(*) FILTER (WHERE f3) AS c3,
    count(*) FILTER (WHERE f1::INT + f2::INT + f3::INT >= 2) AS v2, count(*) FILTER (WHERE f1 OR f2 OR f3) AS v1, count(*) FILTER (WHERE f1 AND f2) AS both12
  FROM {flags_sql(name, x)})"""


add("outlier_consensus",
    lambda s, sf: rnd(O.outlier_summary(gaps(s, sf), _OUT).drop("lower_bound", "upper_bound")),
    cte("fx_orders_gaps") + union(
        f"""SELECT '{x}' AS "column", n AS non_null, c1 AS iqr_count, c2 AS zscore_count, c3 AS modified_zscore_count, v2 AS consensus_rows,
  v1 AS flagged_rows, {r(_PCT)} AS max_pct, {SEVERITY} AS severity, both12 > 0 AS methods_agree FROM {counts_sql('fx_orders_gaps', x)}""" for x in _OUT))

add("outlier_rows", lambda s, sf: joined(O.outlier_rows(gaps(s, sf), "price_spiky", ["row_id"]), "methods"), cte("fx_orders_gaps")
    + f"""SELECT row_id, x AS value, concat_ws(',', CASE WHEN f1 THEN 'iqr' END, CASE WHEN f2 THEN 'zscore' END, CASE WHEN f3 THEN 'modified_zscore' END) AS methods,
  CAST(f1::INT + f2::INT + f3::INT AS BIGINT) AS votes FROM {flags_sql('fx_orders_gaps', 'price_spiky', 'row_id,')} WHERE f1 OR f2 OR f3""")

# --- relations --------------------------------------------------------------

_SNUM = numeric_of("fx_survey")
_PAIRS = [(a, b) for i, a in enumerate(_SNUM) for b in _SNUM[i + 1:]]


def pairs_sql(name="fx_survey", pairs=_PAIRS):
    return union(f"SELECT '{a}' AS column1, '{b}' AS column2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {name}" for a, b in pairs)


def both_sql():
    return f"(SELECT column1 AS a, column2 AS b, r FROM p UNION ALL SELECT column2, column1, r FROM p)"


add("corr_top5", lambda s, sf: rnd(R.top_correlations(survey(s, sf))), cte("fx_survey", f"p AS ({pairs_sql()})") + f"""
SELECT a AS "column", b AS other, {r('r')} AS r, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) AS rk FROM {both_sql()} WHERE abs(r) > 0.1) WHERE rk <= 5""")
add("corr_matrix", lambda s, sf: rnd(R.correlation_matrix(survey(s, sf))), cte("fx_survey", f"p AS ({pairs_sql()})") + f"""
SELECT a AS column1, b AS column2, {r('r')} AS r FROM {both_sql()} UNION ALL
""" + union(f"SELECT '{x}', '{x}', CASE WHEN stddev_samp({x}) > 0 THEN 1.0E0 END FROM fx_survey" for x in _SNUM))
add("corr_high_pairs", lambda s, sf: R.high_pairs(survey(s, sf)), cte("fx_survey", f"p AS ({pairs_sql()})")
    + "SELECT column1, column2, round(r, 3) AS correlation FROM p WHERE abs(r) > 0.7")

# --- quality ----------------------------------------------------------------

_CLASS = """CASE WHEN regexp_matches({x}, '^\\s*[+-]?\\d+\\s*$') THEN 'int' WHEN regexp_matches({x}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN 'float'
 WHEN lower(trim({x})) IN ('true','false','yes','no') THEN 'bool' WHEN regexp_matches({x}, '^\\s*\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}') THEN 'date' ELSE 'text' END"""
_KINDS = ("int", "float", "bool", "date", "text")


def mixed_sql(name, x):
    return (f"(SELECT " + ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS {k}_values" for k in _KINDS)
            + f" FROM (SELECT {_CLASS.format(x=x)} AS k FROM {name} WHERE {x} IS NOT NULL))")


_CLASSES = " + ".join(f"({k}_values > 0)::BIGINT" for k in _KINDS)
_MESSY_TEXT = ["label_raw", "amount_raw", "date_raw", "name_raw"]
add("quality_mixed_content", lambda s, sf: Q.mixed_content(messy(s, sf)), cte("fx_messy_text") + union(
    f"""SELECT '{x}' AS "column", {', '.join(f'{k}_values' for k in _KINDS)}, {_CLASSES} AS classes, {_CLASSES} > 1 AS is_mixed FROM {mixed_sql('fx_messy_text', x)}"""
    for x in _MESSY_TEXT))


def score_sql(name, x, t):
    mixed = f"(SELECT {_CLASSES} > 1 FROM {mixed_sql(name, x)})" if t == "string" else "false"
    return f"""(SELECT *, CASE WHEN mp > 50 THEN 40 WHEN mp > 20 THEN 20 WHEN mp > 5 THEN 10 ELSE 0 END + CASE WHEN mixed THEN 15 ELSE 0 END
    + CASE WHEN NOT (up > 95 AND n > 100) AND up < 1 THEN 10 ELSE 0 END AS penalty
  FROM (SELECT count(*) AS n, 100.0E0 * (count(*) - count({x})) / count(*) AS mp, 100.0E0 * count(DISTINCT {x}) / count(*) AS up, {mixed} AS mixed FROM {name}))"""


SCORE = "CAST(greatest(0, 100 - penalty) AS BIGINT)"
GRADE = f"CASE WHEN {SCORE} >= 90 THEN 'A' WHEN {SCORE} >= 80 THEN 'B' WHEN {SCORE} >= 70 THEN 'C' WHEN {SCORE} >= 60 THEN 'D' ELSE 'F' END"
_ISSUES = """concat_ws(',', CASE WHEN mp > 50 THEN 'high_missing' WHEN mp > 20 THEN 'moderate_missing' WHEN mp > 5 THEN 'low_missing' END, CASE WHEN mixed THEN 'mixed_types' END,
  CASE WHEN up > 95 AND n > 100 THEN 'possible_identifier' END, CASE WHEN NOT (up > 95 AND n > 100) AND up < 1 THEN 'low_uniqueness' END)"""


def scores_sql(name):
    return union(
        f"""SELECT '{x}' AS "column", {r('mp')} AS missing_pct, {r('up')} AS unique_pct, {SCORE} AS score, {GRADE} AS grade, {_ISSUES} AS issues FROM {score_sql(name, x, t)}"""
        for x, t in SCHEMAS[name].items())


add("quality_score", lambda s, sf: rnd(joined(Q.quality_score(survey(s, sf)), "issues")), cte("fx_survey") + scores_sql("fx_survey"))
add("quality_identifier", lambda s, sf: rnd(Q.identifier_columns(survey(s, sf))), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", {r('up')} AS unique_pct, up > 95 AND n > 100 AS possible_identifier FROM {score_sql('fx_survey', x, t)}"""
    for x, t in SCHEMAS["fx_survey"].items()))
add("quality_grades", lambda s, sf: rnd(Q.quality_grades(survey(s, sf))), cte("fx_survey", f"q AS ({scores_sql('fx_survey')})")
    + f"SELECT grade, count(*) AS columns, {r('avg(score)')} AS avg_score FROM q GROUP BY grade")


def validate_sql(name):
    def one(x, t):
        numeric = t in ("bigint", "int", "double")
        out = f"(SELECT count(*) FILTER (WHERE f1) FROM {flags_sql(name, x).replace('n >= 5 AND', 'n > 0 AND')})" if numeric else "0"
        inf = f"count(*) FILTER (WHERE isinf(CAST({x} AS DOUBLE)))" if numeric else "0"
        text = f"""CASE WHEN nn > 0 AND d = n THEN 'all_unique' END, CASE WHEN nn > 0 AND rare > d * 0.5E0 THEN 'many_rare_values' END,""" if t == "string" else ""
        return f"""SELECT '{x}' AS "column", n AS rows, n - nn AS missing, {r('100.0E0 * (n - nn) / n')} AS missing_pct, d AS unique_count, CAST(dup AS BIGINT) AS duplicate_count,
  {r('coalesce(100.0E0 * o / nullif(nn, 0), 0.0E0)')} AS outlier_pct,
  concat_ws(',', CASE WHEN 100.0E0 * (n - nn) / n > 10 THEN 'high_missing' END, CASE WHEN inf > 0 THEN 'infinite_values' END) AS issues,
  concat_ws(',', CASE WHEN 100.0E0 * (n - nn) / n > 5 AND 100.0E0 * (n - nn) / n <= 10 THEN 'moderate_missing' END,
    CASE WHEN coalesce(100.0E0 * o / nullif(nn, 0), 0) > 5 THEN 'many_outliers' END, {text} CASE WHEN dup > n * 0.1E0 THEN 'high_duplicates' END) AS warnings,
  NOT (100.0E0 * (n - nn) / n > 10 OR inf > 0) AS passed
FROM (SELECT count(*) AS n, count({x}) AS nn, {inf} AS inf FROM {name}),
  (SELECT count(v) AS d, coalesce(sum(k) FILTER (WHERE k > 1), 0) AS dup, count(v) FILTER (WHERE k < t * 0.01E0) AS rare FROM (SELECT {x} AS v, count(*) AS k, sum(count(*)) OVER () AS t FROM {name} GROUP BY {x})),
  (SELECT {out} AS o)"""
    return union(one(x, t) for x, t in SCHEMAS[name].items())


add("validate_column", lambda s, sf: rnd(joined(Q.validate_columns(gaps(s, sf)), "issues", "warnings")), cte("fx_orders_gaps") + validate_sql("fx_orders_gaps"))
_COUNT = "CASE WHEN {k} = '' THEN 0 ELSE len(string_split({k}, ',')) END"
add("validate_dataset", lambda s, sf: rnd(joined(Q.validate_dataset(gaps(s, sf)), "critical_issues", "recommendations")),
    cte("fx_orders_gaps", f"v AS ({validate_sql('fx_orders_gaps')})", f"""t AS (SELECT CAST(sum({_COUNT.format(k='issues')}) AS BIGINT) AS i, CAST(sum({_COUNT.format(k='warnings')}) AS BIGINT) AS w,
  bool_and(passed) AS passed, 100.0E0 * sum(missing) / sum(rows) AS mp FROM v)""") + f"""
SELECT i AS total_issues, w AS total_warnings, passed, {r('mp')} AS missing_pct,
  (SELECT string_agg(concat("column", ': ', e), ',' ORDER BY concat("column", ': ', e)) FROM (SELECT "column", unnest(string_split(issues, ',')) AS e FROM v WHERE issues <> '')) AS critical_issues,
  concat_ws(',', CASE WHEN i > 0 THEN 'review_critical_issues' END, CASE WHEN w > 0 THEN 'address_warnings' END, CASE WHEN mp > 10 THEN 'additional_cleaning' END) AS recommendations FROM t""")

# --- metrics-based tables ---------------------------------------------------

def metrics_sql(name, order, rules=None):
    """CTE body ``m``: one row per column with the inputs of the metric tables."""
    rules = rules or {}

    def one(x, t):
        numeric = t in ("bigint", "int", "double")
        counts = counts_sql(name, x) if numeric else "(SELECT 0 AS n, 0 AS c1, 0 AS c2, 0 AS c3, 0 AS v2, 0 AS v1, 0 AS both12)"
        return f"""SELECT '{x}' AS "column", {str(numeric).lower()} AS is_numeric, s.n AS rows, s.mp AS missing_pct, {SCORE} AS score, {GRADE} AS grade, {_ISSUES.replace(' n >', ' s.n >')} AS issues,
  o.c1, o.c2, o.c3, o.v1, CASE WHEN o.n > 0 THEN {SEVERITY.replace('/ n', '/ nullif(o.n, 0)')} ELSE 'low' END AS severity, o.n >= 5 AS measured, g.m AS missing, g.pattern, g.run AS max_run, {rules.get(x, 'CAST(0 AS BIGINT)')} AS violations
FROM {score_sql(name, x, t)} s, {counts} o, (SELECT m, CAST(coalesce(run, 0) AS BIGINT) AS run,
  CASE WHEN m = 0 THEN 'none' WHEN 100.0E0 * m / n < 5 THEN 'sporadic' WHEN run > n * 0.1E0 THEN 'systematic_blocks'
    WHEN f > l * 2 THEN 'front_loaded' WHEN l > f * 2 THEN 'tail_loaded' ELSE 'random' END AS pattern
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS m,
    count(*) FILTER (WHERE x IS NULL AND pos < floor(c * 0.1E0)) AS f, count(*) FILTER (WHERE x IS NULL AND pos >= floor(c * 0.9E0)) AS l
  FROM (SELECT row_number() OVER (ORDER BY {order}) - 1 AS pos, {x} AS x, count(*) OVER () AS c FROM {name})),
  (SELECT max(k) AS run FROM (SELECT count(*) AS k FROM (SELECT pos - row_number() OVER (ORDER BY pos) AS island FROM
    (SELECT row_number() OVER (ORDER BY {order}) - 1 AS pos, {x} AS x FROM {name}) WHERE x IS NULL) GROUP BY island))) g"""
    return union(one(x, t) for x, t in SCHEMAS[name].items())


def gap_metrics(s, sf):
    return Q.column_metrics(gaps(s, sf), ["row_id"], YEAR)


_ADVICE = [
    ("missing_values", "median_imputation", "high", 3, 85, "missing_pct > 0 AND missing_pct < 5 AND is_numeric"),
    ("missing_values", "knn_imputation", "medium", 2, 75, "missing_pct > 0 AND missing_pct < 5 AND is_numeric"),
    ("missing_values", "mode_imputation", "high", 3, 80, "missing_pct > 0 AND missing_pct < 5 AND NOT is_numeric"),
    ("missing_values", "interpolation", "high", 3, 70, "missing_pct >= 5 AND missing_pct < 20 AND pattern = 'systematic_blocks'"),
    ("missing_values", "regression_imputation", "medium", 2, 75, "missing_pct >= 5 AND missing_pct < 20 AND pattern <> 'systematic_blocks'"),
    ("missing_values", "missing_category", "high", 3, 90, "missing_pct >= 20"),
    ("outliers", "winsorization", "high", 3, 85, "measured AND severity = 'high'"),
    ("outliers", "iqr_removal", "medium", 2, 60, "measured AND severity = 'high'"),
    ("outliers", "log_transformation", "medium", 2, 75, "measured AND severity = 'moderate'"),
    ("data_quality", "type_standardization", "high", 3, 95, "score < 70 AND contains(issues, 'mixed_types')"),
]
add("recommend", lambda s, sf: Q.recommend(gaps(s, sf), ["row_id"], YEAR).drop("description", "pros", "cons"),
    cte("fx_orders_gaps", f"m AS ({metrics_sql('fx_orders_gaps', 'row_id')})", "a AS (" + union(
        f"""SELECT "column", '{t}' AS method_type, '{k}' AS method, '{p}' AS priority, {w} AS weight, CAST({ap} AS BIGINT) AS applicability,
  {'is_numeric' if k == 'missing_category' else 'false'} AS changes_type, {i} AS pos FROM m WHERE {cond}""" for i, (t, k, p, w, ap, cond) in enumerate(_ADVICE)) + ")") + """
SELECT "column", method_type, method, priority, applicability, changes_type, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY weight DESC, applicability DESC, pos) AS rk FROM a) WHERE rk <= 10""")

add("issue_digest", lambda s, sf: Q.issue_digest(gap_metrics(s, sf)))
add("priority_table", lambda s, sf: rnd(Q.priority_table(gap_metrics(s, sf))), cte("fx_orders_gaps", f"m AS ({metrics_sql('fx_orders_gaps', 'row_id')})")
    + f"""SELECT "column", {r('missing_pct')} AS missing_pct, score, severity AS outlier_severity FROM m""")

# --- single-column rules ----------------------------------------------------

_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
_PHONE = r"^[\+]?[1-9][\d\s\-\(\)]{6,}$"
_POSTAL = r"^[A-Z0-9\s\-]{3,10}$"
_GENDERS = "('male','m','female','f','other','non-binary','prefer not to say','unknown')"
_YESNO = "('yes','y','no','n','true','false','1','0')"
# rule -> column -> violation condition in SQL
RULE_SQL = {
    "age": {"age": "age < 0 OR age > 120"},
    "birth_year": {"birth_year": "birth_year < 1900 OR birth_year > 2026"},
    "percentage": {"completion_percent": "completion_percent < 0 OR completion_percent > 100"},
    "score": {x: f"{x} < 0" for x in ("score_a", "score_b", "total_score")},
    "income": {x: f"{x} < 0" for x in ("income", "household_income")},
    "email": {"email": f"NOT regexp_matches(email, '{_EMAIL}')"},
    "phone": {"phone": f"NOT regexp_matches(phone, '{_PHONE}')"},
    "postal": {"zip": f"NOT regexp_matches(upper(zip), '{_POSTAL}')"},
    "gender": {"gender": f"lower(gender) NOT IN {_GENDERS}"},
    "yes_no": {"consent_flag": f"lower(consent_flag) NOT IN {_YESNO}"},
}


def _rule(rule):
    return lambda s, sf: S.rule_counts(survey(s, sf), YEAR).where(F.col("rule") == rule)


for _name, _cols in RULE_SQL.items():
    add(f"rule_{_name}", _rule(_name), cte("fx_survey") + union(
        f"""SELECT '{x}' AS "column", '{_name}' AS rule, count(*) FILTER (WHERE {cond}) AS violations, count(*) AS rows FROM fx_survey""" for x, cond in _cols.items()))

add("rule_non_ascii", lambda s, sf: S.rule_counts(table(s, sf, "documents"), YEAR, columns=["text", "lang", "source"]), union(
    f"""SELECT '{x}' AS "column", 'non_ascii' AS rule, count(*) FILTER (WHERE regexp_matches({x}, '[^\\x00-\\x7F]')) AS violations, count(*) AS rows FROM documents"""
    for x in ("text", "lang", "source")))


def _by_column():
    found = {}
    for rule, cols in RULE_SQL.items():
        for x, cond in cols.items():
            found.setdefault(x, []).append((rule, cond))
    for x in text_of("fx_survey"):
        found.setdefault(x, []).append(("non_ascii", f"regexp_matches({x}, '[^\\x00-\\x7F]')"))
    return found


def rule_total(x):
    return "(" + " + ".join(f"count(*) FILTER (WHERE {cond})" for _, cond in _by_column()[x]) + ")"


_SEV = "CASE WHEN v > n * 0.1E0 THEN 'high' WHEN v > n * 0.05E0 THEN 'moderate' ELSE 'low' END"
add("rule_severity", lambda s, sf: rnd(joined(S.rule_severity(survey(s, sf), YEAR), "rules")), cte("fx_survey") + union(
    f"""SELECT '{x}' AS "column", v AS violations, {r('100.0E0 * v / n')} AS violation_pct, {_SEV} AS severity, rules FROM (
  SELECT {rule_total(x)} AS v, count(*) AS n, concat_ws(',', {', '.join(f"CASE WHEN count(*) FILTER (WHERE {cond}) > 0 THEN '{rule}' END" for rule, cond in sorted(checks))}) AS rules FROM fx_survey)"""
    for x, checks in _by_column().items()))

add("rule_samples", lambda s, sf: S.rule_samples(survey(s, sf), ["respondent_id"], YEAR), cte("fx_survey") + union(
    f"""SELECT * FROM (SELECT respondent_id, '{x}' AS "column", '{rule}' AS rule, CAST({x} AS VARCHAR) AS value, CAST(row_number() OVER (ORDER BY respondent_id) AS INTEGER) AS rank
  FROM fx_survey WHERE {cond}) WHERE rank <= {5 if rule == 'non_ascii' else 10}""" for x, checks in _by_column().items() for rule, cond in checks))

add("anomaly_summary", lambda s, sf: Q.anomaly_summary(Q.column_metrics(survey(s, sf), ["respondent_id"], YEAR)),
    cte("fx_survey", "rv AS (SELECT count(*) AS n, " + ", ".join(f"{rule_total(x)} AS v_{x}" for x in _by_column()) + " FROM fx_survey)",
        "m AS (" + metrics_sql("fx_survey", "respondent_id", {x: f"(SELECT v_{x} FROM rv)" for x in _by_column()}) + ")") + """
SELECT "column", c1 AS iqr_count, c2 AS zscore_count, c3 AS modified_zscore_count, c1 + c2 + c3 AS total_outliers, severity AS outlier_severity, missing, pattern,
  violations, CASE WHEN violations > rows * 0.1E0 THEN 'high' WHEN violations > rows * 0.05E0 THEN 'moderate' ELSE 'low' END AS violation_severity,
  c1 + c2 + c3 + missing + violations AS total_anomalies FROM m""")

# --- cross-column rules -----------------------------------------------------

_Q1, _Q3 = ("(SELECT quantile_cont({i}, %s) FROM fx_survey)" % q for q in ("0.25", "0.75"))


def _edu(i):
    return f"""(regexp_matches(lower(education), '\\b(?:master|phd|doctorate|graduate)\\b') AND {i} < {_Q1.format(i=i)}) OR (regexp_matches(lower(education), '\\b(?:high school|elementary|primary)\\b') AND {i} > {_Q3.format(i=i)})"""


CROSS_SQL = {
    "age_birth": {"age,birth_year": "abs(age - (2026 - birth_year)) > 2"},
    "dates": {"start_date,end_date": "try_strptime(end_date, '%Y-%m-%d') < try_strptime(start_date, '%Y-%m-%d')"},
    "edu_income": {f"education,{i}": _edu(i) for i in ("income", "household_income")},
    "gender_title": {"gender,title": "(lower(gender) IN ('male','m') AND lower(title) IN ('mrs','ms')) OR (lower(gender) IN ('female','f') AND lower(title) = 'mr')"},
    "age_retired": {"age,retired": "(age < 50 AND regexp_matches(lower(retired), '\\b(?:yes|retired|true)\\b') AND NOT regexp_matches(lower(retired), '\\bnot retired\\b')) OR (age > 70 AND regexp_matches(lower(retired), '\\b(?:no|working|false)\\b'))"},
    "household_income": {"income,household_income": "income > household_income"},
    "education": {"education": "regexp_matches(lower(education), 'phd.*high school|doctorate.*elementary')"},
    "total_parts": {"total_score,score_a,score_b": "abs(total_score - (coalesce(score_a, 0) + coalesce(score_b, 0))) > (SELECT 0.01E0 * stddev_samp(total_score) FROM fx_survey)"},
    "required_pair": {f"{a},{b}": f"{a} IS NOT NULL AND {b} IS NULL" for a, b in (("email", "phone"), ("start_date", "end_date"), ("income", "employment"), ("household_income", "employment"))},
    "income_unemployed": {f"{i},employment": f"{i} > 0 AND regexp_matches(lower(employment), '\\b(?:unemployed|not working|retired)\\b') AND NOT regexp_matches(lower(employment), '\\bnot retired\\b')" for i in ("income", "household_income")},
    "children": {"children,family_size": "children > family_size"},
    "married_young": {"marital,age": "regexp_matches(lower(marital), '\\b(?:married|spouse)\\b') AND age < 16"},
}


def _cross(rule):
    return lambda s, sf: X.cross_counts(survey(s, sf), YEAR, rules=[rule])


for _name, _cols in CROSS_SQL.items():
    if _name != "required_pair":
        add(f"xrule_{_name}", _cross(_name), cte("fx_survey") + union(
            f"""SELECT '{_name}' AS rule, '{x}' AS columns, count(*) FILTER (WHERE {cond}) AS violations, count(*) AS rows FROM fx_survey""" for x, cond in _cols.items()))

def _employment(spark, sf):
    orders = table(spark, sf, "orders")
    shift = (F.col("o_orderkey") % 7 - 2).cast("int") * 5
    df = orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("employment_start"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), shift), "yyyy-MM-dd").alias("employment_finish"),
    )
    return X.cross_counts(df, YEAR, rules=["employment_dates"])


add("xrule_employment_dates", _employment, """SELECT 'employment_dates' AS rule, 'employment_start,employment_finish' AS columns,
  count(*) FILTER (WHERE CAST(o_orderdate AS DATE) + CAST((o_orderkey % 7 - 2) * 5 AS INTEGER) < o_orderdate) AS violations, count(*) AS rows FROM orders""")

_ALL = [cond for cols in CROSS_SQL.values() for cond in cols.values()]
add("xrule_rows", lambda s, sf: X.cross_violations(survey(s, sf), ["respondent_id"], YEAR), cte("fx_survey") + union(
    f"""SELECT respondent_id, '{rule}' AS rule, '{x}' AS columns FROM fx_survey WHERE {cond}""" for rule, cols in CROSS_SQL.items() for x, cond in cols.items()))
add("xrule_summary", lambda s, sf: X.cross_summary(survey(s, sf), YEAR),
    cte("fx_survey", "c AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {cond}) AS v{i}" for i, cond in enumerate(_ALL))
        + ", count(*) FILTER (WHERE " + " OR ".join(f"coalesce({cond}, false)" for cond in _ALL) + ") AS hit, count(*) FILTER (WHERE income IS NULL) AS comiss FROM fx_survey)")
    + "SELECT t AS total_violations, k AS violated_checks, hit AS affected_rows, CASE WHEN t > n * 0.1E0 THEN 'high' WHEN t > n * 0.05E0 THEN 'moderate' ELSE 'low' END AS severity FROM (SELECT n, hit, "
    + " + ".join(f"v{i}" for i in range(len(_ALL))) + " + comiss AS t, " + " + ".join(f"(v{i} > 0)::BIGINT" for i in range(len(_ALL))) + " + 1 AS k FROM c)")


def _next_steps(spark, sf):
    df = survey(spark, sf)
    analysed = [x for x in df.columns if x not in ("segment", "title")]
    metrics = Q.column_metrics(df.select(analysed), ["respondent_id"], YEAR)
    return Q.next_steps(df.columns, metrics, operation_log(df, SURVEY_RECIPE))


_CLEANED = sorted({op.column for op in SURVEY_RECIPE.operations})
add("next_steps", _next_steps, cte("fx_survey", f"q AS ({scores_sql('fx_survey')})") + f"""
SELECT 'analysis' AS step, 'high' AS priority, CAST(2 AS BIGINT) AS columns_affected, 'segment,title' AS columns
UNION ALL SELECT 'cleaning', 'medium', count(*), string_agg("column", ',' ORDER BY "column") FROM q WHERE "column" NOT IN ({', '.join(f"'{x}'" for x in _CLEANED)})
UNION ALL SELECT 'quality', 'high', count(*), string_agg("column", ',' ORDER BY "column") FROM q WHERE score < 70 AND "column" NOT IN ('segment', 'title') HAVING count(*) > 0
UNION ALL SELECT 'validation', 'medium', CAST({len(_CLEANED)} AS BIGINT), '{','.join(_CLEANED)}'""")
