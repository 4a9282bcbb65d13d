"""Cleaning, standardization and impact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import cte, gaps, messy, r, rnd, survey, table, union
from colprep.operators import cleaning as C
from colprep.operators import impact as I

QUERIES, ORACLE = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def apply(df, column, kind, name, /, **params):
    """Key, value before and value after."""
    return C.fit_method(df, column, kind, name, params).transform(df, "after")


def cleaned(fixture, key, column, kind, name, dp=4, /, **params):
    def query(spark, sf):
        out = apply(fixture(spark, sf), column, kind, name, **params)
        return rnd(out.select(key, F.col(column).alias("before"), "after"), dp)

    return query


_G = cte("fx_orders_gaps")
_S = cte("fx_survey")
_M = cte("fx_messy_text")
MISSING, OUTLIERS, QUALITY = "missing_values", "outliers", "data_quality"
_MED = "(SELECT quantile_cont({x}, 0.5) FROM fx_orders_gaps)"


def gap_sql(x, after, dp=4):
    return _G + f"SELECT row_id, {r(x, dp)} AS before, {r(after, dp)} AS after FROM fx_orders_gaps"


# --- imputation -------------------------------------------------------------

add("clean_mean", cleaned(gaps, "row_id", "price", MISSING, "mean_imputation", 3),
    gap_sql("price", "coalesce(price, (SELECT avg(price) FROM fx_orders_gaps))", 3))
add("clean_median", cleaned(gaps, "row_id", "price", MISSING, "median_imputation"), gap_sql("price", f"coalesce(price, {_MED.format(x='price')})"))
_MODE = "(SELECT priority FROM fx_orders_gaps WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"
add("clean_mode", cleaned(gaps, "row_id", "priority", MISSING, "mode_imputation"),
    _G + f"SELECT row_id, priority AS before, coalesce(priority, {_MODE}) AS after FROM fx_orders_gaps")
_HELD = "FROM fx_orders_gaps WHERE {x} IS NOT NULL AND w IS NOT NULL"
add("clean_mean_weighted", cleaned(gaps, "row_id", "price", MISSING, "mean_imputation", 3, weights="w"),
    gap_sql("price", f"coalesce(price, (SELECT sum(price * w) / sum(w) {_HELD.format(x='price')}))", 3))
add("clean_median_weighted", cleaned(gaps, "row_id", "price", MISSING, "median_imputation", weights="w"),
    _G + f""", v AS (SELECT price AS x, sum(w) AS w {_HELD.format(x='price')} GROUP BY price), k AS (SELECT x, sum(w) OVER (ORDER BY x) AS cum, sum(w) OVER () AS total FROM v)
SELECT row_id, {r('price', 4)} AS before, {r('coalesce(price, (SELECT min(x) FROM k WHERE cum >= 0.5 * total * (1 - 1e-12)))', 4)} AS after FROM fx_orders_gaps""")
add("clean_mode_weighted", cleaned(gaps, "row_id", "priority", MISSING, "mode_imputation", weights="w"),
    _G + f"SELECT row_id, priority AS before, coalesce(priority, (SELECT priority {_HELD.format(x='priority')} GROUP BY priority ORDER BY sum(w) DESC, priority LIMIT 1)) AS after FROM fx_orders_gaps")
add("clean_ffill", cleaned(gaps, "row_id", "price", MISSING, "forward_fill", order_by=["row_id"], buckets=16),
    gap_sql("price", f"coalesce(last_value(price IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING), {_MED.format(x='price')})"))
add("clean_ffill_text", cleaned(gaps, "row_id", "priority", MISSING, "forward_fill", order_by=["row_id"]),
    _G + f"SELECT row_id, priority AS before, coalesce(last_value(priority IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING), {_MODE}) AS after FROM fx_orders_gaps")
def _hosts(spark, sf):
    """Pages with their host, which two of three rows lack."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return table(spark, sf, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, host).alias("host"))


add("clean_ffill_text_key", cleaned(_hosts, "page_id", "host", MISSING, "forward_fill", order_by=["url", "page_id"]), """
WITH h AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '://([^/]*)', 1) END AS host FROM pages),
m AS (SELECT host FROM h WHERE host IS NOT NULL GROUP BY host ORDER BY count(*) DESC, host LIMIT 1)
SELECT page_id, host AS before, coalesce(last_value(host IGNORE NULLS) OVER (ORDER BY url NULLS FIRST, page_id ROWS UNBOUNDED PRECEDING), (SELECT host FROM m)) AS after FROM h""")
add("clean_bfill", cleaned(gaps, "row_id", "price", MISSING, "backward_fill", order_by=["row_id"], buckets=16),
    gap_sql("price", f"coalesce(first_value(price IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), {_MED.format(x='price')})"))


def _neighbours(x, at="pos"):
    """Previous and next observed value with their place on the axis."""
    axis = "row_number() OVER (ORDER BY row_id) - 1.0E0" if at == "pos" else "epoch_us(o_orderdate)"
    return _G + f""", a AS (SELECT row_id, o_orderdate, {x} AS x, {axis} AS ax FROM fx_orders_gaps),
p AS (SELECT *, CASE WHEN x IS NOT NULL THEN ax END AS seen FROM a),
n AS (SELECT row_id, x, CAST(ax AS DOUBLE) AS ax,
  last_value(x IGNORE NULLS) OVER w AS pv, CAST(last_value(seen IGNORE NULLS) OVER w AS DOUBLE) AS pa,
  first_value(x IGNORE NULLS) OVER f AS nv, CAST(first_value(seen IGNORE NULLS) OVER f AS DOUBLE) AS na, quantile_cont(x, 0.5) OVER () AS med FROM p
  WINDOW w AS (ORDER BY {{order}} ROWS UNBOUNDED PRECEDING), f AS (ORDER BY {{order}} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


def _interp(rule, x="price", at="pos", order="row_id"):
    return _neighbours(x, at).format(order=order) + f"SELECT row_id, {r('x', 4)} AS before, {r(f'coalesce(x, {rule})', 4)} AS after FROM n"


_LINE = "pv + (nv - pv) * coalesce((ax - pa) / nullif(na - pa, 0), 0)"
add("clean_interpolate", cleaned(gaps, "row_id", "price", MISSING, "interpolation", order_by=["row_id"], buckets=16), _interp(f"{_LINE}, pv, med"))
add("clean_interp_nearest", cleaned(gaps, "row_id", "price", MISSING, "interpolation", method="nearest", order_by=["row_id"]),
    _interp("CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN CASE WHEN ax - pa <= na - ax THEN pv ELSE nv END END, med"))
add("clean_interp_zero", cleaned(gaps, "row_id", "price", MISSING, "interpolation", method="zero", order_by=["row_id"]),
    _interp("CASE WHEN nv IS NOT NULL THEN pv END, med"))
add("clean_interp_slinear", cleaned(gaps, "row_id", "price", MISSING, "interpolation", method="slinear", order_by=["row_id"]), _interp(f"{_LINE}, med"))
add("clean_interp_cubic", cleaned(gaps, "row_id", "price", MISSING, "interpolation", method="cubic", order_by=["row_id"]))
add("clean_interp_time", cleaned(gaps, "row_id", "price", MISSING, "interpolation", method="time", order_by=["o_orderdate", "row_id"]),
    _interp(f"{_LINE}, pv, med", at="time", order="o_orderdate, row_id"))
add("clean_category", cleaned(gaps, "row_id", "priority", MISSING, "missing_category", category_name="Missing"),
    _G + "SELECT row_id, priority AS before, coalesce(priority, 'Missing') AS after FROM fx_orders_gaps")
add("clean_regression", cleaned(survey, "respondent_id", "income", MISSING, "regression_imputation", 2, predictors=["completion_percent"]),
    _S + f"""SELECT respondent_id, {r('income', 2)} AS before, {r('coalesce(income, a + b * completion_percent)', 2)} AS after FROM fx_survey,
  (SELECT regr_slope(income, completion_percent) AS b, regr_intercept(income, completion_percent) AS a FROM fx_survey)""")
add("clean_regression_all", lambda s, sf: apply(survey(s, sf), "household_income", MISSING, "regression_imputation").select("respondent_id", F.col("household_income").alias("before"), "after"))

_KNN = ["age", "family_size", "children", "score_a", "completion_percent"]
_DIST = " + ".join(f"coalesce(power(CAST(q.{x} AS DOUBLE) - d.{x}, 2), 0)" for x in _KNN)
_SHARED = " + ".join(f"(q.{x} IS NOT NULL AND d.{x} IS NOT NULL)::INT" for x in _KNN)
add("clean_knn", cleaned(survey, "respondent_id", "income", MISSING, "knn_imputation", 4, n_neighbors=5, key=["respondent_id"], features=_KNN),
    _S + f""", pairs AS (SELECT q.respondent_id, d.income, row_number() OVER (PARTITION BY q.respondent_id ORDER BY round(({_DIST}) * {len(_KNN) + 1} / ({_SHARED}), 6), d.respondent_id) AS rk
  FROM fx_survey q, fx_survey d WHERE q.income IS NULL AND d.income IS NOT NULL AND {_SHARED} > 0),
f AS (SELECT respondent_id, avg(income) AS v FROM pairs WHERE rk <= 5 GROUP BY respondent_id)
SELECT s.respondent_id, {r('s.income', 4)} AS before, {r('coalesce(s.income, f.v)', 4)} AS after FROM fx_survey s LEFT JOIN f USING (respondent_id)""")
add("clean_listwise", lambda s, sf: rnd(C.drop_incomplete(survey(s, sf)).select("respondent_id", "age", "income", "email", "phone"), 4),
    _S + f"SELECT respondent_id, age, {r('income', 4)} AS income, email, phone FROM fx_survey WHERE age IS NOT NULL AND income IS NOT NULL AND household_income IS NOT NULL AND email IS NOT NULL AND phone IS NOT NULL")

# --- outlier treatment ------------------------------------------------------

_Q = "(SELECT quantile_cont(price_spiky, %s) FROM fx_orders_gaps)"
_LO = f"({_Q % 0.25} - 1.5E0 * ({_Q % 0.75} - {_Q % 0.25}))"
_HI = f"({_Q % 0.75} + 1.5E0 * ({_Q % 0.75} - {_Q % 0.25}))"


def spiky(name, /, **params):
    return cleaned(gaps, "row_id", "price_spiky", OUTLIERS, name, 3, **params)


def clip_sql(lo, hi):
    return gap_sql("price_spiky", f"CASE WHEN price_spiky IS NOT NULL THEN greatest({lo}, least(price_spiky, {hi})) END", 3)


add("treat_iqr_null", spiky("iqr_removal"), gap_sql("price_spiky", f"CASE WHEN price_spiky >= {_LO} AND price_spiky <= {_HI} THEN price_spiky END", 3))
add("treat_zscore_null", spiky("zscore_removal"), gap_sql(
    "price_spiky", "CASE WHEN abs((price_spiky - (SELECT avg(price_spiky) FROM fx_orders_gaps)) / (SELECT stddev_pop(price_spiky) FROM fx_orders_gaps)) <= 3 THEN price_spiky END", 3))
add("treat_winsor", spiky("winsorization", lower_percentile=5, upper_percentile=95), clip_sql(_Q % 0.05, _Q % 0.95))
add("treat_log", cleaned(gaps, "row_id", "signed_qty", OUTLIERS, "log_transformation", 6), gap_sql("signed_qty", "ln(signed_qty + 6.0E0)", 6))
add("treat_log_positive", cleaned(gaps, "row_id", "price", OUTLIERS, "log_transformation", 6), gap_sql("price", "ln(price)", 6))
add("treat_cap_iqr", spiky("cap_outliers"), clip_sql(_LO, _HI))
add("treat_cap_pct", spiky("cap_outliers", method="percentile"), clip_sql(_Q % 0.05, _Q % 0.95))
add("treat_iforest", lambda s, sf: apply(gaps(s, sf), "price_spiky", OUTLIERS, "isolation_forest", key=["row_id"]).select("row_id", F.col("price_spiky").alias("before"), "after"))

# --- data quality -----------------------------------------------------------

_NUMBER = "CASE WHEN regexp_matches({x}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def text_case(column, name, /, **params):
    return cleaned(messy, "row_id", column, QUALITY, name, 4, **params)


def text_sql(x, after):
    return _M + f"SELECT row_id, {x} AS before, {after} AS after FROM fx_messy_text"


add("std_numeric", text_case("amount_raw", "type_standardization", target_type="numeric"), text_sql("amount_raw", _NUMBER.format(x="amount_raw")))
add("std_datetime", text_case("date_raw", "type_standardization", target_type="datetime"), text_sql("date_raw", "CAST(try_strptime(date_raw, '%Y-%m-%d') AS TIMESTAMP)"))
add("std_auto", text_case("amount_raw", "type_standardization"), text_sql(
    "amount_raw", f"CASE WHEN (SELECT count({_NUMBER.format(x='amount_raw')}) * 1.0E0 / count(amount_raw) FROM fx_messy_text) > 0.8 THEN NULL ELSE amount_raw END"))
add("std_dedupe", cleaned(messy, "row_id", "label_raw", QUALITY, "remove_duplicates", order_by=["row_id"]),
    text_sql("label_raw", "CASE WHEN row_number() OVER (PARTITION BY label_raw ORDER BY row_id) = 1 THEN label_raw END"))
add("std_trim", text_case("label_raw", "trim_whitespace"), text_sql("label_raw", "trim(label_raw)"))
add("std_lower", text_case("label_raw", "standardize_case", case_type="lower"), text_sql("label_raw", "lower(label_raw)"))
add("std_upper", text_case("name_raw", "standardize_case", case_type="upper"), text_sql("name_raw", "upper(name_raw)"))
# Three distinct names: their title forms are written out.
add("std_title", text_case("name_raw", "standardize_case", case_type="title"), text_sql(
    "name_raw", "CASE name_raw WHEN 'o''neil mc-x 3rd' THEN 'O''Neil Mc-X 3Rd' WHEN 'café noir' THEN 'Café Noir' ELSE 'Plain Words' END"))

# --- impact -----------------------------------------------------------------


def filled(s, sf):
    df = gaps(s, sf)
    return C.fit_method(df, "price", MISSING, "median_imputation").transform(df, "price_clean")


_F = cte("fx_orders_gaps", f"c AS (SELECT *, coalesce(price, {_MED.format(x='price')}) AS price_clean FROM fx_orders_gaps)")
_W = f"""SELECT *, CASE WHEN price_spiky IS NOT NULL THEN greatest({_Q % 0.05}, least(price_spiky, {_Q % 0.95})) END AS spiky_clean FROM fx_orders_gaps"""


def winsor(s, sf):
    df = gaps(s, sf)
    return C.fit_method(df, "price_spiky", OUTLIERS, "winsorization").transform(df, "spiky_clean")


add("impact_stats", lambda s, sf: rnd(I.impact_stats(winsor(s, sf), "price_spiky", "spiky_clean"), 4, mean_before=2, mean_after=2, std_before=2, std_after=2, median_before=3, median_after=3),
    cte("fx_orders_gaps", f"c AS ({_W})") + f"""SELECT 'price_spiky' AS "column", k AS rows_changed, {r('100.0E0 * k / n', 4)} AS changed_pct, k + nn AS rows_affected_compat, mb AS missing_before, ma AS missing_after,
  ma - mb AS missing_change, {r('ab', 2)} AS mean_before, {r('aa', 2)} AS mean_after, {r('sb', 2)} AS std_before, {r('sa', 2)} AS std_after, {r('db', 3)} AS median_before, {r('da', 3)} AS median_after
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE b IS DISTINCT FROM a) AS k, count(*) FILTER (WHERE b IS NULL AND a IS NULL) AS nn, count(*) - count(b) AS mb, count(*) - count(a) AS ma,
  avg(b) AS ab, avg(a) AS aa, stddev_samp(b) AS sb, stddev_samp(a) AS sa, quantile_cont(b, 0.5) AS db, quantile_cont(a, 0.5) AS da FROM (SELECT price_spiky AS b, spiky_clean AS a FROM c))""")
add("impact_weighted", lambda s, sf: rnd(I.impact_weighted(filled(s, sf), "price", "price_clean", "w"), 2), _F + f"""
SELECT 'price' AS "column", {r('b', 2)} AS weighted_mean_before, {r('a', 2)} AS weighted_mean_after, {r('a - b', 2)} AS weighted_mean_change, {r('wb', 2)} AS total_weight_before, {r('wa', 2)} AS total_weight_after
FROM (SELECT sum(price * w) / sum(w) FILTER (WHERE price IS NOT NULL) AS b, sum(price_clean * w) / sum(w) AS a, sum(w) FILTER (WHERE price IS NOT NULL) AS wb, sum(w) AS wa FROM c)""")
add("impact_changed_rows", lambda s, sf: rnd(I.changed_rows(filled(s, sf), "price", "price_clean", ["row_id"]), 4), _F + f"""
SELECT row_id, price AS before, {r('price_clean', 4)} AS after, greatest(0, (SELECT count(*) FROM c WHERE price IS DISTINCT FROM price_clean) - 20) AS remaining
FROM c WHERE price IS DISTINCT FROM price_clean ORDER BY row_id LIMIT 20""")


def _delta(s, sf):
    df = gaps(s, sf).select("row_id", "price", "priority", "price_spiky", "empty_col")
    after = C.fit_method(df, "price", MISSING, "mean_imputation").transform(df)
    after = C.fit_method(after, "priority", MISSING, "missing_category").transform(after)
    return rnd(I.missing_delta(df, after, ["price", "priority"]), 4)


add("impact_missing_delta", _delta, cte("fx_orders_gaps", "d AS (" + union(
    f"""SELECT '{x}' AS "column", count(*) - count({x}) AS o, {'0' if x in ('price', 'priority') else f'count(*) - count({x})'} AS k FROM fx_orders_gaps"""
    for x in ("row_id", "price", "priority", "price_spiky", "empty_col")) + ")") + f"""
SELECT "column", o AS original_missing, CAST(k AS BIGINT) AS current_missing, k - o AS change, "column" IN ('price', 'priority') AS cleaned,
  CAST(sum(o - k) OVER () AS BIGINT) AS total_reduction, {r('100.0E0 * sum(o - k) OVER () / sum(o) OVER ()', 4)} AS reduction_pct FROM d""")
add("impact_hist", lambda s, sf: rnd(I.impact_histogram(winsor(s, sf), "price_spiky", "spiky_clean"), 2), cte(
    "fx_orders_gaps", f"c AS ({_W})", "l AS (SELECT least(min(price_spiky), min(spiky_clean)) AS lo, (greatest(max(price_spiky), max(spiky_clean)) - least(min(price_spiky), min(spiky_clean))) / 30 AS wd FROM c)",
    """b AS (SELECT least(floor((price_spiky - lo) / wd), 29) AS bin, 1 AS k, 0 AS j FROM c, l WHERE price_spiky IS NOT NULL
  UNION ALL SELECT least(floor((spiky_clean - lo) / wd), 29), 0, 1 FROM c, l WHERE spiky_clean IS NOT NULL)""")
    + f"SELECT CAST(bin AS BIGINT) AS bin, {r('max(lo) + bin * max(wd)', 2)} AS bin_start, CAST(sum(k) AS BIGINT) AS before_count, CAST(sum(j) AS BIGINT) AS after_count FROM b, l GROUP BY bin")


def _categories(s, sf):
    out = apply(messy(s, sf), "label_raw", QUALITY, "trim_whitespace")
    return I.impact_categories(out, "label_raw", "after")


_TOP = "(SELECT {x} AS category, count(*) AS n FROM fx_messy_text WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY n DESC, category LIMIT 10)"
add("impact_categories", _categories, _M + f"""SELECT coalesce(b.category, a.category) AS category, coalesce(b.n, 0) AS before_count, coalesce(a.n, 0) AS after_count
FROM {_TOP.format(x='label_raw')} b FULL JOIN {_TOP.format(x='trim(label_raw)')} a ON a.category = b.category""")
