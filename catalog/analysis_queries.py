"""Complete analyses, composed from the oracle pieces of the single operators."""

from __future__ import annotations

from catalog.base import LINEITEM_ORDER, SCHEMAS, YEAR, cte, lineitem, numeric_of, r, rnd, survey, union
from catalog.profile_queries import _ENTROPY, _KURT, _SKEW, _SHAPE, _basic, _moments, _vf
from catalog.quality_queries import _ADVICE, _by_column, joined, metrics_sql, rule_total
from catalog.recipes import SURVEY_RECIPE
from colprep.operators.quality import column_metrics
from colprep.plans.analyze import analyze_all
from colprep.plans.recipe import operation_log
from colprep.plans.report import detailed

QUERIES, ORACLE = {}, {}


def analysis_ctes(name: str, order: str, rules: dict[str, str] | None = None) -> list[str]:
    """Named queries: b basics, s shapes, f frequencies, m metrics, a advice, c correlations."""
    columns, numbers = SCHEMAS[name], numeric_of(name)
    basic = union(_basic(name, x, t) for x, t in columns.items())
    shapes = union(_moments(name, x, f"{r(_SKEW, 4)} AS skewness, {r(_KURT, 4)} AS kurtosis, {_SHAPE} AS shape") for x in numbers)
    freq = union(f"""SELECT '{x}' AS "column", {r(f'coalesce({_ENTROPY}, 0)', 4)} AS entropy, CAST(max(v) FILTER (WHERE rk = 1) AS VARCHAR) AS mode_value
FROM (SELECT v, n, sum(n) OVER () AS t, row_number() OVER (ORDER BY n DESC, v) AS rk FROM ({_vf(name, f'CAST({x} AS DOUBLE)' if columns[x] == 'double' else x)}))""" for x in columns)
    advice = union(f"""SELECT "column", '{k}' AS method, {w} AS weight, {ap} AS applicability, {i} AS pos FROM m WHERE {cond}""" for i, (_, k, _, w, ap, cond) in enumerate(_ADVICE))
    pairs = union(f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {name}" for i, a in enumerate(numbers) for b in numbers[i + 1:])
    types = union(f"""SELECT '{x}' AS "column", '{t}' AS dtype""" for x, t in columns.items())
    return [
        f"b AS ({basic})", f"s AS ({shapes})", f"f AS ({freq})", f"m AS ({metrics_sql(name, order, rules)})", f"t AS ({types})", f"adv AS ({advice})",
        """a AS (SELECT "column", string_agg(method, ',' ORDER BY weight DESC, applicability DESC, pos) AS recommended FROM adv GROUP BY "column")""",
        f"p AS ({pairs})",
        f"""c AS (SELECT "column", string_agg(b, ',' ORDER BY rk) AS correlated_with FROM (SELECT a AS "column", b, row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) AS rk
  FROM (SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p) WHERE abs(r) > 0.1) WHERE rk <= 5 GROUP BY "column")""",
    ]


_SELECT = """
SELECT b."column", t.dtype, b.count, b.missing, b.missing_pct, b.unique_count, b.unique_pct, b.mean, b.std, b.min, b.q25, b.median, b.q75, b.max, s.skewness, s.kurtosis,
  coalesce(s.shape, 'categorical') AS shape, f.entropy, f.mode_value, m.pattern, m.max_run, m.c1 AS iqr_count, m.c2 AS zscore_count, m.c3 AS modified_zscore_count,
  m.severity AS outlier_severity, m.score, m.grade, m.violations,
  CASE WHEN m.violations > b.count * 0.1E0 THEN 'high' WHEN m.violations > b.count * 0.05E0 THEN 'moderate' ELSE 'low' END AS violation_severity,
  coalesce(c.correlated_with, '') AS correlated_with, coalesce(a.recommended, '') AS recommended
FROM b JOIN t USING ("column") JOIN m USING ("column") JOIN f USING ("column") LEFT JOIN s USING ("column") LEFT JOIN c USING ("column") LEFT JOIN a USING ("column")"""
_RULES = {x: f"(SELECT v_{x} FROM rv)" for x in _by_column()}
_RV = "rv AS (SELECT count(*) AS n, " + ", ".join(f"{rule_total(x)} AS v_{x}" for x in _by_column()) + " FROM fx_survey)"


def _shown(df):
    return rnd(joined(df, "correlated_with", "recommended"), 4)


QUERIES["analyze_all"] = lambda s, sf: _shown(analyze_all(lineitem(s, sf), LINEITEM_ORDER, YEAR))
ORACLE["analyze_all"] = cte("lineitem", *analysis_ctes("lineitem", ", ".join(LINEITEM_ORDER))) + _SELECT
QUERIES["analyze_survey"] = lambda s, sf: _shown(analyze_all(survey(s, sf), ["respondent_id"], YEAR))
ORACLE["analyze_survey"] = cte("fx_survey", _RV, *analysis_ctes("fx_survey", "respondent_id", _RULES)) + _SELECT


def _detailed(s, sf):
    df = survey(s, sf)
    return rnd(detailed(column_metrics(df, ["respondent_id"], YEAR), operation_log(df, SURVEY_RECIPE)), 4)


_APPLIED = union(f"""SELECT {i} AS seq, '{op.column}' AS "column", '{op.method}' AS method""" for i, op in enumerate(SURVEY_RECIPE.operations))
QUERIES["report_detailed"] = _detailed
ORACLE["report_detailed"] = cte("fx_survey", _RV, *analysis_ctes("fx_survey", "respondent_id", _RULES), f"o AS ({_APPLIED})") + """
SELECT b."column", t.dtype, b.count AS rows, b.missing, b.missing_pct, b.unique_count, m.pattern, coalesce(s.shape, 'categorical') AS shape, m.severity AS outlier_severity, m.v1 AS flagged_rows,
  m.score, m.grade, m.violations, (SELECT count(*) FROM o WHERE o."column" = b."column") AS cleaning_operations, (SELECT string_agg(method, ' > ' ORDER BY seq) FROM o WHERE o."column" = b."column") AS methods
FROM b JOIN t USING ("column") JOIN m USING ("column") LEFT JOIN s USING ("column")"""
