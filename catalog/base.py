"""Fixture tables and helpers shared by the query catalog.

Fixtures are SQL over the given tables; the same text runs on Spark and as a
CTE of the oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprep.session import configure
from colprep.sources.files import read_table

YEAR = 2026  # the year in which ages are judged

FIXTURES = {
    "fx_survey": """
SELECT c_custkey AS respondent_id,
  CASE WHEN c_custkey % 17 = 5 THEN NULL ELSE CAST(c_custkey % 131 - 4 AS BIGINT) END AS age,
  CAST(2026 - (c_custkey % 131 - 4) + CASE WHEN c_custkey % 13 = 0 THEN 5 ELSE 0 END AS BIGINT) AS birth_year,
  CASE WHEN c_custkey % 9 IN (2,3) THEN NULL ELSE c_acctbal END AS income,
  CASE WHEN c_custkey % 9 IN (2,3) THEN NULL ELSE c_acctbal + CAST((c_custkey % 7 - 1) * 100 AS DOUBLE) END AS household_income,
  CASE c_custkey % 6 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN 'M' WHEN 3 THEN 'F' WHEN 4 THEN 'other' ELSE 'n/a' END AS gender,
  CASE c_custkey % 4 WHEN 0 THEN 'Mr' WHEN 1 THEN 'Mrs' WHEN 2 THEN 'Ms' ELSE 'Dr' END AS title,
  CASE WHEN c_custkey % 10 = 0 THEN 'bad-address' WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('u', CAST(c_custkey AS STRING), '@example.org') END AS email,
  CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN '0123' ELSE concat('+4930', CAST(1000000 + c_custkey AS STRING)) END AS phone,
  CASE WHEN c_custkey % 12 = 0 THEN '#!' ELSE CAST(10000 + c_custkey AS STRING) END AS zip,
  CASE c_custkey % 5 WHEN 0 THEN 'Master' WHEN 1 THEN 'High School' WHEN 2 THEN 'PhD' WHEN 3 THEN 'Primary' ELSE 'Bachelor' END AS education,
  CASE c_custkey % 3 WHEN 0 THEN 'Employed' WHEN 1 THEN 'Unemployed' ELSE 'Retired' END AS employment,
  CASE WHEN c_custkey % 2 = 0 THEN 'Married' ELSE 'Single' END AS marital,
  CASE WHEN c_custkey % 3 = 2 THEN 'yes' ELSE 'no' END AS retired,
  CAST(1 + c_custkey % 5 AS BIGINT) AS family_size,
  CAST(c_custkey % 7 AS BIGINT) AS children,
  concat('2020-', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '-15') AS start_date,
  CASE WHEN c_custkey % 19 = 0 THEN 'unknown' ELSE concat('2020-', lpad(CAST(1 + (c_custkey * 5) % 12 AS STRING), 2, '0'), '-15') END AS end_date,
  CAST(c_custkey % 21 AS DOUBLE) AS score_a, CAST(c_custkey % 34 - 1 AS DOUBLE) AS score_b,
  CAST(c_custkey % 21 + c_custkey % 34 - 1 + CASE WHEN c_custkey % 29 = 0 THEN 9 ELSE 0 END AS DOUBLE) AS total_score,
  CAST(c_custkey % 113 AS DOUBLE) - 2.0E0 AS completion_percent,
  CASE c_custkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' ELSE 'maybe' END AS consent_flag,
  0.5E0 + CAST(c_custkey % 40 AS DOUBLE) / 10.0E0 AS design_weight,
  c_mktsegment AS segment
FROM customer""",
    "fx_orders_gaps": """
SELECT o_orderkey AS row_id, o_orderdate,
  CASE WHEN o_orderkey % 11 IN (3,4) OR o_orderkey < 3 OR o_orderkey BETWEEN 500 AND 520 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS price_spiky,
  CASE WHEN o_orderkey % 40 = 0 THEN -5.0E0 ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS signed_qty,
  CAST(7 AS BIGINT) AS constant_col, CAST(NULL AS DOUBLE) AS empty_col,
  0.5E0 + CAST(o_orderkey % 25 AS DOUBLE) / 5.0E0 AS w
FROM orders""",
    "fx_messy_text": """
SELECT event_id AS row_id,
  CASE event_id % 5 WHEN 0 THEN concat('  ', event_type) WHEN 1 THEN concat(event_type, ' ') WHEN 2 THEN upper(event_type) WHEN 3 THEN NULL ELSE event_type END AS label_raw,
  CASE event_id % 9 WHEN 0 THEN 'n/a' WHEN 1 THEN ' 12 ' WHEN 2 THEN '1e3' WHEN 3 THEN '1d' WHEN 4 THEN '-4.5' ELSE CAST(event_id AS STRING) END AS amount_raw,
  CASE event_id % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-28' WHEN 2 THEN 'soon' ELSE NULL END AS date_raw,
  CASE event_id % 3 WHEN 0 THEN 'o''neil mc-x 3rd' WHEN 1 THEN 'café noir' ELSE 'plain words' END AS name_raw,
  value
FROM events""",
}

ORDER_KEYS = {"fx_survey": ["respondent_id"], "fx_orders_gaps": ["row_id"], "fx_messy_text": ["row_id"]}
# lineitem has no unique key; these columns together order its rows.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or a fixture over one."""
    configure(spark)
    if name not in FIXTURES:
        return read_table(spark, f"{sf}/{name}.parquet")
    text = re.sub(r"FROM (\w+)$", lambda m: f"FROM parquet.`{sf}/{m.group(1)}.parquet`", FIXTURES[name])
    return spark.sql(text)


def survey(spark, sf):
    return table(spark, sf, "fx_survey")


def gaps(spark, sf):
    return table(spark, sf, "fx_orders_gaps")


def messy(spark, sf):
    return table(spark, sf, "fx_messy_text")


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


def cte(name: str, *more: str) -> str:
    """``WITH`` clause holding a fixture and further named queries."""
    parts = [f"{name} AS ({FIXTURES[name]})"] if name in FIXTURES else []
    parts += list(more)
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def rnd(df: DataFrame, dp: int = 6, **special: int) -> DataFrame:
    """Round every double; adding zero folds -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), special.get(f.name, dp)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def r(expr: str, dp: int = 6) -> str:
    """The same rounding in oracle SQL."""
    return f"(round({expr}, {dp}) + 0.0)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def columns_of(name: str) -> dict[str, str]:
    """Column -> Spark type of the tables used in generated oracle SQL."""
    return SCHEMAS[name]


_SURVEY_TEXT = ["gender", "title", "email", "phone", "zip", "education", "employment", "marital", "retired", "start_date", "end_date", "consent_flag", "segment"]
_SURVEY_ORDER = [
    "respondent_id", "age", "birth_year", "income", "household_income", "gender", "title", "email", "phone", "zip", "education",
    "employment", "marital", "retired", "family_size", "children", "start_date", "end_date", "score_a", "score_b", "total_score",
    "completion_percent", "consent_flag", "design_weight", "segment",
]
_SURVEY_INT = ["respondent_id", "age", "birth_year", "family_size", "children"]
SCHEMAS = {
    "fx_survey": {x: "string" if x in _SURVEY_TEXT else "bigint" if x in _SURVEY_INT else "double" for x in _SURVEY_ORDER},
    "fx_orders_gaps": {
        "row_id": "bigint", "o_orderdate": "timestamp_ntz", "price": "double", "priority": "string", "price_spiky": "double",
        "signed_qty": "double", "constant_col": "bigint", "empty_col": "double", "w": "double",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
}


def numeric_of(name: str) -> list[str]:
    return [x for x, t in SCHEMAS[name].items() if t in ("bigint", "int", "double")]


def text_of(name: str) -> list[str]:
    return [x for x, t in SCHEMAS[name].items() if t == "string"]
