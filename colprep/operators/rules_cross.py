"""Rules that relate several columns of a row.

Columns are found by name when the plan is built. Every (rule, columns)
combination is one boolean expression; counts of all of them come from a single
aggregate and the affected rows are a filtered projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import DATETIME_TYPES, c, count_if, is_numeric, is_text, literal_rows, num
from colprep.functions.names import matches, tokens
from colprep.functions.quantiles import exact_quantiles
from colprep.functions.text import to_timestamp
from colprep.operators.missing import comissing_pairs, required_pairs
from colprep.operators.rules_single import severity

# Keywords, text patterns and limits of the rules.
BIRTH_WORDS = ("birth_year", "birth")
INCOME_WORDS = ("income", "salary", "wage")
EDUCATION_WORDS = ("education", "degree")
# The patterns are looked for as whole words.
HIGH_EDUCATION = "master|phd|doctorate|graduate"
LOW_EDUCATION = "high school|elementary|primary"
IMPOSSIBLE_EDUCATION = "phd.*high school|doctorate.*elementary"
GENDER_WORDS = ("gender", "sex")
TITLE_WORDS = ("title", "mr", "mrs", "ms")
MALE_VALUES = ("male", "m")
FEMALE_VALUES = ("female", "f")
MALE_TITLES = ("mr",)
FEMALE_TITLES = ("mrs", "ms")
RETIREMENT_WORDS = ("retired", "retirement")
RETIRED_PATTERN = "yes|retired|true"
WORKING_PATTERN = "no|working|false"
EMPLOYMENT_WORDS = ("employ", "job", "work")
NOT_RETIRED = "not retired"
UNEMPLOYED_PATTERN = "unemployed|not working|retired"
FAMILY_WORDS = ("family_size", "household_size")
CHILDREN_WORDS = ("children", "kids", "child")
MARITAL_WORDS = ("marital", "married", "spouse")
MARRIED_PATTERN = "married|spouse"
AGE_TOLERANCE = 2
RETIRED_UNDER = 50
WORKING_OVER = 70
MARRIED_UNDER = 16
TOTAL_TOLERANCE = 0.01


def whole(pattern: str) -> str:
    """The pattern between word boundaries: ``no`` is not found in "unknown"."""
    return rf"\b(?:{pattern})\b"


@dataclass(frozen=True)
class CrossCheck:
    rule: str
    columns: tuple[str, ...]
    condition: Column


class _Binder:
    """Finds columns by name and type and builds the conditions."""

    def __init__(self, df: DataFrame, as_of_year: int, match: str):
        self.df, self.year, self.match = df, as_of_year, match
        self.names = df.columns
        self.numeric = {f.name for f in df.schema.fields if is_numeric(f.dataType)}
        self.text = {f.name for f in df.schema.fields if is_text(f.dataType)}
        self.dated = self.text | {f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)}

    def find(self, words, among=None) -> list[str]:
        return [x for x in self.names if (among is None or x in among) and matches(x, words, self.match)]

    def num(self, name: str) -> Column:
        return num(self.df, name)

    def low(self, name: str) -> Column:
        return F.lower(c(name))

    def date(self, name: str) -> Column:
        return to_timestamp(c(name)) if name in self.text else c(name).cast("timestamp_ntz")

    # -- rules ---------------------------------------------------------------
    def age_birth(self):
        for a, b in product(self.find("age", self.numeric), self.find(BIRTH_WORDS, self.numeric)):
            if a != b:
                yield (a, b), F.abs(self.num(a) - (F.lit(float(self.year)) - self.num(b))) > AGE_TOLERANCE

    def _sequence(self, starts, ends):
        for s, e in product(starts, ends):
            if s != e:
                yield (s, e), self.date(e) < self.date(s)

    def dates(self):
        when = set(self.find(("date", "time"), self.dated))
        return self._sequence([x for x in self.find("start", when)], [x for x in self.find("end", when)])

    def employment_dates(self):
        job = set(self.find("employ", self.dated))
        return self._sequence(self.find(("start", "begin"), job), self.find(("end", "finish"), job))

    def edu_income(self):
        pairs = list(product(self.find(EDUCATION_WORDS, self.text), self.find(INCOME_WORDS, self.numeric)))
        incomes = {i: self.num(i) for _, i in pairs}
        quartiles = exact_quantiles(self.df, incomes, [0.25, 0.75])
        for e, i in pairs:
            q1, q3 = quartiles[i]
            if q1 is not None:
                yield (e, i), (self.low(e).rlike(whole(HIGH_EDUCATION)) & (incomes[i] < F.lit(q1))) | (
                    self.low(e).rlike(whole(LOW_EDUCATION)) & (incomes[i] > F.lit(q3)))

    def gender_title(self):
        for g, t in product(self.find(GENDER_WORDS, self.text), self.find(TITLE_WORDS, self.text)):
            title = F.regexp_replace(F.trim(self.low(t)), r"\.$", "")
            gender = F.trim(self.low(g))
            yield (g, t), (gender.isin(*MALE_VALUES) & title.isin(*FEMALE_TITLES)) | (
                gender.isin(*FEMALE_VALUES) & title.isin(*MALE_TITLES))

    def age_retired(self):
        for a, r in product(self.find("age", self.numeric), self.find(RETIREMENT_WORDS, self.text)):
            yield (a, r), ((self.num(a) < RETIRED_UNDER) & self.low(r).rlike(whole(RETIRED_PATTERN)) & ~self.low(r).rlike(whole(NOT_RETIRED))) | (
                (self.num(a) > WORKING_OVER) & self.low(r).rlike(whole(WORKING_PATTERN)))

    def household_income(self):
        house = set(self.find("household"))
        incomes = self.find("income", self.numeric)
        for i, h in product([x for x in incomes if x not in house], [x for x in incomes if x in house]):
            yield (i, h), self.num(i) > self.num(h)

    def education(self):
        for e in self.find(EDUCATION_WORDS, self.text):
            yield (e,), self.low(e).rlike(whole(IMPOSSIBLE_EDUCATION))

    def total_parts(self):
        for total in self.find("total", self.numeric):
            base = "_".join(t for t in tokens(total) if t not in ("total", "totals"))
            if not base:
                continue
            parts = [x for x in self.find(base, self.numeric) if x != total]
            if len(parts) < 2:
                continue
            spread = self.df.agg(F.stddev_samp(self.num(total))).first()[0]
            tolerance = spread * TOTAL_TOLERANCE if spread and spread > 0 else 1.0
            added = sum((F.coalesce(self.num(x), F.lit(0.0)) for x in parts), F.lit(0.0))
            yield (total, *parts), F.abs(self.num(total) - added) > F.lit(tolerance)

    def income_unemployed(self):
        for i, e in product(self.find(INCOME_WORDS, self.numeric), self.find(EMPLOYMENT_WORDS, self.text)):
            yield (i, e), (self.num(i) > 0) & self.low(e).rlike(whole(UNEMPLOYED_PATTERN)) & ~self.low(e).rlike(whole(NOT_RETIRED))

    def children(self):
        for f, k in product(self.find(FAMILY_WORDS, self.numeric), self.find(CHILDREN_WORDS, self.numeric)):
            yield (k, f), self.num(k) > self.num(f)

    def married_young(self):
        for m, a in product(self.find(MARITAL_WORDS, self.text), self.find("age", self.numeric)):
            yield (m, a), self.low(m).rlike(whole(MARRIED_PATTERN)) & (self.num(a) < MARRIED_UNDER)

    def required_pair(self):
        for a, b in required_pairs(self.names, self.match):
            yield (a, b), c(a).isNotNull() & c(b).isNull()


RULES = (
    "age_birth", "dates", "edu_income", "gender_title", "age_retired", "employment_dates", "household_income",
    "education", "total_parts", "required_pair", "income_unemployed", "children", "married_young",
)


def bind_cross_rules(df: DataFrame, as_of_year: int, match: str = "token", rules: Sequence[str] | None = None) -> list[CrossCheck]:
    unknown = set(rules or ()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rule: {sorted(unknown)}")
    binder = _Binder(df, as_of_year, match)
    return [
        CrossCheck(rule, columns, F.coalesce(condition, F.lit(False)))
        for rule in (rules or RULES)
        for columns, condition in getattr(binder, rule)()
    ]


_SCHEMA = "rule string, columns string, violations long, rows long"


def cross_counts(df: DataFrame, as_of_year: int, match: str = "token", rules: Sequence[str] | None = None, checks: list[CrossCheck] | None = None) -> DataFrame:
    """``(rule, columns, violations, rows)`` in one aggregate."""
    checks = bind_cross_rules(df, as_of_year, match, rules) if checks is None else checks
    if not checks:
        return literal_rows(df.sparkSession, [], _SCHEMA)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[count_if(k.condition).alias(f"v{i}") for i, k in enumerate(checks)])
    entries = F.array(
        *[F.struct(F.lit(k.rule).alias("rule"), F.lit(",".join(k.columns)).alias("columns"), F.col(f"v{i}").alias("violations"))
          for i, k in enumerate(checks)]
    )
    return counts.select("rows", F.inline(entries)).select("rule", "columns", "violations", "rows")


def cross_violations(df: DataFrame, key: Sequence[str], as_of_year: int, match: str = "token", rules: Sequence[str] | None = None) -> DataFrame:
    """Affected rows, one per violated rule."""
    checks = bind_cross_rules(df, as_of_year, match, rules)
    keys = [c(k) for k in key]
    if not checks:
        return df.select(*keys, F.lit("").alias("rule"), F.lit("").alias("columns")).where(F.lit(False))
    entries = [F.when(k.condition, F.struct(F.lit(k.rule).alias("rule"), F.lit(",".join(k.columns)).alias("columns"))) for k in checks]
    return df.select(*keys, F.inline(F.array_compact(F.array(*entries))))


def cross_summary(df: DataFrame, as_of_year: int, match: str = "token") -> DataFrame:
    """Total violations, rules hit, affected rows and severity of the table."""
    checks = bind_cross_rules(df, as_of_year, match)
    flags = [k.condition for k in checks] or [F.lit(False)]
    hit = flags[0]
    for f in flags[1:]:
        hit = hit | f
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), count_if(hit).alias("affected_rows"),
        *[count_if(f).alias(f"v{i}") for i, f in enumerate(flags)],
    )
    values = F.array(*[F.col(f"v{i}") for i in range(len(flags))])
    direct = counts.select(
        "rows", "affected_rows",
        F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v).alias("direct"),
        F.size(F.filter(values, lambda v: v > 0)).cast("long").alias("checks_hit"),
    )
    # one row of totals over column pairs; inlined rather than joined
    pairs = comissing_pairs(df).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("v"), F.count(F.lit(1)).alias("n")).first()
    total = F.col("direct") + F.lit(pairs["v"])
    return direct.select(
        total.cast("long").alias("total_violations"),
        (F.col("checks_hit") + F.lit(pairs["n"])).cast("long").alias("violated_checks"),
        "affected_rows", severity(total, F.col("rows")).alias("severity"),
    )
