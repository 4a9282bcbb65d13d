"""Cleaning recipes: ordered operations on an immutable source table.

A recipe holds no data. Undo and redo move a cursor; the current table is the
source with the active operations replayed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprep.functions.exprs import c, count_if, is_numeric, literal_rows
from colprep.operators.cleaning import METHODS, Fitted, fit_method
from colprep.session import scratch_dir

_BEFORE = "__before"


@dataclass(frozen=True)
class Operation:
    column: str
    method_type: str
    method: str
    parameters: dict = field(default_factory=dict)
    timestamp: str = ""


@dataclass(frozen=True)
class Recipe:
    """Operations, the number of active ones, and chosen semantic types."""

    operations: tuple[Operation, ...] = ()
    cursor: int = 0
    column_types: dict = field(default_factory=dict)

    def append(self, column: str, method_type: str, method: str, parameters: Mapping | None = None, timestamp: str = "") -> Recipe:
        """Add an operation; anything undone before is dropped."""
        if method not in METHODS.get(method_type, {}):
            raise ValueError(f"unknown method: {method_type}/{method}")
        done = self.operations[: self.cursor]
        return replace(self, operations=(*done, Operation(column, method_type, method, dict(parameters or {}), timestamp)), cursor=len(done) + 1)

    @property
    def active(self) -> tuple[Operation, ...]:
        return self.operations[: self.cursor]

    def undo(self) -> Recipe:
        if self.cursor == 0:
            return self
        return replace(self, cursor=self.cursor - 1)

    def redo(self) -> Recipe:
        return replace(self, cursor=min(len(self.operations), self.cursor + 1))

    # -- configuration ---------------------------------------------------------
    def to_json(self) -> str:
        return json.dumps(
            {
                "column_types": self.column_types,
                "cursor": self.cursor,
                "operations": [op.__dict__ for op in self.operations],
            },
            indent=2, sort_keys=True,
        )

    @staticmethod
    def from_json(text: str) -> Recipe:
        data = json.loads(text)
        recipe = Recipe(column_types=dict(data.get("column_types", {})))
        for op in data.get("operations", []):
            recipe = recipe.append(op["column"], op["method_type"], op["method"], op.get("parameters"), op.get("timestamp", ""))
        return replace(recipe, cursor=min(int(data.get("cursor", recipe.cursor)), recipe.cursor))

    # -- execution -------------------------------------------------------------
    def fit(self, df: DataFrame, materialize: bool = False) -> FittedRecipe:
        """Fit each active operation on the table as the previous ones left it.

        ``materialize`` writes the table to shared storage after each step that
        shuffles rows, which keeps long recipes from repeating that work.
        """
        steps, current = [], df
        for op in self.active:
            try:
                fitted = fit_method(current, op.column, op.method_type, op.method, op.parameters)
            except ValueError as error:
                steps.append(Step(op, None, str(error)))
                continue
            current = _advance(current, fitted, materialize)
            steps.append(Step(op, fitted, None))
        return FittedRecipe(tuple(steps))

    def replay(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass(frozen=True)
class Step:
    operation: Operation
    fitted: Fitted | None
    error: str | None


@dataclass(frozen=True)
class FittedRecipe:
    """Fitted steps; a failed step leaves its column unchanged."""

    steps: tuple[Step, ...]

    @property
    def row_wise(self) -> bool:
        return all(s.fitted is None or s.fitted.row_wise for s in self.steps)

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            if s.fitted is not None:
                df = s.fitted.transform(df)
        return df


def _advance(df: DataFrame, fitted: Fitted, materialize: bool) -> DataFrame:
    """The table after one step, written out when the step shuffled its rows."""
    out = fitted.transform(df)
    if not materialize or fitted.row_wise:
        return out
    path = scratch_dir(df.sparkSession, "recipe")
    out.write.parquet(path)
    return df.sparkSession.read.parquet(path)


LOG_SCHEMA = (
    "seq int, ts string, column string, method_type string, method string, parameters map<string,string>, success boolean, "
    "error string, imputed_value string, rows_changed long, missing_before long, missing_after long"
)


def operation_log(df: DataFrame, recipe: Recipe, materialize: bool = False) -> DataFrame:
    """One row per active operation with its effect on the data.

    The log has as many rows as the recipe has steps. ``materialize`` works as
    in :meth:`Recipe.fit`.
    """
    rows, current = [], df
    for seq, step in enumerate(recipe.fit(df, materialize).steps, 1):
        op = step.operation
        params = {k: str(v) for k, v in op.parameters.items()}
        if step.fitted is None:
            rows.append((seq, op.timestamp, op.column, op.method_type, op.method, params, False, step.error, None, 0, None, None))
            continue
        both = step.fitted.transform(current.withColumn(_BEFORE, c(op.column)))
        was, now = F.col(_BEFORE), c(op.column)
        if both.schema[_BEFORE].dataType != both.schema[op.column].dataType:
            kind = "double" if all(is_numeric(both.schema[x].dataType) for x in (_BEFORE, op.column)) else "string"
            was, now = was.cast(kind), now.cast(kind)
        effect = both.agg(
            count_if(~was.eqNullSafe(now)).alias("changed"), count_if(was.isNull()).alias("before"), count_if(now.isNull()).alias("after"),
        ).first()
        value = step.fitted.params.get("imputed_value", step.fitted.params.get("category_name"))
        rows.append((seq, op.timestamp, op.column, op.method_type, op.method, params, True, None,
                     None if value is None else str(value), effect["changed"], effect["before"], effect["after"]))
        current = _advance(current, step.fitted, materialize)
    return literal_rows(df.sparkSession, rows, LOG_SCHEMA)


# --- audit views of the log -------------------------------------------------

def audit_trail(log: DataFrame, newest: int | None = None) -> DataFrame:
    """Chronological, or the newest entries first when limited."""
    cols = ["seq", "ts", "column", "method_type", "method", "success", "rows_changed", "missing_before", "missing_after"]
    out = log.select(*cols)
    if newest is None:
        return out.orderBy("ts", "seq")
    return out.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(newest)


def audit_by_column(log: DataFrame) -> DataFrame:
    return log.groupBy("column").agg(
        F.count(F.lit(1)).alias("operations"), F.max_by("method", "seq").alias("last_method"), F.max_by("ts", "seq").alias("last_applied"),
        F.sum("rows_changed").alias("rows_changed"),
    )


def audit_methods(log: DataFrame) -> DataFrame:
    return log.groupBy("method_type", "method").agg(
        F.count(F.lit(1)).alias("operations"), F.countDistinct("column").alias("columns"), F.sum("rows_changed").alias("rows_changed"),
    )


def audit_imputed(log: DataFrame) -> DataFrame:
    """Values put in place of missing ones."""
    return log.where("method_type = 'missing_values' AND success").select(
        "seq", "column", "method", F.coalesce("imputed_value", F.lit("per row")).alias("imputed_value"),
        (F.col("missing_before") - F.col("missing_after")).alias("rows_imputed"), "missing_after",
    )
